"""State that builds up over a sequence of outcomes, as windows and folds over batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ewma(values: Column, alpha: float = 0.3) -> Column:
    """Running mean of an array of values in order, seeded by the first; a null first value starts it at 0."""
    return F.aggregate(
        values, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean")),
        lambda s, v: F.struct(
            (s["n"] + 1).alias("n"),
            F.when(v.isNull(), s["mean"]).when(s["n"] == 0, v).otherwise(s["mean"] * (1 - alpha) + v * alpha).alias("mean"),
        ),
        lambda s: s["mean"],
    )


def streaks(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Add ``streak``: how many rows in a row the flag holds, up to this one."""
    own = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("__f", flag).withColumn("__run", F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(own))
    place = F.sum(F.when(F.col("__f"), 1).otherwise(0)).over(Window.partitionBy(key, "__run").orderBy(*order))
    return rows.withColumn("streak", F.when(F.col("__f"), place).otherwise(0)).drop("__f", "__run")


def circuit(rows: DataFrame, key: str, order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """Add ``opens``: the row is the limit-th failure in a row (and each further multiple), which starts a cooldown."""
    return streaks(rows, key, order, failed).withColumn("opens", (F.col("streak") > 0) & (F.col("streak") % limit == 0))


def cooling(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Add ``cooling``: an earlier row of the key opened the circuit less than ``seconds`` ago."""
    before = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("opens"), F.col(at))).over(before)
    return rows.withColumn("cooling", F.coalesce(F.col(at) - last < seconds, F.lit(False)))


def yield_verdict(status: Column, nodes: Column, usable: Column, n: Column, mean: Column, drift: Column, raw: Column) -> Column:
    """Health of a source of rows from one round and what is known of it: nothing found is told from a broken reader."""
    return (
        F.when(status == "preempted", "not_asked").when(status.isin("blocked", "circuit_open"), "blocked").when(status == "timeout", "timeout")
        .when(status.rlike("^(error|init_error|no_key)"), "unreachable").when(nodes < 0, "not_instrumented")
        .when((nodes > 0) & (usable == 0), F.when(raw > 0, "filtered_out").when(drift >= 3, "parser_drift").otherwise("parser_suspect"))
        .when((nodes == 0) & (usable == 0), F.when((n >= 5) & (mean >= 1.0), "upstream_empty").otherwise("unknown_empty")).otherwise("healthy")
    )


def watch_verdicts(rows: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """Add ``verdict``: baseline for the first look at a key, then changed or unchanged; error where there is no content."""
    own = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("__c", content)
    last = F.last("__c", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    verdict = F.when(F.col("__c").isNull(), "error").when(last.isNull(), "baseline").when(F.col("__c") == last, "unchanged").otherwise("changed")
    return rows.withColumn("verdict", verdict).drop("__c")


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def upsert(table: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key of a table and new rows."""
    both = table.unionByName(rows)
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc()))).where("__n = 1").drop("__n")


def nth_smallest(table: DataFrame, at: str, rank: int, few: int = 100_000):
    """The exact value at a rank (from 1) of a column's values in order, nulls last; None where a null stands there.

    Approximate percentiles only propose borders; rows are counted against them, and what
    lies between is narrowed until it is few rows or does not shrink, then counted by value.
    """
    left, before = table.select(at).where(F.col(at).isNotNull()), 0
    n = left.count()
    while n > few and rank <= before + n:
        share = (rank - before) / n
        p = left.agg(F.percentile_approx(at, [max(share - 3e-4, 0.0), min(share + 3e-4, 1.0)], 10_000).alias("p")).first()["p"]
        c = [F.col(at) < p[0], F.col(at) <= p[0], F.col(at) < p[1], F.col(at) <= p[1]]
        below = left.agg(*[F.count_if(x).alias(f"c{k}") for k, x in enumerate(c)]).first()
        place, size = rank - before, n
        for k, v in ((0, p[0]), (2, p[1])):
            if below[k] < place <= below[k + 1]:
                return v
        if place <= below[0]:
            left, n = left.where(c[0]), below[0]
        elif place <= below[2]:
            left, n, before = left.where(~c[1] & c[2]), below[2] - below[1], before + below[1]
        else:
            left, n, before = left.where(~c[3]), n - below[3], before + below[3]
        if n == size:  # whole numbers beyond 2^53 that percentiles do not tell apart
            break
    if rank > before + n:
        return None
    upto = F.sum("count").over(Window.orderBy(at))
    return left.groupBy(at).count().withColumn("upto", upto + before).where(F.col("upto") >= rank).agg(F.min(at)).first()[0]


def evict(table: DataFrame, at: str, cap: int) -> DataFrame:
    """Over the cap, only the newest nine tenths of it stay; rows of the border's time go, nulls count as newest and go too.

    The border is found by its exact rank, not by numbering all rows in one task.
    """
    n = table.count()
    if n <= cap:
        return table
    border = nth_smallest(table, at, n - cap * 9 // 10)
    # a rank among the nulls: nothing is newer
    return table.where(F.col(at) > border) if border is not None else table.where(F.lit(False))


def alive(at: Column, ttl: Column, asked: int, now: Column) -> Column:
    """Not older than its own and the asked time to live."""
    return at + F.least(ttl, F.lit(asked)) > now


def last_good(rows: DataFrame, key: str, at: str, what: str, good: Column, seconds: int) -> DataFrame:
    """The last good value of each key and whether it is still remembered at the latest time of all."""
    now = rows.agg(F.max(at)).first()[0]
    out = rows.where(good).groupBy(key).agg(F.max_by(what, at).alias(what), F.max(at).alias(at))
    return out.withColumn("remembered", F.col(at) + seconds > now)
