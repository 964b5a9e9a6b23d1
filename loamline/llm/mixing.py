"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source has a target of words. The words of a source, laid end to end in
a seeded order of its documents within shards of the source, are cut into
blocks of ``block_words``. The blocks of the whole mix are apportioned to
sources by the highest quotients target / (2k + 1), and a source's blocks to
its shards by the highest quotients of the shards' blocks, which gives each
shard an integer quota. Within a shard the quota is met by whole rounds over
all blocks and by the blocks that come first in a seeded order.

No quotient list of the length of the mix is made: with n parties the seats of
a party with share p of N seats lie between (N - n/2)p - 1/2 and (N + n/2)p +
1/2, and caps move n seats at most, so all but about 6n quotients of an
apportionment are settled without ranking.

Defined results: a null text has no words; a document without words is taken
0 times; the null source is a source of its own, last in order; a repeated
doc_id is a row like any other; no document is taken more than ``most`` times
its words; with no words at all every target is 0. The result depends on the
seed and the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_small, source_name, word_count

WEIGHTS = [3.0, 1.0, 2.0]
BLOCK_WORDS = 32
#: A source gets a shard for so many words, and so many shards at most.
SHARD_WORDS, SHARDS = 50_000, 4096
#: A prime above the blocks of any shard.
STEP = 1_000_000_007


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Add ``target`` to a table of sources (skey, source_size): the level to which all fill up by weight.

    The weights repeat in source order. A source stops at ``most`` times its
    size and the excess is shared again; the level of the sources that don't
    stop is found by one pass in the order in which they would stop.
    """
    by_name = Window.orderBy(F.col("skey").startswith("n"), F.col("skey"))
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weigh).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    stop = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    upto, everything = stop.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    rows = rows.withColumns(
        {
            "left": F.sum("source_size").over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    # the first source, in order of stopping, that does not stop sets the level
    # (past it the levels only fall, so it has the highest)
    lowest = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(everything)
    return rows.withColumn("final", lowest).select(
        "skey", "source_size",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"),
    )


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, cap: str) -> DataFrame:
    """Add ``won``: the seats of each party of a group by the highest quotients votes / (2k + 1).

    ``seats`` is the same number in all rows of a group; no party gets more
    than its ``cap``; ties go to the lower key. Parties without votes get none.
    """
    whole = Window.partitionBy(*group)
    n, total = F.count("*").over(whole), F.sum(votes).over(whole)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    rows = parties.withColumns({"__n": n, "__p": share}).withColumns(
        {
            "__low": F.least(
                F.col(cap),
                F.greatest(F.lit(0), F.floor((F.col(seats) - F.col("__n") * 2) * F.col("__p") - 1)).cast("long"),
            ),
            "__high": F.ceil((F.col(seats) + F.col("__n") * 2) * F.col("__p") + 1).cast("long"),
        }
    )
    rows = rows.withColumn("__high", F.greatest("__low", F.least(F.col(cap), F.col("__high"))))
    tried = rows.where(f"__high > __low and {votes} > 0").select(
        *group, key, "__low", votes, seats, F.explode(F.expr("sequence(__low, __high - 1)")).alias("__k")
    )
    best = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("__k") + 1)).desc(), key, "__k")
    settled = rows.groupBy(*group).agg(F.sum("__low").alias("__settled"))
    won = (
        tried.join(settled, group)
        .withColumn("__rank", F.row_number().over(best))
        .where(F.col("__rank") <= F.col(seats) - F.col("__settled"))
        .groupBy(*group, key)
        .agg(F.count("*").alias("__more"))
    )
    return (
        rows.join(won, [*group, key], "left")
        .withColumn("won", F.col("__low") + F.coalesce("__more", F.lit(0)))
        .drop("__n", "__p", "__low", "__high", "__more")
    )


def _taken(
    df: DataFrame,
    weights: list[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block_words: int = BLOCK_WORDS,
    seed: int = 17,
    **more: Column,
) -> DataFrame:
    """The columns of ``mix`` and skey, shard and ``more`` columns, which settle ties in the order of documents."""
    rows = cut(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            source_name(F.col("source").cast("string")).alias("skey"), word_count(F.col("text")).alias("size"),
            *[c.alias(k) for k, c in more.items()],
        )
    )
    sources = targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = cut(sources.withColumn("n_shards", F.least(F.lit(SHARDS), F.floor(F.col("source_size") / SHARD_WORDS) + 1).cast("int")))
    dealt = join_small(rows, sources, ["skey"]).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_shards")).cast("int")
    )
    cells = dealt.groupBy("skey", "shard").agg(
        F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size")
    ).withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    cells = cut(cells)
    of_source = cells.groupBy("skey").agg(F.first("target").alias("target"), F.sum("blocks").alias("n_blocks"))
    of_source = of_source.withColumns(
        {
            "all": F.lit(1),
            "cap": F.col("n_blocks") * most,
            "seats": F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block_words).cast("long"),
        }
    )
    quota = sainte_lague(of_source, ["all"], "skey", "target", "seats", "cap").select("skey", F.col("won").alias("seats"))
    shares = cells.join(quota, "skey").withColumns({"cap": F.col("blocks") * most})
    shares = cut(
        sainte_lague(shares, ["skey"], "shard", "blocks", "seats", "cap").select(
            "skey", "shard", "blocks", F.col("won").alias("quota")
        )
    )
    cell = Window.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "doc_id", "size", *more)
    laid = dealt.withColumn("end", F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0)))
    out = laid.join(shares, ["skey", "shard"], "left")
    # a seeded permutation of the shard's blocks (a prime step cannot divide their number):
    # the blocks that it puts into the first quota % blocks places are taken once more
    start = F.pmod(F.xxhash64(F.lit(seed), "skey", "shard"), F.col("blocks"))
    rest = F.col("quota") % F.col("blocks")
    again = lambda b: F.pmod(b * F.lit(STEP) + start, F.col("blocks")) < rest
    first, last = F.floor((F.col("end") - F.col("size")) / block_words), F.floor((F.col("end") - 1) / block_words)
    extra = F.aggregate(
        F.filter(F.sequence(first, last), again),
        F.lit(0).cast("long"),
        lambda s, b: s
        + F.least(F.col("end"), (b + 1) * block_words)
        - F.greatest(F.col("end") - F.col("size"), b * block_words),
    )
    taken = F.floor(F.col("quota") / F.col("blocks")) * F.col("size") + F.when(rest > 0, extra).otherwise(0)
    return out.select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"), "skey", "shard", *more,
    )


def mix(df: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted) of every row."""
    return _taken(df, **parameters).select("doc_id", "source", "size", "source_size", "target", "taken")


def _more_copies(open_: DataFrame) -> DataFrame:
    """skey, shard, words, more: how many documents of so many words get a copy for the words that their whole copies leave.

    In each source the lengths are gone through from the longest, and what a
    length leaves or overdraws is carried to the next, so that a source ends
    within half of its shortest such document of the words it takes, unless
    all or none of its documents have got their copy by then. There are no more lengths
    than about the root of twice the words of a source. The copies of a length
    are dealt to shards by their documents of it.
    """
    cells = cut(open_.groupBy("skey", "words", "shard").agg(F.count("*").alias("m"), F.sum("rest").alias("rest")))
    lengths = cells.groupBy("skey", "words").agg(F.sum("m").alias("all"), F.sum("rest").alias("rest"))
    falling = F.sort_array(F.collect_list(F.struct("words", "all", "rest")), asc=False)

    def step(state: Column, x: Column) -> Column:
        due = state["carry"] + x["rest"]
        k = F.least(x["all"], F.greatest(F.lit(0), F.floor(due / x["words"] + 0.5))).cast("long")
        return F.struct((due - k * x["words"]).alias("carry"), F.array_append(state["ks"], k).alias("ks"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("ks"))
    settled = (
        lengths.groupBy("skey").agg(falling.alias("of"))
        .select("skey", F.explode(F.arrays_zip("of", F.aggregate("of", start, step)["ks"].alias("k"))).alias("x"))
        .select("skey", "x.of.words", "x.of.all", "x.k")
    )
    upto = Window.partitionBy("skey", "words").orderBy("shard")
    dealt = cells.join(settled, ["skey", "words"]).withColumn("upto", F.sum("m").over(upto))
    return dealt.select("skey", "shard", "words", F.expr("k * upto div all - k * (upto - m) div all").alias("more"))


def mixed_documents(df: DataFrame, seed: int = 17, **parameters) -> DataFrame:
    """The rows of ``df``, each as many times as the mix takes its words, in whole texts.

    A document has as many copies as its words are taken in full; for the words
    left over some documents get one more, so that the words of every source
    add up. Rows of one doc_id, source and text are one document.
    """
    mark = F.xxhash64(F.col("text"))
    rows = _taken(df, seed=seed, mark=mark, **parameters).where("taken > 0")
    units = rows.groupBy("skey", "shard", "doc_id", "source", "size", "mark").agg(
        (F.count("*") * F.col("size")).alias("words"), F.sum("taken").alias("taken")
    )
    units = cut(units.withColumns({"base": F.expr("taken div words"), "rest": F.expr("taken % words")}))
    more = _more_copies(units.where("rest > 0"))
    # of documents of one length and shard, those come first of which the mix takes most
    first = Window.partitionBy("skey", "shard", "words").orderBy(
        F.desc("rest"), F.xxhash64(F.lit(seed + 2), "doc_id", "mark"), "doc_id", "mark"
    )
    ranked = units.join(more, ["skey", "shard", "words"], "left").withColumn("place", F.row_number().over(first))
    one_more = F.when((F.col("rest") > 0) & (F.col("place") <= F.col("more")), 1).otherwise(0)
    copies = ranked.select(
        F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("mark").alias("__m"),
        (F.col("base") + one_more).cast("int").alias("__copies"),
    ).where("__copies > 0")
    rows = df.withColumns(
        {
            "__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__size": word_count(F.col("text")),
            "__mark": mark,
        }
    )
    on = (
        F.col("__id").eqNullSafe(F.col("__d")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
        & (F.col("__mark") == F.col("__m"))
    )
    kept = rows.join(copies, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return kept.select(*df.columns)
