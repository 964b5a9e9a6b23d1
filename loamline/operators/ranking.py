"""Scoring and ordering of rows of result lists.

A result row has query_id, position and what an operator names; ties always
fall back to the original position, so that orders are total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_query(*order) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def bm25(tokens: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score: (doc_id, token) rows against distinct (query_id, term) rows.

    Only the terms' own postings are joined; N and the mean length are two numbers.
    """
    size = tokens.groupBy("doc_id").agg(F.count("*").alias("dl"))
    n, mean = size.agg(F.count("*"), F.avg("dl")).first()
    wanted = queries.select(F.col("term").alias("token")).distinct()
    tf = tokens.join(wanted, "token", "left_semi").groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weigh = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (mean or 1.0)))
    scored = tf.join(df, "token").join(size, "doc_id").select("doc_id", F.col("token").alias("term"), weigh.alias("w"))
    return scored.join(queries.distinct(), "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def block_scores(blocks: DataFrame, terms: Column, tokens: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Add ``score``: BM25 of every block within its document, half as much again under each matching heading.

    ``blocks`` has doc_id, block_id, kind, level, block; ``tokens`` is an array per block.
    """
    doc = Window.partitionBy("doc_id")
    rows = blocks.withColumns({"toks": tokens}).withColumn("dl", F.size("toks"))
    rows = rows.withColumns({"n": F.count("*").over(doc), "mean": F.avg("dl").over(doc), "hits": F.filter("toks", lambda t: F.array_contains(terms, t))})
    hits = rows.select("doc_id", "block_id", "n", "mean", "dl", F.explode("hits").alias("t")).groupBy("doc_id", "block_id", "n", "mean", "dl", "t").agg(F.count("*").alias("tf"))
    hits = hits.withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "t")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    w = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))))
    base = hits.groupBy("doc_id", "block_id").agg(F.sum(w).alias("base"))
    # a heading holds until the next one of its level or a higher one
    following = Window.partitionBy("doc_id").orderBy("block_id").rowsBetween(1, Window.unboundedFollowing)
    heads = rows.where((F.col("kind") == "heading")).withColumn("later", F.collect_list(F.struct("block_id", "level")).over(following))
    stop = F.array_min(F.transform(F.filter("later", lambda h: h["level"] <= F.col("level")), lambda h: h["block_id"]))
    heads = heads.where(F.size("hits") > 0).select("doc_id", F.col("block_id").alias("start"), F.coalesce(stop, F.lit(2**31 - 1)).alias("stop"))
    under = rows.select("doc_id", "block_id").join(heads, "doc_id").where((F.col("block_id") >= F.col("start")) & (F.col("block_id") < F.col("stop")))
    boosts = under.groupBy("doc_id", "block_id").agg(F.count("*").alias("boosts"))
    out = rows.select("doc_id", "block_id", "kind", "level", "block").join(base, ["doc_id", "block_id"], "left").join(boosts, ["doc_id", "block_id"], "left")
    return out.withColumn("score", F.coalesce("base", F.lit(0.0)) * F.pow(F.lit(1.5), F.coalesce("boosts", F.lit(0)))).drop("base", "boosts")


def focus(scored: DataFrame, threshold: float = 0.1, relative: float = 0.33, fallback: int = 5) -> DataFrame:
    """The blocks of each document that a focused read keeps, with ``why``.

    Kept are blocks at the relative cut below the best block that is no
    heading, and the heading before them; without any, the closest five.
    """
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("block_id")
    cutoff = F.greatest(F.lit(threshold), F.max(F.when(F.col("kind") != "heading", F.col("score"))).over(doc) * relative)
    rows = scored.withColumn("hit", F.coalesce(F.col("score") >= cutoff, F.lit(False)))
    rows = rows.withColumns(
        {"any": F.max("hit").over(doc), "place": F.row_number().over(doc.orderBy(F.col("score").desc(), "block_id")), "next": F.lead("hit").over(order)}
    )
    why = (
        F.when(F.col("hit"), "score").when((F.col("kind") == "heading") & F.col("next"), "heading")
        .when(~F.col("any") & (F.col("place") <= fallback), "closest")
    )
    return rows.withColumn("why", why).where("why is not null").drop("hit", "any", "place", "next")


def interleave(rows: DataFrame, lane: str) -> DataFrame:
    """Add ``place``: one row of each lane in turn, lanes in the order of their first rows."""
    own = Window.partitionBy("query_id", lane)
    rows = rows.withColumns({"turn": F.row_number().over(own.orderBy("position")), "first": F.min("position").over(own)})
    return rows.withColumn("place", F.row_number().over(by_query("turn", "first"))).drop("turn", "first")


def diversify(rows: DataFrame, domain: str, most: int = 2) -> DataFrame:
    """Add ``place``: rows past the first ``most`` of a domain move to the end, in their order."""
    nth = F.row_number().over(Window.partitionBy("query_id", domain).orderBy("position"))
    return rows.withColumn("late", nth > most).withColumn("place", F.row_number().over(by_query("late", "position"))).drop("late")


def boosted(rows: DataFrame, terms: Column, model: str = "raw") -> DataFrame:
    """Add ``bucket``, ``boosted``, ``place``: consensus and query terms in title and address add to the score.

    Without any model score in a query, rows with two terms or more come first, then those with one.
    """
    low = lambda c: F.lower(F.col(c))
    n = F.size(terms)
    hits = lambda text: F.size(F.filter(terms, lambda t: text.contains(t)))
    share = lambda text, w: F.when(n > 0, hits(text) / n * w).otherwise(0.0)
    scored = F.max(F.col(model).isNotNull()).over(Window.partitionBy("query_id"))
    seen = hits(F.concat_ws(" ", low("title"), low("snippet"), low("url")))
    rows = rows.withColumns(
        {
            "total": F.col("score") + 0.2 * (F.greatest(F.col("consensus"), F.lit(1)) - 1) + share(low("title"), 0.10) + share(low("path"), 0.08),
            "bucket": F.when(scored | (n == 0), 0).when(seen >= 2, 0).when(seen == 1, 1).otherwise(2),
        }
    )
    top = F.max("total").over(Window.partitionBy("query_id"))
    order = by_query("bucket", F.col("total").desc(), F.col("consensus").desc(), "position")
    return rows.withColumns(
        {"place": F.row_number().over(order), "boosted": F.round(F.when(top > 1.0, F.col("total") / top).otherwise(F.col("total")), 4)}
    ).drop("total")


def tier(score: Column, rank: Column, total: Column, raw: Column) -> Column:
    """high, med or low: by the model's own score, or without one by place, which can't give high."""
    by_model = F.when(raw >= 0.5, "high").when(raw >= 0.05, "med").otherwise("low")
    by_place = F.when((score >= 0.15) | (rank <= F.greatest(F.lit(2), F.floor(total / 3))), "med").otherwise("low")
    return F.when(raw.isNotNull(), by_model).otherwise(by_place)


def drop_low(rows: DataFrame, least: int = 3) -> DataFrame:
    """Rows of tier low go, unless a query would keep fewer than ``least``; places are numbered anew."""
    query = Window.partitionBy("query_id")
    good = F.count_if(F.col("tier") != "low").over(query)
    rows = rows.withColumn("drop", (F.count("*").over(query) > least) & (good >= least)).where("not (drop and tier = 'low')").drop("drop")
    return rows.withColumn("place", F.row_number().over(by_query("position")))


def drop_strangers(rows: DataFrame, terms: Column, high: float = 0.5) -> DataFrame:
    """A query's whole list goes when no row has any of its terms and none a high model score."""
    text = F.lower(F.concat_ws(" ", "title", "snippet", "url"))
    keep = F.exists(terms, lambda t: text.contains(t)) | (F.coalesce("raw", F.lit(0.0)) >= high) | (F.size(terms) == 0)
    return rows.withColumn("keep", F.max(keep).over(Window.partitionBy("query_id"))).where("keep").drop("keep")


def gate(rows: DataFrame, least: int) -> DataFrame:
    """Rows that ``least`` families agree on; not applied where a query's rows come from one family."""
    most = F.max("consensus").over(Window.partitionBy("query_id"))
    return rows.withColumn("most", most).where((F.col("most") <= 1) | (F.col("consensus") >= least)).drop("most")


def newest_first(rows: DataFrame) -> DataFrame:
    """Add ``place``: rows dated to the day first, newest first; the rest in their order."""
    dated = (F.col("precision") == "day") & F.col("published").isNotNull()
    return rows.withColumn("d", F.when(dated, F.col("published"))).withColumn("place", F.row_number().over(by_query(F.col("d").desc_nulls_last(), "position"))).drop("d")


def normalised(rows: DataFrame, score: str = "score", floor: float = 0.0) -> DataFrame:
    """Add ``unit`` (score from 0 to 1 within the query) and ``place``; rows below the floor go."""
    query = Window.partitionBy("query_id")
    low, top = F.min(score).over(query), F.max(score).over(query)
    rows = rows.withColumn("unit", F.when(top > low, (F.col(score) - low) / (top - low)).otherwise(1.0)).where(F.col("unit") >= floor)
    return rows.withColumn("place", F.row_number().over(by_query(F.col(score).desc(), "position")))


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """query_id, p5, p10, mrr, ndcg of rows (query_id, place, rel), unjudged as 0."""
    rel = F.coalesce("rel", F.lit(0)).cast("double")
    gain = lambda r: rel / F.log2(r + 1)
    ideal = F.row_number().over(by_query(rel.desc(), "place"))
    rows = rows.withColumns({"best": rel / F.log2(ideal + 1)})
    at = lambda k: F.sum(F.when(F.col("place") <= k, rel).otherwise(0.0)) / k
    out = rows.groupBy("query_id").agg(
        at(5).alias("p5"), at(10).alias("p10"), F.coalesce(1.0 / F.min(F.when(rel > 0, F.col("place"))), F.lit(0.0)).alias("mrr"),
        F.sum(gain(F.col("place"))).alias("dcg"), F.sum("best").alias("idcg"),
    )
    return out.select("query_id", "p5", "p10", "mrr", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))
