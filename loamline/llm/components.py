"""Connected components of a link table, by contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of the component of every node in ``links`` (a, b).

    In each round every node moves to the lowest of itself and its neighbours, in an
    order by hashes that changes from round to round, and once more to where that one
    moves; links between what is left are made distinct, so a round leaves a
    fraction of them. Each round is written to the shared folder. Joins are keyed by
    negated nodes, so that both sides are dealt out and the rows of a much-linked node
    can be split.

    Defined results: a link of a node with itself, or with a null end, is no link;
    repeated links count once; without links there are no rows.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c, salt=len(steps): F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("x"))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.select("a", order("b").alias("low")).groupBy("a").agg(F.min("low").alias("low"))
        up = stored(low.select(F.col("a").alias("node"), F.least("low", order("a"))["x"].alias("to")))
        far = up.select((-F.col("node")).alias("key"), F.col("to").alias("far"))
        step = stored(up.withColumn("key", -F.col("to")).join(far, "key").select("node", F.col("far").alias("to")))
        moved = step.select((-F.col("node")).alias("key"), "to")
        edges = edges.withColumn("key", -F.col("a")).join(moved, "key").select((-F.col("b")).alias("key"), F.col("to").alias("x"))
        edges = edges.join(moved, "key").where("x <> to").select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b"))
        edges = stored(edges.distinct())
        steps.append(step)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    ends = steps[0]
    for step in steps[1:]:
        last = step.select((-F.col("node")).alias("key"), F.col("to").alias("last"))
        ends = stored(ends.withColumn("key", -F.col("to")).join(last, "key", "left").select("node", F.coalesce("last", "to").alias("to")))
    least = ends.groupBy("to").agg(F.min("node").alias("label")).select((-F.col("to")).alias("key"), "label")
    return ends.withColumn("key", -F.col("to")).join(least, "key").select("node", "label")
