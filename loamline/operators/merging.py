"""Merging result lists of several backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_rows(rows: DataFrame, key: Column, family: Column) -> DataFrame:
    """One row per query and address key: the first seen, its backends, and how many index families agree."""
    return (
        rows.withColumns({"key": key, "family": family}).groupBy("query_id", "key")
        .agg(
            F.min("position").alias("position"), F.min_by("url", "position").alias("url"), F.min_by("title", "position").alias("title"),
            F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"), F.countDistinct("family").cast("int").alias("consensus"),
        )
    )


def merge_verticals(web: DataFrame, hits: DataFrame) -> DataFrame:
    """Full outer merge on query and key: the web row wins, backends unite, the first date stands."""
    w, h = web.alias("w"), hits.alias("h")
    joined = w.join(h, (F.col("w.query_id") == F.col("h.query_id")) & (F.col("w.key") == F.col("h.key")), "full_outer")
    pick = lambda c: F.coalesce(f"w.{c}", f"h.{c}").alias(c)
    return joined.select(
        pick("query_id"), pick("key"), pick("url"), F.array_join(F.array_sort(F.array_compact(F.array("w.backend", "h.backend"))), ",").alias("backends"),
        F.greatest("w.consensus", "h.consensus").alias("consensus"), F.coalesce("w.published", "h.published").alias("published"),
        F.col("w.key").isNull().alias("vertical"),
    )


def first_of_title(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each title key within a query; rows without a key all stay."""
    nth = F.row_number().over(Window.partitionBy("query_id", key).orderBy("position"))
    return rows.withColumn("nth", nth).where((F.col(key) == "") | (F.col("nth") == 1)).drop("nth")


def newest_variant(rows: DataFrame, key: str, when: str) -> DataFrame:
    """The newest row of each key, how many there are, and the place of the first."""
    own = Window.partitionBy(key)
    rows = rows.withColumns(
        {"nth": F.row_number().over(own.orderBy(F.col(when).desc(), F.col("position").desc())), "variants": F.count("*").over(own), "first": F.min("position").over(own)}
    )
    return rows.where("nth = 1").drop("nth")


def best_distinct(rows: DataFrame, side: str, value: str, score: str, n: int) -> DataFrame:
    """side, value, place: the ``n`` distinct values of each side with the best scores; ties to the lesser value."""
    best = rows.where(F.col(value).isNotNull()).groupBy(side, value).agg(F.max(score).alias("__score"))
    place = F.row_number().over(Window.partitionBy(side).orderBy(F.col("__score").desc(), value))
    return best.withColumn("place", place).where(F.col("place") <= n).select(side, value, "place")


def capped(rows: DataFrame, source: str, order: list, date: str, n: int) -> DataFrame:
    """The first ``n`` rows of each source (0 for all) with ``total`` and ``undated``, counts of all that it has."""
    counts = rows.groupBy(source).agg(F.count("*").alias("total"), F.count_if(F.col(date).isNull()).alias("undated"))
    place = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    first = rows.withColumn("__place", place).where((F.col("__place") <= n) | F.lit(n == 0)).drop("__place")
    return first.join(counts, source)
