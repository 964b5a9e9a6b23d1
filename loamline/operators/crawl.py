"""Crawl plans: scores and order of links, budgets, reach, and the rounds of a best-first crawl over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.urls import locale_of, part, without_locale

# Words of paths that lead to content, and away from it.
CONTENT = "doc docs guide tutorial api reference article blog post learn manual help spec".split()
JUNK = "login signin sign-in signup sign-up register submit cart checkout account admin logout auth password settings preferences".split()


def link_score(url: Column, label: Column, focus: list[str]) -> Column:
    """Twice the share of focus words in the label and once that in the path, half a point per kind of content word
    that the path has and one off per kind of junk word."""
    path = F.translate(F.lower(part(url, 3)), "/-_", "   ")
    words = F.array_distinct(F.split(path, r"\s+"))
    share = lambda c: sum((c.contains(f).cast("int") for f in focus), F.lit(0)) / F.lit(max(1, len(focus)))
    of = lambda kinds: F.size(F.array_intersect(words, F.array(*map(F.lit, kinds))))
    return 2.0 * share(F.lower(F.coalesce(label, F.lit("")))) + share(path) + 0.5 * of(CONTENT) - of(JUNK)


def map_order(rows: DataFrame, score: Column) -> DataFrame:
    """Add ``place`` within site: by score, then freshness, then order; the fourth and later locales of a page go last."""
    path = part(F.col("url"), 3)
    rows = rows.withColumns({"score": score, "folded": without_locale(path), "locale": locale_of(path)})
    nth = F.row_number().over(Window.partitionBy("site", "folded").orderBy(F.col("score").desc(), F.col("lastmod").desc_nulls_last(), "pos"))
    rows = rows.withColumn("late", (F.col("locale") != "") & (nth > 3))
    order = Window.partitionBy("site").orderBy("late", F.col("score").desc(), F.col("lastmod").desc_nulls_last(), "pos")
    return rows.withColumn("place", F.row_number().over(order)).drop("folded", "locale", "late")


def within_budget(rows: DataFrame, cost: Column, budget: int) -> DataFrame:
    """The first rows of each site, by place, whose serialised sizes add up to the budget at most."""
    rows = rows.withColumn("cost", cost)
    upto = Window.partitionBy("site").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("spent", F.sum("cost").over(upto)).where(F.col("spent") <= budget)


def crawl_rounds(links: DataFrame, seeds: DataFrame, width: int, rounds: int, cut=lambda df: df) -> DataFrame:
    """node, round: best-first rounds of ``width`` pages per site over (site, source, target, score) links.

    ``cut`` writes a small table and returns it, to end the growth of the plan.
    """
    known = cut(seeds.select("site", F.col("node"), F.lit(0).alias("round")))
    for k in range(1, rounds + 1):
        latest = known.where(F.col("round") > 0) if k > 1 else known
        ahead = links.join(latest.select("site", F.col("node").alias("source")), ["site", "source"])
        ahead = ahead.groupBy("site", F.col("target").alias("node")).agg(F.max("score").alias("score"))
        ahead = ahead.join(known.select("site", "node"), ["site", "node"], "left_anti")
        best = F.row_number().over(Window.partitionBy("site").orderBy(F.col("score").desc(), "node"))
        new = ahead.withColumn("n", best).where(F.col("n") <= width).select("site", "node", F.lit(k).alias("round"))
        known = cut(known.unionByName(new))
    return known
