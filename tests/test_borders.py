"""Exact borders of evicted tables and exact ties of printed sizes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamline.functions import phrases
from loamline.operators import state


@pytest.mark.parametrize("rank", [1, 2, 1500, 2999, 3000, 3001])
@pytest.mark.parametrize("value", ["id", "id % 3", "id % 50 * 1000", "cast(id as double) / 7", "id + 9007199254740993", "timestamp_micros(id * 997 % 3000)"])
def test_rank_is_exact(spark, value, rank):
    df = spark.range(3000).select(F.expr(value).alias("v"))
    have = sorted(r["v"] for r in df.collect())
    assert state.nth_smallest(df, "v", rank, few=10) == (have[rank - 1] if rank <= len(have) else None)


def test_eviction_keeps_exactly_nine_tenths(spark):
    """An approximate percentile is off by whole rows on a table of more rows than its accuracy."""
    rows = spark.range(6_000_000).select(F.col("id").alias("t"))
    assert state.evict(rows, "t", 3_000_000).agg(F.count("*"), F.min("t")).first()[:] == (2_700_000, 3_300_000)


def test_eviction_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,), (3,), (4,), (5,), (6,), (7,), (8,), (9,)], "t int")
    assert sorted(r["t"] for r in state.evict(rows, "t", 5).collect()) == [7, 8, 9]
    assert state.evict(spark.createDataFrame([(None,), (None,)], "t int"), "t", 1).count() == 0


def test_sizes_are_printed_as_c_does(spark, duck):
    """All lengths to 3 MB by steps that meet every tie of KB, and null."""
    rows = spark.range(-1, 3 * 2**14).select(F.expr("if(id < 0, null, id * 64)").alias("n"))
    got = rows.select("n", phrases.human_size(F.col("n")).alias("s")).toArrow()
    duck.register("sizes", got)
    size = "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END"
    assert duck.execute(f"SELECT n, s, {size} FROM sizes WHERE s IS DISTINCT FROM {size}").fetchall() == []
    assert got.num_rows == 3 * 2**14 + 1
