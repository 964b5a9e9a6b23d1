"""Streams over several files, in no order of time, against batch results."""

from __future__ import annotations

import compare
import pytest
from pyspark.sql import functions as F

from loamline import plans
from loamline.streaming import polls

START = 1_704_067_200


@pytest.fixture()
def events(spark, tmp_path):
    """A table in 12 files (two batches of a stream), the later times first."""
    rows = [(i, START + (i * 7919) % 3000 * 60, i % 7, f"k{i % 2}", float(i % 97)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double")
    df = df.select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", "event_type", "value")
    df.repartitionByRange(12, F.desc("ts")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_sessions_are_whole_and_lie_in_files(spark, events):
    got = plans.queries()["streaming_sessions"](spark, events)
    assert got.inputFiles()  # a memory sink's rows lie on the driver
    batch = spark.read.parquet(f"{events}/events.parquet").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    want = batch.select("w.start", "w.end", "user_id", "n").collect()
    assert sorted(map(tuple, got.select("start", "stop", "user_id", "n").collect())) == sorted(map(tuple, want))
    assert sum(r["n"] for r in want) == 3000


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(f"{tmp_path}/in")
    assert polls.run_available(stream, str(tmp_path / "out")).count() == 0


def test_running_means_follow_time_not_arrival(spark, events):
    """12 files in two batches, the later times first."""
    sql = plans.oracle_sql()["streaming_running_means"]
    assert compare.difference(plans.queries()["streaming_running_means"](spark, events), compare.connect(events), sql) == ""


def test_running_means_of_large_kinds_and_odd_values(spark, tmp_path):
    """More rows of a kind than an Arrow batch or the state holds, a null late in one kind, rows without kind, time or id."""
    value = F.when((F.col("id") == 31_007) | (F.col("id") == 39_000), None).otherwise(F.col("id") * 7919 % 1009 / 3.0)
    kind = F.when(F.col("id") % 4 < 2, "a").when(F.col("id") % 4 == 2, "b").when(F.col("id") % 40 == 7, None).otherwise("c")
    at = F.when(F.col("id") != 20, F.timestamp_seconds(F.lit(START) + F.col("id") * 104_729 % 50_021))
    rows = spark.range(40_000).select(F.when(F.col("id") != 21, F.col("id")).alias("event_id"), at.alias("ts"), kind.alias("event_type"), value.alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sql = plans.oracle_sql()["streaming_running_means"]
    assert compare.difference(plans.queries()["streaming_running_means"](spark, str(tmp_path)), compare.connect(str(tmp_path)), sql) == ""
