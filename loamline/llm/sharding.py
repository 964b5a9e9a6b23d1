"""Sharding by rendezvous hashing.

Each record key draws one exponential waiting time per shard, from a hash of
key and shard and divided by the shard's weight; the record goes to the shard
with the least. A shard that is added or taken away moves only the records
that it wins or held. The choice needs no shuffle and no shared state.

``slots`` numbers the records of each shard from 0 without gaps: records are
dealt over many ranges of each shard, numbered there, and shifted by the sizes
of the ranges before.

Defined results: a null key is a key of its own (all rows with it share a
shard); rows that repeat a key share its shard and get slots of their own; a
null text has size 8 and checksum 0; of equal waiting times the lower shard
wins; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Hash values are 60 bits wide.
WIDTH = float(2**60)


def _wait(key: Column, shard: int, weight: float) -> Column:
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{shard}"))), 1, 15), 16, 10).cast("long")
    return -F.log((draw.cast("double") + 0.5) / F.lit(WIDTH)) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (its index in ``weights``) of a record key; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    draws = [F.struct(_wait(text, i, w).alias("wait"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def slots(df: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """Add ``slot``: the place of a row in its shard by ``order``, gapless from 0.

    Rows equal in ``order`` are interchangeable. The ranges grow with the
    shuffle partitions, so that no task holds a shard.
    """
    ranges = df.repartitionByRange(4 * partitions(df.sparkSession), shard, *order)
    rows = cut(ranges.withColumn("__range", F.spark_partition_id()))
    sizes = rows.groupBy(shard, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(shard, "__range").orderBy(*order))
    return rows.withColumn("__place", place).join(starts, [shard, "__range"]).withColumn(
        "slot", F.col("__start") + F.col("__place") - 1
    ).drop("__range", "__start", "__place")


def shard_documents(df: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, under the law ``key``."""
    text = F.coalesce("text", F.lit(""))
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * shards).alias("shard"),
        rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return slots(rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
