"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of ``block_chars`` characters. The blocks
of all documents are sorted (by fingerprint, and by content where fingerprints
meet) and get integer names; then the names of adjacent blocks are paired, the
pairs sorted and named again, level by level, until each document is left with
one name. Two documents have the same name on the same level exactly when
their texts are equal.

Only fingerprints travel between tasks in the naming; one pass over the block
contents, folded to distinct blocks before its shuffle, finds contents that
share a fingerprint. Those are told apart by their rank.

Defined results: a null text counts as empty, and all empty texts are one
group; a null doc_id is kept and loses every tie; rows that repeat doc_id and
text count as members of their group, and as they can't be told apart each of
them is marked like the one that stays (``dedup`` leaves one of them); other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, sorted_names

BLOCK_CHARS = 4096
DOC = ["doc_id", "text_sha256"]


def _normalised(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_points"),
        F.regexp_replace(text, SPACE, "").alias("plain"),
    )


def _blocks(df: DataFrame, block_chars: int) -> DataFrame:
    """doc_id, n_points, text_sha256, blocks; an empty text is one empty block."""
    last = F.floor((F.greatest(F.length("plain"), F.lit(1)) - 1) / block_chars).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(F.col("plain"), i * block_chars + 1, F.lit(block_chars))
    )
    return _normalised(df).select(
        "doc_id",
        "n_points",
        F.sha2("plain", 256).alias("text_sha256"),
        F.when(F.length("plain") <= block_chars, F.array("plain")).otherwise(pieces).alias("blocks"),
    )


def _level_zero(df: DataFrame, block_chars: int, fingerprint) -> DataFrame:
    """One row per document with its parts, each a fingerprint and a rank among contents that share it."""
    blocks = _blocks(df, block_chars)
    contents = (
        blocks.select(F.explode("blocks").alias("content"))
        .select(fingerprint(F.col("content")).alias("a"), "content")
        .distinct()
    )
    met = cut(contents.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    if met.isEmpty():
        part = lambda b: F.struct(fingerprint(b).alias("a"), F.lit(0).cast("long").alias("b"))
        return blocks.select(*DOC, "n_points", F.transform("blocks", part).alias("parts"))
    ranks = (
        contents.join(met, "a", "left_semi")
        .withColumn("b", (F.row_number().over(Window.partitionBy("a").orderBy("content")) - 1).cast("long"))
        .select("content", "b")
    )
    one = F.struct("pos", fingerprint(F.col("content")).alias("a"), F.coalesce("b", F.lit(0)).cast("long").alias("b"))
    return (
        blocks.select(*DOC, "n_points", F.posexplode("blocks").alias("pos", "content"))
        .join(ranks, "content", "left")
        .groupBy(*DOC, "n_points")
        .agg(F.array_sort(F.collect_set(one)).alias("parts"), F.count_if(F.col("pos") == 0).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))  # rows that repeat a document
        .select(*DOC, "n_points", "parts")
    )


def name_documents(
    df: DataFrame, block_chars: int = BLOCK_CHARS, fingerprint=F.xxhash64
) -> tuple[DataFrame, DataFrame]:
    """(a row per document: doc_id, text_sha256, n_points; names: doc_id, text_sha256, name)."""
    zero = cut(_level_zero(df, block_chars, fingerprint))
    parts = zero.select(*DOC, F.posexplode("parts").alias("pos", "part")).select(
        *DOC, F.col("pos").cast("long").alias("pos"), "part.a", "part.b"
    )
    done, level = [], 0
    while True:
        # rows that repeat a document fold here
        parts = parts.groupBy(*DOC, "pos").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        if level:
            parts = cut(parts)
            if parts.isEmpty():
                break
        names = cut(sorted_names(parts, ["a", "b"]))
        named = cut(parts.join(names, ["a", "b"]).select(*DOC, "pos", "name"))
        top = named.groupBy(*DOC).agg(F.max("pos").alias("last"), F.max("name").alias("name"))
        # a level of its own keeps the names of documents of different depth apart
        done.append(top.where("last = 0").select(*DOC, (F.col("name") * 64 + level).alias("name")))
        longer = top.where("last > 0").select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("t"))
        parts = (
            named.join(longer, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("t")), "left_semi")
            .withColumn("half", F.floor(F.col("pos") / 2))
            .groupBy(*DOC, F.col("half").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        level += 1
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    return zero.select(*DOC, "n_points"), names


def exact_groups(df: DataFrame, block_chars: int = BLOCK_CHARS, fingerprint=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points for every row of ``df``.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    documents, names = name_documents(df, block_chars, fingerprint)
    names = names.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("t"), "name")
    rows = cut(
        documents.join(names, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("t")))
        .select(*DOC, "n_points", "name")
    )
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    keep = rows.groupBy("name").agg(best.alias("best"), F.count("*").alias("group_size"))
    # keyed by the negated name, both sides are dealt out anew and a large group can be split
    keep = keep.select(
        (-F.col("name")).alias("key"), F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.less")).alias("most"), "group_size",
    )
    return rows.withColumn("key", -F.col("name")).join(keep, "key").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most"))).alias("kept"),
        "text_sha256", "n_points",
    )


def dedup(df: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    kept = cut(
        exact_groups(df, block_chars).where("kept").groupBy(*DOC, "n_points").agg(F.count("*").alias("n_rows"))
    )
    keys = kept.select(
        F.col("doc_id").alias("__d"), F.col("text_sha256").alias("__t"), F.col("n_points").alias("__n")
    )
    plain = F.coalesce(F.col("text"), F.lit(""))
    rows = df.withColumns(
        {"__sha": F.sha2(F.regexp_replace(plain, SPACE, ""), 256), "__points": F.length(plain).cast("long"),
         "__id": F.col("doc_id").cast("long")}
    )
    same = F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__sha") == F.col("__t")) & (F.col("__points") == F.col("__n"))
    out = rows.join(keys, same, "left_semi")
    if not kept.where("n_rows > 1").isEmpty():
        out = out.dropDuplicates(["__id", "__sha", "__points"])
    return out.drop("__sha", "__points", "__id")
