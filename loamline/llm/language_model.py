"""Stupid-backoff scores of documents, by n-gram count tables that are partitioned by hash.

Documents are dealt into batches of bounded size. Each batch asks for the
counts of its distinct n-grams (words and pairs of words); the requests go to
the partition of the count table that their hash names, where the counts of
all batches are added up, and the answers return to the batch, are joined to
its n-grams and summed per document. An n-gram is asked for once by a batch
however often it occurs, so common ones are no burden to any partition.

A document is scored by what the other documents hold: its own n-grams are
subtracted from the counts. With c the counts that are left, a word w after v
has the logarithm of c(vw) / c(v) where c(vw) > 0, else of ``BACKOFF`` * c(w) /
N; a word that no other document has counts as one occurrence. The first word
of a document has c(w) / N. N is the number of words elsewhere, at least 1.

Counts are kept by 48 bits of a 64-bit hash within a partition that the upper bits name.

Defined results: A-Z count as a-z; a null, empty or blank text has no words and
score 0; copies count as other documents; rows that repeat a doc_id are
documents of their own; a null doc_id is returned as null; other columns are
ignored; the order of rows does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

BACKOFF = 0.4
#: Bytes of text in a batch, and at most so many partitions of the count table.
BATCH_BYTES, TABLES = 6_000_000, 16_384


def _ngrams(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, pair hashes, first word of every row and the end, row of every pair) of a batch's texts."""
    hashed, firsts = [], [np.zeros(1, np.int64)]
    for chunk in table["text"].chunks:
        for at, to in vectors.slices(chunk):
            h, f = vectors.words(chunk.slice(at, to - at))
            hashed.append(h)
            firsts.append(f[1:] + firsts[-1][-1])
    h = np.concatenate(hashed) if hashed else np.empty(0, np.uint64)
    f = np.concatenate(firsts)
    inner = np.ones(max(len(h) - 1, 0), dtype=bool)
    edges = f[1:-1]
    inner[edges[(edges > 0) & (edges < len(h))] - 1] = False
    second = np.flatnonzero(inner) + 1
    pairs = vectors.mix(h[second - 1] * vectors._PLACE[0] + h[second] * vectors._PLACE[1])
    return h, pairs, f, second


def _tables(keys: np.ndarray, n: int) -> np.ndarray:
    """The partition of each key, in the order of the keys."""
    return ((keys >> np.uint64(48)).astype(np.int64) * n) >> 16


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _request(n: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        words, pairs, _, _ = _ngrams(table)
        keys, counts = np.unique(np.concatenate([words, pairs]), return_counts=True)
        cuts = np.searchsorted(_tables(keys, n), np.arange(n + 1))
        used = np.flatnonzero(np.diff(cuts))
        batch = table["batch"][0].as_py()
        return pa.table(
            {
                "part": pa.array(used, pa.int64()),
                "batch": pa.array([batch] * len(used), pa.int64()),
                "keys": pa.array([_pack(keys[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
                "counts": pa.array([counts[cuts[i] : cuts[i + 1]].astype(np.uint32).tobytes() for i in used], pa.binary()),
                "words": pa.array([len(words)] * len(used), pa.int64()),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The summed counts of the keys of one partition, for each batch that asked."""
    keys = [_unpack(k.as_py()) for k in table["keys"]]
    counts = np.concatenate([np.frombuffer(c.as_py(), np.uint32) for c in table["counts"]])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, counts).astype(np.int64)[at]
    cuts = np.cumsum([0, *map(len, keys)])
    answers = [totals[a:b].astype(np.uint64 if totals[a:b].max(initial=0) >= 2**32 else np.uint32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table(
        {
            "batch": table["batch"], "part": table["part"],
            "totals": pa.array([a.tobytes() for a in answers], pa.binary()),
            "wide": pa.array([a.itemsize for a in answers], pa.int64()),
        }
    )


def _own(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How often the n-gram of each place occurs in the row of that place."""
    _, back, many = np.unique(rows * n + at, return_inverse=True, return_counts=True)
    return many[back]


def _scorer(total: int, backoff: float) -> Callable:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        words, pairs, firsts, second = _ngrams(table)
        n_words = np.diff(firsts)
        keys = np.unique(np.concatenate([words, pairs]))
        parts = np.argsort(answers["part"].to_numpy())
        raw = [(answers["totals"][int(i)].as_py(), answers["wide"][int(i)].as_py()) for i in parts]
        counts = np.concatenate([np.frombuffer(t, np.uint64 if w == 8 else np.uint32).astype(np.int64) for t, w in raw] or [np.empty(0, np.int64)])
        row = np.repeat(np.arange(len(n_words)), n_words)
        word_at, pair_at = np.searchsorted(keys, words), np.searchsorted(keys, pairs)
        c_word = counts[word_at] - _own(row, word_at, len(keys))
        c_pair = counts[pair_at] - _own(row[second], pair_at, len(keys))
        elsewhere = np.maximum(total - n_words, 1)[row]
        score = np.log(np.maximum(c_word, 1) / elsewhere)
        seen = c_pair > 0
        score[second] += np.log(backoff)
        score[second[seen]] = np.log(c_pair[seen] / c_word[second[seen] - 1])
        sums = np.bincount(row, score, len(n_words)) if len(row) else np.zeros(len(n_words))
        return pa.table(
            {
                "doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()),
                "n_seen": pa.array(np.bincount(row[second[seen]], minlength=len(n_words)), pa.int64()),
                "log_score": pa.array(sums, pa.float64()),
            }
        )

    return run


def score(df: DataFrame, backoff: float = BACKOFF, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_seen (words whose pair with the one before is known elsewhere), log_score of every row."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("w")).first()
    batches = max(1, -(-int(sizes["b"] or 0) // batch_bytes))
    parts = min(TABLES, batches)
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    requests = dealt.groupBy("batch").applyInArrow(_request(parts), "part long, batch long, keys binary, counts binary, words long")
    answers = requests.select("part", "batch", "keys", "counts").groupBy("part").applyInArrow(
        _answer, "batch long, part long, totals binary, wide long"
    )
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _scorer(int(sizes["w"] or 0), backoff), "doc_id long, n_words long, n_seen long, log_score double"
    )
