"""Exact top-k search by multi-resolution segment statistics.

Vectors are turned into an orthogonal basis of the candidates, in which the first
coordinates differ most and inner products stay the same, and cut into segments there.
A segment's mean and deviation bound what it can add to an inner product
(Cauchy-Schwarz: the product of the means times the length plus the product of
the deviations), and so bound the distance from below; a segment of one coordinate is
exact. From coarse to fine, a growing head of the vector falls into segments of
one coordinate each and its rest is one long segment. The best by half of the coordinates
give a first k-th best score for each query; a candidate whose bound at any level
is less is out, and only the survivors' scores are computed exactly, in integers.

Queries and candidates are packed into blocks, every block of queries meets
every block of candidates in a unit of its own, and the k best of each unit
meet per query.

Defined results: a vector that is null, empty or holds null or non-finite
components takes no part, nor does a row without id; vectors of different
length do not meet; rows that have a query's id are the query's own; with fewer than k
candidates all are returned; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

QUERIES, CANDIDATES = 1024, 4096
#: Shares of the coordinates that are segments of their own at each level.
LEVELS = (0.0, 0.25, 0.5, 0.75, 0.875)


def _valid(df: DataFrame, scale: float) -> DataFrame:
    v = F.col("embedding")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where(usable & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("vector"),
    )


def _packer(most: int) -> Callable:
    """Rows of blocks of up to ``most`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(d: int) -> pa.RecordBatch:
            ids, vectors = held.pop(d)
            m = np.concatenate(vectors)
            m = m.astype(np.int16) if np.abs(m).max() < 2**15 else m
            row = [[d], [m.itemsize], [np.concatenate(ids).tobytes()], [m.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["d", "wide", "ids", "vectors"])

        for b in batches:
            sizes = b["vector"].value_lengths().to_numpy()
            ids = b["vec_id"].to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                flat = b["vector"].take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                for i in range(0, len(at), most):
                    pair = held.setdefault(int(d), ([], []))
                    pair[0].append(ids[at[i : i + most]])
                    pair[1].append(flat[i : i + most])
                    if sum(map(len, pair[0])) >= most:
                        yield block(int(d))
        for d in list(held):
            yield block(d)

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int16 if row["wide"] == 2 else np.int64
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], kind).reshape(-1, row["d"])


def _basis(c: np.ndarray) -> np.ndarray:
    """An orthogonal basis (columns) in which the coordinates of ``c`` are sorted by their size."""
    return np.linalg.eigh(c.T @ c)[1][:, ::-1]


def _rest(x: np.ndarray, head: int) -> np.ndarray:
    """Scaled mean and deviation of the segment after the first ``head`` coordinates: their inner products are its bounds."""
    mean = x[:, head:].mean(axis=1)
    apart = x[:, head:] - mean[:, None]
    return np.stack([mean * np.sqrt(x.shape[1] - head), np.sqrt(np.square(apart).sum(axis=1))], axis=1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integers."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    return np.einsum("ij,ij->i", q.astype(np.float64), c.astype(np.float64)).astype(np.int64) if top < 2**53 else (
        np.einsum("ij,ij->i", q.astype(np.int64), c.astype(np.int64)) if top < 2**63
        else np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)], dtype=object)
    )


def _row_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of one integer vector with others; by floating-point products where these are exact."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * len(q)
    if top < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return _exact(np.broadcast_to(q, c.shape), c)


def search(
    qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, levels: tuple[float, ...] = LEVELS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(query rows, candidate rows, scores) of the k best of each query, and the pairs that each level left."""
    x, y = q.astype(np.float64), c.astype(np.float64)
    # rounding of the bounds never loses a candidate
    slack = 1e-9 * (1 + np.sqrt(np.square(x).sum(axis=1).max(initial=0) * np.square(y).sum(axis=1).max(initial=0)))
    turn = _basis(y)
    x, y = x @ turn, y @ turn
    alive = qids[:, None] != cids[None, :]
    # a first k-th best score: exact scores of the candidates that are best by half of the coordinates
    half, some = max(1, x.shape[1] // 2), min(len(cids), 4 * k + 1)
    guess = np.where(alive, x[:, :half] @ y[:, :half].T, -np.inf)
    likely = np.argpartition(guess, len(cids) - some, axis=1)[:, len(cids) - some :]
    least = np.full(len(qids), -np.inf)
    for i, at in enumerate(likely):
        scores = np.sort(_row_scores(q[i], c[at[alive[i, at]]]).astype(np.float64))
        if len(scores) >= k:
            least[i] = scores[-k]
    left, head, known = [], 0, np.zeros(alive.shape)
    for share in levels:
        more = min(x.shape[1] - 1, int(share * x.shape[1]))
        known += x[:, head:more] @ y[:, head:more].T
        head = more
        alive &= known + _rest(x, head) @ _rest(y, head).T >= least[:, None] - slack
        left.append(int(alive.sum()))
    found = []
    for i, row in enumerate(alive):
        at = np.flatnonzero(row)
        scores = _row_scores(q[i], c[at])
        keep = scores.astype(np.float64) >= least[i]
        found.append((np.full(int(keep.sum()), i), at[keep], scores[keep]))
    i, j, scores = (np.concatenate([f[n] for f in found]) for n in range(3))
    return _best(qids, cids, i, j, scores, k, left)


def _best(qids, cids, i, j, scores, k: int, left: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The k best of the pairs of each query, ties to the smaller candidate id."""
    rank = np.unique(scores, return_inverse=True)[1] if scores.dtype == object else scores
    order = np.lexsort((cids[j], -rank, i))
    i, j, scores = i[order], j[order], scores[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], scores[best], left


def _unit(k: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["side"])
        names = ["query_id", "vec_id", "score"]
        if len(rows) != 2 or rows[0]["d"] != rows[1]["d"]:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        (qids, q), (cids, c) = map(_unpack, rows)
        i, j, scores, _ = search(qids, q, cids, c, k)
        return pa.table([pa.array(qids[i]), pa.array(cids[j]), pa.array(scores.astype(np.int64))], names)

    return run


def _numbered(df: DataFrame, most: int, name: str) -> DataFrame:
    blocks = cut(df.mapInArrow(_packer(most), "d long, wide long, ids binary, vectors binary"))
    blocks = cut(blocks.withColumn("__at", F.monotonically_increasing_id()))
    # one short row per block of thousands of vectors
    places = blocks.select("__at").withColumn(name, F.row_number().over(Window.orderBy("__at")) - 1)
    return blocks.join(places, "__at").drop("__at")


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query (ids divisible by ``every``)."""
    vectors = _valid(df, scale)
    queries = cut(_numbered(vectors.where(F.col("vec_id") % every == 0), QUERIES, "q"))
    candidates = cut(_numbered(vectors, CANDIDATES, "c"))
    n_q, n_c = queries.count(), candidates.count()
    columns = ["q", "c", "side", "d", "wide", "ids", "vectors"]
    met = (
        queries.withColumns({"c": F.explode(F.sequence(F.lit(0), F.lit(max(n_c - 1, 0)))), "side": F.lit(0)}).select(*columns)
        .unionByName(
            candidates.withColumns({"q": F.explode(F.sequence(F.lit(0), F.lit(max(n_q - 1, 0)))), "side": F.lit(1)}).select(*columns)
        )
    )
    found = met.groupBy("q", "c").applyInArrow(_unit(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
