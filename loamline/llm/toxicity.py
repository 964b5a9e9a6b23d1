"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over features of a text is trained on labelled documents:
whether it has a word, a beginning of words, or a beginning thrice or more
(beginnings find the forms and compounds of a stem). The features are those
that tell the classes apart best in the training rows, and the identity terms
among their words. Every identity term of a labelled text is swapped for the
others of its group, and the change of the score under the swap is penalised,
so that to mention one group is scored like to mention another; an L1 term
drops features that add nothing. All rows are scored by their whole text.

Training uses at most ``SAMPLE`` labelled rows, taken evenly by a hash of the
id; everything else covers all rows.

Defined results: rows whose crc32 of the id as text is divisible by 5 are held
out, and rows without id too; a null or empty text gets the score of the
intercept; labels other than 0 and 1, labels without document, and null labels
are ignored; repeated label rows count repeatedly; without both classes every
score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the training: labelled rows, features besides the identity terms, and rows that a feature needs.
SAMPLE, FEATURES, LEAST = 12_000, 400, 5
#: Lengths of the beginnings of words, and the count that is a feature of its own.
SHORT, LONG, OFTEN = 4, 8, 3
#: Weights of the penalties: absolute and squared weights, changes under swaps.
L1, L2, SWAP = 2e-4, 1e-5, 1.0

#: Terms for groups of people, which are swapped within their line.
IDENTITY = [
    "woman man girl boy women men girls boys female male",
    "frau mann mädchen junge frauen männer",
    "femme homme fille garçon femmes hommes filles garçons",
    "mujer hombre niña niño mujeres hombres",
    "muslim christian jew hindu buddhist atheist muslims christians jews hindus buddhists atheists catholic catholics",
    "moslem christ jude hinduist buddhist muslime christen juden",
    "musulman chrétien juif hindou bouddhiste musulmans chrétiens juifs",
    "musulmán cristiano judío hindú budista musulmanes cristianos judíos",
    "black white asian latino african european blacks whites asians latinos africans europeans",
    "gay lesbian straight bisexual transgender queer heterosexual homosexual",
    "immigrant immigrants refugee refugees foreigner foreigners migrant migrants citizen citizens",
    "blind deaf disabled autistic elderly young old",
]

WORD = re.compile(r"[^\W\d_]+")


def text_features(text: str | None, heads: set[str] | None = None) -> set[str]:
    """Words, beginnings (``stem*``) and frequent beginnings (``stem**``); with ``heads``, of words that begin so."""
    out: set[str] = set()
    counts: Counter[str] = Counter()
    for word, n in Counter(WORD.findall(text.lower()) if text else ()).items():
        if heads is not None and word[:SHORT] not in heads:
            continue
        out.add(word)
        for k in range(SHORT, min(LONG, len(word))):
            counts[word[:k]] += n
    out.update(f"{p}*" for p in counts)
    out.update(f"{p}**" for p, n in counts.items() if n >= OFTEN)
    return out


@dataclass
class Model:
    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.heads = {f[:SHORT].rstrip("*") for f in self.weights}

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weights[f] for f in sorted(text_features(text, self.heads) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def scorer(self):
        """A column function: text to score, in Arrow batches."""
        model = self

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([model.score(t) for t in texts], dtype="float64")

        return score


def swaps(features: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what each swap of an identity term for another of its group changes in the features, how often the term occurs)."""
    at = {f: i for i, f in enumerate(features)}
    changes, often = [], []
    for line in IDENTITY:
        terms = line.split()
        for a in terms:
            if a not in at or not x[:, at[a]].any():
                continue
            for b in terms:
                change = np.zeros(len(features))
                for sign, term in ((-1, a), (1, b)):
                    for f in text_features(term) & at.keys():
                        change[at[f]] += sign
                changes.append(change)
                often.append(x[:, at[a]].mean())
    return np.array(changes).reshape(len(changes), len(features)), np.array(often)


def fit(x: np.ndarray, y: np.ndarray, features: list[str], steps: int = 400) -> Model:
    """Proximal gradient descent (accelerated) on logistic loss, swap penalty and weights' size."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(share / (1 - share))))
    changes, often = swaps(features, x)
    n, d = x.shape
    w, c = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    v, u, t = w.copy(), c, 1.0
    direction, curve = np.ones(d + 1), 1.0
    for _ in range(30):  # the largest curvature of the loss, by power iteration
        direction /= np.linalg.norm(direction)
        seen = x @ direction[:d] + direction[d]
        direction = np.append(x.T @ seen, seen.sum()) / n
        curve = float(np.linalg.norm(direction))
    step = 1 / (0.3 * curve + L2 + SWAP * float(often @ np.square(changes).sum(axis=1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v + u, -500, 500)))
        g = x.T @ (p - y) / n + L2 * v
        g += SWAP * changes.T @ (often * (changes @ v))
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        c_new = u - step * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = new + (t - 1) / t_new * (new - w), c_new + (t - 1) / t_new * (c_new - c)
        w, c, t = new, c_new, t_new
    return Model(c, {k: float(s) for k, s in zip(features, w, strict=True) if s})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = min(1.0, SAMPLE / max(1, rows.count()))
    picked = rows.where(spot < share * 1_000_000).orderBy(spot, "doc_id", "toxic").limit(SAMPLE)
    labelled = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(picked), "doc_id"  # SAMPLE rows at most
    )
    terms = {t for line in IDENTITY for t in line.split()}

    def counted_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, n1 = Counter(), Counter()
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                found = text_features(text.as_py())
                n.update(found)
                if toxic.as_py():
                    n1.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n.keys(), pa.string()), pa.array([n1[f] for f in n], pa.int64()), pa.array(n.values(), pa.int64())], ["feature", "n1", "n"]
            )

    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return fit(np.empty((n0 + n1, 0)), np.repeat([0.0, 1.0], [n0, n1]), [])
    counted = labelled.mapInArrow(counted_in, "feature string, n1 long, n long").groupBy("feature").agg(
        F.sum("n1").alias("n1"), F.sum("n").alias("n")
    )
    # how far the feature's share of both classes is from what the classes' sizes make expect, in standard deviations
    expected = F.col("n") * (n1 / (n0 + n1))
    apart = F.abs(F.col("n1") - expected) / F.sqrt(expected * (n0 / (n0 + n1)))
    known = cut(counted.where((F.col("n") >= LEAST) | F.col("feature").isin(*terms)).withColumn("apart", apart))
    best = known.orderBy(F.col("apart").desc(), "feature").limit(FEATURES).select("feature")
    features = sorted({r["feature"] for r in best.union(known.where(F.col("feature").isin(*terms)).select("feature")).collect()})
    at = {f: i for i, f in enumerate(features)}
    heads = {f[:SHORT].rstrip("*") for f in features}

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [sorted(at[f] for f in text_features(t.as_py(), heads) & at.keys()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), b["toxic"]], ["hits", "toxic"])

    found = labelled.mapInArrow(hits_of, "hits array<int>, toxic int").toPandas()
    found = found.assign(key=[tuple(h) for h in found["hits"]]).sort_values(["toxic", "key"], ignore_index=True)  # whatever the order of rows
    x = np.zeros((len(found), len(features)))
    for i, h in enumerate(found["hits"]):
        x[i, list(h)] = 1
    return fit(x, found["toxic"].to_numpy(float), features)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), model.scorer()(F.col("text").cast("string")).alias("score")
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not predict to be toxic, with all their columns."""
    return documents.where(model.scorer()(F.col("text").cast("string")) < 0.5)
