"""The corpus operators as queries over whole tables, with their production parameters, and SQL for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_model, licenses, mixing, ngram_join, pieces, sharding, topk, toxicity, wrappers
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    """The file of the merge-type vocabulary: LOAMLINE_PIECES, or the installed public one."""
    if path := os.environ.get("LOAMLINE_PIECES"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of three-word shingle sets at 90 % Jaccard similarity: doc_id, n_shingles, component_id."""
    return ngram_join.near_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards by rendezvous hashing of doc_id, and the shard with one more."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of each document against all others: doc_id, n_words, n_seen, log_score."""
    from pyspark.sql import functions as F

    scored = language_model.score(table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text and what they decode to, as counts and digests."""
    return pieces.encode_digests(table(spark, sf_dir, "documents"), piece_model())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of each document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page by its host's wrapper: page_id, url, text, n_chars."""
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of each query vector: query_id, rank, vec_id, score."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document: doc_id, held_out, score, predicted."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_html_extraction": op7_html_extraction,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_toxicity": op10_toxicity,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

_OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
m AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS c FROM n UNION SELECT m.y, r.c FROM r JOIN m ON m.x = r.x AND r.c < m.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""

_OP2 = """
WITH k AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
d AS (
  SELECT doc_id, octet_length(encode(t)) + 8 AS size,
    xor(list_reduce(list_transform(range(octet_length(encode(t))), lambda p: CAST(('0x' || substr(hex(encode(t)), 2 * p + 1, 2)) AS BIGINT)),
      lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS crc
  FROM k, bits
),
z AS (
  SELECT doc_id, s, -ln((CAST(('0x' || substr(md5(doc_id::VARCHAR || '|' || s), 1, 15)) AS BIGINT)::DOUBLE + 0.5) / 1152921504606846976.0) AS wait
  FROM documents, range(25) r(s)
),
c AS (
  SELECT doc_id, CAST(arg_min(s, wait) FILTER (s < 24) AS INTEGER) AS shard, CAST(arg_min(s, wait) AS INTEGER) AS grown_shard
  FROM z GROUP BY doc_id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, crc) - 1 AS slot, grown_shard
FROM d JOIN c USING (doc_id)
"""

_OP3 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, ws FROM w),
t AS (SELECT doc_id, w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM e),
n AS (SELECT count(*) AS n FROM t),
o1 AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL),
c1 AS (SELECT w, sum(c) AS c FROM o1 GROUP BY w),
o2 AS (SELECT doc_id, v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY ALL),
c2 AS (SELECT v, w, sum(c) AS c FROM o2 GROUP BY ALL),
d AS (SELECT doc_id, sum(c) AS n FROM o1 GROUP BY doc_id),
s AS (
  SELECT t.doc_id, c2.c - o2.c AS pair, cv.c - ov.c AS one, greatest(cw.c - ow.c, 1) / greatest(n.n - d.n, 1) AS alone, t.v
  FROM t JOIN c1 cw ON cw.w = t.w JOIN o1 ow ON ow.doc_id = t.doc_id AND ow.w = t.w JOIN d ON d.doc_id = t.doc_id CROSS JOIN n
  LEFT JOIN o2 ON o2.doc_id = t.doc_id AND o2.v = t.v AND o2.w = t.w LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w
  LEFT JOIN c1 cv ON cv.w = t.v LEFT JOIN o1 ov ON ov.doc_id = t.doc_id AND ov.w = t.v
),
f AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (pair > 0) AS n_seen,
    sum(CASE WHEN pair > 0 THEN ln(pair / one) WHEN v IS NOT NULL THEN ln(alone) + ln(0.4::DOUBLE) ELSE ln(alone) END) AS log_score
  FROM s GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen,
  round(coalesce(log_score, 0.0), 4)::DOUBLE AS log_score
FROM documents LEFT JOIN f USING (doc_id)
"""


def _op6() -> str:
    phrase = {p: [f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split())] for p in licenses.PHRASES}
    at = ", ".join(
        f"list_filter(range(0, len(ws)), lambda i: {' AND '.join(c)}) AS p{k}" for k, c in enumerate(phrase.values())
    )
    sets = [sorted(set(t.split())) for t in licenses.TEMPLATES]
    held = ", ".join(
        f"coalesce(list_max(list_transform(bs, lambda b: len(list_intersect(b, {s!r})) / {len(s)})), 0.0) AS c{k}" for k, s in enumerate(sets)
    )
    names = lambda parts: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))), ',')"
    base = [f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(licenses.PHRASES.values())]
    more = [f"CASE WHEN c{k} >= 0.8 - 1e-12 THEN '{label}' END" for k, label in enumerate(licenses.TEMPLATES.values())]
    places = " || ".join(f"p{k}" for k in range(len(phrase)))
    need = [-int((1e-9 - licenses.THRESHOLD * len(s)) // 1) for s in sets]
    score = ", ".join(f"CASE WHEN c{k} * {len(s)} >= {n} - 1e-9 THEN c{k} ELSE 0.0 END" for k, (s, n) in enumerate(zip(sets, need, strict=True)))
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(0, len(ws), 32), lambda i: list_distinct(ws[i + 1 : i + 64])) END AS bs
  FROM w
),
f AS (SELECT doc_id, ws, {at}, {held} FROM b),
g AS (SELECT *, {places} AS ps FROM f)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_base, CAST(list_min(ps) AS BIGINT) AS first_word,
  CAST(list_max(ps) AS BIGINT) AS last_word, {names(base)} AS base_labels, {names(base + more)} AS labels,
  greatest(CASE WHEN len(ps) > 0 THEN 1.0 ELSE 0.0 END, {score})::DOUBLE AS score
FROM g
"""


_OP8 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents
),
g AS (
  SELECT doc_id, p, first_value(doc_id) OVER (PARTITION BY p ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY p) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(p) AS text_sha256 FROM g
"""

_OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": _OP1,
    "op2_sharding": _OP2,
    "op3_lm_scoring": _OP3,
    "op6_license_scan": _op6(),
    "op8_exact_dedup": _OP8,
    "op9_exact_topk": _OP9,
}
