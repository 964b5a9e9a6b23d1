"""Queries that score, merge and order result lists made of the pages and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.functions import html, text, urls
from loamline.operators import blocks, merging, ranking
from loamline.plans.html_queries import collapsed, unescaped, visible
from loamline.plans.tables import Pack, read
from loamline.plans.text_queries import docs
from loamline.plans.url_queries import SEARCH_KEY, bare, p

PACK = Pack()

#: Result rows of 25 queries over 4 backends, made of the pages; odd queries have model scores.
SERP = f"""(SELECT page_id % 25 AS query_id, CAST(row_number() OVER (PARTITION BY page_id % 25 ORDER BY page_id) AS INTEGER) AS position, page_id, url, 'b' || (page_id // 25) % 4 AS backend,
  {collapsed(unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, substr({visible('html')}, 1, 200) AS snippet, {p(3)} AS path, {bare()} AS domain,
  CAST(1 + page_id % 3 AS INTEGER) AS consensus, CASE WHEN page_id % 2 = 1 THEN ((page_id * 37) % 100) / 100.0::DOUBLE END AS raw, (100 - (page_id * 13) % 100) / 100.0::DOUBLE AS score,
  CASE page_id % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE '' END AS precision, CASE WHEN page_id % 3 < 2 THEN DATE '2024-01-01' + CAST(page_id % 400 AS INTEGER) END AS published FROM pages)"""
TERMS = ["the", "and", "de"]
SQL_TERMS = "['the', 'and', 'de']"


def serp(spark, sf_dir):
    i, h = F.col("page_id"), F.col("html")
    place = F.row_number().over(Window.partitionBy(i % 25).orderBy("page_id"))
    return read(spark, sf_dir, "pages").select(
        (i % 25).alias("query_id"), place.alias("position"), "page_id", "url", F.concat(F.lit("b"), (F.floor(i / 25) % 4).cast("string")).alias("backend"),
        html.title(h).alias("title"), F.substring(html.visible_text(h), 1, 200).alias("snippet"), urls.part(F.col("url"), 3).alias("path"),
        urls.bare_host(F.col("url")).alias("domain"), (1 + i % 3).cast("int").alias("consensus"),
        F.when(i % 2 == 1, (i * 37) % 100 / 100.0).alias("raw"), ((100 - (i * 13) % 100) / 100.0).alias("score"),
        F.when(i % 3 == 0, "day").when(i % 3 == 1, "month").otherwise("").alias("precision"),
        F.when(i % 3 < 2, F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int"))).alias("published"),
    )


def terms():
    return F.array(*map(F.lit, TERMS))


@PACK.query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS token FROM documents),
    s AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id), m AS (SELECT count(*) AS n, avg(dl) AS mean FROM s),
    q AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}'))) AS token FROM benchmark),
    tf AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token IN (SELECT token FROM q) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    r AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) AS score
      FROM tf JOIN df USING (token) JOIN s USING (doc_id) JOIN q USING (token), m GROUP BY item_id, doc_id),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS place FROM r)
    SELECT item_id, doc_id, place, round(score, 6)::DOUBLE AS score FROM k WHERE place <= 10"""
)
def bm25_recall_topk(spark, sf_dir):
    """The ten documents closest to each benchmark item, over whole texts."""
    tokens = docs(spark, sf_dir).select("doc_id", F.explode(text.word_tokens(F.col("text"))).alias("token"))
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.query_runs(F.col("text"))).alias("term"))
    scored = ranking.bm25(tokens, queries).withColumn("score", F.round("score", 6))
    scored = scored.withColumn("place", F.row_number().over(ranking.by_query(F.col("score").desc(), "doc_id"))).where("place <= 10")
    return scored.select(F.col("query_id").alias("item_id"), "doc_id", "place", "score")


@PACK.query(
    """WITH w AS (SELECT doc_id, list_min(list_filter(list_transform(['license', 'with', 'que', 'und'], lambda t: strpos(lower(text), t)), lambda x: x > 0)) AS hit_at, text FROM documents)
    SELECT doc_id, CAST(coalesce(hit_at, 0) AS INTEGER) AS hit, CASE WHEN hit_at IS NULL THEN substr(text, 1, 240) ELSE substr(text, greatest(1, hit_at - 60), 240) END AS snippet FROM w"""
)
def recall_snippets(spark, sf_dir):
    """A window of 240 characters from 60 before the first hit."""
    low = F.lower("text")
    found = F.array_min(F.filter(F.array(*[F.instr(low, t) for t in ["license", "with", "que", "und"]]), lambda x: x > 0))
    rows = docs(spark, sf_dir).withColumn("hit", F.coalesce(found, F.lit(0)))
    return rows.select("doc_id", "hit", F.substring(F.col("text"), F.greatest(F.lit(1), F.col("hit") - 60), F.lit(240)).alias("snippet"))


_MD = "array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN (i - 1) % 4 = 0 THEN repeat('#', CAST(1 + (i // 4) % 3 AS INTEGER)) || ' ' || substr(l[i], 1, 40) || chr(10) || l[i] ELSE chr(10) || l[i] END), chr(10))"


def _marked(spark, sf_dir):
    """Documents as Markdown: a heading before every fourth line."""
    line = lambda x, i: F.when(
        i % 4 == 0, F.concat(F.repeat(F.lit("#"), (1 + F.floor((i + 1) / 4) % 3).cast("int")), F.lit(" "), F.substring(x, 1, 40), F.lit("\n"), x)
    ).otherwise(F.concat(F.lit("\n"), x))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def _block_sql() -> str:
    from loamline.plans.text_queries import BLOCKS

    return BLOCKS.replace("FROM documents", f"FROM (SELECT doc_id, {_MD} AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")


_SCORED = f"""SELECT b.doc_id, b.block_id, b.kind, coalesce(base, 0.0) * power(1.5, coalesce(boosts, 0)) AS score FROM bl b LEFT JOIN base USING (doc_id, block_id) LEFT JOIN boosts USING (doc_id, block_id)"""
_FOCUS = rf"""WITH bl AS ({_block_sql()}),
  k AS (SELECT *, regexp_extract_all(lower(block), '[\p{{L}}\p{{N}}]{{2,}}') AS toks FROM bl),
  d AS (SELECT doc_id, block_id, kind, level, len(toks) AS dl, count(*) OVER (PARTITION BY doc_id) AS n, avg(len(toks)) OVER (PARTITION BY doc_id) AS mean, list_filter(toks, lambda t: t IN ('the', 'and', 'de')) AS hits FROM k),
  h AS (SELECT doc_id, block_id, n, mean, dl, t, count(*) AS tf FROM (SELECT doc_id, block_id, n, mean, dl, unnest(hits) AS t FROM d) GROUP BY ALL),
  f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS df FROM h),
  base AS (SELECT doc_id, block_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / CASE WHEN mean = 0 THEN 1 ELSE mean END))) AS base FROM f GROUP BY ALL),
  e AS (SELECT a.doc_id, a.block_id AS start, coalesce(min(c.block_id), 2147483647) AS stop FROM d a LEFT JOIN d c ON c.doc_id = a.doc_id AND c.kind = 'heading' AND c.block_id > a.block_id AND c.level <= a.level
    WHERE a.kind = 'heading' AND len(a.hits) > 0 GROUP BY ALL),
  boosts AS (SELECT d.doc_id, d.block_id, count(*) AS boosts FROM d JOIN e ON e.doc_id = d.doc_id AND d.block_id >= e.start AND d.block_id < e.stop GROUP BY ALL),
  s AS ({_SCORED})"""


def _scored(spark, sf_dir):
    parts = blocks.split_blocks(_marked(spark, sf_dir))
    return ranking.block_scores(parts, terms(), text.word_tokens(F.col("block")))


@PACK.query(f"{_FOCUS} SELECT doc_id, block_id, round(score, 6)::DOUBLE AS score FROM s")
def focus_block_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "block_id", F.round("score", 6).alias("score"))


@PACK.query(
    f"""{_FOCUS}, c AS (SELECT doc_id, block_id, kind, round(score, 6) AS score, round(score, 6) >= greatest(0.1, max(CASE WHEN kind <> 'heading' THEN round(score, 6) END) OVER (PARTITION BY doc_id) * 0.33) AS hit FROM s),
    w AS (SELECT doc_id, block_id, coalesce(hit, false) AS hit, kind, bool_or(coalesce(hit, false)) OVER (PARTITION BY doc_id) AS any_hit, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, block_id) AS place,
      lead(coalesce(hit, false)) OVER (PARTITION BY doc_id ORDER BY block_id) AS nxt FROM c)
    SELECT doc_id, block_id, why FROM (SELECT doc_id, block_id, CASE WHEN hit THEN 'score' WHEN kind = 'heading' AND nxt THEN 'heading' WHEN NOT any_hit AND place <= 5 THEN 'closest' END AS why FROM w) WHERE why IS NOT NULL"""
)
def focus_blocks_kept(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return ranking.focus(scored).select("doc_id", "block_id", "why")


@PACK.query(f"SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, fst) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, backend ORDER BY position) AS turn, min(position) OVER (PARTITION BY query_id, backend) AS fst FROM {SERP})")
def round_robin_interleave(spark, sf_dir):
    return ranking.interleave(serp(spark, sf_dir), "backend").select("query_id", "page_id", "place")


@PACK.query(f"SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY nth > 2, position) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY position) AS nth FROM {SERP})")
def domain_cap_diversify(spark, sf_dir):
    return ranking.diversify(serp(spark, sf_dir), "domain").select("query_id", "page_id", "place")


_HITS = lambda x: f"len(list_filter({SQL_TERMS}, lambda t: contains({x}, t)))"
_BOOST = f"""SELECT query_id, page_id, position, bucket, total, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bucket, total DESC, consensus DESC, position) AS INTEGER) AS place,
  round(CASE WHEN max(total) OVER (PARTITION BY query_id) > 1.0 THEN total / max(total) OVER (PARTITION BY query_id) ELSE total END, 4)::DOUBLE AS boosted FROM (
  SELECT *, score + 0.2::DOUBLE * (greatest(consensus, 1) - 1) + {_HITS('lower(title)')} / 3 * 0.10::DOUBLE + {_HITS('lower(path)')} / 3 * 0.08::DOUBLE AS total,
    CAST(CASE WHEN bool_or(raw IS NOT NULL) OVER (PARTITION BY query_id) OR seen >= 2 THEN 0 WHEN seen = 1 THEN 1 ELSE 2 END AS INTEGER) AS bucket
  FROM (SELECT *, {_HITS("lower(title) || ' ' || lower(snippet) || ' ' || lower(url)")} AS seen FROM {SERP.replace("page_id % 2 = 1", "page_id % 25 % 2 = 1")}))"""


@PACK.query(f"SELECT query_id, page_id, bucket, boosted FROM ({_BOOST})")
def quality_boost(spark, sf_dir):
    rows = serp(spark, sf_dir).withColumn("raw", F.when(F.col("query_id") % 2 == 1, (F.col("page_id") * 37) % 100 / 100.0))
    return ranking.boosted(rows, terms()).select("query_id", "page_id", "bucket", "boosted")


_TIER = f"""SELECT *, CASE WHEN raw >= 0.5 THEN 'high' WHEN raw >= 0.05 THEN 'med' WHEN raw IS NOT NULL THEN 'low'
  WHEN score >= 0.15 OR position <= greatest(2, count(*) OVER (PARTITION BY query_id) // 3) THEN 'med' ELSE 'low' END AS tier FROM {SERP}"""


def _tiered(spark, sf_dir):
    total = F.count("*").over(Window.partitionBy("query_id"))
    return serp(spark, sf_dir).withColumn("tier", ranking.tier(F.col("score"), F.col("position"), total, F.col("raw")))


@PACK.query(f"SELECT query_id, page_id, tier FROM ({_TIER})")
def result_tiers(spark, sf_dir):
    return _tiered(spark, sf_dir).select("query_id", "page_id", "tier")


@PACK.query(
    f"""SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position) AS INTEGER) AS place FROM (
      SELECT *, count(*) OVER (PARTITION BY query_id) > 3 AND count(*) FILTER (tier <> 'low') OVER (PARTITION BY query_id) >= 3 AS d FROM ({_TIER})) WHERE NOT (d AND tier = 'low')"""
)
def quality_filter(spark, sf_dir):
    return ranking.drop_low(_tiered(spark, sf_dir)).select("query_id", "page_id", "place")


@PACK.query(
    f"""SELECT query_id, page_id FROM (SELECT *, bool_or(contains(lower(title || ' ' || snippet || ' ' || url), 'nicht') OR contains(lower(title || ' ' || snippet || ' ' || url), 'asmente') OR coalesce(raw, 0) >= 0.99)
      OVER (PARTITION BY query_id) AS keep FROM {SERP}) WHERE keep"""
)
def irrelevant_lists_dropped(spark, sf_dir):
    wanted = F.array(F.lit("nicht"), F.lit("asmente"))
    return ranking.drop_strangers(serp(spark, sf_dir), wanted, 0.99).select("query_id", "page_id")


@PACK.query(f"SELECT query_id, page_id FROM (SELECT *, max(consensus) OVER (PARTITION BY query_id) AS m FROM {SERP}) WHERE m <= 1 OR consensus >= 2")
def consensus_gate(spark, sf_dir):
    return ranking.gate(serp(spark, sf_dir), 2).select("query_id", "page_id")


@PACK.query(f"SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN precision = 'day' THEN published END DESC NULLS LAST, position) AS INTEGER) AS place FROM {SERP}")
def newest_first(spark, sf_dir):
    return ranking.newest_first(serp(spark, sf_dir)).select("query_id", "page_id", "place")


@PACK.query(
    f"""SELECT query_id, page_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY backend NOT IN ('b1', 'b2'), CASE backend WHEN 'b0' THEN 2 WHEN 'b1' THEN 1 WHEN 'b2' THEN 0 ELSE 3 END, position) AS INTEGER) AS place FROM {SERP}"""
)
def lane_and_reliability_order(spark, sf_dir):
    """Rows of the preferred lane first; within it and outside, the more trusted backends first."""
    trust = F.when(F.col("backend") == "b0", 2).when(F.col("backend") == "b1", 1).when(F.col("backend") == "b2", 0).otherwise(3)
    order = ranking.by_query(~F.col("backend").isin("b1", "b2"), trust, "position")
    return serp(spark, sf_dir).select("query_id", "page_id", F.row_number().over(order).alias("place"))


@PACK.query(
    f"""SELECT query_id, page_id, unit, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS INTEGER) AS place, round(linear, 6)::DOUBLE AS linear FROM (
      SELECT *, round(CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1.0 END, 6)::DOUBLE AS unit,
        1 - (position - 1) / count(*) OVER q AS linear FROM {SERP} WINDOW q AS (PARTITION BY query_id)) WHERE unit >= 0.2"""
)
def rerank_normalised(spark, sf_dir):
    query = Window.partitionBy("query_id")
    rows = serp(spark, sf_dir).withColumn("linear", F.round(1 - (F.col("position") - 1) / F.count("*").over(query), 6))
    low, top = F.min("score").over(query), F.max("score").over(query)
    rows = rows.withColumn("unit", F.round(F.when(top > low, (F.col("score") - low) / (top - low)).otherwise(1.0), 6)).where("unit >= 0.2")
    return rows.withColumn("place", F.row_number().over(ranking.by_query(F.col("score").desc(), "position"))).select("query_id", "page_id", "unit", "place", "linear")


@PACK.query(f"SELECT query_id, page_id, position FROM {SERP} WHERE {bare()} || regexp_replace({p(3)}, '/+$', '') NOT IN (SELECT {bare()} || regexp_replace({p(3)}, '/+$', '') FROM pages WHERE page_id < 25)")
def source_page_dropped(spark, sf_dir):
    """Rows of pages other than the first 25, by host and path."""
    key = urls.page_key(F.col("url"))
    sources = read(spark, sf_dir, "pages").where("page_id < 25").select(key.alias("key")).distinct()
    return serp(spark, sf_dir).withColumn("key", key).join(sources, "key", "left_anti").select("query_id", "page_id", "position")


_MERGED = f"""SELECT query_id, key, min(position) AS position, arg_min(url, position) AS url, arg_min(title, position) AS title, array_to_string(list_sort(list_distinct(list(backend))), ',') AS backends,
  CAST(count(DISTINCT CASE WHEN backend IN ('b0', 'b1') THEN 'x' ELSE backend END) AS INTEGER) AS consensus FROM (SELECT *, {SEARCH_KEY} AS key FROM (SELECT * REPLACE (query_id % 2 AS query_id) FROM {SERP})) GROUP BY query_id, key"""


@PACK.query(_MERGED.replace("min(position)", "min(pos2)").replace("arg_min(url, position)", "arg_min(url, pos2)").replace("arg_min(title, position)", "arg_min(title, pos2)").replace("(SELECT * REPLACE (query_id % 2 AS query_id)", "(SELECT * REPLACE (query_id % 2 AS query_id), page_id AS pos2"))
def metasearch_merge(spark, sf_dir):
    """Rows of several backends merged by address, with the number of index families that agree."""
    rows = serp(spark, sf_dir).withColumns({"query_id": F.col("query_id") % 2, "position": F.col("page_id")})
    family = F.when(F.col("backend").isin("b0", "b1"), "x").otherwise(F.col("backend"))
    return merging.merge_rows(rows, urls.search_key(F.col("url")), family)


@PACK.query(
    f"""WITH r AS (SELECT *, {SEARCH_KEY} AS key FROM {SERP}), w AS (SELECT * FROM r WHERE page_id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY position) = 1),
    h AS (SELECT * REPLACE ('v' AS backend) FROM r WHERE page_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY position) = 1)
    SELECT coalesce(w.query_id, h.query_id) AS query_id, coalesce(w.key, h.key) AS key, coalesce(w.url, h.url) AS url,
      array_to_string(list_sort(list_filter([w.backend, h.backend], lambda x: x IS NOT NULL)), ',') AS backends, greatest(w.consensus, h.consensus) AS consensus,
      coalesce(w.published, h.published) AS published, w.key IS NULL AS vertical FROM w FULL JOIN h ON w.query_id = h.query_id AND w.key = h.key"""
)
def vertical_merge(spark, sf_dir):
    """Web rows and vertical hits that overlap, merged by address."""
    rows = serp(spark, sf_dir).withColumn("key", urls.search_key(F.col("url")))
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("position"))
    one = lambda x: x.withColumn("n", first).where("n = 1").drop("n")
    return merging.merge_verticals(one(rows.where("page_id % 3 > 0")), one(rows.where("page_id % 3 < 2").withColumn("backend", F.lit("v"))))


@PACK.query(
    rf"""SELECT query_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY position) AS n FROM (SELECT *, lower(regexp_replace(title, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS k FROM {SERP})) WHERE k = '' OR n = 1"""
)
def same_title_first(spark, sf_dir):
    rows = serp(spark, sf_dir).withColumn("k", F.lower(F.regexp_replace("title", r"[^\p{L}\p{N}]+", "")))
    return merging.first_of_title(rows, "k").select("query_id", "page_id")


@PACK.query(
    f"""SELECT key, page_id, variants, fst AS first FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY published DESC NULLS LAST, position DESC) AS n, count(*) OVER (PARTITION BY key) AS variants, min(position) OVER (PARTITION BY key) AS fst
      FROM (SELECT page_id AS position, page_id, published, regexp_replace({SEARCH_KEY}, '[0-9]+', '#', 'g') AS key FROM {SERP})) WHERE n = 1"""
)
def url_variants_newest(spark, sf_dir):
    """The newest of the variants of an address (numbers apart)."""
    rows = serp(spark, sf_dir).select(F.col("page_id").alias("position"), "page_id", "published", F.regexp_replace(urls.search_key(F.col("url")), "[0-9]+", "#").alias("key"))
    return merging.newest_variant(rows, "key", "published").select("key", "page_id", "variants", "first")


_JUDGED = "(SELECT doc_id % 25 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY n_chars DESC, doc_id) AS place, quality AS rel FROM documents LEFT JOIN labels USING (doc_id))"


def _judged(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("rel")), "doc_id", "left")
    rows = rows.withColumn("query_id", F.col("doc_id") % 25)
    return rows.withColumn("place", F.row_number().over(ranking.by_query(F.col("n_chars").desc(), "doc_id")))


_METRICS = f"""SELECT query_id, sum(CASE WHEN place <= 5 THEN g ELSE 0 END) / 5 AS p5, sum(CASE WHEN place <= 10 THEN g ELSE 0 END) / 10 AS p10, coalesce(1.0 / min(CASE WHEN g > 0 THEN place END), 0.0) AS mrr,
  CASE WHEN sum(b) > 0 THEN sum(g / log2(place + 1)) / sum(b) ELSE 0 END AS ndcg FROM (
  SELECT *, g / log2(row_number() OVER (PARTITION BY query_id ORDER BY g DESC, place) + 1) AS b FROM (SELECT *, coalesce(rel, 0)::DOUBLE AS g FROM {_JUDGED})) GROUP BY query_id"""


@PACK.query(f"SELECT query_id, round(p5, 6)::DOUBLE AS p5, round(p10, 6)::DOUBLE AS p10, round(mrr, 6)::DOUBLE AS mrr, round(ndcg, 6)::DOUBLE AS ndcg FROM ({_METRICS})")
def retrieval_metrics(spark, sf_dir):
    """P@5, P@10, MRR and nDCG of documents ordered by length, judged by the labels."""
    m = ranking.retrieval_metrics(_judged(spark, sf_dir))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("p5", "p10", "mrr", "ndcg")])


@PACK.query(
    f"""SELECT count(*) AS n, round(avg(d), 6)::DOUBLE AS mean, round(stddev_samp(d), 6)::DOUBLE AS sd, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses
    FROM (SELECT round(p5, 6) - round(p10, 6) AS d FROM ({_METRICS}))"""
)
def paired_statistics(spark, sf_dir):
    """P@5 against P@10 of the same queries, as a paired comparison."""
    m = ranking.retrieval_metrics(_judged(spark, sf_dir)).select((F.round("p5", 6) - F.round("p10", 6)).alias("d"))
    return m.agg(
        F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_samp("d"), 6).alias("sd"),
        F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"),
    )
