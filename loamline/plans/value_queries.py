"""Queries over printed text, values of services and verdicts on responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import printed, values
from loamline.operators import merging
from loamline.plans.tables import Pack, read

PACK = Pack()


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")

# -- printed text

_GLYPHS = "CASE doc_id % 3 WHEN 0 THEN text || ' (cid:' || doc_id || ')(cid:7)' WHEN 1 THEN chr(7) || text ELSE text END"


@PACK.query(
    rf"""SELECT doc_id, CASE WHEN length(t) > 0 THEN round((length(t) - length(regexp_replace(t, '{printed.GLYPH}', '', 'g'))) / length(t), 9) ELSE 0.0 END::DOUBLE AS glyphs,
      CASE WHEN length(t) > 0 THEN round(length(regexp_replace(regexp_replace(t, '{printed.GLYPH}', '', 'g'), '[\x00-\x08\x0B-\x1F\x7F-\x{{9F}}]', '', 'g')) / length(t), 9) ELSE 0.0 END::DOUBLE AS readable
    FROM (SELECT doc_id, {_GLYPHS} AS t FROM documents)"""
)
def glyph_quality(spark, sf_dir):
    """Shares of glyph marks and of printable characters, with marks planted in a third of the texts."""
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.col("text"), F.lit(" (cid:"), F.col("doc_id").cast("string"), F.lit(")(cid:7)"))).when(k == 1, F.concat(F.lit("\x07"), F.col("text"))).otherwise(F.col("text"))
    rows = docs(spark, sf_dir).select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.round(printed.glyph_share(F.col("t")), 9).alias("glyphs"), F.round(printed.readable_share(F.col("t")), 9).alias("readable"))


_LINE = "(CASE doc_id % 5 WHEN 0 THEN (doc_id % 40) || '.' || (doc_id % 9) || ' ' WHEN 1 THEN '2024 ' WHEN 2 THEN '3. ' ELSE '' END || source || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE ' part' END || CASE WHEN doc_id % 11 = 0 THEN repeat(' x', 120) ELSE '' END)"
_ENDS = r"[.,;:?!)\]]$"


@PACK.query(
    rf"""SELECT doc_id, length(trim(l)) <= 60 AND NOT regexp_matches(trim(l), '{_ENDS}') AND regexp_matches(trim(l), '^[0-9]{{1,2}}(\.[0-9]{{1,2}})*\.?\s+\S') AS numbered,
      CAST(CASE WHEN s <= 0 OR length(trim(l)) > 200 OR regexp_matches(trim(l), '{_ENDS}') THEN 0 WHEN b AND v > 1 THEN v - 1 ELSE v END AS INTEGER) AS level
    FROM (SELECT *, CASE WHEN s / 10.0 >= 2.0 THEN 1 WHEN s / 10.0 >= 1.55 THEN 2 WHEN s / 10.0 >= 1.25 THEN 3 ELSE 0 END AS v
      FROM (SELECT doc_id, {_LINE} AS l, doc_id % 23 AS s, doc_id % 2 = 0 AS b FROM documents))"""
)
def heading_lines(spark, sf_dir):
    """Numbered titles and levels of lines by their size, of made-up lines."""
    k = F.col("doc_id")
    lead = F.when(k % 5 == 0, F.concat((k % 40).cast("string"), F.lit("."), (k % 9).cast("string"), F.lit(" "))).when(k % 5 == 1, "2024 ").when(k % 5 == 2, "3. ").otherwise("")
    tail = F.concat(F.when(k % 7 == 0, ".").otherwise(" part"), F.when(k % 11 == 0, F.repeat(F.lit(" x"), 120)).otherwise(""))
    rows = docs(spark, sf_dir).select("doc_id", F.concat(lead, F.col("source"), tail).alias("l"))
    level = printed.heading_level((k % 23).cast("double"), F.lit(10.0), k % 2 == 0, F.col("l"))
    return rows.select("doc_id", printed.is_numbered_title(F.col("l")).alias("numbered"), level.alias("level"))


@PACK.query(
    r"""SELECT doc_id, replace(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(t, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> ''), chr(10)),
      '([\p{L}\p{N}])-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' ') AS joined FROM (SELECT doc_id, replace(text, 'e ', 'e-' || chr(10)) || chr(10) || chr(10) || ' End-' || chr(13) || 'Of' AS t FROM documents)"""
)
def joined_lines(spark, sf_dir):
    """Texts whose words were broken over lines, put together."""
    t = F.concat(F.replace(F.col("text"), F.lit("e "), F.lit("e-\n")), F.lit("\n\n End-\rOf"))
    return docs(spark, sf_dir).select("doc_id", printed.joined_lines(t).alias("joined"))


_SPEC = "CASE conv_id % 6 WHEN 0 THEN '' WHEN 1 THEN '7-3, 2' WHEN 2 THEN ' 5 , x, 40-60,1-' WHEN 3 THEN turn || '-' || (turn + 3) || ',2,2' WHEN 4 THEN '99' END"


@PACK.query(
    rf"""WITH r AS (SELECT conv_id, turn, {_SPEC} AS spec FROM conversations),
    x AS (SELECT conv_id, turn, regexp_extract(trim(u), '^([0-9]{{1,9}})\s*(-\s*([0-9]{{1,9}}))?$', 1) AS a, regexp_extract(trim(u), '^([0-9]{{1,9}})\s*(-\s*([0-9]{{1,9}}))?$', 3) AS b
      FROM (SELECT conv_id, turn, unnest(string_split(spec, ',')) AS u FROM r WHERE trim(coalesce(spec, '')) <> '')),
    y AS (SELECT conv_id, turn, unnest(range(greatest(1, least(a, b)), least(12, greatest(a, b)) + 1)) AS page FROM (SELECT conv_id, turn, a::INTEGER AS a, coalesce(nullif(b, ''), a)::INTEGER AS b FROM x WHERE a <> '')),
    z AS (SELECT conv_id, turn, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages, count(DISTINCT page) AS n FROM y GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN trim(coalesce(spec, '')) = '' THEN '1,10,11,12,2,3,4,5,6,7,8,9' ELSE coalesce(pages, '') END AS pages FROM r LEFT JOIN z USING (conv_id, turn)"""
)
def page_ranges(spark, sf_dir):
    """Pages of a document of twelve that a range names."""
    k, t = F.col("conv_id") % 6, F.col("turn")
    spec = (
        F.when(k == 0, "").when(k == 1, "7-3, 2").when(k == 2, " 5 , x, 40-60,1-")
        .when(k == 3, F.concat(t.cast("string"), F.lit("-"), (t + 3).cast("string"), F.lit(",2,2"))).when(k == 4, "99")
    )
    pages = F.transform(printed.page_numbers(spec, F.lit(12)), lambda p: p.cast("string"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(pages), ",").alias("pages"))


def _last(x: str, marks: list[str], keep: bool) -> str:
    at = [f"CASE WHEN contains({x}, '{m}') THEN length({x}) - position(reverse('{m}') IN reverse({x})) - {len(m)} + 1 ELSE -1 END" for m in marks]
    best = f"greatest({', '.join(at)})"
    size = "CASE " + " ".join(f"WHEN {a} = {best} THEN {len(m)}" for a, m in zip(at, marks, strict=True)) + " END" if keep else "0"
    return f"CASE WHEN {best} > 0 THEN {best} + {size} END"


@PACK.query(
    f"SELECT conv_id, turn, CAST(coalesce({', '.join(_last('text', m, False) for m in printed.BREAKS)}, length(text)) AS INTEGER) AS label_end, "
    f"CAST(coalesce({', '.join(_last('text', m, True) for m in printed.BREAKS)}, length(text)) AS INTEGER) AS chunk_end FROM conversations"
)
def cut_lengths(spark, sf_dir):
    """Where a turn may be cut, before and after the mark."""
    t = F.col("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", printed.cut_length(t).alias("label_end"), printed.cut_length(t, True).alias("chunk_end"))


_TABLE = "CASE doc_id % 6 WHEN 0 THEN 'a;b' || chr(10) || doc_id || ';2' WHEN 1 THEN 'a' || chr(9) || 'b' || chr(10) || 'c' || chr(9) || 'd' WHEN 2 THEN 'a|b|c' || chr(10) || '1|2|3' WHEN 3 THEN 'a,b;c' || chr(10) || '1;2' WHEN 4 THEN '' ELSE 'plain' || chr(10) || source END"


@PACK.query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ';' WHEN 1 THEN chr(9) WHEN 2 THEN '|' WHEN 3 THEN ';' ELSE ',' END AS delimiter FROM (SELECT doc_id, {_TABLE} AS t FROM documents)")
def delimiters(spark, sf_dir):
    """What separates the fields of made-up tables."""
    k = F.col("doc_id") % 6
    t = (
        F.when(k == 0, F.concat(F.lit("a;b\n"), F.col("doc_id").cast("string"), F.lit(";2"))).when(k == 1, "a\tb\nc\td").when(k == 2, "a|b|c\n1|2|3")
        .when(k == 3, "a,b;c\n1;2").when(k == 4, "").otherwise(F.concat(F.lit("plain\n"), F.col("source")))
    )
    return docs(spark, sf_dir).select("doc_id", printed.delimiter(t).alias("delimiter"))


# -- values of services


@PACK.query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace('<p>' || text || '</p> <b>x</b>', '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents"""
)
def plain_values(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", values.plain(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p> <b>x</b>"))).alias("plain"))


@PACK.query(
    """SELECT event_id, greatest(0.0, CASE event_id % 4 WHEN 0 THEN (event_id % 900)::DOUBLE WHEN 1 THEN (event_id % 500 - 100)::DOUBLE ELSE value END)::DOUBLE AS seconds FROM events"""
)
def retry_waits(spark, sf_dir):
    """Waits by headers that hold seconds, a date, nothing or something else."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    later = F.timestamp_seconds(F.unix_timestamp(ts) + (k % 500 - 100))
    header = F.when(k % 4 == 0, (k % 900).cast("string")).when(k % 4 == 1, F.concat(F.date_format(later, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k % 4 == 2, "soon")
    return read(spark, sf_dir, "events").select("event_id", values.retry_after(header, ts, F.col("value")).alias("seconds"))


@PACK.query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch(date_trunc('day', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) WHEN 2 THEN epoch(date_trunc('second', ts)) - 7200 ELSE 0 END::DOUBLE AS at,
      CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d') END AS day FROM events"""
)
def stated_times(spark, sf_dir):
    """Seconds of ISO values with and without zones, and days of seconds."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    value = F.when(k % 5 == 0, F.date_format(ts, "yyyy-MM-dd")).when(k % 5 == 1, F.concat(iso, F.lit("Z"))).when(k % 5 == 2, F.concat(iso, F.lit("+02:00"))).when(k % 5 == 3, "yesterday")
    number = F.when(k % 3 == 0, "n/a").otherwise(F.unix_timestamp(ts).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", values.lastmod_epoch(value).alias("at"), values.epoch_day(number).alias("day"))


_ASKED = "CASE (conv_id + turn) % 5 WHEN 0 THEN '東京の天気 ' WHEN 1 THEN '서울 날씨' WHEN 2 THEN '北京天气' WHEN 3 THEN '' ELSE text END"
_WIDE = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"


@PACK.query(
    rf"""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'de' WHEN regexp_matches(q, '[\x{{3040}}-\x{{30FF}}]') THEN 'ja' WHEN regexp_matches(q, '[\x{{AC00}}-\x{{D7AF}}]') THEN 'ko' WHEN regexp_matches(q, '[\x{{3400}}-\x{{9FFF}}]') THEN 'zh' ELSE 'en' END AS language,
      CASE WHEN s > 0.30 THEN 'cn' WHEN s < 0.05 THEN 'en' ELSE '' END AS lane, CASE WHEN trim(q) <> '' AND length(trim(q)) <= 2048 THEN regexp_replace(trim(q), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') END AS query
    FROM (SELECT *, CASE WHEN length(b) > 0 THEN len(regexp_extract_all(b, '{_WIDE}')) / length(b) END AS s FROM (SELECT *, regexp_replace(q, '\s+', '', 'g') AS b FROM (SELECT conv_id, turn, {_ASKED} AS q FROM conversations)))"""
)
def query_languages(spark, sf_dir):
    """The language to ask in, the lane of engines, and the query as it may be sent."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    q = F.when(k == 0, "東京の天気 ").when(k == 1, "서울 날씨").when(k == 2, "北京天气").when(k == 3, "").otherwise(F.col("text"))
    asked = F.when(F.col("turn") % 4 == 1, "DE-at").when(F.col("turn") % 4 == 2, "x1")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("q"), asked.alias("asked"))
    return rows.select(
        "conv_id", "turn", values.encyclopedia_language(F.col("q"), F.col("asked")).alias("language"), values.language_lane(F.col("q")).alias("lane"),
        values.query_or_null(F.col("q")).alias("query"),
    )


_STATUS = "CASE page_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 0 ELSE 200 END"
_BODY = "CASE page_id % 7 WHEN 0 THEN 'Checking your browser' WHEN 1 THEN '  ' ELSE html END"


@PACK.query(
    f"""SELECT page_id, s > 0 AND s < 400 AND page_id % 3 > 0 AND trim(b) <> '' AS cacheable, s IN (403, 503) AND ({' OR '.join(f"contains(lower(b), '{c}')" for c in values.CHALLENGES)}) AS challenged
    FROM (SELECT page_id, {_STATUS} AS s, {_BODY} AS b FROM pages)"""
)
def response_verdicts(spark, sf_dir):
    """Responses that may be kept, and those that ask for proof."""
    k = F.col("page_id")
    status = F.when(k % 5 == 0, 403).when(k % 5 == 1, 503).when(k % 5 == 2, 404).when(k % 5 == 3, 0).otherwise(200)
    body = F.when(k % 7 == 0, "Checking your browser").when(k % 7 == 1, "  ").otherwise(F.col("html"))
    rows = read(spark, sf_dir, "pages").select("page_id", status.alias("s"), body.alias("b"), F.when(k % 3 == 0, "timeout").alias("e"))
    return rows.select("page_id", values.is_cacheable(F.col("s"), F.col("e"), F.col("b")).alias("cacheable"), values.is_challenged(F.col("s"), F.col("b")).alias("challenged"))


@PACK.query(
    r"""SELECT page_id, page_id % 4 < 2 AS own, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/sitemap.xml' AS first_map, CAST(CASE page_id % 3 WHEN 0 THEN least(50, greatest(1, page_id)) WHEN 1 THEN 20 ELSE 50 END AS INTEGER) AS bounded FROM pages"""
)
def row_addresses(spark, sf_dir):
    """Titles that are the row's own address, a site's usual map, and bounded numbers."""
    k, url = F.col("page_id"), F.col("url")
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")
    title = F.when(k % 4 == 0, F.concat(F.upper(bare), F.lit("..."))).when(k % 4 == 1, bare).when(k % 4 == 2, "Home").otherwise(F.concat(bare, F.lit(" x")))
    number = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "many").otherwise("9999")
    return read(spark, sf_dir, "pages").select(
        "page_id", values.title_is_address(title, url).alias("own"), F.element_at(values.conventional_sitemaps(url), 1).alias("first_map"),
        values.bounded_int(number, 1, 50, 20).cast("int").alias("bounded"),
    )


# -- rows


@PACK.query(
    """SELECT user_id, string_agg(event_type, ',' ORDER BY score DESC, event_type) AS best FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS n FROM (SELECT user_id, event_type, max(value) AS score FROM events GROUP BY ALL)) WHERE n <= 3 GROUP BY user_id"""
)
def best_distinct(spark, sf_dir):
    """The three best distinct addresses of a side, here the kinds of a user's events."""
    rows = merging.best_distinct(read(spark, sf_dir, "events"), "user_id", "event_type", "value", 3)
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_type"))), lambda x: x["event_type"]), ",").alias("best"))


@PACK.query(
    """SELECT source, doc_id, total, undated FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY source) AS total,
      count(*) FILTER (doc_id % 4 = 0) OVER (PARTITION BY source) AS undated FROM documents) WHERE n <= 20"""
)
def capped_sources(spark, sf_dir):
    """Twenty entries a source, with counts of all it has."""
    rows = docs(spark, sf_dir).select("source", "doc_id", "n_chars", F.when(F.col("doc_id") % 4 > 0, F.col("n_chars")).alias("dated"))
    return merging.capped(rows, "source", [F.desc("n_chars"), F.col("doc_id")], "dated", 20).select("source", "doc_id", "total", "undated")


@PACK.query("SELECT lang, round(sum(CASE WHEN doc_id % 3 > 0 THEN n_chars ELSE n_chars // 2 END) / sum(n_chars), 9)::DOUBLE AS retention FROM documents GROUP BY lang")
def weighted_retention(spark, sf_dir):
    """The share of all characters that a cut keeps, by language."""
    kept = F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).otherwise(F.floor(F.col("n_chars") / 2))
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.sum(kept) / F.sum("n_chars"), 9).alias("retention"))
