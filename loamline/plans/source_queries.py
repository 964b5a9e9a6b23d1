"""Queries that read services' bodies, feeds, sitemaps and robots files, made of the tables, and that plan crawls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.operators import crawl
from loamline.plans.tables import Pack, read
from loamline.plans.url_queries import p
from loamline.sources import feeds

PACK = Pack()


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")


def _json_query(dialect: str):
    schema, path, title, url, snippet = feeds.DIALECTS[dialect]

    def run(spark, sf_dir):
        row = F.struct(
            F.concat(F.col("source"), F.lit(" "), F.col("doc_id").cast("string")).alias(title), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias(url), F.col("text").alias(snippet)
        )
        body = F.array(row, F.struct(F.lit(None).cast("string").alias(title), F.lit("https://y.example").alias(url), F.lit("z").alias(snippet)))
        for name in reversed(path.split(".")):
            body = F.struct(body.alias(name))
        raw = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 == 0, "not json").otherwise(F.to_json(body)).alias("body"))
        return feeds.json_results(raw, "body", dialect)

    run.__name__ = f"json_results_{dialect}"
    PACK.query(
        """SELECT doc_id, 0 AS place, source || ' ' || doc_id AS title, 'https://x.example/' || doc_id AS url, text AS snippet FROM documents WHERE doc_id % 9 > 0
        UNION ALL SELECT doc_id, 1, NULL, 'https://y.example', 'z' FROM documents WHERE doc_id % 9 > 0"""
    )(run)


for _dialect in feeds.DIALECTS:
    _json_query(_dialect)


@PACK.query("SELECT doc_id, substr(array_to_string(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), ' '), 1, 400) AS abstract FROM documents".replace("\\\\", "\\"))
def inverted_abstracts(spark, sf_dir):
    """Texts as inverted indexes, and back."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(words).alias("p", "w"))
    index = rows.groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("p")).alias("l")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "l"))).alias("index"))
    raw = index.select("doc_id", F.to_json("index").alias("body"))
    return raw.select("doc_id", feeds.abstract(F.from_json("body", "map<string,array<int>>")).alias("abstract"))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_PLAIN = r"regexp_replace(text, '[^A-Za-z0-9 .,]+', ' ', 'g')"


def _feed_bodies(spark, sf_dir):
    """A feed of two dated items and an undated one per document."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("timestamp"), "d MMM yyyy HH:mm:ss")
    text = _escaped(F.regexp_replace("text", "[^A-Za-z0-9 .,]+", " "))
    item = lambda t, d, s: F.concat(F.lit(f"<item><title>{t}</title><link>https://f.example/{t}</link><description>x"), s, F.lit("</description>"), d, F.lit("</item>"))
    body = F.concat(
        F.lit("<rss><channel><title>T</title>"), item("undated", F.lit(""), F.lit("short")), item("old", F.lit("<pubDate>Mon, 1 Jan 2001 00:00:00 +0000</pubDate>"), F.lit("y")),
        item("new", F.concat(F.lit("<pubDate>Tue, "), day, F.lit(" +0000</pubDate>")), text), F.lit("</channel></rss>"),
    )
    return docs(spark, sf_dir).select("doc_id", body.alias("body"))


_ITEMS = f"""SELECT doc_id, i AS place, CASE i WHEN 1 THEN 'new' WHEN 2 THEN 'old' ELSE 'undated' END AS title, CASE i WHEN 1 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') WHEN 2 THEN '2001-01-01' END AS published,
  CASE i WHEN 1 THEN length(trim('x' || {_PLAIN})) > 500 ELSE false END AS truncated FROM documents, (SELECT unnest([1, 2, 3])::INTEGER AS i)"""


@PACK.query(f"SELECT doc_id, place, title, published, truncated FROM ({_ITEMS})")
def feed_items(spark, sf_dir):
    items = feeds.feed_items(_feed_bodies(spark, sf_dir), "doc_id", "body")
    return items.select("doc_id", "place", "title", F.date_format("published", "yyyy-MM-dd").alias("published"), "truncated")


@PACK.query(f"SELECT doc_id, count(*) AS n, count(*) FILTER (published IS NULL) AS undated FROM ({_ITEMS}) WHERE published IS NULL OR published >= '2024-03-01' GROUP BY doc_id")
def feed_since(spark, sf_dir):
    items = feeds.newer_items(feeds.feed_items(_feed_bodies(spark, sf_dir), "doc_id", "body"), F.lit("2024-03-01").cast("timestamp"))
    return items.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("published").isNull()).alias("undated"))


def _sitemaps(spark, sf_dir):
    entry = F.concat(
        F.lit("<url><loc> "), _escaped(F.col("url")), F.lit(" </loc>"),
        F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<lastmod>"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 200).cast("int")), "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(""),
        F.lit("</url>"),
    )
    rows = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("site"), "page_id", entry.alias("e"))
    rows = rows.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_id", "e"))).alias("l"))
    return rows.select("site", F.concat(F.lit("<urlset>"), F.array_join(F.transform("l", lambda x: x["e"]), ""), F.lit("</urlset>")).alias("body"))


_MAP = """(SELECT page_id % 10 AS site, CAST(row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) - 1 AS INTEGER) AS pos, url,
  CASE WHEN page_id % 3 > 0 THEN strftime(DATE '2024-01-01' + CAST(page_id % 200 AS INTEGER), '%Y-%m-%d') END AS lastmod FROM pages)"""


@PACK.query(f"SELECT site, pos AS place, url AS loc, lastmod FROM {_MAP}")
def sitemap_urls(spark, sf_dir):
    return feeds.sitemap_urls(_sitemaps(spark, sf_dir), "site", "body")


_PATH = f"translate(lower({p(3)}), '/-_', '   ')"
_KINDS = lambda kinds: f"len(list_intersect(string_split_regex({_PATH}, '\\s+'), {kinds!r}))"
_SCORE = f"""(2.0 * (CASE WHEN contains('page ' || pos, 'fr') THEN 1 ELSE 0 END + CASE WHEN contains('page ' || pos, '7') THEN 1 ELSE 0 END) / 2
  + (CASE WHEN contains({_PATH}, 'fr') THEN 1 ELSE 0 END + CASE WHEN contains({_PATH}, '7') THEN 1 ELSE 0 END) / 2.0
  + 0.5 * {_KINDS(crawl.CONTENT)} - {_KINDS(crawl.JUNK)})::DOUBLE"""
_ORDERED = f"""SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY late, score DESC, lastmod DESC NULLS LAST, pos) AS INTEGER) AS place FROM (
  SELECT *, regexp_extract({p(3)}, '^/([a-z]{{2}}(-[A-Z]{{2}})?)(/|$)', 1) <> '' AND row_number() OVER (PARTITION BY site, regexp_replace({p(3)}, '^/[a-z]{{2}}(-[A-Z]{{2}})?(/|$)', '/') ORDER BY score DESC, lastmod DESC NULLS LAST, pos) > 3 AS late
  FROM (SELECT *, {_SCORE} AS score FROM {_MAP}))"""


def _ordered(spark, sf_dir):
    rows = feeds.sitemap_urls(_sitemaps(spark, sf_dir), "site", "body").select("site", F.col("place").alias("pos"), F.col("loc").alias("url"), "lastmod")
    return crawl.map_order(rows, crawl.link_score(F.col("url"), F.concat(F.lit("Page "), F.col("pos").cast("string")), ["fr", "7"]))


@PACK.query(f"SELECT site, pos, place, score FROM ({_ORDERED})")
def map_order(spark, sf_dir):
    """The order in which a site's map is read."""
    return _ordered(spark, sf_dir).select("site", "pos", "place", F.col("score").cast("double").alias("score"))


@PACK.query(f"SELECT site, pos, place, CAST(spent AS BIGINT) AS spent FROM (SELECT *, sum(length(url) + 12) OVER (PARTITION BY site ORDER BY place) AS spent FROM ({_ORDERED})) WHERE spent <= 600")
def map_within_budget(spark, sf_dir):
    return crawl.within_budget(_ordered(spark, sf_dir), F.length("url") + 12, 600).select("site", "pos", "place", F.col("spent").cast("long").alias("spent"))


_ROBOTS = "# rules\nUser-agent: *\nDisallow: /en\nAllow: /en/1\n\nUser-agent: Own\nUser-agent: Other\nDisallow: /fr\nDisallow:\nSitemap: https://s.example/map.xml\n"


@PACK.query(
    f"""SELECT site, path, CASE WHEN site % 2 = 0 THEN NOT starts_with(path, '/fr') ELSE NOT starts_with(path, '/en') OR starts_with(path, '/en/1') END AS allowed FROM (SELECT DISTINCT page_id % 10 AS site, {p(3)} AS path FROM pages)"""
)
def robots_verdicts(spark, sf_dir):
    """Paths of pages against robots files; even sites name the reader, odd ones only all readers."""
    from loamline.functions.urls import part

    paths = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("site"), part(F.col("url"), 3).alias("path")).distinct()
    body = F.when(F.col("site") % 2 == 0, _ROBOTS).otherwise(F.replace(F.lit(_ROBOTS), F.lit("User-agent: Own\n"), F.lit("")))
    files = paths.select("site").distinct().withColumn("body", body)
    return feeds.robots_verdicts(paths, feeds.robots_rules(files, "site", "body"), "site", "own")


@PACK.query("SELECT DISTINCT page_id % 10 AS site, 'https://s.example/map.xml' AS sitemap FROM pages")
def robots_sitemaps(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("site")).distinct().withColumn("body", F.lit(_ROBOTS))
    return feeds.robots_sitemaps(files, "site", "body")


@PACK.query(
    """SELECT source, string_agg(line, chr(10) ORDER BY place) AS markdown FROM (SELECT source, -2 AS place, '| id | chars |' AS line FROM (SELECT DISTINCT source FROM documents) UNION ALL
      SELECT source, -1, '| --- | --- |' FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT source, doc_id, '| ' || doc_id || ' | ' || CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR ELSE '' END || ' |' FROM documents
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 100) GROUP BY source"""
)
def markdown_tables(spark, sf_dir):
    """The first 100 documents of each source as a table; ragged rows are padded."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    row = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))).otherwise(F.array(F.col("doc_id").cast("string")))
    rows = docs(spark, sf_dir).withColumn("n", nth).where("n <= 100").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", row.alias("r")))).alias("l"))
    return rows.select("source", feeds.markdown_table(F.array(F.lit("id"), F.lit("chars")), F.transform("l", lambda x: x["r"])).alias("markdown"))


@PACK.query(
    """SELECT source, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS spans FROM (SELECT source, min(page) AS a, max(page) AS b FROM (
      SELECT source, page, page - row_number() OVER (PARTITION BY source ORDER BY page) AS g FROM (SELECT DISTINCT source, (doc_id // 7) % 90 AS page FROM documents)) GROUP BY source, g) GROUP BY source"""
)
def page_spans(spark, sf_dir):
    """Page numbers as spans."""
    rows = docs(spark, sf_dir).select("source", (F.floor(F.col("doc_id") / 7) % 90).alias("page")).distinct()
    rows = rows.withColumn("g", F.col("page") - F.row_number().over(Window.partitionBy("source").orderBy("page")))
    spans = rows.groupBy("source", "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    out = spans.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("l"))
    return out.select("source", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("spans"))


@PACK.query(
    """SELECT a.source, a.doc_id, a.page, greatest(a.page, coalesce(min(b.page) - 1, 400)) AS end_page FROM (SELECT source, doc_id, doc_id % 400 AS page, doc_id % 3 AS level FROM documents) a
      LEFT JOIN (SELECT source, doc_id, doc_id % 400 AS page, doc_id % 3 AS level FROM documents) b ON b.source = a.source AND b.doc_id > a.doc_id AND b.level <= a.level AND b.page > a.page GROUP BY a.source, a.doc_id, a.page"""
)
def outline_end_pages(spark, sf_dir):
    """Where each entry of an outline ends: before the next later entry of its level or above."""
    rows = docs(spark, sf_dir).select("source", "doc_id", (F.col("doc_id") % 400).alias("page"), (F.col("doc_id") % 3).alias("level"))
    b = rows.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("page").alias("q"), F.col("level").alias("m"))
    met = rows.join(b, (F.col("source") == F.col("s")) & (F.col("d") > F.col("doc_id")) & (F.col("m") <= F.col("level")) & (F.col("q") > F.col("page")), "left")
    return met.groupBy("source", "doc_id", "page").agg(F.min("q").alias("next")).select("source", "doc_id", "page", F.greatest("page", F.coalesce(F.col("next") - 1, F.lit(400))).alias("end_page"))


@PACK.query("""SELECT page_id, '{"kind":"page","id":' || page_id || ',"chars":' || length(html) || '}' AS line FROM pages""")
def ndjson_rows(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id", F.to_json(F.struct(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").alias("chars"))).alias("line")
    )


def _graph(spark, sf_dir):
    """Links among events: each leads to three others of its site."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("site"), F.col("event_id").alias("source"), "value")
    to = F.explode(F.array(*[F.pmod(F.col("source") * k + 1, F.lit(1000)) for k in (2, 3, 7)]))
    return rows.select("site", "source", to.alias("target"), F.round("value", 2).alias("score"))


@PACK.query()
def crawl_rounds(spark, sf_dir):
    """Four rounds of a best-first crawl, three pages a round and site."""
    seeds = spark.createDataFrame([(s, 1) for s in range(5)], "site long, node long")
    return crawl.crawl_rounds(_graph(spark, sf_dir), seeds, 3, 4)
