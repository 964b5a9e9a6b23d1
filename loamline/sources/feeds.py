"""Rows from the bodies of JSON and XML services, feeds, sitemaps, robots files and delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.dates import iso8601, rfc822
from loamline.functions.html import plain_text
from loamline.functions.urls import part, resolve

#: The shape of a result list in each JSON dialect: the path of the rows and the fields of title, address and text.
DIALECTS = {
    "items": ("struct<items:array<struct<title:string,link:string,snippet:string>>>", "items", "title", "link", "snippet"),
    "results": ("struct<results:array<struct<title:string,url:string,content:string>>>", "results", "title", "url", "content"),
    "web": ("struct<web:struct<results:array<struct<title:string,url:string,description:string>>>>", "web.results", "title", "url", "description"),
    "hits": ("struct<hits:array<struct<title:string,url:string,story_text:string>>>", "hits", "title", "url", "story_text"),
    "works": ("struct<message:struct<items:array<struct<title:string,URL:string,abstract:string>>>>", "message.items", "title", "URL", "abstract"),
}


def json_results(df: DataFrame, body: str, dialect: str) -> DataFrame:
    """The columns of ``df`` but the body, and place, title, url, snippet of every row of its result list; a bad body has none."""
    schema, path, title, url, snippet = DIALECTS[dialect]
    rows = df.withColumn("__b", F.from_json(body, schema, {"mode": "PERMISSIVE"})).select(
        *[c for c in df.columns if c != body], F.posexplode(F.col(f"__b.{path}")).alias("place", "__r")
    )
    kept = [c for c in df.columns if c != body]
    return rows.select(*kept, "place", *[F.col(f"__r.{c}").alias(n) for c, n in ((title, "title"), (url, "url"), (snippet, "snippet"))])


def abstract(index: Column) -> Column:
    """Text of an inverted index (word to places), in the order of the places, 400 characters."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.substring(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), 1, 400)


_ITEM = "title:string,link:string,description:string,pubDate:string,published:string,date:string"
_ENTRY = "title:string,link:array<struct<_href:string>>,summary:string,content:string,published:string,updated:string,date:string"
#: RSS 2.0 (channel with its items), RDF (items beside the channel) and Atom (entries), without their name spaces.
FEED = f"struct<channel:struct<title:string,item:array<struct<{_ITEM}>>>,item:array<struct<{_ITEM}>>,entry:array<struct<{_ENTRY}>>,_corrupt_record:string>"


def _feed(body: Column) -> Column:
    return F.from_xml(body, F.lit(FEED), {"ignoreNamespace": "true"})


def _rows(f: Column) -> Column:
    """title, link, summary and date of the entries of an Atom feed, else of the items of the other kinds."""
    first = lambda *c: F.coalesce(*[F.when(x != "", x) for x in c])
    items = F.concat(*[F.coalesce(x, F.array().cast(f"array<struct<{_ITEM}>>")) for x in (f["channel"]["item"], f["item"])])
    items = F.transform(items, lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["description"].alias("summary"), first(i["pubDate"], i["published"], i["date"]).alias("date")))

    def read(e: Column) -> Column:
        hrefs = F.filter(F.transform(e["link"], lambda x: x["_href"]), lambda h: h != "")
        link = F.when(F.size(hrefs) > 0, F.element_at(hrefs, -1)).otherwise("")
        return F.struct(e["title"].alias("title"), link.alias("link"), first(e["summary"], e["content"]).alias("summary"), first(e["published"], e["updated"], e["date"]).alias("date"))

    return F.when(f["entry"].isNotNull(), F.transform(f["entry"], read)).otherwise(items)


def feed_items(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, place, title, link, published, summary (500 characters), truncated: dated items newest first, then undated in order.

    RSS 2.0, RDF and Atom; dates as RFC 822 or ISO, UTC where they name no zone. A null or broken body has no rows.
    """
    rows = df.select(key, _feed(F.col(body)).alias("f")).select(key, F.posexplode(_rows(F.col("f"))).alias("pos", "i"))
    when = F.coalesce(rfc822(F.col("i.date")), iso8601(F.col("i.date")))
    rows = rows.select(key, "pos", "i.title", "i.link", when.alias("published"), F.substring("i.summary", 1, 500).alias("summary"), (F.length("i.summary") > 500).alias("truncated"))
    order = Window.partitionBy(key).orderBy(F.col("published").desc_nulls_last(), "pos")
    return rows.withColumn("place", F.row_number().over(order)).drop("pos")


def feed_report(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, n_items, outcome of every source: 'ok', 'empty', or 'error' for a body that is null or broken, so that none vanishes."""
    n = F.coalesce(F.size(_rows(F.col("f"))), F.lit(0))
    bad = F.col(body).isNull() | F.col("f").isNull() | F.col("f._corrupt_record").isNotNull()
    rows = df.select(key, body, _feed(F.col(body)).alias("f")).select(key, F.when(bad, 0).otherwise(n).alias("n_items"), bad.alias("bad"))
    return rows.select(key, "n_items", F.when(F.col("bad"), "error").when(F.col("n_items") > 0, "ok").otherwise("empty").alias("outcome"))


def newer_items(items: DataFrame, since: Column) -> DataFrame:
    """Items not shown to be older: undated ones stay."""
    return items.where(F.col("published").isNull() | (F.col("published") >= since))


def sitemap_urls(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, place, loc, lastmod of a urlset, in document order."""
    rows = df.select(key, F.from_xml(body, F.lit("struct<url:array<struct<loc:string,lastmod:string>>>")).alias("s"))
    return rows.select(key, F.posexplode("s.url").alias("place", "u")).select(key, "place", F.trim("u.loc").alias("loc"), F.trim("u.lastmod").alias("lastmod"))


def sitemap_children(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, place, loc of the sitemaps that an index names, in document order; other documents have none."""
    index = F.regexp_extract(body, r"<(?:[A-Za-z0-9_.-]+:)?(urlset|sitemapindex)[\s/>]", 1) == "sitemapindex"
    rows = df.where(index).select(key, F.from_xml(body, F.lit("struct<sitemap:array<struct<loc:string>>>"), {"ignoreNamespace": "true"}).alias("s"))
    rows = rows.select(key, F.posexplode("s.sitemap").alias("place", "m")).select(key, "place", F.trim("m.loc").alias("loc"))
    return rows.where(F.col("loc") != "")


# Types of declared feeds, usual places of undeclared ones, and how many are tried.
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/feed+json"]
FEED_PATHS = ["/feed", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml"]
PROBES, FEED_ANCHORS = 3, 2


def declared_feeds(html: Column, base: Column) -> Column:
    """Addresses of a page's alternates of a feed's type, distinct, in page order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    kinds = "|".join(t.replace("+", r"\+") for t in FEED_TYPES)
    tags = F.filter(tags, lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?alternate\b""") & t.rlike(rf"""(?i)\btype\s*=\s*["']?(?:{kinds})(?![A-Za-z0-9+.-])"""))
    links = F.transform(tags, lambda t: F.trim(F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']([^"']+)["']""", 1)))
    links = F.filter(links, lambda h: (h != "") & ~h.rlike("^(?:javascript|data):"))
    return F.array_distinct(F.transform(links, lambda h: resolve(base, h)))


def named_feeds(html: Column, base: Column) -> Column:
    """The first two links within the page's host that a feed's word names, by path or label."""
    anchor = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("label"))
    pairs = F.filter(pairs, lambda a: (F.trim(a["href"]) != "") & ~F.trim(a["href"]).rlike("^(?:#|javascript:|mailto:|data:)"))
    pairs = F.transform(pairs, lambda a: F.struct(resolve(base, F.trim(a["href"])).alias("url"), a["label"].alias("label")))
    own = F.filter(pairs, lambda a: a["url"].rlike("^https?://") & (_host(a["url"]) == _host(base)))
    named = F.filter(own, lambda a: part(a["url"], 3).rlike(r"(?i)(?:^|[/._-])(?:rss|atom|feed)(?:[/._-]|$)") | plain_text(a["label"]).rlike(r"(?i)\b(?:rss|atom|feed)\b"))
    return F.slice(F.array_distinct(F.transform(named, lambda a: a["url"])), 1, FEED_ANCHORS)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 2), "^(?:[^@]*@)?([^:]*)", 1))


def feed_probes(html: Column, url: Column) -> Column:
    """What to try for a page's feed: declared and named ones; usual places only on a front page that declares none."""
    declared, named = declared_feeds(html, url), named_feeds(html, url)
    front = part(url, 3).isin("", "/") & (part(url, 2) != "")
    usual = F.array(*[F.concat(part(url, 1), F.lit("://"), part(url, 2), F.lit(p)) for p in FEED_PATHS])
    guesses = F.when(F.size(declared) > 0, F.concat(declared, named)).otherwise(F.concat(named, F.when(front, usual).otherwise(F.array().cast("array<string>"))))
    return F.slice(guesses, 1, PROBES)


def robots_rules(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, agent, place, allow, path: a row per rule and agent that it stands for."""
    lines = df.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", "")))
    field = F.lower(F.trim(F.regexp_extract("line", "^([A-Za-z-]+)[ ]*:", 1)))
    lines = lines.select(key, "pos", field.alias("field"), F.trim(F.regexp_extract("line", "^[A-Za-z-]+[ ]*:(.*)$", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy(key).orderBy("pos")
    starts = (F.col("field") == "user-agent") & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    lines = lines.withColumn("starts", starts.cast("int"))
    lines = lines.withColumn("block", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    agents = lines.where("field = 'user-agent'").select(key, "block", F.lower("value").alias("agent"))
    rules = lines.where("field <> 'user-agent' and value <> ''").select(key, "block", "pos", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, [key, "block"]).select(key, "agent", F.col("pos").alias("place"), "allow", "path")


def robots_verdicts(paths: DataFrame, rules: DataFrame, key: str, agent: str) -> DataFrame:
    """key, path, allowed: the longest rule of the agent (else of *) that the path begins with decides; without one it is allowed."""
    mine = rules.where(F.col("agent") == agent)
    named = mine.select(key).distinct().withColumn("named", F.lit(True))
    others = rules.where("agent = '*'").join(named, key, "left_anti")
    chosen = mine.unionByName(others).select(key, F.col("path").alias("rule"), "allow")
    met = paths.join(chosen, key, "left").withColumn("hit", F.col("path").startswith(F.col("rule")))
    best = F.max_by("allow", F.struct(F.length("rule"), "allow"))
    return met.where(F.col("hit")).groupBy(key, "path").agg(best.alias("allowed")).join(paths.select(key, "path").distinct(), [key, "path"], "right").select(
        key, "path", F.coalesce("allowed", F.lit(True)).alias("allowed")
    )


def robots_sitemaps(df: DataFrame, key: str, body: str) -> DataFrame:
    lines = df.select(key, F.explode(F.split(body, r"\r?\n")).alias("line")).where(F.col("line").rlike("(?i)^sitemap:"))
    return lines.select(key, F.trim(F.substring_index("line", ":", -2)).alias("sitemap")).where(F.col("sitemap").rlike("^https?://")).distinct()


def markdown_table(header: Column, rows: Column) -> Column:
    """A Markdown table of an array of rows, all padded to the widest."""
    wide = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(pad(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")
