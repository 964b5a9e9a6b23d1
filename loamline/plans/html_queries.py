"""Queries over the markup of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import html, urls
from loamline.plans.tables import Pack, read
from loamline.plans.url_queries import host, p

PACK = Pack()


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def unescaped(x: str) -> str:
    for k, v in html.ENTITIES.items():
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return x


def visible(x: str) -> str:
    return collapsed(f"regexp_replace(regexp_replace({x}, '{html.SCRIPTS}', ' ', 'g'), '<[^>]*>', ' ', 'g')")


def plain(x: str) -> str:
    return collapsed(unescaped(visible(x)))


Q = html.ANCHOR.replace("'", "''")
HREFS, LABELS = f"regexp_extract_all(html, '{Q}', 1)", f"regexp_extract_all(html, '{Q}', 2)"


def pages(spark, sf_dir):
    return read(spark, sf_dir, "pages")


@PACK.query(f"SELECT page_id, {visible('html')} AS text, CAST(length({visible('html')}) AS INTEGER) AS n_chars FROM pages")
def page_visible_text(spark, sf_dir):
    text = html.visible_text(F.col("html"))
    return pages(spark, sf_dir).select("page_id", text.alias("text"), F.length(text).alias("n_chars"))


@PACK.query(f"SELECT page_id, {plain('html')} AS text FROM pages")
def page_plain_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.plain_text(F.col("html")).alias("text"))


@PACK.query(
    f"""SELECT page_id, CAST(length({visible('html')}) AS INTEGER) AS all_chars, CAST(length(t) AS INTEGER) AS kept_chars,
      length({visible('html')}) >= 400 AND length(t) < 0.9 * length({visible('html')}) AS wider, length({visible('html')}) >= 400 AND length(t) < 0.5 * length({visible('html')}) AS collapsed
    FROM (SELECT page_id, html, {collapsed(f"regexp_replace(regexp_replace(html, '{html.CHROME}', ' ', 'g'), '<[^>]*>', ' ', 'g')")} AS t FROM pages)"""
)
def page_text_without_chrome(spark, sf_dir):
    """Visible characters with and without page furniture, and what the share says about an extraction of that size."""
    a, k = F.length(html.visible_text(F.col("html"))), F.length(html.text_without_chrome(F.col("html")))
    rows = pages(spark, sf_dir).select("page_id", a.alias("all_chars"), k.alias("kept_chars"))
    enough = F.col("all_chars") >= 400
    return rows.select(
        "page_id", "all_chars", "kept_chars", (enough & (F.col("kept_chars") < 0.9 * F.col("all_chars"))).alias("wider"),
        (enough & (F.col("kept_chars") < 0.5 * F.col("all_chars"))).alias("collapsed"),
    )


@PACK.query(
    f"""SELECT page_id, {collapsed(unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
      lower(regexp_extract(html, '(?is)<html\\b[^>]*\\blang\\s*=\\s*["'']([^"'']*)["'']', 1)) AS lang,
      {unescaped('''regexp_extract(html, '(?is)<meta\\b[^>]*\\b(?:name|property)\\s*=\\s*["'']description["''][^>]*\\bcontent\\s*=\\s*["'']([^"'']*)["'']', 1)''')} AS description,
      lower(regexp_extract(html, '(?is)<meta\\b[^>]*\\bcharset\\s*=\\s*["'']?([A-Za-z0-9_-]+)', 1)) AS charset
    FROM pages"""
)
def page_metadata(spark, sf_dir):
    h = F.col("html")
    return pages(spark, sf_dir).select(
        "page_id", html.title(h).alias("title"), html.language(h).alias("lang"), html.meta(h, "description").alias("description"),
        F.lower(F.regexp_extract(h, r"""(?is)<meta\b[^>]*\bcharset\s*=\s*["']?([A-Za-z0-9_-]+)""", 1)).alias("charset"),
    )


_CLASS = f"""CASE WHEN NOT regexp_matches(target, '^https?://') THEN 'other' WHEN {host('target')} <> {host('url')} THEN 'external'
  WHEN href LIKE '#%' THEN 'fragment' ELSE 'internal' END"""
_TARGET = f"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN {p(1)} || ':' || href
  WHEN starts_with(href, '/') THEN {p(1)} || '://' || {p(2)} || href WHEN starts_with(href, '#') THEN {p(1)} || '://' || {p(2)} || {p(3)} || {p(4)} || href
  WHEN starts_with(href, '?') THEN {p(1)} || '://' || {p(2)} || {p(3)} || href
  ELSE {p(1)} || '://' || {p(2)} || CASE WHEN {p(3)} = '' THEN '/' ELSE regexp_replace({p(3)}, '[^/]*$', '') END || href END"""
_LINKS = f"""SELECT page_id, url, pos, target, label, {_CLASS} AS kind FROM (
  SELECT page_id, url, pos, label, href, {_TARGET} AS target FROM (
    SELECT page_id, url, CAST(i - 1 AS INTEGER) AS pos, {unescaped('h[i]')} AS href, {plain('l[i]')} AS label
    FROM (SELECT page_id, url, h, l, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, {HREFS} AS h, {LABELS} AS l FROM pages))))"""


def links(spark, sf_dir):
    """A row per anchor: its place, absolute target, label and kind."""
    rows = pages(spark, sf_dir).select("page_id", "url", F.posexplode(html.anchors(F.col("html"))).alias("pos", "a"))
    rows = rows.select("page_id", "url", "pos", F.col("a.href").alias("href"), F.col("a.label").alias("label"))
    rows = rows.withColumn("target", urls.resolve(F.col("url"), F.col("href")))
    kind = (
        F.when(~F.col("target").rlike("^https?://"), "other").when(urls.host(F.col("target")) != urls.host(F.col("url")), "external")
        .when(F.col("href").startswith("#"), "fragment").otherwise("internal")
    )
    return rows.withColumn("kind", kind)


@PACK.query(f"SELECT page_id, pos, target, label, kind FROM ({_LINKS})")
def page_links_classified(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", "pos", "target", "label", "kind")


@PACK.query(
    f"""SELECT page_id, target, min(pos) AS first_pos, count(*) AS n, arg_min(label, pos) AS label FROM
    (SELECT page_id, pos, label, regexp_replace(target, '#.*$', '') AS target FROM ({_LINKS}) WHERE kind = 'internal') GROUP BY ALL"""
)
def page_links_distinct(spark, sf_dir):
    """Internal links of each page once, at their first place."""
    rows = links(spark, sf_dir).where("kind = 'internal'").withColumn("target", F.regexp_replace("target", "#.*$", ""))
    return rows.groupBy("page_id", "target").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.min_by("label", "pos").alias("label"))


@PACK.query(
    f"""SELECT page_id, string_agg('* [' || substr(label, 1, 160) || '](' || target || ')', chr(10) ORDER BY pos) AS markdown FROM ({_LINKS}) WHERE pos < 200 GROUP BY page_id"""
)
def page_link_list_markdown(spark, sf_dir):
    line = F.concat(F.lit("* ["), F.substring("label", 1, 160), F.lit("]("), F.col("target"), F.lit(")"))
    rows = links(spark, sf_dir).where("pos < 200").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return rows.select("page_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


@PACK.query(
    rf"""SELECT page_id, CAST(length({visible('html')}) AS INTEGER) AS text_chars, CAST(len(regexp_extract_all(html, '(?i)<script\b')) AS INTEGER) AS n_scripts,
      CAST(len({HREFS}) AS INTEGER) AS n_links, regexp_matches(html, '(?i)id=["''](root|app|__next|__nuxt)["'']') AS app_root,
      CAST(coalesce(list_sum(list_transform({LABELS}, lambda x: length({plain('x')}))), 0) AS INTEGER) AS link_chars FROM pages"""
)
def page_signals(spark, sf_dir):
    h = F.col("html")
    chars = F.aggregate(F.transform(html.anchors(h), lambda a: F.length(a["label"])), F.lit(0), lambda s, x: s + x)
    return pages(spark, sf_dir).select(
        "page_id", F.length(html.visible_text(h)).alias("text_chars"), F.regexp_count(h, F.lit(r"(?i)<script\b")).alias("n_scripts"),
        F.size(html.anchors(h)).alias("n_links"), h.rlike(r"""(?i)id=["'](root|app|__next|__nuxt)["']""").alias("app_root"), chars.alias("link_chars"),
    )


@PACK.query(
    rf"""SELECT page_id, CAST(len(list_filter(regexp_extract_all(regexp_replace(html, '{html.CHROME}', ' ', 'g'), '{Q}', 1), lambda x: starts_with(x, '/') AND length(x) > 1)) AS INTEGER) AS n FROM pages"""
)
def page_content_links(spark, sf_dir):
    """Root-relative links outside the page's furniture."""
    body = F.regexp_replace("html", html.CHROME, " ")
    hrefs = F.regexp_extract_all(body, F.lit(html.ANCHOR), F.lit(1))
    return pages(spark, sf_dir).select("page_id", F.size(F.filter(hrefs, lambda x: x.startswith("/") & (F.length(x) > 1))).alias("n"))


_ITEMS = rf"""list_filter(list_transform(regexp_extract_all(html, '(?is)<[uo]l\b[^>]*>(.*?)</[uo]l>', 1),
  lambda x: list_transform(regexp_extract_all(x, '(?is)<li\b[^>]*>(.*?)</li>', 1), lambda y: {plain('y')})[1:30]), lambda x: len(x) >= 3)[1:10]"""


@PACK.query(f"SELECT page_id, CAST(len(l) AS INTEGER) AS n_lists, array_to_string(l[1], ' / ') AS first_list FROM (SELECT page_id, {_ITEMS} AS l FROM pages)")
def page_lists(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", html.list_items(F.col("html")).alias("l"))
    return rows.select("page_id", F.size("l").alias("n_lists"), F.array_join(F.get("l", F.lit(0)), " / ").alias("first_list"))


@PACK.query(
    rf"""SELECT page_id, list_distinct(list_filter([CASE WHEN own <> '' THEN own ELSE late END], lambda x: x <> ''))[1] AS image FROM
    (SELECT page_id, regexp_extract(t, '(?i)(?:^|\s)src\s*=\s*["'']([^"'']*)["'']', 1) AS own, regexp_extract(t, '(?i)\bdata-src\s*=\s*["'']([^"'']*)["'']', 1) AS late
     FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ' alt="x" src="/i/' || page_id || '.png"' ELSE ' data-src="/late/' || page_id || '.png"' END AS t FROM pages))"""
)
def page_images(spark, sf_dir):
    """First image of each page, with an image put into the markup (own source, or a deferred one)."""
    even = F.concat(F.lit('<img alt="x" src="/i/'), F.col("page_id").cast("string"), F.lit('.png">'))
    odd = F.concat(F.lit('<img data-src="/late/'), F.col("page_id").cast("string"), F.lit('.png">'))
    h = F.concat(F.col("html"), F.when(F.col("page_id") % 2 == 0, even).otherwise(odd))
    return pages(spark, sf_dir).select("page_id", F.get(html.images(h), F.lit(0)).alias("image"))


@PACK.query(
    f"""SELECT prefix, count(*) AS n_links, count(DISTINCT target) AS n_targets FROM (SELECT target, regexp_extract(target, '^(https?://[^/]*/[^/]*)', 1) AS prefix
    FROM ({_LINKS}) WHERE kind = 'internal') GROUP BY prefix HAVING count(DISTINCT target) >= 2 ORDER BY n_targets DESC, length(prefix), prefix LIMIT 20"""
)
def link_group_suggestions(spark, sf_dir):
    """Groups of internal links by the beginning of their address, those with most targets first."""
    rows = links(spark, sf_dir).where("kind = 'internal'").select("target", F.regexp_extract("target", "^(https?://[^/]*/[^/]*)", 1).alias("prefix"))
    groups = rows.groupBy("prefix").agg(F.count("*").alias("n_links"), F.countDistinct("target").alias("n_targets")).where("n_targets >= 2")
    return groups.orderBy(F.col("n_targets").desc(), F.length("prefix"), "prefix").limit(20)


@PACK.query(
    rf"""SELECT page_id, CASE WHEN regexp_matches(lower(t), 'checking your browser|are you a robot|enable cookies') AND length(t) <= 1500 THEN 'bot_wall'
      WHEN length(html) >= 2000 AND length(t) < 200 THEN 'js_shell' WHEN n_links >= 5 AND link_chars * 2 >= length(t) THEN 'list'
      WHEN regexp_matches(html, '(?i)<article\b') AND length(t) >= 200 THEN 'article' ELSE 'unknown' END AS page_type
    FROM (SELECT page_id, html, {visible('html')} AS t, len({HREFS}) AS n_links, coalesce(list_sum(list_transform({LABELS}, lambda x: length({plain('x')}))), 0) AS link_chars FROM pages)"""
)
def page_type(spark, sf_dir):
    """Kind of page by its visible text, links and markup; the first rule that holds decides."""
    h, t = F.col("html"), F.col("t")
    chars = F.aggregate(F.transform(html.anchors(h), lambda a: F.length(a["label"])), F.lit(0), lambda s, x: s + x)
    rows = pages(spark, sf_dir).select("page_id", "html", html.visible_text(h).alias("t"), F.size(html.anchors(h)).alias("n_links"), chars.alias("link_chars"))
    kind = (
        F.when(F.lower(t).rlike("checking your browser|are you a robot|enable cookies") & (F.length(t) <= 1500), "bot_wall")
        .when((F.length("html") >= 2000) & (F.length(t) < 200), "js_shell")
        .when((F.col("n_links") >= 5) & (F.col("link_chars") * 2 >= F.length(t)), "list")
        .when(h.rlike(r"(?i)<article\b") & (F.length(t) >= 200), "article").otherwise("unknown")
    )
    return rows.select("page_id", kind.alias("page_type"))
