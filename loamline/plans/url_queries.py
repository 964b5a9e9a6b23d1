"""Queries over the addresses of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import urls
from loamline.plans.tables import Pack, read

PACK = Pack()
U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"


def p(k: int, u: str = "url") -> str:
    return f"regexp_extract(trim({u}), {U}, {k})"


def host(u: str = "url") -> str:
    return f"lower(regexp_extract({p(2, u)}, '^(?:[^@]*@)?([^:]*)', 1))"


def bare(u: str = "url") -> str:
    return rf"regexp_replace({host(u)}, '^www\.', '')"


def kept(names: list[str], prefixed: bool) -> str:
    name = "lower(split_part(kv, '=', 1))"
    drop = f"{name} IN ({', '.join(repr(n) for n in names)})" + (f" OR starts_with({name}, 'utm_')" if prefixed else "")
    q = f"array_to_string(list_filter(string_split(substr({p(4)}, 2), '&'), lambda kv: kv <> '' AND NOT ({drop})), '&')"
    return f"CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"


SEARCH_KEY = rf"""(lower({p(1)}) || '://' || CASE WHEN {p(2)} LIKE '%@%' THEN lower({p(2)}) ELSE
  (CASE WHEN regexp_matches(regexp_extract(lower({p(2)}), '^([^:]*)', 1), '^www\.[^.]+\.') THEN substr(regexp_extract(lower({p(2)}), '^([^:]*)', 1), 5)
    ELSE regexp_extract(lower({p(2)}), '^([^:]*)', 1) END)
  || CASE WHEN regexp_extract({p(2)}, ':([0-9]+)$', 1) = '' OR (lower({p(1)}) = 'http' AND regexp_extract({p(2)}, ':([0-9]+)$', 1) = '80')
    OR (lower({p(1)}) = 'https' AND regexp_extract({p(2)}, ':([0-9]+)$', 1) = '443') THEN '' ELSE ':' || regexp_extract({p(2)}, ':([0-9]+)$', 1) END END
  || CASE WHEN length({p(3)}) > 1 THEN regexp_replace({p(3)}, '/+$', '') ELSE {p(3)} END || {kept(urls.SEARCH_TRACKING, True)})"""

CRAWL_KEY = rf"""(lower({p(1)}) || '://' || CASE lower({p(1)}) WHEN 'http' THEN regexp_replace(lower({p(2)}), ':80$', '')
  WHEN 'https' THEN regexp_replace(lower({p(2)}), ':443$', '') ELSE lower({p(2)}) END
  || CASE WHEN {p(3)} = '' THEN '/' WHEN length({p(3)}) > 1 THEN regexp_replace({p(3)}, '/+$', '') ELSE {p(3)} END || {kept(urls.CRAWL_TRACKING, False)})"""


@PACK.query(f"SELECT page_id, {SEARCH_KEY} AS url_key FROM pages")
def url_search_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.search_key(F.col("url")).alias("url_key"))


@PACK.query(f"SELECT page_id, {CRAWL_KEY} AS url_key FROM pages")
def url_crawl_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.crawl_key(F.col("url")).alias("url_key"))


@PACK.query(f"SELECT page_id, {bare()} || regexp_replace({p(3)}, '/+$', '') AS page_key FROM pages")
def url_page_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.page_key(F.col("url")).alias("page_key"))


@PACK.query(
    f"""SELECT url_key, min(page_id) AS first_page, count(*) AS n_variants, count(DISTINCT h) AS n_hosts, arg_min(url, page_id) AS url
    FROM (SELECT page_id, url, {SEARCH_KEY} AS url_key, {host()} AS h FROM pages) GROUP BY url_key"""
)
def url_dedup_first_seen(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url", urls.search_key(F.col("url")).alias("url_key"), urls.host(F.col("url")).alias("h"))
    return rows.groupBy("url_key").agg(
        F.min("page_id").alias("first_page"), F.count("*").alias("n_variants"), F.countDistinct("h").alias("n_hosts"),
        F.min_by("url", "page_id").alias("url"),
    )


@PACK.query(
    f"""SELECT page_id, {host()} AS host, {bare()} AS bare_host, CASE WHEN len(l) <= 2 OR len(list_filter(l, lambda x: NOT regexp_matches(x, '^[0-9]+$'))) = 0 THEN {bare()}
      WHEN l[-2] || '.' || l[-1] IN ({', '.join(repr(s) for s in urls.TWO_LABEL_SUFFIXES)}) THEN l[-3] || '.' || l[-2] || '.' || l[-1]
      ELSE l[-2] || '.' || l[-1] END AS domain
    FROM (SELECT page_id, url, string_split({bare()}, '.') AS l FROM pages)"""
)
def url_domains(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", urls.host(u).alias("host"), urls.bare_host(u).alias("bare_host"), urls.registrable_domain(u).alias("domain")
    )


@PACK.query(
    f"""SELECT page_id, url FROM pages WHERE ({host()} = 'example.com' OR ends_with({host()}, '.example.com'))
    AND NOT ({host()} = 'blog.tionble.example.com' OR {host()} LIKE 'm.%')"""
)
def url_site_filter(spark, sf_dir):
    h = urls.host(F.col("url"))
    rows = read(spark, sf_dir, "pages").where(urls.within(h, F.lit("example.com")))
    return rows.where(~(urls.within(h, F.lit("blog.tionble.example.com")) | h.startswith("m."))).select("page_id", "url")


@PACK.query(
    rf"""SELECT page_id, path, regexp_replace(path, '^/[a-z]{{2}}(-[A-Z]{{2}})?(/|$)', '/') AS folded, regexp_extract(path, '^/([a-z]{{2}}(-[A-Z]{{2}})?)(/|$)', 1) AS locale,
      ((path = '/en' OR starts_with(path, '/en/')) OR (path = '/fr' OR starts_with(path, '/fr/'))) AND NOT (path = '/fr/825' OR starts_with(path, '/fr/825/')) AS allowed
    FROM (SELECT page_id, CASE WHEN starts_with(q, '/') THEN q ELSE '/' || q END AS path FROM (SELECT page_id, regexp_replace({p(3)}, '/+$', '') AS q FROM pages))"""
)
def url_path_scope(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", urls.path_of(F.col("url")).alias("path"))
    path = F.col("path")
    return rows.select(
        "page_id", "path", urls.without_locale(path).alias("folded"), urls.locale_of(path).alias("locale"),
        urls.path_allowed(path, ["/en", "/fr"], ["/fr/825"]).alias("allowed"),
    )


@PACK.query(
    f"""SELECT segment, count(*) AS n, count(*) * 2 >= (SELECT count(*) FROM pages) AS half FROM
    (SELECT split_part(regexp_replace({p(3)}, '^/', ''), '/', 1) AS segment FROM pages) GROUP BY segment HAVING count(*) >= 3"""
)
def url_scope_hint(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.substring_index(F.regexp_replace(urls.part(F.col("url"), 3), "^/", ""), "/", 1).alias("segment"))
    counted = rows.groupBy("segment").agg(F.count("*").alias("n")).where("n >= 3")
    return counted.select("segment", "n", (F.col("n") * 2 >= rows.count()).alias("half"))


@PACK.query(
    f"""SELECT page_id, l[1] AS kind, CASE WHEN regexp_matches(l[2], '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l[2]
      WHEN starts_with(l[2], '//') THEN {p(1)} || ':' || l[2]
      WHEN starts_with(l[2], '/') THEN {p(1)} || '://' || {p(2)} || l[2]
      WHEN starts_with(l[2], '#') THEN {p(1)} || '://' || {p(2)} || {p(3)} || {p(4)} || l[2]
      WHEN starts_with(l[2], '?') THEN {p(1)} || '://' || {p(2)} || {p(3)} || l[2]
      ELSE {p(1)} || '://' || {p(2)} || CASE WHEN {p(3)} = '' THEN '/' ELSE regexp_replace({p(3)}, '[^/]*$', '') END || l[2] END AS target
    FROM pages, (SELECT unnest([['a', '/x/y?z=1'], ['b', '//cdn.example.org/k'], ['c', 'https://other.example/p'], ['d', 'page.html'], ['e', '#part'], ['f', '?q=2'], ['g', 'mailto:a@b.c']]) AS l)"""
)
def url_resolve(spark, sf_dir):
    links = [("a", "/x/y?z=1"), ("b", "//cdn.example.org/k"), ("c", "https://other.example/p"), ("d", "page.html"), ("e", "#part"), ("f", "?q=2"), ("g", "mailto:a@b.c")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("link")) for k, v in links])).alias("l")
    rows = read(spark, sf_dir, "pages").select("page_id", "url", each)
    return rows.select("page_id", F.col("l.kind").alias("kind"), urls.resolve(F.col("url"), F.col("l.link")).alias("target"))


@PACK.query("SELECT page_id, url AS from_news, url AS from_click, url AS from_segment FROM pages")
def url_redirect_targets(spark, sf_dir):
    """Links made of each page's address in the three redirect forms, and unwrapped again."""
    u = F.col("url")
    news = F.concat(F.lit("http://news.example/apiclick?ref=1&url="), F.url_encode(u), F.lit("&c=7"))
    code = F.regexp_replace(F.translate(F.base64(F.encode(u, "UTF-8")), "+/", "-_"), "=|\\s", "")
    click = F.concat(F.lit("https://search.example/ck/a?p=9&u=a1"), code, F.lit("&ntb=1"))
    segment = F.concat(F.lit("https://r.search.example/x/RU="), F.url_encode(u), F.lit("/RK=2/"))
    return read(spark, sf_dir, "pages").select(
        "page_id", urls.news_target(news).alias("from_news"), urls.click_target(click).alias("from_click"), urls.segment_target(segment).alias("from_segment")
    )


@PACK.query(
    rf"""SELECT page_id, array_to_string(list_filter([CASE WHEN len(l) >= 5 THEN 'many_labels' END, CASE WHEN length(h) - length(replace(h, '-', '')) >= 4 THEN 'many_hyphens' END,
      CASE WHEN len(list_filter(l, lambda x: starts_with(x, 'xn--'))) > 0 THEN 'punycode' END, CASE WHEN regexp_matches(h, '^[0-9]+(\.[0-9]+){{3}}$') THEN 'ip_literal' END,
      CASE WHEN port <> '' AND port NOT IN ('80', '443', '8080') THEN 'odd_port' END], lambda x: x IS NOT NULL), ',') AS flags,
      len(list_filter(l, lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))) >= 2 OR (length(l[1]) >= 10 AND regexp_matches(l[1], '^[a-z]+[0-9]+[a-z]')) AS farm
    FROM (SELECT page_id, h, string_split(h, '.') AS l, port FROM (SELECT page_id, {host('v')} AS h, regexp_extract({p(2, 'v')}, ':([0-9]+)$', 1) AS port
      FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://a1b.c2d.x-y-z-q-w.') WHEN 2 THEN 'http://10.0.0.' || (page_id % 200) || ':8081/' ELSE 'https://abcdefgh12kl.xn--b.example/' END AS v FROM pages)))"""
)
def url_shape_flags(spark, sf_dir):
    k, u = F.col("page_id") % 4, F.col("url")
    v = (
        F.when(k == 0, u).when(k == 1, F.replace(u, F.lit("://"), F.lit("://a1b.c2d.x-y-z-q-w.")))
        .when(k == 2, F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 200).cast("string"), F.lit(":8081/"))).otherwise("https://abcdefgh12kl.xn--b.example/")
    )
    rows = read(spark, sf_dir, "pages").select("page_id", v.alias("v"))
    return rows.select("page_id", F.array_join(urls.shape_flags(F.col("v")), ",").alias("flags"), urls.farm_shaped(F.col("v")).alias("farm"))


@PACK.query(
    """SELECT event_id, (n // 16777216) % 256 || '.' || (n // 65536) % 256 || '.' || (n // 256) % 256 || '.' || n % 256 AS ip
    FROM (SELECT event_id, (event_id * 429496 + 12345) % 4294967296 AS n FROM events)"""
)
def url_ip_notation(spark, sf_dir):
    n = F.pmod(F.col("event_id") * 429496 + 12345, F.lit(4294967296))
    name = F.when(F.col("event_id") % 2 == 0, n.cast("string")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(n))))
    return read(spark, sf_dir, "events").select("event_id", urls.dotted_ip(name).alias("ip"))
