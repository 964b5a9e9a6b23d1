"""Queries over the bodies of single services, walls in front of pages, follow-up queries and keys of repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import urls, walls
from loamline.operators import agreement, suggest
from loamline.plans.tables import Pack, read
from loamline.sources import feeds, islands, verticals

PACK = Pack()


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


# -- walls


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SAID = walls.LOGIN_PHRASES + walls.LOGIN_HINTS + walls.PROOF_PHRASES + walls.FAILURE_PHRASES + walls.COUNTRY_PHRASES
_PATHS = walls.LOGIN_PATHS + walls.PROOF_PATHS + ["/read"]
_ERRORS = [e for kind in walls.ERROR_KINDS.values() for e in kind] + ["not_a_pdf: authorization", "http_error_404"]


def _hits(text: str, values: list[str]) -> str:
    return f"len(list_filter({_list(values)}, lambda p: contains({text}, p)))"


_SERVED = "(status = 0 OR status BETWEEN 200 AND 399)"
_KIND = " ".join(
    f"WHEN {' OR '.join(f'''starts_with(error, '{e}')''' for e in begins)}{' OR (starts_with(error, $$not_a_pdf$$) AND contains(error, $$auth$$))' if kind == 'auth_wall' else ''} THEN '{kind}'"
    for kind, begins in walls.ERROR_KINDS.items()
)


@PACK.query(
    f"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 403 END AS status, {_list(_PATHS)}[page_id % {len(_PATHS)} + 1] AS path, {_list(_ERRORS)}[page_id % {len(_ERRORS)} + 1] AS error,
      page_id % 11 = 0 AS paper, trim(lower(CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN 'Please log in. Please sign in. You must be logged in' WHEN 2 THEN {_list(_SAID)}[page_id % {len(_SAID)} + 1] || repeat(' long', 150)
        ELSE ' ' || {_list(_SAID)}[page_id % {len(_SAID)} + 1] END)) AS body FROM pages)
    SELECT page_id, CASE WHEN {_hits('path', walls.LOGIN_PATHS)} > 0 THEN {_hits('body', walls.LOGIN_PHRASES + walls.LOGIN_HINTS)} > 0 ELSE {_hits('body', walls.LOGIN_PHRASES)} >= 3 END AS login,
      {_SERVED} AND length(body) BETWEEN 1 AND {walls.PROOF_CHARS} AND ({_hits('path', walls.PROOF_PATHS)} > 0 OR {_hits('body', walls.PROOF_PHRASES)} > 0) AS proof,
      {_SERVED} AND NOT paper AND length(body) BETWEEN 1 AND {walls.FAILURE_CHARS} AND {_hits('body', walls.FAILURE_PHRASES)} > 0 AS failure, {_hits('body', walls.COUNTRY_PHRASES)} > 0 AS country,
      CASE {_KIND} ELSE '' END AS implied FROM p"""
)
def page_walls(spark, sf_dir):
    """Walls and failures by address, status and text, over raw pages and every phrase in turn, alone and in longer texts."""
    k = F.col("page_id")
    turn = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    status = F.when(k % 3 == 0, F.lit(None).cast("int")).when(k % 3 == 1, 200).otherwise(403)
    text = (
        F.when(k % 5 == 0, F.col("html")).when(k % 5 == 1, "Please log in. Please sign in. You must be logged in")
        .when(k % 5 == 2, F.concat(turn(_SAID), F.repeat(F.lit(" long"), 150))).otherwise(F.concat(F.lit(" "), turn(_SAID)))
    )
    rows = read(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("https://w.example"), F.upper(turn(_PATHS)), F.lit("?next=/x")).alias("url"), status.alias("status"), text.alias("text"),
        F.when(k % 11 == 0, "Application/PDF").alias("type"), turn(_ERRORS).alias("error"),
    )
    return rows.select(
        "page_id", walls.is_login_wall(F.col("url"), F.col("text")).alias("login"), walls.is_proof_wall(F.col("url"), F.col("status"), F.col("text")).alias("proof"),
        walls.is_soft_failure(F.col("status"), F.col("type"), F.col("text")).alias("failure"), walls.asks_country(F.col("text")).alias("country"),
        walls.kind_of_error(F.col("error")).alias("implied"),
    )


# -- services: of ten bodies one is refused and one is no JSON; the rows made up around the real one have no title or no web address


def _plain(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def _cut(x: str) -> str:
    return f"CASE WHEN length({x}) <= 420 THEN {x} ELSE rtrim(substr({x}, 1, 419)) || '…' END"


def _rows_sql(title: str, url: str, snippet: str, day: str, place: int = 2, where: str = "true") -> str:
    return f"""SELECT doc_id, {place}::INTEGER AS place, title, url, {_cut('said')} AS snippet, published FROM (SELECT doc_id, {title} AS title, {url} AS url, {_plain(snippet)} AS said, {day} AS published
      FROM documents WHERE doc_id % 10 > 1 AND {where}) WHERE title <> ''"""


def _bodies(spark, sf_dir, body):
    k = F.col("doc_id") % 10
    sent = F.when(k == 1, "<html>busy</html>").otherwise(F.to_json(body))
    return docs(spark, sf_dir).select("doc_id", "lang", sent.alias("body"), F.when(k == 0, 429).otherwise(200).alias("status"))


def _found(rows, service, language=None):
    return verticals.hits(rows, "body", "status", service, language).drop("lang")


def _three(title, url, /, **real):
    """An array of a row without a title, the real one, and one whose address is none."""
    row = lambda t, u: F.struct(F.lit(t).alias(title) if t else F.lit(None).cast("string").alias(title), F.lit(u).alias(url), *[v.alias(n) for n, v in real.items() if n not in (title, url)])
    return F.array(row("", "https://a.example"), F.struct(real[title].alias(title), real[url].alias(url), *[v.alias(n) for n, v in real.items() if n not in (title, url)]), row("T", "ftp://b.example/x"))


def _id():
    return F.col("doc_id").cast("string")


@PACK.query(_rows_sql(_plain("text"), "'https://n.example/' || doc_id", "concat_ws(' · ', source, lang)", "CASE doc_id % 3 WHEN 0 THEN '2024-02-29' ELSE '' END"))
def service_news(spark, sf_dir):
    day = F.when(F.col("doc_id") % 3 == 0, "20240229T101500Z").when(F.col("doc_id") % 3 == 1, "20230229T101500Z")
    rows = _three("title", "url", title=F.col("text"), url=F.concat(F.lit("https://n.example/"), _id()), domain=F.col("source"), language=F.col("lang"), sourcecountry=F.lit(""), seendate=day)
    return _found(_bodies(spark, sf_dir, F.struct(rows.alias("articles"))), "gdelt")


@PACK.query(
    _rows_sql(_plain("text"), "'https://q.example/' || doc_id", "'score ' || (doc_id % 50 - 9) || ' · ' || (doc_id % 4) || ' answers' || CASE WHEN doc_id % 2 = 0 THEN ' · accepted' ELSE '' END || ' · a, b, ' || lang || ', d'", "'2023-11-14'")
)
def service_questions(spark, sf_dir):
    k, tags = F.col("doc_id"), F.array(F.lit("a"), F.lit("b"), F.col("lang"), F.lit("d"), F.lit("e"))
    rows = _three("title", "link", title=F.col("text"), link=F.concat(F.lit("https://q.example/"), _id()), score=k % 50 - 9, answer_count=k % 4, is_answered=k % 2 == 0, tags=tags, creation_date=F.lit(1_700_000_000))
    return _found(_bodies(spark, sf_dir, F.struct(rows.alias("items"))), "stackexchange")


@PACK.query(
    _rows_sql("'o/' || source || doc_id", "'https://c.example/' || doc_id", f"concat_ws(' · ', '★' || CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id END, CASE WHEN doc_id % 3 > 0 THEN 'Rust' END, 'updated 2024-05-02', nullif(substr({_plain('text')}, 1, 260), ''))", "'2020-01-01'")
)
def service_repositories(spark, sf_dir):
    k = F.col("doc_id")
    rows = _three(
        "full_name", "html_url", full_name=F.concat(F.lit("o/"), "source", _id()), html_url=F.concat(F.lit("https://c.example/"), _id()), stargazers_count=F.when(k % 4 > 0, k),
        language=F.when(k % 3 > 0, "Rust"), description=F.col("text"), updated_at=F.lit("2024-05-02T23:59:59Z"), created_at=F.lit("2020-01-01"),
    )
    return _found(_bodies(spark, sf_dir, F.struct(rows.alias("items"))), "github")


@PACK.query(
    _rows_sql(
        "'S ' || source", "CASE WHEN doc_id % 2 = 0 THEN 'https://news.ycombinator.com/item?id=' || doc_id ELSE 'https://s.example/' || doc_id END",
        f"concat_ws(' · ', 'HN', (doc_id % 300) || ' points', '0 comments', nullif(substr({_plain('text')}, 1, 240), ''))", "CASE doc_id % 3 WHEN 0 THEN '' ELSE '2022-03-01' END",
    )
)
def service_stories(spark, sf_dir):
    k = F.col("doc_id")
    rows = _three(
        "title", "url", title=F.concat(F.lit("<b>S</b> "), "source"), url=F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("https://s.example/"), _id())), objectID=_id(), points=k % 300,
        num_comments=F.lit(None).cast("long"), story_text=F.col("text"), created_at=F.when(k % 3 == 0, "soon").otherwise("2022-02-28T23:30:00-01:00"),
    )
    return _found(_bodies(spark, sf_dir, F.struct(rows.alias("hits"))), "hackernews")


@PACK.query(
    _rows_sql(
        _plain("text"), "CASE doc_id % 3 WHEN 1 THEN 'https://o.example/' || doc_id ELSE 'https://www.reddit.com/r/x/' || doc_id END",
        f"concat_ws(' · ', 'r/' || lang, (doc_id % 9) || ' points', '3 comments', nullif(substr({_plain('text')}, 1, 240), ''))", "'2023-11-14'", where="doc_id % 7 > 1",
    )
)
def service_posts(spark, sf_dir):
    """Posts; those for adults and removed ones are left out, own addresses stand for media of the service."""
    k = F.col("doc_id")
    url = F.when(k % 3 == 0, "self").when(k % 3 == 1, F.concat(F.lit("https://o.example/"), _id())).otherwise("https://i.reddit.com/pic")
    rows = _three(
        "title", "url", title=F.col("text"), url=url, permalink=F.when(F.lit(True), F.concat(F.lit("/r/x/"), _id())), subreddit=F.col("lang"), score=k % 9, num_comments=F.lit(3),
        selftext=F.col("text"), over_18=k % 7 == 0, removed_by_category=F.when(k % 7 == 1, "moderator"), created_utc=F.lit(1_700_000_000.0),
    )
    return _found(_bodies(spark, sf_dir, F.struct(F.slice(rows, 1, 2).alias("data"))), "reddit")


@PACK.query(
    _rows_sql(
        "'A b (c), ' || doc_id || '/ü~*'", "'https://' || lang || '.wikipedia.org/wiki/A_b_(c),_' || doc_id || '/%C3%BC~%2A'",
        f"concat_ws(' · ', nullif({_plain('text')}, ''), CASE WHEN doc_id % 2 = 0 THEN n_chars || ' words' END)", "''", place=1,
    )
)
def service_articles(spark, sf_dir):
    row = F.struct(F.concat(F.lit("A b (c), "), _id(), F.lit("/ü~*")).alias("title"), F.col("text").alias("snippet"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("wordcount"))
    return _found(_bodies(spark, sf_dir, F.struct(F.struct(F.array(row).alias("search")).alias("query"))), "wikipedia", "lang")


@PACK.query(
    _rows_sql(
        "'@s/p-' || doc_id || ' (npm)'", "'https://www.npmjs.com/package/@s/p-' || doc_id",
        f"concat_ws(' · ', 'v1.' || (doc_id % 5), CASE WHEN doc_id % 2 = 0 THEN 'MIT' END, 'updated 2024-07-01', CASE WHEN doc_id % 3 > 0 THEN 'deps=2' END, 'https://g.example/' || doc_id, nullif({_plain('text')}, ''))",
        "'2024-07-01'", place=1,
    )
)
def service_packages(spark, sf_dir):
    """The newest version of a package; its repository as text or as an object, its text of the version or of the whole."""
    k, latest = F.col("doc_id"), F.concat(F.lit("1."), (F.col("doc_id") % 5).cast("string"))
    home = F.concat(F.lit("git+https://g.example/"), _id(), F.lit(".git"))
    version = F.struct(
        F.when(k % 2 == 0, "MIT").alias("license"), F.when(k % 2 == 0, home).alias("repository"), F.when(k % 2 == 0, F.col("text")).alias("description"),
        F.when(k % 3 > 0, F.create_map(F.lit("a"), F.lit("^1"), F.lit("b"), F.lit("*"))).alias("dependencies"),
    )
    body = F.struct(
        F.concat(F.lit("@s/p-"), _id()).alias("name"), F.struct(latest.alias("latest")).alias("dist-tags"), F.create_map(F.when(k % 4 > 0, latest).otherwise("modified"), F.lit("2024-07-01T08:00:00.123Z")).alias("time"),
        F.struct(F.lit("git").alias("type"), home.alias("url")).alias("repository"), F.col("text").alias("description"), F.create_map(latest, version).alias("versions"),
    )
    return _found(_bodies(spark, sf_dir, body), "npm")


@PACK.query(
    """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'blocked' WHEN 1 THEN 'error' WHEN 2 THEN 'empty' WHEN 3 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 10 > 3 THEN 1 + doc_id % 2 ELSE 0 END AS n_rows FROM documents"""
)
def service_reports(spark, sf_dir):
    """What became of each answer: refused, broken, failed, without rows, with rows."""
    k = F.col("doc_id") % 10
    row = F.struct(F.lit("T").alias("title"), F.lit("https://x.example").alias("url"))
    rows = F.when(k == 2, F.array().cast("array<struct<title:string,url:string>>")).otherwise(F.array_repeat(row, (F.col("doc_id") % 2 + 1).cast("int")))
    body = F.when(k == 1, "{broken").otherwise(F.to_json(F.struct(rows.alias("articles"))))
    answers = docs(spark, sf_dir).select("doc_id", body.alias("body"), F.when(k == 0, 403).when(k == 3, 502).otherwise(200).alias("status"))
    return verticals.report(answers, "doc_id", "body", "status", "gdelt")


# -- follow-up queries, keys of repositories


_STOP, _LEAD = _list(suggest.STOP), _list(suggest.LEAD + suggest.STOP)


@PACK.query(
    rf"""WITH RECURSIVE q AS (SELECT lang, lower(arg_min(substr(text, 1, 60), doc_id)) AS q FROM documents GROUP BY lang),
    t AS (SELECT lang, source, string_split_regex(lower(text), '[ \t\n\f\r]+') AS w FROM documents),
    b AS (SELECT lang, source, regexp_extract(w[i], '{suggest.LAST.replace("'", "''")}', 1) AS a, regexp_extract(w[i + 1], '{suggest.FIRST.replace("'", "''")}', 1) AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
    c AS (SELECT lang, a, b, a || ' ' || b AS phrase, count(DISTINCT source) AS n FROM b WHERE a <> '' AND b <> '' AND NOT list_contains({_STOP}, a) AND NOT list_contains({_STOP}, b) GROUP BY ALL HAVING count(DISTINCT source) >= 2),
    k AS (SELECT lang, phrase, a, b, row_number() OVER (PARTITION BY lang ORDER BY n DESC, phrase) AS place
      FROM (SELECT *, regexp_extract_all(q, '{suggest.WORD.replace("'", "''")}') AS known FROM c JOIN q USING (lang)) WHERE NOT list_contains({_LEAD}, a) AND NOT ends_with(a, 'ing')
      AND NOT (list_contains(known, a) AND list_contains(known, b)) AND NOT contains(q, phrase) AND NOT contains(phrase, q)),
    r AS (SELECT lang, 0::BIGINT AS place, []::VARCHAR[] AS kept, []::VARCHAR[] AS seen FROM q
      UNION ALL SELECT r.lang, k.place, CASE WHEN len(list_intersect(list_distinct([a, b]), seen)) < 2 THEN list_append(kept, phrase) ELSE kept END,
        CASE WHEN len(list_intersect(list_distinct([a, b]), seen)) < 2 THEN seen || [a, b] ELSE seen END FROM r JOIN k ON k.lang = r.lang AND k.place = r.place + 1 WHERE len(kept) < 6)
    SELECT lang, array_to_string(arg_max(kept, place), ', ') AS phrases FROM r GROUP BY lang HAVING max(place) > 0"""
)
def related_phrases(spark, sf_dir):
    """Phrases of two sources or more, by language, beside the beginning of the language's first document as the query."""
    rows = docs(spark, sf_dir)
    asked = rows.groupBy("lang").agg(F.min_by(F.substring("text", 1, 60), "doc_id").alias("q"))
    return suggest.related(rows, "lang", "source", ["text"], asked, F.col("q")).select("lang", F.array_join("phrases", ", ").alias("phrases"))


@PACK.query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://github.com/owner' || page_id || '/repo' WHEN 1 THEN 'https://github.com/owner/repo/blob/Main/' || page_id WHEN 2 THEN 'https://github.com/Topics/Spark' || page_id
      WHEN 3 THEN 'https://github.com/Owner' || page_id WHEN 4 THEN 'https://gist.github.com/Owner/Repo' || page_id ELSE 'https://github.com//owner//repo?q=A' || page_id END AS url_key FROM pages"""
)
def url_repository_keys(spark, sf_dir):
    """Owner and repository in lower case, but no other path, host or list page."""
    k, n = F.col("page_id") % 6, F.col("page_id").cast("string")
    url = (
        F.when(k == 0, F.concat(F.lit("https://www.GitHub.com/Owner"), n, F.lit("/Repo/?utm_source=x"))).when(k == 1, F.concat(F.lit("https://github.com:443/OWNER/Repo/blob/Main/"), n))
        .when(k == 2, F.concat(F.lit("https://github.com/Topics/Spark"), n)).when(k == 3, F.concat(F.lit("https://github.com/Owner"), n, F.lit("/")))
        .when(k == 4, F.concat(F.lit("https://gist.github.com/Owner/Repo"), n)).otherwise(F.concat(F.lit("https://github.com//Owner//Repo?q=A"), n))
    )
    return read(spark, sf_dir, "pages").select("page_id", urls.search_key(url).alias("url_key"))


# -- feeds of other kinds, sitemap indexes, where a feed may be, families of engines


@PACK.query(
    r"""WITH t AS (SELECT doc_id, 'x' || regexp_replace(text, '[^A-Za-z0-9 .,]+', ' ', 'g') AS said FROM documents)
    SELECT doc_id, 1 AS place, 'new' AS title, 'https://f.example/' || doc_id AS link, '2024-05-01 22:30' AS published, substr(said, 1, 500) AS summary FROM (SELECT doc_id, rtrim(said) AS said FROM t) WHERE doc_id % 3 < 2
    UNION ALL SELECT doc_id, 2, 'old', CASE doc_id % 3 WHEN 0 THEN '' ELSE 'https://f.example/o' END, '2001-01-01 00:00', 's' FROM documents WHERE doc_id % 3 < 2
    UNION ALL SELECT doc_id, 3, 'undated', CASE doc_id % 3 WHEN 0 THEN '' ELSE 'https://f.example/u' END, NULL, NULL FROM documents WHERE doc_id % 3 < 2"""
)
def feed_entries(spark, sf_dir):
    """Items of Atom and RDF feeds, and none of broken ones."""
    said, k = F.regexp_replace("text", "[^A-Za-z0-9 .,]+", " "), F.col("doc_id") % 3
    atom = F.concat(
        F.lit("<a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:title>T</a:title><a:entry><a:title>undated</a:title></a:entry><a:entry><a:title type='text'>old</a:title><a:summary>s</a:summary><a:updated>2001-01-01</a:updated></a:entry>"),
        F.lit("<a:entry><a:title>new</a:title><a:link href='https://f.example/first'/><a:link rel='alternate' href='https://f.example/"), _id(), F.lit("'/><a:content>x"), said,
        F.lit("</a:content><a:published>2024-05-01T23:30:00+01:00</a:published><a:updated>2025-01-01T00:00:00Z</a:updated></a:entry></a:feed>"),
    )
    rdf = F.concat(
        F.lit("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:dc='http://purl.org/dc/elements/1.1/'><channel rdf:about='x'><title>T</title></channel><item><title>undated</title><link>https://f.example/u</link></item>"),
        F.lit("<item rdf:about='n'><title>new</title><link>https://f.example/"), _id(), F.lit("</link><description>x"), said, F.lit("</description><dc:date>2024-05-01T22:30Z</dc:date></item>"),
        F.lit("<item><title>old</title><link>https://f.example/o</link><description>s</description><dc:date>Mon, 01 Jan 2001 00:00:00 GMT</dc:date></item></rdf:RDF>"),
    )
    body = F.when(k == 0, atom).when(k == 1, rdf).otherwise(F.concat(F.lit("<feed><entry>"), said))
    items = feeds.feed_items(docs(spark, sf_dir).select("doc_id", body.alias("body")), "doc_id", "body")
    return items.select("doc_id", "place", "title", F.coalesce("link", F.lit("")).alias("link"), F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"), "summary")


@PACK.query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id % 3 + 1 ELSE 0 END AS n_items, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' ELSE 'error' END AS outcome FROM documents")
def feed_outcomes(spark, sf_dir):
    """Every source keeps its row: with items, without, broken, without a body."""
    k = F.col("doc_id") % 4
    items = F.repeat(F.lit("<item><title>x</title></item>"), (F.col("doc_id") % 3 + 1).cast("int"))
    body = F.when(k == 0, F.concat(F.lit("<rss><channel>"), items, F.lit("</channel></rss>"))).when(k == 1, "<rss><channel><title>T</title></channel></rss>").when(k == 2, "<rss><channel><item>")
    return feeds.feed_report(docs(spark, sf_dir).select("doc_id", body.alias("body")), "doc_id", "body")


@PACK.query(
    "SELECT page_id, place::INTEGER AS place, 'https://m.example/' || page_id || '/' || place || '.xml' AS loc FROM (SELECT page_id, unnest(range(0, page_id % 4 + 1)) AS place FROM pages WHERE page_id % 3 > 0)"
)
def sitemap_indexes(spark, sf_dir):
    """The sitemaps that an index names; a list of pages names none."""
    entry = lambda i: F.concat(F.lit("<s:sitemap><s:loc> https://m.example/"), F.col("page_id").cast("string"), F.lit("/"), i.cast("string"), F.lit(".xml </s:loc><s:lastmod>2024-01-01</s:lastmod></s:sitemap>"))
    entries = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int")), entry), "")
    index = F.concat(F.lit("<?xml version='1.0'?><s:sitemapindex xmlns:s='http://www.sitemaps.org/schemas/sitemap/0.9'>"), entries, F.lit("</s:sitemapindex>"))
    body = F.when(F.col("page_id") % 3 == 0, "<urlset><url><loc>https://m.example/</loc></url></urlset>").otherwise(index)
    return feeds.sitemap_children(read(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id", "body")


@PACK.query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://a.example/x/own.xml https://cdn.example/b https://a.example/news/rss' WHEN 1 THEN 'https://a.example/feed https://a.example/rss.xml https://a.example/atom.xml'
      WHEN 2 THEN 'https://a.example/news/rss https://a.example/n?k=1' ELSE 'https://a.example/news/rss https://a.example/feed https://a.example/rss.xml' END AS probes FROM pages"""
)
def feed_probes(spark, sf_dir):
    """Where a page's feed may be: declared, named or usual, in marks planted before the whole page, whose own words for feeds are taken out."""
    k = F.col("page_id") % 4
    declared = '<LINK href="own.xml" type="application/atom+xml" rel="alternate"><link rel=alternate type=application/rss+xml href="//cdn.example/b"><link rel="alternate" type="text/html" href="/no"><link rel="alternate" type="application/rss+xml" href="own.xml">'
    named = '<a href="https://b.example/feed">feed</a><a href="/news/rss">N</a><a href="#feed">feed</a>'
    html = F.when(k == 0, declared + named).when(k == 1, "<a href='/feedback'>feeds</a>").when(k == 2, named + '<a class=x href="/n?k=1"><b>Atom</b></a><a href="/third/feed">x</a>').otherwise(named)
    url = F.when(k.isin(0, 2), "https://a.example/x/y.html").otherwise("https://a.example/")
    found = feeds.feed_probes(F.concat(html, F.regexp_replace("html", "(?i)rss|atom|feed", "")), url)
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(found, " ").alias("probes"))


@PACK.query(
    """WITH e AS (SELECT user_id, event_type AS f, event_id % 5 > 0 AS told, event_id % 4 = 0 AS ok, event_id % 37 = 0 AS blocked, event_id % 3 > 0 AS late FROM events),
    f AS (SELECT user_id, f, count(*) FILTER (told) > 0 AND count(*) FILTER (told AND NOT late) = 0 AS silenced, count(*) FILTER (told AND ok) > 0 AS spoke, count(*) FILTER (told AND blocked) > 0 AS refused FROM e GROUP BY ALL),
    c AS (SELECT user_id, count(*) AS asked, count(*) FILTER (NOT silenced) AS could, count(*) FILTER (NOT silenced AND spoke) AS answered, count(*) FILTER (refused) AS refused FROM f GROUP BY ALL)
    SELECT user_id, asked, could, answered, CASE WHEN refused > 0 THEN 'degraded_pool' WHEN answered <= 1 THEN 'single_family' WHEN could < asked THEN 'partial_pool' ELSE 'full' END AS basis FROM c"""
)
def family_tallies(spark, sf_dir):
    """Families asked, able to speak and heard, here the kinds of a user's events."""
    k = F.col("event_id")
    told = lambda c: F.when(k % 5 > 0, c)
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", told(k % 4 == 0).alias("ok"), told(k % 37 == 0).alias("blocked"), told(k % 3 > 0).alias("preempted"))
    return agreement.family_tally(rows, "user_id", "event_type", "ok", "blocked", "preempted")


# -- JSON in pages: planted before the page's own html


@PACK.query(
    """SELECT page_id, place::INTEGER AS place, CASE place WHEN 0 THEN 'Article' WHEN 1 THEN 'A' ELSE 'B' END AS kind, CASE place WHEN 0 THEN url END AS address FROM pages, (SELECT unnest([0, 1, 2]) AS place) WHERE page_id % 3 = 0 OR (page_id % 3 = 1 AND place = 0)"""
)
def page_linked_data(spark, sf_dir):
    """Items of linked data planted before the page, whose own type marks are taken out: one object, a graph and a list; after a broken block nothing."""
    k, script = F.col("page_id") % 3, lambda x: F.concat(F.lit("<script data-x='1' type='application/ld+json'>\n"), x, F.lit("</script>"))
    first = script(F.to_json(F.struct(F.lit("Article").alias("@type"), F.col("url"))))
    graph, listed, bad = script(F.lit('{"@graph": [{"@type": "A"}]}')), script(F.lit('[{"@type":"B"}]')), script(F.lit("{broken"))
    html = F.when(k == 0, F.concat(first, graph, script(F.lit(" ")), listed)).when(k == 1, F.concat(first, bad, listed)).otherwise("<script type='text/javascript'>{}</script>")
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(islands.linked_items(F.concat(html, F.regexp_replace("html", "ld.json", "")))).alias("place", "item"))
    return rows.select("page_id", "place", F.get_json_object("item", "$['@type']").alias("kind"), F.get_json_object("item", "$.url").alias("address"))


@PACK.query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x20<>\x7F-\x{10FFFF}]+', ' ', 'g')) AS said FROM documents WHERE doc_id % 5 > 0)
    SELECT doc_id, 0::INTEGER AS place, said AS text FROM t WHERE length(said) >= 120 UNION ALL SELECT doc_id, CASE WHEN length(said) >= 120 THEN 1 ELSE 0 END::INTEGER, repeat('y', 120) FROM t"""
)
def page_island_texts(spark, sf_dir):
    """Long strings of the states of pages made of documents, each once; settings, short strings and broken states give none."""
    said = F.regexp_replace("text", r"[\x00-\x20<>\x7F-\x{10FFFF}]+", " ")
    long = F.repeat(F.lit("y"), 120)
    state = F.to_json(F.struct(F.struct(long.alias("x")).alias("themeConfig"), F.array(F.struct(said.alias("body")), F.struct(F.concat(F.lit(" "), said).alias("body"))).alias("posts"), F.struct(F.lit("short").alias("a"), long.alias("b")).alias("z")))
    html = F.concat(F.when(F.col("doc_id") % 2 == 0, "<p>x</p><script type='application/json'>").otherwise('<SCRIPT id="__NEXT_DATA__">'), F.when(F.col("doc_id") % 5 == 0, "{").otherwise(""), state, F.lit("</script>"))
    return islands.island_texts(docs(spark, sf_dir).select("doc_id", html.alias("html")), "doc_id", "html")
