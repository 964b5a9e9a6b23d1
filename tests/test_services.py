"""Stated cases of service bodies, walls and follow-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import dates, urls, walls
from loamline.operators import agreement, suggest
from loamline.sources import feeds, islands, verticals


def test_answers_without_rows(spark):
    answers = [(1, None, 200, "x"), (2, "no json", 200, "x"), (3, '{"articles": null}', 200, "x"), (4, '{"articles": [{"title": "T", "url": "https://a.example"}]}', 429, "x"), (5, "{}", None, None),
               (6, '{"articles": [null, {"title": "<b>T</b> u", "url": " https://a.example "}, {"title": "V", "url": "https:///x"}]}', 200, "x")]
    df = spark.createDataFrame(answers, "id int, body string, status int, place_of string")
    rows = [tuple(r) for r in verticals.hits(df, "body", "status", "gdelt").collect()]
    assert rows == [(6, "x", 2, "T u", "https://a.example", "", "")]
    outcomes = {r.id: (r.outcome, r.n_rows) for r in verticals.report(df, "id", "body", "status", "gdelt").collect()}
    assert outcomes == {1: ("error", 0), 2: ("error", 0), 3: ("empty", 0), 4: ("blocked", 0), 5: ("error", 0), 6: ("ok", 1)}
    for service in verticals.SERVICES:
        assert verticals.hits(df.limit(0), "body", "status", service).count() == 0


def test_long_snippets_end_in_an_ellipsis(spark):
    body = '{"query": {"search": [{"title": "T", "snippet": "%s"}, {"title": "U", "snippet": "%s"}]}}' % ("a" * 420, "a" * 418 + " " + "b" * 9)
    df = spark.createDataFrame([(1, body, 200)], "id int, body string, status int")
    assert [r.snippet for r in verticals.hits(df, "body", "status", "wikipedia").orderBy("place").collect()] == ["a" * 420, "a" * 418 + "…"]


def test_walls_of_nulls_and_lengths(spark):
    cases = [(1, None, None, None), (2, "https://a.example/login", 200, "Password"), (3, "https://a.example/", 200, "password"), (4, "https://a.example/captcha", 200, "x"),
             (5, None, 200, "Just a moment" + "." * 1500), (6, None, 404, "access denied"), (7, None, None, " Please Wait... "), (8, None, 200, "too many requests" + "." * 600)]
    df = spark.createDataFrame(cases, "id int, url string, status int, text string")
    rows = df.select(
        "id", walls.is_login_wall(F.col("url"), F.col("text")).alias("login"), walls.is_proof_wall(F.col("url"), F.col("status"), F.col("text")).alias("proof"),
        walls.is_soft_failure(F.col("status"), F.lit(None).cast("string"), F.col("text")).alias("failure"),
    ).collect()
    assert {r.id for r in rows if r.login} == {2}
    assert {r.id for r in rows if r.proof} == {4}
    assert {r.id for r in rows if r.failure} == {7}


def plain_related(rows, query, n=6):
    """The rule of suggest.related, in plain loops over one key."""
    import re

    uses: dict[str, set] = {}
    for domain, text in rows:
        low = (text or "").lower()
        found = list(re.finditer(suggest.WORD, low))
        for a, b in zip(found, found[1:]):
            gap = low[a.end() : b.start()]
            if gap and not gap.strip(" \t\n\f\r") and a.group() not in suggest.STOP and b.group() not in suggest.STOP:
                uses.setdefault(f"{a.group()} {b.group()}", set()).add(domain)
    known, kept, seen = re.findall(suggest.WORD, query.lower()), [], set()
    for phrase in sorted(uses, key=lambda p: (-len(uses[p]), p)):
        words = phrase.split()
        if len(uses[phrase]) < 2 or words[0] in suggest.LEAD + suggest.STOP or words[0].endswith("ing") or all(w in known for w in words):
            continue
        if phrase in query.lower() or query.lower() in phrase or len(set(words) & seen) >= 2:
            continue
        if len(kept) < n:
            kept.append(phrase)
            seen.update(words)
    return kept


def test_related_phrases_by_plain_loops(spark):
    texts = [
        ("a", "Spark plan reader; plan reader x-ray Spark plan. reader plan the plan"), ("b", "spark  plan\nreader plan 9lives 1abc def reading glasses"), ("c", "reading glasses reader plan 1abc def +one-two three"),
        ("c", None), ("c", "reader plan spark spark"), ("d", "spark spark -x1abc def three'd four+ +one-two three before noon"), ("e", "before noon four+ spark"), ("a", "three'd four+ of-late news"),
    ]
    rows = spark.createDataFrame([(1, d, t) for d, t in texts] * 2 + [(2, "a", "only one"), (None, "a", "spark plan")], "key int, domain string, text string")
    for query in ("spark", "reader plan", "nothing"):
        asked = spark.createDataFrame([(1, query), (2, query)], "key int, q string")
        got = {r.key: r.phrases for r in suggest.related(rows, "key", "domain", ["text"], asked, F.col("q")).collect()}
        assert got == {1: plain_related(texts, query)}, query
        assert len(got[1]) >= 4


def test_spellings_of_a_repository_meet(spark):
    spellings = ["https://github.com/Owner/Repo", "https://www.github.com/owner/repo/", "HTTPS://GitHub.com:443/OWNER/REPO?utm_source=x"]
    others = ["https://github.com/topics/Spark", "https://github.com/topics/spark", "https://user@github.com/Owner/Repo", "https://github.com/Owner"]
    keys = [r[0] for r in spark.createDataFrame([(u,) for u in spellings + others], "u string").select(urls.search_key(F.col("u"))).collect()]
    assert len(set(keys[:3])) == 1 and len(set(keys)) == 1 + len(others)


def test_times_of_feeds(spark):
    cases = {
        "2024-05-01": "2024-05-01 00:00:00", " 2024-05-01T22:30Z": "2024-05-01 22:30:00", "2024-05-01T22:30:15.25-01:00": "2024-05-01 23:30:15", "2024-05-01 22:30": "2024-05-01 22:30:00",
        "2024-13-01": None, "2024-05-01T": None, "soon": None, "": None, None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "v string").select(F.date_format(dates.iso8601(F.col("v")), "yyyy-MM-dd HH:mm:ss"))
    assert [r[0] for r in df.collect()] == list(cases.values())
    mail = spark.createDataFrame([("Tue, 05 Aug 2026 12:00:00 GMT",), ("5 Aug 2026 12:00:00 +0200",), ("Tue",)], "v string").select(F.date_format(dates.rfc822(F.col("v")), "yyyy-MM-dd HH"))
    assert [r[0] for r in mail.collect()] == ["2026-08-05 12", "2026-08-05 10", None]


def test_feed_bodies_of_every_kind(spark):
    bodies = [
        (1, None), (2, ""), (3, "<rss"), (4, "<rss><channel><title>T</title></channel></rss>"), (5, "<rss><channel><item><title>only</title></item></channel></rss>"),
        (6, "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>a</title><link href='https://a.example'/></entry></feed>"),
    ]
    df = spark.createDataFrame(bodies, "id int, body string")
    assert {r.id: (r.outcome, r.n_items) for r in feeds.feed_report(df, "id", "body").collect()} == {
        1: ("error", 0), 2: ("error", 0), 3: ("error", 0), 4: ("empty", 0), 5: ("ok", 1), 6: ("ok", 1)
    }
    assert {(r.id, r.title, r.link) for r in feeds.feed_items(df, "id", "body").collect()} == {(5, "only", None), (6, "a", "https://a.example")}
    assert feeds.feed_report(df.limit(0), "id", "body").count() == 0


def test_families_without_reports_could_speak(spark):
    rows = [("a", "f", True, False, False), ("a", "g", None, None, None), ("b", "f", False, False, True), ("b", "f", False, False, True), ("b", "g", True, False, False), ("b", "h", True, False, False),
            ("c", "f", False, True, False), ("d", "f", True, False, False), ("d", "g", True, False, False)]
    df = spark.createDataFrame(rows, "k string, family string, ok boolean, blocked boolean, late boolean")
    got = {r.k: tuple(r)[1:] for r in agreement.family_tally(df, "k", "family", "ok", "blocked", "late").collect()}
    assert got == {"a": (2, 2, 1, "single_family"), "b": (3, 2, 2, "partial_pool"), "c": (1, 1, 0, "degraded_pool"), "d": (2, 2, 2, "full")}


def test_states_of_pages(spark):
    a, b = "a" * 120, "b" * 130
    pages = [
        (1, None), (2, ""), (3, f'<script type="application/json">{{"k": ["{a}", "{a}"], "cookieText": "{b}", "n": 1, "s": "short"}}</script>'), (4, f'<script>{{"k": "{a}"}}</script>'),
        (5, f'<script type="application/json">{{"k": "{a}"</script><script id="__NEXT_DATA__">["{b}", {{"deep": " {a} "}}]</script>'), (6, '<script type="application/json">' + "[" * 30 + f'"{a}"' + "]" * 30 + "</script>"),
    ]
    df = spark.createDataFrame(pages, "id int, html string")
    assert sorted(tuple(r) for r in islands.island_texts(df, "id", "html").collect()) == [(3, 0, a), (5, 0, b), (5, 1, a)]
    assert islands.island_texts(df.limit(0), "id", "html").count() == 0
    assert [r[0] for r in df.orderBy("id").select(F.size(islands.linked_items(F.coalesce("html", F.lit(""))))).collect()] == [0] * 6
