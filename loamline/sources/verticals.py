"""Rows from the JSON bodies of single services: news, questions, repositories, communities, encyclopedia, packages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.dates import iso8601
from loamline.functions.values import epoch_day, plain

#: Longest snippet of a row.
SNIPPET_CHARS = 420


def _line(*parts: Column) -> Column:
    """The parts that say something, with a dot between."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), lambda p: p != ""), " · ")


def _said(prefix: str, value: Column, suffix: str = "") -> Column:
    """Null where the value is null or empty."""
    return F.when(value.cast("string") != "", F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix)))


def _count(value: Column, what: str) -> Column:
    return F.concat(F.coalesce(value, F.lit(0)).cast("string"), F.lit(what))


def _iso_day(value: Column) -> Column:
    """The day, in UTC, of an ISO date or time; '' for none or a bad one."""
    return F.coalesce(F.date_format(iso8601(value), "yyyy-MM-dd"), F.lit(""))


def _packed_day(value: Column) -> Column:
    """The day of digits such as 20240131T120000Z; '' for fewer than eight or a bad date."""
    digits = F.substring(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", ""), 1, 8)
    day = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.coalesce(F.when(F.length(digits) == 8, F.date_format(day.try_cast("date"), "yyyy-MM-dd")), F.lit(""))


def _cut(text: Column, n: int) -> Column:
    """A text within n characters: a longer one ends in an ellipsis."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…")))


@dataclass(frozen=True)
class Service:
    """How rows are read: the schema of a body, its array of rows, and (title, url, snippet, published, usable) of a row and the language."""

    schema: str
    rows: Callable[[Column], Column]
    read: Callable[[Column, Column], tuple[Column, Column, Column, Column, Column]]


def _news(r: Column, _: Column):
    return r["title"], r["url"], _line(r["domain"], r["language"], r["sourcecountry"]), _packed_day(r["seendate"]), F.lit(True)


def _questions(r: Column, _: Column):
    answered = F.when(r["is_answered"], "accepted")
    tags = F.array_join(F.slice(F.coalesce(r["tags"], F.array().cast("array<string>")), 1, 4), ", ")
    return r["title"], r["link"], _line(F.concat(F.lit("score "), _count(r["score"], "")), _count(r["answer_count"], " answers"), answered, tags), epoch_day(r["creation_date"]), F.lit(True)


def _repositories(r: Column, _: Column):
    about = F.substring(plain(r["description"]), 1, 260)
    snippet = _line(F.concat(F.lit("★"), _count(r["stargazers_count"], "")), r["language"], _said("updated ", _iso_day(r["updated_at"])), about)
    return r["full_name"], r["html_url"], snippet, _iso_day(r["created_at"]), F.lit(True)


def _stories(r: Column, _: Column):
    own = _said("https://news.ycombinator.com/item?id=", r["objectID"])
    url = F.coalesce(F.when(r["url"] != "", r["url"]), own)
    snippet = _line(F.lit("HN"), _count(r["points"], " points"), _count(r["num_comments"], " comments"), F.substring(plain(r["story_text"]), 1, 240))
    return r["title"], url, snippet, _iso_day(r["created_at"]), F.lit(True)


def _posts(r: Column, _: Column):
    link, target = F.coalesce(r["permalink"], F.lit("")), F.coalesce(r["url"], F.lit(""))
    own = F.when(link != "", F.concat(F.lit("https://www.reddit.com"), link))
    outside = target.rlike("^https?://")
    url = F.when(outside & ~(F.contains(target, F.lit("reddit.com")) & (link != "")), target).otherwise(own)
    place = F.concat(F.lit("r/"), F.coalesce(r["subreddit"], F.lit("")))
    snippet = _line(place, _count(r["score"], " points"), _count(r["num_comments"], " comments"), F.substring(plain(r["selftext"]), 1, 240))
    usable = ~F.coalesce(r["over_18"], F.lit(False)) & (F.coalesce(r["removed_by_category"], F.lit("")) == "")
    return r["title"], url, snippet, epoch_day(r["created_utc"].cast("string")), usable


def _articles(r: Column, language: Column):
    name = F.url_encode(F.replace(F.coalesce(r["title"], F.lit("")), F.lit(" "), F.lit("_")))
    for code, char in (("%2F", "/"), ("%28", "("), ("%29", ")"), ("%2C", ","), ("%7E", "~"), ("*", "%2A")):
        name = F.replace(name, F.lit(code), F.lit(char))
    url = F.concat(F.lit("https://"), language, F.lit(".wikipedia.org/wiki/"), name)
    return r["title"], url, _line(plain(r["snippet"]), _said("", r["wordcount"], " words")), F.lit(""), F.lit(True)


def _package(b: Column, _: Column):
    latest = F.coalesce(b["dist-tags"]["latest"], F.lit(""))
    version = F.element_at(b["versions"], latest)
    stamp = F.coalesce(F.element_at(b["time"], latest), F.element_at(b["time"], F.lit("modified")))
    home = F.coalesce(version["repository"], b["repository"], F.lit(""))
    home = F.when(home.startswith("{"), F.coalesce(F.get_json_object(home, "$.url"), F.lit(""))).otherwise(home)
    home = F.regexp_replace(F.regexp_replace(home, r"^git\+", ""), r"\.git$", "")
    needs = F.coalesce(F.size(version["dependencies"]), F.lit(0))
    about = plain(F.coalesce(F.when(version["description"] != "", version["description"]), b["description"]))
    snippet = _line(_said("v", latest), plain(version["license"]), _said("updated ", _iso_day(stamp)), F.when(needs > 0, F.concat(F.lit("deps="), needs.cast("string"))), home, about)
    return F.concat(b["name"], F.lit(" (npm)")), F.concat(F.lit("https://www.npmjs.com/package/"), b["name"]), snippet, _iso_day(stamp), F.lit(True)


SERVICES = {
    "gdelt": Service("articles array<struct<title:string,url:string,domain:string,language:string,sourcecountry:string,seendate:string>>", lambda b: b["articles"], _news),
    "stackexchange": Service(
        "items array<struct<title:string,link:string,score:bigint,answer_count:bigint,is_answered:boolean,tags:array<string>,creation_date:string>>", lambda b: b["items"], _questions
    ),
    "github": Service(
        "items array<struct<full_name:string,html_url:string,stargazers_count:bigint,language:string,description:string,updated_at:string,created_at:string>>", lambda b: b["items"], _repositories
    ),
    "hackernews": Service(
        "hits array<struct<objectID:string,title:string,url:string,points:bigint,num_comments:bigint,story_text:string,created_at:string>>", lambda b: b["hits"], _stories
    ),
    "reddit": Service(
        "data array<struct<title:string,url:string,permalink:string,subreddit:string,score:bigint,num_comments:bigint,selftext:string,over_18:boolean,removed_by_category:string,created_utc:double>>",
        lambda b: b["data"], _posts,
    ),
    "wikipedia": Service("query struct<search:array<struct<title:string,snippet:string,wordcount:bigint>>>", lambda b: b["query"]["search"], _articles),
    "npm": Service(
        "name string, `dist-tags` struct<latest:string>, time map<string,string>, repository string, description string, "
        "versions map<string,struct<license:string,repository:string,description:string,dependencies:map<string,string>>>",
        F.array, _package,
    ),
}


def hits(df: DataFrame, body: str, status: str, service: str, language: str | None = None) -> DataFrame:
    """The columns of ``df`` but body and status, and place (from 1), title, url, snippet, published of every usable row of the service.

    Rows without a title or a web address are left out and keep their place; a body that is null, no JSON or refused has none.
    """
    s = SERVICES[service]
    kept = [c for c in df.columns if c not in (body, status)]
    spoken = F.col(language) if language else F.lit("en")
    parsed = df.where(F.col(status) == 200).select(*kept, F.from_json(body, s.schema).alias("__b"))
    rows = parsed.select(*kept, F.posexplode(s.rows(F.col("__b"))).alias("__p", "__r"))
    title, url, snippet, published, usable = s.read(F.col("__r"), spoken)
    rows = rows.where(usable).select(
        *kept, (F.col("__p") + 1).alias("place"), plain(title).alias("title"), F.trim(F.coalesce(url, F.lit(""))).alias("url"),
        _cut(plain(snippet), SNIPPET_CHARS).alias("snippet"), published.alias("published"),
    )
    return rows.where((F.col("title") != "") & F.col("url").rlike("(?i)^https?://[^/?#]"))


def report(df: DataFrame, key: str, body: str, status: str, service: str) -> DataFrame:
    """key, outcome, n_rows of each answer, by a key without repeats: 'ok', 'empty', 'blocked' (refused) or 'error' (other status, no JSON)."""
    found = hits(df.select(key, body, status), body, status, service).groupBy(key).agg(F.count("*").alias("n_rows"))
    refused, broken = F.col(status).isin(401, 403, 429), F.get_json_object(body, "$").isNull()
    outcome = F.when(refused, "blocked").when((F.coalesce(F.col(status), F.lit(0)) != 200) | broken, "error").when(F.col("n_rows") > 0, "ok").otherwise("empty")
    return df.select(key, body, status).join(found, key, "left").select(key, outcome.alias("outcome"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
