"""Column expressions over values that services send: waits, dates, languages, addresses, verdicts on responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import iso8601
from .html import unescaped
from .urls import part

# Phrases of pages that stand between a reader and a page.
CHALLENGES = [
    "cloudflare", "cf-browser", "challenge-platform", "cf_chl_opt", "ray id", "captcha-delivery.com", "datadome", "dd=",
    "please verify you are a human", "are you a robot", "checking your browser",
]
QUERY_CHARS = 2048


def plain(value: Column) -> Column:
    """Without tags, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def readable(text: Column) -> Column:
    """Character references decoded once more, spaces and blank lines folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescaped(text), r"[ \t]+", " "), r"\n\s*\n+", "\n"))


def retry_after(value: Column, now: Column, fallback: Column) -> Column:
    """Seconds to wait by a header that holds seconds or a date; never below 0."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    date = F.try_to_timestamp(F.regexp_extract(raw, r"([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1), F.lit("d MMM yyyy HH:mm:ss"))
    seconds = F.when(raw.rlike("^[0-9]+$"), raw.try_cast("double")).otherwise((F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.greatest(F.lit(0.0), F.coalesce(seconds, fallback.cast("double")))


def lastmod_epoch(value: Column) -> Column:
    """Seconds of an ISO date or time, taken as UTC where it names no zone; 0 for none or a bad one."""
    return F.coalesce(F.unix_timestamp(iso8601(value)), F.lit(0)).cast("double")


def epoch_day(value: Column) -> Column:
    """The day of a number of seconds as a string; '' for none or a bad one."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.trim(value).try_cast("double").cast("long")), "yyyy-MM-dd"), F.lit(""))


def encyclopedia_language(query: Column, language: Column) -> Column:
    """The code that was asked for, else one by the query's script."""
    code = F.substring_index(F.lower(F.trim(F.coalesce(language, F.lit("")))), "-", 1)
    script = (
        F.when(query.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(query.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko")
        .when(query.rlike(r"[\x{3400}-\x{9FFF}]"), "zh").otherwise("en")
    )
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(script)


def language_lane(query: Column) -> Column:
    """'cn' above 30 % of ideographs and syllables, 'en' below 5 %, else ''."""
    bare = F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", "")
    wide = F.regexp_count(bare, F.lit(r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"))
    share = F.when(F.length(bare) > 0, wide / F.length(bare))
    return F.when(share > 0.30, "cn").when(share < 0.05, "en").otherwise("")


def conventional_sitemaps(url: Column) -> Column:
    base = F.concat(F.when(part(url, 1) == "", "https").otherwise(part(url, 1)), F.lit("://"), part(url, 2))
    return F.array(F.concat(base, F.lit("/sitemap.xml")), F.concat(base, F.lit("/sitemap_index.xml")))


def query_or_null(query: Column) -> Column:
    """The query without control characters; null where it is empty or too long to be one."""
    t = F.trim(query)
    return F.when((t != "") & (F.length(t) <= QUERY_CHARS), F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def is_cacheable(status: Column, error: Column, content: Column) -> Column:
    return (status > 0) & (status < 400) & (F.coalesce(error, F.lit("")) == "") & (F.trim(F.coalesce(content, F.lit(""))) != "")


def is_challenged(status: Column, content: Column) -> Column:
    """A refusal whose page asks its reader for proof."""
    text = F.lower(F.coalesce(content, F.lit("")))
    found = F.lit(False)
    for phrase in CHALLENGES:
        found = found | F.contains(text, F.lit(phrase))
    return status.isin(403, 503) & found


def _face(text: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text)), "^[a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(s, r"^www\.", ""), "[/.?& ]+$", "")


def title_is_address(title: Column, url: Column) -> Column:
    """The title is how the row's own address is printed."""
    face = _face(F.regexp_replace(title, r"(\s*\.\.\.|\s*…)\s*$", ""))
    return (face != "") & F.contains(face, F.lit(".")) & ~F.contains(F.trim(title), F.lit(" ")) & F.startswith(_face(url), face)


def bounded_int(value: Column, low: int, high: int, default: int) -> Column:
    """A whole number within bounds; the default where it is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.trim(value).try_cast("int"), F.lit(default))))
