"""Dates of unequal precision as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy年M月d日"]


def day(text: Column) -> Column:
    """A calendar day from ISO, compact and written forms; null for others."""
    s = F.trim(text)
    compact = F.when(s.rlike("^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd"))
    iso = F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    written = [F.try_to_date(s, f) for f in FORMATS]
    return F.coalesce(compact, iso, *written)


def relative_days(text: Column) -> Column:
    """Days before the reading of '3 days ago', '2 weeks ago', 'yesterday' and the like; null for others."""
    s = F.lower(text)
    n = F.regexp_extract(s, r"([0-9]+)\s*(second|minute|hour|day|week|month|year)s?\s+ago", 1)
    unit = F.regexp_extract(s, r"([0-9]+)\s*(second|minute|hour|day|week|month|year)s?\s+ago", 2)
    per = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365).otherwise(0)
    return F.when(n != "", n.try_cast("int") * per).when(s.contains("yesterday"), 1).when(s.contains("just now"), 0)


def read_row(text: Column, now: Column) -> Column:
    """struct(value, precision): day, month, year or relative; nulls where the text shows no date."""
    s = F.trim(text)
    rel = relative_days(s)
    month = F.try_to_date(F.concat(F.regexp_extract(s, r"^(20[0-9]{2})[-/.]([0-9]{2})$", 1), F.lit("-"), F.regexp_extract(s, r"^(20[0-9]{2})[-/.]([0-9]{2})$", 2), F.lit("-01")), "yyyy-MM-dd")
    named = F.try_to_date(F.concat(F.lit("1 "), s), "d MMMM yyyy")
    year = F.when(s.rlike("^(19|20)[0-9]{2}$"), F.try_to_date(F.concat(s, F.lit("-01-01")), "yyyy-MM-dd"))
    read = lambda value, precision: F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(precision).alias("precision")))
    # the first form that fits; each is tried once
    return F.coalesce(
        read(F.date_sub(now, rel), "relative"), read(F.coalesce(month, named), "month"), read(day(s), "day"), read(year, "year"),
        F.struct(F.lit(None).cast("date").alias("value"), F.lit(None).cast("string").alias("precision")),
    )


def before_verdict(value: Column, precision: Column, cutoff: Column) -> Column:
    """keep, drop or unverifiable under an upper bound; what can't be shown to be later is never dropped."""
    end = F.when(precision == "month", F.add_months(value, 1)).otherwise(F.add_months(value, 12))
    wide = F.when(end <= cutoff, "keep").when(value >= cutoff, "drop").otherwise("unverifiable")
    return (
        F.when(value.isNull() | cutoff.isNull(), "keep").when(precision == "relative", "unverifiable")
        .when(precision == "day", F.when(value < cutoff, "keep").otherwise("drop")).when(precision.isin("month", "year"), wide).otherwise("unverifiable")
    )


def in_window(value: Column, after: Column, before: Column) -> Column:
    """Vertical rows: undated ones fall under ``after`` but stay under ``before``, which includes its day."""
    return F.coalesce(value >= after, F.lit(False)) & F.coalesce(value <= before, F.lit(True))


def freshness(modified: Column, published: Column, now: Column, horizon: Column) -> Column:
    """struct(age_days, stale): by the later kind of date known."""
    age = F.datediff(now, F.coalesce(modified, published))
    return F.struct(age.alias("age_days"), F.coalesce(age > horizon, F.lit(False)).alias("stale"))


def preset(days: Column) -> Column:
    """The narrowest of day, week, month and year that covers an age in days; null beyond."""
    return F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 31, "month").when(days <= 366, "year")


def since_hours(window: Column) -> Column:
    """Hours of a relative window such as 3h, 2d or 1w; null for others."""
    n, unit = F.regexp_extract(window, "^([0-9]+)([hdw])$", 1), F.regexp_extract(window, "^([0-9]+)([hdw])$", 2)
    return F.when(unit == "h", n.try_cast("long")).when(unit == "d", n.try_cast("long") * 24).when(unit == "w", n.try_cast("long") * 168)


def rfc822(text: Column) -> Column:
    """Timestamp of an RFC 822 date; the weekday is not looked at."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, *", "")
    return F.try_to_timestamp(F.regexp_replace(bare, " (?:GMT|UTC|UT|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))


def iso8601(text: Column) -> Column:
    """Timestamp of an ISO date or time, UTC where it names no zone; null for others."""
    shape = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2})(:[0-9]{2}(?:\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
    s = F.trim(text)
    at = lambda k, other: F.coalesce(F.when(F.regexp_extract(s, shape, k) != "", F.regexp_extract(s, shape, k)), F.lit(other))
    return F.when(s.rlike(shape), F.concat(at(1, ""), F.lit("T"), at(2, "00:00"), at(3, ":00"), at(4, "Z"))).try_cast("timestamp")


def pdf_date(text: Column) -> Column:
    return F.regexp_replace(text, r"^D:([0-9]{4})([0-9]{2})([0-9]{2}).*$", "$1-$2-$3")
