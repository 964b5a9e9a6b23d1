"""Cases with stated results for the column functions and operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamline.functions import dates, text, urls
from loamline.operators import agreement, blocks, ranking


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://x.example/p/1?utm_id=0", "https://x.example/p/1", True), ("https://x.example/p/1?UTM_CUSTOM=x", "https://www.x.example/p/1/", True),
        ("https://x.example/?page=2&utm_id=0", "https://x.example/?page=2", True), ("https://x.example/?page=2", "https://x.example/?page=3", False),
        ("http://x.example:80/a#t", "http://x.example/a", True), ("https://www.com/a", "https://com/a", False),
    ],
)
def test_search_keys(spark, a, b, same):
    assert (one(spark, a, urls.search_key) == one(spark, b, urls.search_key)) is same


def test_crawl_key_keeps_www_and_own_parameters(spark):
    assert one(spark, "HTTPS://WWW.X.example:443?utm_id=1&ref=2", urls.crawl_key) == "https://www.x.example/?utm_id=1"


@pytest.mark.parametrize(
    ("value", "precision", "cutoff", "verdict"),
    [
        ("2026-09-30", "day", "2026-10-01", "keep"), ("2026-10-01", "day", "2026-10-01", "drop"), ("2026-10-02", "day", "2026-10-01", "drop"),
        ("2026-03-01", "month", "2026-10-15", "keep"), ("2026-12-01", "month", "2026-10-15", "drop"), ("2026-10-01", "month", "2026-10-15", "unverifiable"),
        ("2026-10-01", "month", "2026-10-01", "drop"), ("2020-01-01", "year", "2026-10-01", "keep"), ("2027-01-01", "year", "2026-10-01", "drop"),
        ("2026-01-01", "year", "2026-10-01", "unverifiable"), ("2026-01-01", "relative", "2026-10-01", "unverifiable"), (None, None, "2026-10-01", "keep"),
    ],
)
def test_before(spark, value, precision, cutoff, verdict):
    df = spark.createDataFrame([(value, precision, cutoff)], "v string, p string, c string")
    got = df.select(dates.before_verdict(F.col("v").cast("date"), F.col("p"), F.col("c").cast("date")).alias("r")).first()["r"]
    assert got == verdict


LONG = "a line that is quite long enough to count"


@pytest.mark.parametrize(
    ("body", "dropped"),
    [(f"{LONG}\n{LONG}", 1), ("Read more\nRead more", 0), (f"# {LONG}\n# {LONG}", 0), (f"```\n{LONG}\n{LONG}\n```", 0), (f"{LONG}\nx\n{LONG}\n{LONG}", 2)],
)
def test_folding(spark, body, dropped):
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    once = blocks.fold_repeated_lines(df)
    assert once.first()["dropped"] == dropped
    assert blocks.fold_repeated_lines(once.select("doc_id", "text")).first()["dropped"] == 0


def test_tokens_of_mixed_scripts(spark):
    assert one(spark, "Python教程 如 a Größe", text.tokens) == ["python", "教程", "如", "größe"]


def test_numbers_and_stances(spark):
    df = spark.createDataFrame([("grew by 45 % in 2020", "grew by 50 percent")], "a string, b string")
    got = df.select(agreement.numeric_flip(F.col("a"), F.col("b")).alias("n"), agreement.antonym_flip(F.lit("an increase"), F.lit("a decrease")).alias("o")).first()
    assert got["n"] and got["o"]


def test_diversify_keeps_all_rows(spark):
    rows = spark.createDataFrame([(1, i, "d" if i < 5 else "e") for i in range(1, 8)], "query_id int, position int, domain string")
    got = [r["position"] for r in ranking.diversify(rows, "domain").orderBy("place").collect()]
    assert got == [1, 2, 5, 6, 3, 4, 7]


def test_one_domain_never_confirms(spark):
    rows = spark.createDataFrame([("c", "x", "support"), ("c", "x", "support"), ("d", "x", "support"), ("d", "y", "support")], "claim string, domain string, stance string")
    got = {r["claim"]: r["verdict"] for r in agreement.verdicts(rows).collect()}
    assert got == {"c": "unverified", "d": "confirmed"}
