"""Queries' intents, search operators, error texts and sources' kinds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.urls import host, part, within

# Wordings that show what a query asks for, in order of precedence.
INTENTS = [
    ("comparison", r"(^|[^a-z0-9])(vs|versus|compare|comparison|difference\s+between|pros\s+and\s+cons|which\s+is\s+better)([^a-z0-9]|$)"),
    ("howto", r"(^|[^a-z0-9])(how\s+to|how\s+do\s+i|guide|tutorial|step\s+by\s+step|walkthrough)([^a-z0-9]|$)"),
    ("research", r"(^|[^a-z0-9])(arxiv|research|benchmark|literature|state\s+of\s+the\s+art|case\s+study|white\s+paper)([^a-z0-9]|$)"),
    ("code", r"(^|[^a-z0-9])(implement|function|api|method|class|snippet|script|debug|error|exception|source\s+code|code\s+example)([^a-z0-9]|$)"),
    ("reference", r"(^|[^a-z0-9])(what\s+is|definition|explain|meaning|overview|introduction|understand)([^a-z0-9]|$)"),
    ("news", r"(^|[^a-z0-9])(latest|newest|recent|announcement|breaking|changelog|release\s+notes|new\s+release|just\s+released)([^a-z0-9]|$)"),
]
# What an expanded query adds.
EXPANSIONS = {"research": ["paper", "arxiv", "benchmark", "results"], "factual": ["specifications", "table", "data", "parameters"]}
# Error texts, their category and whether the same call may succeed later.
ERRORS = [
    ("connection_refused", "connection refused|econnrefused", False), ("connection_reset", "connection reset|econnreset", True),
    ("dns_failure", "name or service not known|getaddrinfo|nxdomain", False), ("timeout", "timed out|timeout", True),
    ("tls_error", "certificate|ssl|tls", False), ("proxy_error", "proxy", False),
]


def intent(query: Column) -> Column:
    low = F.lower(query)
    return F.coalesce(*[F.when(low.rlike(p), name) for name, p in INTENTS], F.lit("general"))


def expanded(query: Column, kind: Column) -> Column:
    """The query with the words of its intent that it lacks; long queries stay."""

    def more(words: list[str]) -> Column:
        return F.filter(F.array(*map(F.lit, words)), lambda w: ~F.lower(query).contains(w))

    added = F.coalesce(*[F.when(kind == k, more(w)) for k, w in EXPANSIONS.items()], F.array().cast("array<string>"))
    return F.when((F.size(added) > 0) & (F.size(F.split(F.trim(query), r"\s+")) < 15), F.concat_ws(" ", query, F.array_join(added, " "))).otherwise(query)


def site_operators(query: Column) -> Column:
    """struct(query, sites, excluded): site: and -site: words taken out of a query."""
    padded = F.concat(F.lit(" "), query)
    sites = F.regexp_extract_all(padded, F.lit(r"\s(site:\S+)"), F.lit(1))
    out = F.regexp_extract_all(padded, F.lit(r"\s(-site:\S+)"), F.lit(1))
    plain = F.trim(F.regexp_replace(F.regexp_replace(padded, r"\s-?site:\S+", " "), r"\s+", " "))
    return F.struct(
        plain.alias("query"), F.transform(sites, lambda x: F.lower(F.substring(x, 6, 1000))).alias("sites"), F.transform(out, lambda x: F.lower(F.substring(x, 7, 1000))).alias("excluded")
    )


def error_category(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), name) for name, p, _ in ERRORS], F.lit("unknown"))


def error_retryable(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(r)) for _, p, r in ERRORS], F.lit(False))


def status_retryable(status: Column) -> Column:
    return (status == 429) | (status == 408) | (status == 425) | (status >= 500)


def source_kind(url: Column) -> Column:
    """Kind of a source by its host's shape, and its path last."""
    name, path = host(url), F.lower(part(url, 3))
    return (
        F.when((name == "") | name.isNull(), "unknown").when(name.rlike(r"(^|\.)gov(\.[a-z]{2})?$"), "gov").when(name.rlike(r"\.edu(\.[a-z]{2})?$|\.ac\.[a-z]{2}$"), "edu")
        .when(within(name, F.lit("github.com")) | name.endswith(".github.io"), "github").when(name.rlike(r"^(docs|developers?)\."), "docs-site")
        .when(name.rlike("forum|community|discourse|board"), "forum").when(name.startswith("blog."), "blog").when(name.rlike(r"^(shop|store)\.|\.shop$"), "ecommerce")
        .when(path.contains("/docs/"), "docs-site").when(path.rlike("/(blog|post)/"), "blog").otherwise("unknown")
    )


def redacted(text: Column) -> Column:
    """Keys in parameters and credentials in addresses, masked."""
    text = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret)=)[^&\s]+", "$1***")
    return F.regexp_replace(text, r"(://)[^/@\s:]+:[^/@\s]+@", "$1***@")


def human_size(n: Column) -> Column:
    """Bytes in B, KB or MB; exact ties of the decimal go to the even digit, as C prints them. Null where there is none."""

    def tenths(unit: int) -> Column:
        return F.bround(n / float(unit), 1)

    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", tenths(1024))).when(
        n.isNotNull(), F.format_string("%.1f MB", tenths(1024**2))
    )
