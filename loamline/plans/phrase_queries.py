"""Queries over turns, error texts and sources' kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import phrases
from loamline.plans.tables import Pack, read
from loamline.plans.url_queries import host, p

PACK = Pack()

_LEADS = ["how to ", "latest arxiv ", "what is ", "compare ", "", "debug the "]
_Q = "(CASE turn % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_LEADS)) + " END || text || CASE WHEN turn % 2 = 0 THEN ' site:Docs.example -site:x.example' ELSE '' END)"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{r}') THEN '{n}'" for n, r in phrases.INTENTS) + " ELSE 'general' END"


def turns(spark, sf_dir):
    lead = F.coalesce(*[F.when(F.col("turn") % 6 == k, F.lit(v)) for k, v in enumerate(_LEADS)])
    q = F.concat(lead, F.col("text"), F.when(F.col("turn") % 2 == 0, " site:Docs.example -site:x.example").otherwise(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("q"))


@PACK.query(
    rf"""SELECT conv_id, turn, intent, CASE WHEN len(more) > 0 AND len(string_split_regex(trim(q), '\s+')) < 15 THEN q || ' ' || array_to_string(more, ' ') ELSE q END AS expanded FROM (
      SELECT *, CASE WHEN intent = 'research' THEN list_filter(['paper', 'arxiv', 'benchmark', 'results'], lambda w: NOT contains(lower(q), w)) ELSE [] END AS more FROM (SELECT *, {_INTENT} AS intent FROM (SELECT conv_id, turn, {_Q} AS q FROM conversations)))"""
)
def query_intents(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("intent", phrases.intent(F.col("q")))
    return rows.select("conv_id", "turn", "intent", phrases.expanded(F.col("q"), F.col("intent")).alias("expanded"))


@PACK.query(
    rf"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(' ' || q, '\s-?site:\S+', ' ', 'g'), '\s+', ' ', 'g')) AS query, CASE WHEN turn % 2 = 0 THEN 'docs.example' ELSE '' END AS sites,
      CASE WHEN turn % 2 = 0 THEN 'x.example' ELSE '' END AS excluded FROM (SELECT conv_id, turn, {_Q} AS q FROM conversations)"""
)
def site_operators(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", phrases.site_operators(F.col("q")).alias("s"))
    return rows.select("conv_id", "turn", "s.query", F.array_join("s.sites", ",").alias("sites"), F.array_join("s.excluded", ",").alias("excluded"))


_TEXTS = ["Connection refused by peer", "read timed out", "SSL: certificate verify failed", "getaddrinfo failed", "odd", "connection reset", "no proxy"]


@PACK.query(
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'connection_refused' WHEN 1 THEN 'timeout' WHEN 2 THEN 'tls_error' WHEN 3 THEN 'dns_failure' WHEN 4 THEN 'unknown' WHEN 5 THEN 'connection_reset' ELSE 'proxy_error' END AS category, "
    "event_id % 7 IN (1, 5) AS retryable, (400 + event_id % 120) IN (408, 425, 429) OR 400 + event_id % 120 >= 500 AS status_retryable FROM events"
)
def error_verdicts(spark, sf_dir):
    k = F.col("event_id")
    text = F.coalesce(*[F.when(k % 7 == i, F.lit(t)) for i, t in enumerate(_TEXTS)])
    return read(spark, sf_dir, "events").select(
        "event_id", phrases.error_category(text).alias("category"), phrases.error_retryable(text).alias("retryable"), phrases.status_retryable(400 + k % 120).alias("status_retryable")
    )


@PACK.query(
    rf"""SELECT page_id, CASE WHEN h = '' THEN 'unknown' WHEN regexp_matches(h, '(^|\.)gov(\.[a-z]{{2}})?$') THEN 'gov' WHEN regexp_matches(h, '\.edu(\.[a-z]{{2}})?$|\.ac\.[a-z]{{2}}$') THEN 'edu'
      WHEN h = 'github.com' OR ends_with(h, '.github.com') OR ends_with(h, '.github.io') THEN 'github' WHEN regexp_matches(h, '^(docs|developers?)\.') THEN 'docs-site'
      WHEN regexp_matches(h, 'forum|community|discourse|board') THEN 'forum' WHEN starts_with(h, 'blog.') THEN 'blog' WHEN regexp_matches(h, '^(shop|store)\.|\.shop$') THEN 'ecommerce'
      WHEN contains(lower(pa), '/docs/') THEN 'docs-site' WHEN regexp_matches(lower(pa), '/(blog|post)/') THEN 'blog' ELSE 'unknown' END AS kind
    FROM (SELECT page_id, {host('u')} AS h, {p(3, 'u')} AS pa FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, '://', '://docs.') WHEN 1 THEN 'https://a.gov.uk/x' WHEN 2 THEN 'https://x.github.io' WHEN 3 THEN url || '/docs/' ELSE url END AS u FROM pages))"""
)
def source_kinds(spark, sf_dir):
    k, url = F.col("page_id") % 6, F.col("url")
    u = F.when(k == 0, F.replace(url, F.lit("://"), F.lit("://docs."))).when(k == 1, "https://a.gov.uk/x").when(k == 2, "https://x.github.io").when(k == 3, F.concat(url, F.lit("/docs/"))).otherwise(url)
    return read(spark, sf_dir, "pages").select("page_id", phrases.source_kind(u).alias("kind"))


@PACK.query("SELECT page_id, 'see https://***@h.example/?api_key=***&id=' || page_id AS text, CASE WHEN length(html) < 1024 THEN length(html) || ' B' WHEN length(html) < 1048576 THEN printf('%.1f KB', length(html) / 1024.0) ELSE printf('%.1f MB', length(html) / 1048576.0) END AS size FROM pages")
def redaction_and_sizes(spark, sf_dir):
    text = F.concat(F.lit("see https://me:pw@h.example/?api_key=abc&id="), F.col("page_id").cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", phrases.redacted(text).alias("text"), phrases.human_size(F.length("html")).alias("size"))
