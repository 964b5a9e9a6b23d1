"""Queries over outcomes, polls and caches, made of the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.operators import state
from loamline.plans.tables import Pack, read
from loamline.streaming import polls

PACK = Pack()


def events(spark, sf_dir):
    return read(spark, sf_dir, "events")


@PACK.query(
    """WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT event_type, i, value::DOUBLE AS mean FROM o WHERE i = 1 UNION ALL SELECT o.event_type, o.i, r.mean * 0.7::DOUBLE + o.value * 0.3::DOUBLE FROM r JOIN o ON o.event_type = r.event_type AND o.i = r.i + 1)
    SELECT event_type, max(i) AS n, round(arg_max(mean, i), 6)::DOUBLE AS mean FROM r GROUP BY event_type"""
)
def ewma_engine_health(spark, sf_dir):
    """Exponentially weighted mean of each kind of event, in order of time."""
    rows = events(spark, sf_dir).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("l"))
    return rows.select("event_type", F.size("l").cast("long").alias("n"), F.round(state.ewma(F.transform("l", lambda x: x["value"])), 6).alias("mean"))


_STREAK = """SELECT event_id, user_id, ts, f, CAST(CASE WHEN f THEN sum(f::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) ELSE 0 END AS BIGINT) AS streak FROM (
  SELECT *, sum((NOT f)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, value < 60 AS f FROM events))"""


@PACK.query(f"SELECT event_id, streak, streak > 0 AND streak % 3 = 0 AS opens FROM ({_STREAK})")
def failure_streaks(spark, sf_dir):
    """Low values in a row per user, and where the third opens the circuit."""
    return state.circuit(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("value") < 60).select("event_id", "streak", "opens")


@PACK.query(
    f"""SELECT event_id, coalesce(t - last < 86400 * 20, false) AS cooling FROM (SELECT event_id, t, max(CASE WHEN streak > 0 AND streak % 3 = 0 THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
      FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM ({_STREAK})))"""
)
def circuit_cooldowns(spark, sf_dir):
    rows = state.circuit(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("value") < 60)
    rows = rows.withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    last = F.max(F.when(F.col("opens"), F.col("t"))).over(Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("last", last).select("event_id", F.coalesce(F.col("t") - F.col("last") < 86400 * 20, F.lit(False)).alias("cooling"))


@PACK.query(
    """SELECT event_id, CASE WHEN s = 'preempted' THEN 'not_asked' WHEN s = 'blocked' THEN 'blocked' WHEN s = 'timeout' THEN 'timeout' WHEN s = 'error: x' THEN 'unreachable' WHEN nodes < 0 THEN 'not_instrumented'
      WHEN nodes > 0 AND usable = 0 THEN CASE WHEN event_id % 11 > 5 THEN 'filtered_out' WHEN event_id % 5 >= 3 THEN 'parser_drift' ELSE 'parser_suspect' END
      WHEN nodes = 0 AND usable = 0 THEN CASE WHEN event_id % 9 >= 5 AND value >= 1.0 THEN 'upstream_empty' ELSE 'unknown_empty' END ELSE 'healthy' END AS verdict FROM (
      SELECT *, CASE event_id % 13 WHEN 0 THEN 'preempted' WHEN 1 THEN 'blocked' WHEN 2 THEN 'timeout' WHEN 3 THEN 'error: x' ELSE 'ok' END AS s, event_id % 4 - 1 AS nodes, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END AS usable FROM events)"""
)
def yield_verdicts(spark, sf_dir):
    k = F.col("event_id")
    status = F.when(k % 13 == 0, "preempted").when(k % 13 == 1, "blocked").when(k % 13 == 2, "timeout").when(k % 13 == 3, "error: x").otherwise("ok")
    verdict = state.yield_verdict(status, k % 4 - 1, F.when(k % 3 == 0, 0).otherwise(k % 7), k % 9, F.col("value"), k % 5, F.when(k % 11 > 5, 1).otherwise(-1))
    return events(spark, sf_dir).select("event_id", verdict.alias("verdict"))


_WATCH = """SELECT event_id, user_id, CASE WHEN c IS NULL THEN 'error' WHEN l IS NULL THEN 'baseline' WHEN c = l THEN 'unchanged' ELSE 'changed' END AS verdict FROM (
  SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS c FROM events))"""


def _watched(spark, sf_dir):
    content = F.when(F.col("event_id") % 10 != 0, F.col("event_type"))
    return state.watch_verdicts(events(spark, sf_dir), "user_id", ["ts", "event_id"], content)


@PACK.query(f"SELECT event_id, verdict FROM ({_WATCH})")
def watch_verdicts(spark, sf_dir):
    return _watched(spark, sf_dir).select("event_id", "verdict")


@PACK.query(f"SELECT verdict, count(*) AS n, count(DISTINCT user_id) AS n_keys FROM ({_WATCH}) GROUP BY verdict")
def watch_summary(spark, sf_dir):
    return _watched(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_keys"))


@PACK.query("SELECT page_id, substr(sha256(url || '|markdown||' || (page_id % 3) || '|'), 1, 24) AS cache_key FROM pages")
def cache_keys(spark, sf_dir):
    key = state.cache_key(F.col("url"), F.lit("markdown"), F.lit(None), F.col("page_id") % 3, F.lit(None))
    return read(spark, sf_dir, "pages").select("page_id", key.alias("cache_key"))


@PACK.query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def cache_upsert(spark, sf_dir):
    """A table keyed by user, with later events put in."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return state.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "event_id")


@PACK.query(
    """SELECT event_id, value FROM events WHERE event_id > (SELECT max(event_id) FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM events)
      WHERE i <= n - CAST(floor((n // 2) * 0.9) AS BIGINT))"""
)
def cache_eviction(spark, sf_dir):
    """A cache of half the events: the newest nine tenths of that stay."""
    rows = events(spark, sf_dir).select("event_id", "value")
    return state.evict(rows, "event_id", rows.count() // 2)


_NOW = "(SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events)"


@PACK.query(
    f"""SELECT count(*) AS n, count(*) FILTER (NOT a) AS expired, max(now - t) AS oldest FROM (SELECT t, now, t + least(CASE WHEN event_id % 2 = 0 THEN 86400 * 100 ELSE 86400 * 400 END, 86400 * 300) > now AS a FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, {_NOW} AS now FROM events))"""
)
def cache_statistics(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    now = F.lit(rows.agg(F.max("t")).first()[0])
    ttl = F.when(F.col("event_id") % 2 == 0, 86400 * 100).otherwise(86400 * 400)
    rows = rows.withColumn("alive", state.alive(F.col("t"), ttl, 86400 * 300, now))
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.col("alive")).alias("expired"), F.max(now - F.col("t")).alias("oldest"))


@PACK.query(
    f"""SELECT user_id, arg_max(event_type, t) AS event_type, max(t) AS t, max(t) + 86400 * 30 > {_NOW} AS remembered FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) * 1000000 + event_id AS u, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) WHERE event_type <> 'error' GROUP BY user_id""".replace("arg_max(event_type, t)", "arg_max(event_type, u)")
)
def route_memory(spark, sf_dir):
    """The last good kind of each user, and whether it is still remembered."""
    rows = events(spark, sf_dir).withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    now = rows.agg(F.max("t")).first()[0]
    out = rows.where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_type", F.struct("t", "event_id")).alias("event_type"), F.max("t").alias("t"))
    return out.withColumn("remembered", F.col("t") + 86400 * 30 > now)


def _folder(spark) -> str:
    """Where streams keep state and output: a folder that driver and executors share."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return polls.event_stream(spark, path, spark.read.parquet(path).schema)


@PACK.query("SELECT event_type, count(*) AS n, sum(value)::DOUBLE AS total FROM events GROUP BY event_type".replace("sum(value)::DOUBLE", "round(sum(value), 4)::DOUBLE"))
def streaming_window_totals(spark, sf_dir):
    """Daily windows of a stream of the events, summed up to kinds."""
    out = polls.run_available(polls.window_counts(_stream(spark, sf_dir), "1 day", "1 hour"), _folder(spark), "complete")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@PACK.query("SELECT user_id, event_type FROM events GROUP BY ALL")
def streaming_new_items(spark, sf_dir):
    """Each user and kind once, from a stream with a watermark longer than the table's span."""
    return polls.run_available(polls.new_items(_stream(spark, sf_dir), ["user_id", "event_type"], "1000 days").select("user_id", "event_type"), _folder(spark))


@PACK.query(
    """WITH RECURSIVE o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT event_type, i, value::DOUBLE AS mean FROM o WHERE i = 1 UNION ALL SELECT o.event_type, o.i, r.mean * 0.7::DOUBLE + o.value * 0.3::DOUBLE FROM r JOIN o ON o.event_type = r.event_type AND o.i = r.i + 1)
    SELECT event_type, max(i) AS n, round(arg_max(mean, i), 6)::DOUBLE AS mean FROM r GROUP BY event_type"""
)
def streaming_running_means(spark, sf_dir):
    """The running means of ``ewma_engine_health``, from state that streams keep."""
    kinds = polls.run_available(polls.kinds(_stream(spark, sf_dir)), _folder(spark), "complete")
    newest = polls.run_available(polls.newest_values(_stream(spark, sf_dir), kinds), _folder(spark), "update")
    out = polls.running_means(kinds, newest)
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"))


@PACK.query()
def streaming_sessions(spark, sf_dir):
    """Sessions of users with gaps of 30 minutes, from a stream."""
    return polls.run_available(polls.sessions(_stream(spark, sf_dir), late=None), _folder(spark), "complete")
