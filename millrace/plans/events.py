"""The stream operators on the whole event table, as batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import table
from millrace.plans.define import Collector
from millrace.streaming import events as E

query = Collector()
QUERIES, SQL = query.queries, query.sql


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return E.timed(table(spark, sf, "events"))


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.tumbling(_events(spark, sf), "6 hours").select(_stamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(6 * k AS INTEGER)) AS start, event_type, value FROM events, unnest(range(0, 4)) AS t(k))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.sliding(_events(spark, sf), "24 hours", "6 hours").select(_stamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.sessions(_events(spark, sf), "12 hours").select("user_id", _stamp("start").alias("start"), "n")


@query("""SELECT count(*) AS pairs FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def streaming_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return E.deduplicated(_events(spark, sf), ["user_id", "event_type"]).agg(F.count("*").alias("pairs"))


@query("""WITH d(event_type, stage) AS (VALUES ('view', 'look'), ('click', 'look'), ('signup', 'join'), ('purchase', 'buy')) SELECT coalesce(stage, 'other') AS stage, count(*) AS n FROM events LEFT JOIN d USING (event_type) GROUP BY ALL""")
def stream_static_join(spark: SparkSession, sf: str) -> DataFrame:
    stages = spark.createDataFrame([("view", "look"), ("click", "look"), ("signup", "join"), ("purchase", "buy")], "event_type string, stage string")
    return E.enriched(_events(spark, sf), F.broadcast(stages), "event_type").groupBy(F.coalesce("stage", F.lit("other")).alias("stage")).agg(F.count("*").alias("n"))


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def click_then_purchase(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return E.followed_by(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "1 HOUR")
