"""Queries on feeds, run over the tables at rest; `tests/test_streaming.py` runs the same operators as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.runtime import table
from kernelweave.streaming import feeds as S


def feed_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events and their values by day and type."""
    found = S.window_counts(table(spark, d, "events"), "ts", "1 day", "1 day", "event_type")
    return found.select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


def feed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user: events at most six hours apart."""
    found = S.user_sessions(table(spark, d, "events"), "user_id", "ts", "6 hours", "1 day")
    return found.select("user_id", F.unix_micros(F.col("begin").cast("timestamp")).alias("begin"), "n")


def feed_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Number of sentences by corpus once repeated deliveries are left out."""
    rows = S.without_repeats(table(spark, d, "sentence"), "sent_id", "loaded_at", "30 days")
    return rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))


def feed_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """Phrases found in the documents, with the number of documents."""
    found = S.phrase_hits(table(spark, d, "documents"), "doc_id", "text", "market stall", "traffic light", "bus lane")
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


_HAS = r"regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{p})(?:[^\p{{L}}\p{{N}}]|$)')"

QUERIES = {f.__name__: f for f in (feed_window_counts, feed_sessions, feed_without_repeats, feed_phrase_hits)}
ORACLES = {
    "feed_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value::DECIMAL(20,4))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2",
    "feed_sessions": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
      SELECT user_id, epoch_us(min(ts)) AS begin, count(*) AS n FROM s GROUP BY user_id, k""",
    "feed_without_repeats": "SELECT corpus, count(*) AS n FROM (SELECT DISTINCT ON (sent_id) * FROM sentence) GROUP BY 1",
    "feed_phrase_hits": "SELECT phrase, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS phrase FROM documents WHERE {_HAS.format(p=p)}" for p in ("market stall", "traffic light", "bus lane")) + ") GROUP BY 1",
}
