"""Feeds as streams: arrivals without repeats, counts by window, and hits of phrases.

State is bounded by the watermark in every operator. The same functions work on a table that is at rest, where
the watermark has no effect, so a stream that has read all its files agrees with the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelweave.functions.text import has_word


def without_repeats(feed: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first arrival of every key; a stream forgets a key once its watermark has passed, a table keeps one row a key."""
    if feed.isStreaming:
        return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return feed.dropDuplicates([key])


def window_counts(feed: DataFrame, time: str, width: str, delay: str, *by: str) -> DataFrame:
    """begin, by, n, total: rows and sum of `value` by window of event time."""
    marked = feed.withWatermark(time, delay) if feed.isStreaming else feed
    sums = marked.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).alias("total"))
    return sums.select(F.col("window.start").alias("begin"), *by, "n", "total")


def user_sessions(feed: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """key, begin, end, n of the sessions of a key: runs of rows no further apart than `gap`."""
    marked = feed.withWatermark(time, delay) if feed.isStreaming else feed
    found = marked.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def phrase_hits(feed: DataFrame, key: str, text: str, *phrases: str) -> DataFrame:
    """key and the phrase of every text that holds it as whole words; stateless."""
    found = [F.when(has_word(F.col(text), p), F.lit(p)) for p in phrases]
    return feed.select(key, F.explode(F.array_compact(F.array(*found))).alias("phrase"))
