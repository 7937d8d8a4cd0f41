"""Windowed aggregations of a stream with late rows, and batch work that is resumed where it stopped.

The functions take streaming and batch tables alike: a batch has no late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _spans(df: DataFrame, at: str, late: str, window: Column, group: list[str], aggregates: list[Column]) -> DataFrame:
    timely = df.withWatermark(at, late) if df.isStreaming else df
    got = timely.groupBy(window.alias("span"), *group).agg(*aggregates)
    return got.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *[c for c in got.columns if c != "span"])


def tumbling(df: DataFrame, at: str, width: str, group: list[str], aggregates: list[Column], late: str = "1 hour") -> DataFrame:
    return _spans(df, at, late, F.window(at, width), group, aggregates)


def sliding(df: DataFrame, at: str, width: str, step: str, group: list[str], aggregates: list[Column], late: str = "1 hour") -> DataFrame:
    return _spans(df, at, late, F.window(at, width, step), group, aggregates)


def sessions(df: DataFrame, at: str, gap: str, group: list[str], aggregates: list[Column], late: str = "1 hour") -> DataFrame:
    return _spans(df, at, late, F.session_window(at, gap), group, aggregates)


def distinct_events(df: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; a stream forgets keys that are older than ``late``."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def resumed(spark: SparkSession, todo: DataFrame, key: str, done: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the rows whose key the table at ``done`` lacks, added to it; a second call does only what is new. Returns the table."""
    try:
        left = todo.join(spark.read.parquet(done).select(key), key, "left_anti")
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = todo
    work(left).write.mode("append").parquet(done)
    return spark.read.parquet(done)
