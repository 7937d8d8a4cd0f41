"""Checks of tables, each a row of check, ok and found, or an error where asked for."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKS = "check string, ok boolean, found long"


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def unique_keys(df: DataFrame, keys: list[str]) -> tuple[str, bool, int]:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    return f"unique {', '.join(keys)}", n == 0, n


def no_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[str, bool, int]:
    n = a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi").count()
    return f"no common {', '.join(keys)}", n == 0, n


def covers(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[str, bool, int]:
    """Every key of ``a`` is in ``b``."""
    n = a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti").count()
    return f"covers {', '.join(keys)}", n == 0, n


def reconciles(before: DataFrame, kept: DataFrame, removed: DataFrame) -> tuple[str, bool, int]:
    n = before.count() - kept.count() - removed.count()
    return "rows are kept or removed", n == 0, n


def all_rows(df: DataFrame, name: str, test: Column) -> tuple[str, bool, int]:
    """A test that fails or is null counts against it."""
    n = df.where(~F.coalesce(test, F.lit(False))).count()
    return name, n == 0, n


def consecutive_ranks(df: DataFrame, rank: str) -> tuple[str, bool, int]:
    """Ranks are 1, 2, ... without gaps or repeats: told by their count, distinct count and ends alone."""
    n, k, low, high = df.agg(F.count(F.lit(1)), F.countDistinct(rank), F.min(rank), F.max(rank)).first()
    bad = 0 if n == 0 else abs(n - k) + abs((high or 0) - n) + abs((low or 0) - 1)
    return f"{rank} is consecutive", bad == 0, bad


def unchanged(before: DataFrame, after: DataFrame, key: str, touched: DataFrame) -> tuple[str, bool, int]:
    """Rows whose key is not in ``touched`` are as they were, nulls and NaN included."""
    hashed = lambda df: df.select(key, F.xxhash64(*[F.to_json(F.struct(c)) for c in before.columns]).alias("h")).join(touched.select(key), key, "left_anti")
    both = hashed(before).withColumnRenamed("h", "was").join(hashed(after), key, "full_outer")
    n = both.where(~F.col("was").eqNullSafe(F.col("h"))).count()
    return "untouched rows are unchanged", n == 0, n


def report(spark: SparkSession, found: list[tuple[str, bool, int]], strict: bool = False) -> DataFrame:
    if strict:
        for name, ok, n in found:
            require(ok, f"{name}: {n}")
    return spark.createDataFrame(found, CHECKS)


def outcomes(expected: DataFrame, key: str, steps: list[tuple[str, DataFrame]], last: str) -> DataFrame:
    """key and status: the name of the first step that an expected key is missing from, or ``last`` if it passed all."""
    out = expected.select(key).distinct()
    for i, (_, table) in enumerate(steps):
        out = out.join(table.select(key).distinct().withColumn(f"at_{i}", F.lit(True)), key, "left")
    status = F.lit(last)
    for i, (name, _) in reversed(list(enumerate(steps))):
        status = F.when(F.col(f"at_{i}").isNull(), name).otherwise(status)
    return out.select(key, status.alias("status"))


def frame_hash(df: DataFrame) -> str:
    """A hash of a table's rows as a multiset: equal for equal rows in whatever order and partitions."""
    rows = df.select(F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("h")).first()
    return hashlib.sha256(f"{n} {total or 0}".encode()).hexdigest()


def stable_json(payload: object) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def payload_hash(payload: object) -> str:
    return hashlib.sha256(stable_json(payload).encode()).hexdigest()


def checked_config(config: dict, ranges: dict[str, tuple[float, float]]) -> dict:
    """``config`` if it has exactly the keys of ``ranges``, each a number within its range; else an error that names what is wrong."""
    wrong = sorted(config.keys() ^ ranges.keys())
    require(not wrong, f"missing or unknown: {wrong}")
    bad = sorted(k for k, (low, high) in ranges.items() if isinstance(config[k], bool) or not isinstance(config[k], (int, float)) or not low <= config[k] <= high)
    require(not bad, f"out of range: {bad}")
    return config
