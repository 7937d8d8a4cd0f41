"""Distances and pools of vectors held as arrays, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def pooled(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, dim, mean, low and high of each component, in long form: one aggregation on (group, dim)."""
    long = df.select(group, F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    return long.groupBy(group, "dim").agg(F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))


def nearest_anchor(df: DataFrame, key: str, vector: str, anchors: list[tuple[str, list[float]]]) -> DataFrame:
    """key, anchor, distance: the nearest of a given, short list of anchors; ties go to the smaller name."""
    each = F.array(*[F.struct(distance(F.col(vector), F.array(*map(F.lit, v))).alias("distance"), F.lit(n).alias("anchor")) for n, v in anchors])
    return df.select(key, F.array_min(each).alias("best")).select(key, "best.anchor", "best.distance")
