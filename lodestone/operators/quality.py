"""Profiles of columns and relations between them, each from one pass over the table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.joins import null_safe
from lodestone.operators.transforms import exact_quantiles, value_places


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_rows, n_null, n_distinct (nulls not counted), one row per column."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"{c}__full") for c in columns], *[F.countDistinct(c).alias(f"{c}__distinct") for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"{c}__full")).alias("n_null"), F.col(f"{c}__distinct").alias("n_distinct")) for c in columns]
    return stats.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n of the values that are not null, in long form; counted before the shuffle."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def near_zero_variance(df: DataFrame, columns: list[str], distinct_share: float, ratio: float) -> DataFrame:
    """column, distinct_share, top_count, second_count and near_zero: few distinct values among all, and the commonest ``ratio`` times as
    common as the second. A column of one value is constant, not near zero; one of nulls alone has no row."""
    counts = value_counts(df, columns)
    first = counts.groupBy("column").agg(F.max_by("value", F.struct("n", "value")).alias("top"), F.max("n").alias("top_count"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"))
    rest = counts.join(F.broadcast(first.select("column", "top")), "column").where("value <> top").groupBy("column").agg(F.max("n").alias("second_count"))  # a row a column
    got = first.join(rest, "column", "left").withColumns({"second_count": F.coalesce("second_count", F.lit(0)), "distinct_share": F.col("k") / F.col("all")})
    near = (F.col("k") > 1) & (F.col("distinct_share") <= distinct_share) & (F.col("top_count") >= ratio * F.col("second_count"))
    return got.select("column", "distinct_share", "top_count", "second_count", near.alias("near_zero"))


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """a, b and Pearson's r of each pair of columns: one aggregation, as many numbers as pairs; of many columns, a Gram matrix."""
    pairs = list(combinations(columns, 2))
    if len(columns) > 24:
        from lodestone.operators.gram import correlation_matrix

        r = correlation_matrix(df, columns)
        at = {c: i for i, c in enumerate(columns)}
        rows = [(a, b, None if r[at[a], at[b]] != r[at[a], at[b]] else float(r[at[a], at[b]])) for a, b in pairs]
        return df.sparkSession.createDataFrame(rows, "a string, b string, r double").withColumn("r", F.round("r", digits))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", digits).alias("r")) for i, (a, b) in enumerate(pairs)])))


def mean_ranks(df: DataFrame, columns: list[str], within: list[str]) -> DataFrame:
    """Adds rank_<c>, average ranks (ties share their mean) inside the groups ``within``; a null has none."""
    for c in columns:
        ranks = value_places(df, within, c).select("g.*", F.col("value").alias(c), (F.col("below") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))
        df = null_safe(df, ranks, [*within, c])
    return df


def robust_stats(df: DataFrame, group: list[str], value: str, digits: int = 6) -> DataFrame:
    """Per group: n, mean, std_pop, median, iqr, low, high and spread."""
    v = F.col(value)
    got = df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.min(v).alias("low"), F.max(v).alias("high"))
    got = null_safe(got, exact_quantiles(df, group, value, [0.25, 0.5, 0.75]), group)
    r = lambda c: F.round(c, digits)
    return got.select(*group, "n", r(F.col("mean")).alias("mean"), r(F.col("std_pop")).alias("std_pop"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2] - F.col("q")[0]).alias("iqr"), r(F.col("low")).alias("low"), r(F.col("high")).alias("high"), r(F.col("high") - F.col("low")).alias("spread"))


def entropy(df: DataFrame, group: list[str], category: str, digits: int = 6) -> DataFrame:
    """Per group: n_categories and Shannon entropy of the category shares in nats, raw and divided by its largest value (0 for one)."""
    n = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    got = n.groupBy(*group).agg(F.count(F.lit(1)).alias("n_categories"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    h = F.log("total") - F.col("nlogn") / F.col("total")
    top = F.when(F.col("n_categories") > 1, h / F.log("n_categories")).otherwise(0.0)
    return got.select(*group, "n_categories", (F.round(h, digits) + 0.0).alias("entropy"), (F.round(top, digits) + 0.0).alias("evenness"))


def weighted(df: DataFrame, group: list[str], value: str, weight: str, digits: int = 4) -> DataFrame:
    """Per group: weighted mean, weighted standard deviation and geometric mean over rows with a value and a positive weight."""
    ok = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    v, w = F.col(value), F.col(weight)
    got = ok.groupBy(*group).agg(F.sum(w).alias("w"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wvv"), F.sum(w * F.log(v)).alias("wl"))
    mean = F.col("wv") / F.col("w")
    return got.select(*group, F.round(mean, digits).alias("weighted_mean"), F.round(F.sqrt(F.greatest(F.col("wvv") / F.col("w") - mean * mean, F.lit(0.0))), digits).alias("weighted_std"), F.round(F.exp(F.col("wl") / F.col("w")), digits).alias("geometric_mean"))
