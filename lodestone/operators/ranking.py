"""Rankings, their fusion, selections from them, sessions and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.joins import null_safe
from lodestone.operators.transforms import exact_quantiles, value_places
from lodestone.sources.scratch import written


def sessions(df: DataFrame, key: str, at: str, order: list[str], gap: int) -> DataFrame:
    """Adds session: rows of a key whose ``at`` (seconds) is more than ``gap`` after the row before begin a new one."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def outliers(df: DataFrame, group: str, value: str, k: float, least: float) -> DataFrame:
    """Rows with |value - median| > max(least, k * 1.4826 * MAD) of their group. Both medians are exact and counted range by range."""
    middle = lambda df, c, name: written(exact_quantiles(df, [group], c, [0.5]).select(group, F.col("q")[0].alias(name)))
    far = df.join(middle(df, value, "centre"), group).withColumn("deviation", F.abs(F.col(value) - F.col("centre")))
    return far.join(middle(far, "deviation", "mad"), group).where(F.col("deviation") > F.greatest(F.lit(least), 1.4826 * k * F.col("mad")))


def positions(df: DataFrame, group: list[str], value: str, ties: list[str]) -> DataFrame:
    """Adds below_ (rows of the group with a larger value), tied_ (rows before it among equal values, by ``ties``) and all_ (rows of the group)
    to the rows with a value; by counts of values, so that a large group is not sorted in one task."""
    down = df.where(F.col(value).isNotNull()).withColumn("down_", -F.col(value))
    ranks = value_places(down, group, "down_")
    size = ranks.groupBy("g").agg(F.sum("n").alias("all"))
    told = ranks.join(size, "g").select("g.*", F.col("value").alias("down_"), F.col("below").alias("below_"), F.col("all").alias("all_"))
    tied = F.row_number().over(Window.partitionBy(*group, "down_").orderBy(*ties)) - 1
    return null_safe(down, told, [*group, "down_"]).withColumn("tied_", tied).drop("down_")


def places(df: DataFrame, group: list[str], value: str, ties: list[str]) -> DataFrame:
    """Adds place (rank by descending value, from 1, ties share the first) and percentile (1 for the best, by ``ties`` among equal values)
    within each group of rows with a value."""
    got = positions(df, group, value, ties)
    return got.select(*df.columns, (F.col("below_") + 1).alias("place"), (1 - (F.col("below_") + F.col("tied_")) / F.col("all_")).alias("percentile"))


def borda(rankings: DataFrame, item: str, ranking: str, place: str, n: int, missing: float | str = "penalty") -> DataFrame:
    """item, borda (sum of its places, and for each of the ``n`` rankings that lack it ``missing``: "penalty" is 1e6, "zero" 0, or a number)
    and votes (rankings that have it).

    The order of the fusion is by votes, most first, then by borda. Counted in one pass, without an outer join of the rankings.
    """
    missing = {"penalty": 1e6, "zero": 0.0}.get(missing, missing)
    got = rankings.groupBy(item).agg(F.sum(place).cast("double").alias("sum"), F.countDistinct(ranking).alias("votes"))
    return got.select(item, (F.col("sum") + missing * (n - F.col("votes"))).alias("borda"), "votes")


def best_two(df: DataFrame, item: str, name: str, score: Column) -> DataFrame:
    """item, best (name), best_score, second_score, margin; ties go to the smaller name. Combined before the shuffle."""
    w = Window.partitionBy(item).orderBy(F.col("score").desc(), F.col(name))
    two = df.withColumn("score", score).withColumn("place", F.row_number().over(w)).where("place <= 2")
    got = two.groupBy(item).agg(F.max(F.when(F.col("place") == 1, F.col(name))).alias("best"), F.max("score").alias("best_score"), F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    second = F.when(F.col("n") > 1, F.col("low"))
    return got.select(item, "best", "best_score", second.alias("second_score"), F.round(F.col("best_score") - second, 6).alias("margin"))


def share_until(df: DataFrame, item: str, weight: str, share: float) -> DataFrame:
    """The heaviest items up to the one that brings their sum to ``share`` of all, from a table of few items."""
    w = Window.orderBy(F.col(weight).desc(), F.col(item))
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumns({"before": before, "all": F.sum(weight).over(Window.partitionBy())}).where(F.col("before") < share * F.col("all"))
