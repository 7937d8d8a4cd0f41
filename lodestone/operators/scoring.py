"""Scores of rows against references, selections from rankings, and how well predictions and rankings do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.transforms import distinct_ranks, exact_quantiles

# --- against a reference sample


def against_reference(df: DataFrame, value: str, reference: DataFrame, key: str) -> DataFrame:
    """key, percentile and survival of each row's value in the reference sample of the same column.

    percentile is (smaller + not larger) / (2 n), 0.5 without a reference, survival (n - smaller + 1) / (n + 1); both null for a null value.
    One sort of the
    distinct values of both tables gives all counts.
    """
    marked = reference.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(1).alias("w"))
    n = marked.count()
    all_ = marked.unionByName(df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(0).alias("w")))
    per = all_.groupBy("v").agg(F.sum("w").alias("w"))
    ranks = distinct_ranks(marked, "v").select(F.col("value").alias("r"), "below", "n")
    edges = ranks.agg(F.percentile_approx("r", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    bounds = sorted(set(edges))
    part = lambda c: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= c)) if bounds else F.lit(0)
    tops = ranks.groupBy(part(F.col("r")).alias("part")).agg(F.max(F.col("below") + F.col("n")).alias("top"))
    every = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("part")).join(tops, "part", "left")
    before = every.select("part", F.coalesce(F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # at most 64 rows
    here = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    told = per.withColumn("part", part(F.col("v"))).withColumn("smaller", F.coalesce(F.sum("w").over(here), F.lit(0)))
    counts = told.join(F.broadcast(before), "part").select("v", (F.col("smaller") + F.col("before")).alias("smaller"), F.col("w").alias("equal"))
    both = df.select(key, F.col(value).alias("v")).join(counts, "v", "left")
    middle = ((2 * F.col("smaller") + F.col("equal")) / (2.0 * n)) if n else F.when(F.col("v").isNotNull(), 0.5)
    return both.select(key, middle.alias("percentile"), ((n - F.col("smaller") + 1) / F.lit(n + 1.0)).alias("survival"))


# --- selections


def capped_head(df: DataFrame, group: str, order: list[Column], each: int, most: int) -> DataFrame:
    """The first ``most`` rows by ``order`` with no more than ``each`` of a group. Groups are cut to ``each`` first, in parallel."""
    few = df.withColumn("in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("in_group") <= each).drop("in_group")
    return few.orderBy(*order).limit(most)  # a top-k report: each task keeps its own first rows


def top_fraction_frequency(runs: DataFrame, run: str, item: str, score: str, fraction: float) -> DataFrame:
    """item and share of the runs in whose first ceil(fraction * n) by score it is; ties go to the smaller item."""
    from lodestone.operators.ranking import positions

    n = runs.groupBy(run).agg(F.ceil(F.count(F.lit(1)) * fraction).alias("top_"))
    placed = positions(runs, [run], score, [item]).join(n, run)
    total = runs.select(run).distinct().count()
    chosen = placed.groupBy(item).agg(F.sum((F.col("below_") + F.col("tied_") < F.col("top_")).cast("long")).alias("hits"))
    return runs.select(item).distinct().join(chosen, item, "left").select(item, (F.coalesce("hits", F.lit(0)) / total).alias("frequency"))


def best_per_group(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """The best item of each group and the group's rank by it, 1 the best; ties by group. Groups are ranked by counts, not in one task."""
    best = df.where(F.col(score).isNotNull()).groupBy(group).agg(F.max_by(F.struct(item, score), F.struct(F.col(score), F.col(item))).alias("best")).select(group, "best.*")
    ranks = distinct_ranks(best.select((-F.col(score)).alias("s")), "s")
    tied = Window.partitionBy(score).orderBy(group)
    return best.join(ranks.select((-F.col("value")).alias(score), "below"), score).withColumn("rank", F.col("below") + F.row_number().over(tied)).select(group, item, score, "rank")


# --- kernels and fusion


def kernel(a: Column, b: Column) -> Column:
    """Dot product clipped to 0..1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0))


def best_kernel(df: DataFrame, key: str, vector: str, anchors: list[list[float]]) -> DataFrame:
    """key and the largest kernel with any of a short list of anchors."""
    return df.select(key, F.array_max(F.array(*[kernel(F.col(vector), F.array(*map(F.lit, a))) for a in anchors])).alias("similarity"))


def kernel_distance(aa: Column, bb: Column, ab: Column) -> Column:
    return F.sqrt(F.greatest(aa + bb - 2 * ab, F.lit(0.0)))


def distance_scale(df: DataFrame, distance: str, eligible: Column, q: float = 0.1, least: float = 1e-8) -> float:
    """The ``q`` quantile of the distances of eligible rows, ``least`` at least; 1 without such rows."""
    got = exact_quantiles(df.where(eligible), [], distance, [q]).first()
    return 1.0 if got is None else max(got["q"][0], least)


def fused(views: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the views' scores that are there."""
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in views), F.lit(0.0))
    return sum((F.coalesce(v * w, F.lit(0.0)) for v, w in views), F.lit(0.0)) / F.nullif(weight, F.lit(0.0))


def best_prototype(df: DataFrame, key: str, prototype: str, views: list[tuple[str, float]]) -> DataFrame:
    """key, prototype and score: views are fused inside each prototype, then the best prototype counts; ties by name."""
    scored = df.select(key, prototype, fused([(F.col(c), w) for c, w in views]).alias("score")).where("score IS NOT NULL")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col(prototype).alias("p")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col("b.p").alias(prototype), (-F.col("b.s")).alias("score"))


# --- how well it went


def regression_metrics(df: DataFrame, group: list[str], truth: str, guess: str) -> DataFrame:
    """Per group: n, r2, mae and rmse over rows with both values; r2 is null for a constant truth. One pass."""
    y, p = F.col(truth), F.col(guess)
    ok = df.where(y.isNotNull() & p.isNotNull())
    got = ok.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((y - p) ** 2).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("v"))
    return got.select(*group, "n", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"), "mae", F.sqrt("mse").alias("rmse"))


def retrieval_metrics(df: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """Mean reciprocal rank and recall at each k of the ranks of hidden positives; a null rank was not found."""
    r = F.col(rank)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), *[F.avg(F.coalesce((r <= k).cast("int"), F.lit(0))).alias(f"recall_at_{k}") for k in ks])


def min_max_fused(df: DataFrame, item: str, scores: list[str]) -> DataFrame:
    """item and the mean of its scores, each brought to 0..1 by its least and greatest (0 where these are equal); nulls count as 0."""
    ends = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(scores) for n, f in (("low", F.min), ("high", F.max))])
    both = df.crossJoin(F.broadcast(ends))  # one row
    each = [F.coalesce((F.col(c) - F.col(f"low_{i}")) / F.nullif(F.col(f"high_{i}") - F.col(f"low_{i}"), F.lit(0)), F.lit(0.0)) for i, c in enumerate(scores)]
    return both.select(item, (sum(each[1:], each[0]) / len(scores)).alias("fused"))


def sum_of_top(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """group and the sum of its ``k`` largest values; k counts each, equal values too."""
    placed = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.least(F.col("n"), k - F.coalesce(F.sum("n").over(w), F.lit(0))))
    return placed.withColumn("room", room).groupBy(group).agg(F.sum(F.col(value) * F.col("room")).alias("total"))


def allocated(df: DataFrame, key: str, parts: Column, score: str) -> DataFrame:
    """part, weight and mean: each row's score goes to its parts (an array of symbol and amount) by their shares, and is averaged per part."""
    long = df.where(F.col(score).isNotNull()).select(key, score, F.inline(parts))
    return long.groupBy("symbol").agg(F.sum("amount").alias("weight"), (F.sum(F.col(score) * F.col("amount")) / F.sum("amount")).alias("mean"))


def pivot_counts(df: DataFrame, index: list[str], column: str, labels: list) -> DataFrame:
    """index, a count for each label (0 where there is none, also for labels that no row has) and total; other labels count in total."""
    return df.groupBy(*index).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(str(v)) for v in labels], F.count(F.lit(1)).alias("total"))
