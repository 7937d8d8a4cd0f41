"""Retrieval by prototypes: anchors, references, seeds, and how well known cases are found when they are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scoring import against_reference
from lodestone.sources.scratch import written


def anchors(df: DataFrame, prototype: str, eligible: Column, order: list[Column], id_: str) -> DataFrame:
    """prototype and id of the best eligible row of each prototype, by ``order`` and then by id; combined before the shuffle."""
    rows = df.where(eligible & F.col(prototype).isNotNull())
    return rows.groupBy(prototype).agg(F.min_by(id_, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id_))).alias(id_))


def neighbourhood_scores(distances: DataFrame, support: DataFrame, fits: DataFrame, names: list[str], weight: float, id_: str = "id") -> DataFrame:
    """id, prototype, survival, support and score of each row and prototype, and whether it is the row's best (the first of ``names`` in ties).

    ``distances`` has id, prototype and d; ``support`` id, prototype and support. survival compares d with those of the rows in ``fits``
    (ids of fitted rows that are no prototypes); score is ``weight`` * survival + (1 - ``weight``) * support. Rows without d have no score.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight must be between 0 and 1")
    parts = None
    for i, name in enumerate(names):  # a few prototypes, each against its own reference
        mine = distances.where(F.col("prototype") == name).select(id_, "d")
        got = against_reference(mine, "d", mine.join(fits.select(id_), id_, "left_semi"), id_).select(id_, F.lit(name).alias("prototype"), F.lit(i).alias("place"), "survival")
        parts = got if parts is None else parts.union(got)
    both = parts.join(support.select(id_, "prototype", "support"), [id_, "prototype"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    scored = written(both.withColumn("score", weight * F.col("survival") + (1 - weight) * F.col("support")))
    best = scored.where("score IS NOT NULL").groupBy(id_).agg(F.max(F.struct("score", -F.col("place"))).alias("b")).select(id_, (-F.col("b.col2")).alias("best_place"))
    return scored.join(best, id_, "left").select(id_, "prototype", "survival", "support", "score", F.coalesce(F.col("place") == F.col("best_place"), F.lit(False)).alias("best"))


def seed_labels(df: DataFrame, seeds: DataFrame, id_: str = "id", name: str = "label") -> DataFrame:
    """``df`` with 1 for the seeds and -1 for all others."""
    return df.join(seeds.select(id_).distinct().withColumn(name, F.lit(1)), id_, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def seed_neighbours(df: DataFrame, seeds: DataFrame, vector: str, k: int, id_: str = "id") -> DataFrame:
    """id and distance of the ``k`` rows that are nearest to the mean of the seeds' vectors, seeds left out; ties by id."""
    held = df.join(seeds.select(id_), id_, "left_semi").where(F.col(vector).isNotNull())
    mean = held.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m")).orderBy("i").collect()  # a row a component
    if not mean:
        raise ValueError("no seed has a vector")
    centre = F.array(*[F.lit(float(r["m"])) for r in mean])
    d = F.sqrt(F.aggregate(F.zip_with(vector, centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return df.join(seeds.select(id_), id_, "left_anti").where(F.size(vector) == len(mean)).select(id_, d.alias("distance")).orderBy("distance", id_).limit(k)


def left_out_ranks(similarities: DataFrame, anchors_: list, id_: str = "id") -> DataFrame:
    """anchor, score and rank of each anchor when it is left out: it is scored by the other anchors, as is every row, and ranked among all.

    ``similarities`` has id, anchor and s; a row's score is its highest s with the anchors that are left. Each row keeps its best two
    anchors only, and all ranks are counted in one pass; an anchor shares the first place of its ties.
    """
    top = written(similarities.where(F.col("s").isNotNull()).groupBy(id_).agg(F.max(F.struct("s", "anchor")).alias("first")))
    rest = similarities.join(top, id_).where((F.col("anchor") != F.col("first.anchor")) & F.col("s").isNotNull()).groupBy(id_).agg(F.max("s").alias("second"))
    two = written(top.join(rest, id_, "left").select(id_, F.col("first.s").alias("s"), F.col("first.anchor").alias("anchor"), "second"))
    without = lambda a: F.when(F.col("anchor") == a, F.col("second")).otherwise(F.col("s"))
    own = {r["a"]: r["s"] for r in two.where(F.col(id_).isin(anchors_)).select(F.col(id_).alias("a"), F.when(F.col("anchor") == F.col(id_), F.col("second")).otherwise(F.col("s")).alias("s")).collect()}  # a row an anchor
    known = [a for a in anchors_ if own.get(a) is not None]
    counts = two.agg(F.lit(0), *[F.sum((without(F.lit(a)) > own[a]).cast("long")) for a in known]).first()[1:]
    spark = similarities.sparkSession
    kind = dict(similarities.dtypes)[id_]
    return spark.createDataFrame([(a, float(own[a]), int(n or 0) + 1) for a, n in zip(known, counts, strict=True)], f"anchor {kind}, score double, rank long")


def composition_stats(parts: DataFrame, elements: DataFrame, properties: list[str], key: str = "formula", symbol: str = "symbol", amount: str = "amount") -> DataFrame:
    """key and, of each property, its mean and standard deviation weighted by amount, least, highest, range and known (share of the amount with
    a value), over the parts (key, symbol, amount) of each formula. Parts without a positive amount or without a value do not count."""
    rows = parts.where(F.col(amount) > 0).join(elements.select(symbol, *properties), symbol, "left")
    w, sums = F.col(amount).cast("double"), []
    for p in properties:
        v = F.col(p).cast("double")
        on = F.when(v.isNotNull(), w)
        sums += [F.sum(on).alias(f"{p}__w"), F.sum(on * v).alias(f"{p}__wv"), F.sum(on * v * v).alias(f"{p}__wvv"), F.min(v).alias(f"{p}__min"), F.max(v).alias(f"{p}__max")]
    got = rows.groupBy(key).agg(F.sum(w).alias("all__w"), *sums)
    out = []
    for p in properties:
        mean = F.col(f"{p}__wv") / F.col(f"{p}__w")
        out += [
            mean.alias(f"{p}__mean"),
            F.sqrt(F.greatest(F.col(f"{p}__wvv") / F.col(f"{p}__w") - mean * mean, F.lit(0.0))).alias(f"{p}__std"),
            F.col(f"{p}__min"),
            F.col(f"{p}__max"),
            (F.col(f"{p}__max") - F.col(f"{p}__min")).alias(f"{p}__range"),
            F.coalesce(F.col(f"{p}__w") / F.col("all__w"), F.lit(0.0)).alias(f"{p}__known"),
        ]
    return got.select(key, *out)


def proxy_score(df: DataFrame, id_: str, fit: Column, clipped: list[str], optima: dict[str, tuple[float, float]], zero_filled: set[str], steps: tuple[str, dict[float, float], float]) -> DataFrame:
    """id and score, the mean of components between 0 and 1: columns clipped to that range (missing: 0); for each column of ``optima`` a
    Gaussian of the distance of its percentile among the fitted rows from (optimum, width); and the value that ``steps`` (column, known
    values, default) gives.

    Missing values of ``optima`` columns are 0 if in ``zero_filled``, else the median of the fitted rows (0 without any). An error if the
    column of ``steps`` has a missing value. ``id_`` is unique.
    """
    from lodestone.functions.cleaning import finite
    from lodestone.operators.transforms import exact_quantiles

    column, known, default = steps
    if not df.where(finite(F.col(column)).isNull()).isEmpty():
        raise ValueError(f"{column} has missing values")
    at = finite(F.col(column))
    step = F.lit(float(default))
    for value, gives in known.items():
        step = F.when(at == value, float(gives)).otherwise(step)
    parts = [F.least(F.greatest(F.coalesce(finite(F.col(c)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias(f"c_{i}") for i, c in enumerate(clipped)]
    rows = written(df.select(id_, fit.alias("fit_"), *[finite(F.col(c)).alias(f"v_{i}") for i, c in enumerate(optima)], *parts, step.alias("step_")))
    out = rows
    for i, (c, (optimum, width)) in enumerate(optima.items()):  # a few columns, each against its own reference
        middle = None if c in zero_filled else exact_quantiles(rows.where("fit_"), [], f"v_{i}", [0.5]).first()
        full = rows.withColumn("x_", F.coalesce(f"v_{i}", F.lit(float(middle["q"][0]) if middle is not None else 0.0)))
        told = against_reference(full, "x_", full.where("fit_"), id_)
        out = out.join(told.select(id_, F.exp(-((F.col("percentile") - optimum) ** 2) / (2 * width**2)).alias(f"p_{i}")), id_)
    names = [*[f"c_{i}" for i in range(len(clipped))], *[f"p_{i}" for i in range(len(optima))], "step_"]
    return out.select(id_, (sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).alias("score"))
