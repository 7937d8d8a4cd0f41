"""Joins that hold their promises: of one row a key, of no lost or clashing columns, of an unambiguous answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: list[str], name: str) -> None:
    """An error with a key that several rows of ``df`` have."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys).first()
    if twice is not None:
        raise ValueError(f"{name} has several rows with {tuple(twice)}")


def no_clash(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {k.lower() for k in keys}
    if both:
        raise ValueError(f"both tables have {sorted(both)}")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of tables in which a key is one row at most; an error if it is not, or if other columns share a name."""
    no_clash(left, right, keys)
    unique(left, keys, "left")
    unique(right, keys, "right")
    return left.join(right, keys, "left")


def outer_fold(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """All tables joined on ``keys``, with every key that any of them has."""
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), tables)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys match null keys; the keys come once."""
    r = right.select(*[F.col(c).alias(f"r_{keys.index(c)}") if c in keys else F.col(c) for c in right.columns])
    met = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"r_{i}"]) for i, k in enumerate(keys)])
    return left.join(r, met, how).drop(*[f"r_{i}" for i in range(len(keys))])


def group_values(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Every row with the aggregates of its group; null keys are a group."""
    return null_safe(df, df.groupBy(*keys).agg(*aggregates), keys)


def nearest(left: DataFrame, right: DataFrame, on: str, key: str, most: float | None = None) -> DataFrame:
    """``left`` with ``key`` of the ``right`` row whose value ``on`` is nearest (the smaller value in ties), and the gap; null beyond ``most``.

    The distinct values of both tables go through one sorted pass: no row meets all of ``right``, which may be large, and equal values of
    ``left`` are looked up once. Values are dealt to ranges by quantiles of both, and each range gets the nearest keys outside it as well.
    """
    keys = right.where(F.col(on).isNotNull()).groupBy(F.col(on).alias("v")).agg(F.min(key).alias("k"))
    asked = left.where(F.col(on).isNotNull()).select(F.col(on).alias("x")).distinct()
    found = keys.select("v").union(asked).agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000)).first()[0]
    bounds = sorted(set(found or []))
    part = lambda c: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= c)) if bounds else F.lit(0)
    dealt = keys.withColumn("part", part(F.col("v")))
    edges = dealt.groupBy("part").agg(F.min(F.struct("v", "k")).alias("low"), F.max(F.struct("v", "k")).alias("high"))
    every = edges.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("part")).join(edges, "part", "left")
    w = Window.orderBy("part")  # at most 64 rows
    around = every.select("part", F.last("high", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    so_far = lambda *order: Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # noqa: E731  # a frame to the end would be read anew for each row
    both = asked.withColumns({"side": F.lit(1), "v": F.lit(None).cast(dict(keys.dtypes)["v"]), "k": F.lit(None).cast(dict(keys.dtypes)["k"])}).unionByName(dealt.select(F.col("v").alias("x"), F.lit(0).alias("side"), "v", "k"))
    mark = F.when(F.col("side") == 0, F.struct("v", "k"))
    both = both.withColumn("part", part(F.col("x")))
    seen = both.withColumns({"down": F.last(mark, True).over(so_far("x", "side")), "up": F.last(mark, True).over(so_far(F.desc("x"), F.desc("side")))}).where("side = 1")
    seen = seen.join(F.broadcast(around), "part", "left").withColumns({"down": F.coalesce("down", "before"), "up": F.coalesce("up", "after")})
    gap = lambda c: F.abs(F.col("x") - F.col(f"{c}.v"))
    down = F.col("up").isNull() | (gap("down") <= gap("up"))
    best = F.when(down & F.col("down").isNotNull(), F.struct(gap("down").alias("gap"), F.col("down.k").alias("k"))).when(F.col("up").isNotNull(), F.struct(gap("up").alias("gap"), F.col("up.k").alias("k")))
    ok = F.lit(True) if most is None else F.col("best.gap") <= most
    told = seen.withColumn("best", best).select(F.col("x").alias("x_"), F.when(ok, F.col("best.k")).alias("k_"), F.when(ok, F.col("best.gap")).alias("gap"))
    return left.join(told, F.col(on) == F.col("x_"), "left").select(*[left[c] for c in left.columns], F.col("k_").alias(key), "gap")


def preferred(rows: DataFrame, keys: list[str], kind: str, preference: list, value: str, then: list[Column]) -> DataFrame:
    """keys, value and kind of one row a key: the first ``kind`` in ``preference``, else any; ties by ``then``. Combined before the shuffle."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preference)), F.col(kind)), F.lit(0)), F.lit(len(preference) + 1))
    best = F.min(F.struct(place.alias("place"), *[c.alias(f"t{i}") for i, c in enumerate(then)], F.col(value).alias("value"), F.col(kind).alias("kind")))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.value").alias(value), F.col("b.kind").alias(kind))


def repaired(df: DataFrame, bad: Column, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` of the rows that are ``bad`` taken from the good rows of the same key, and repair: kept, repaired, ambiguous
    (the good rows of the key differ) or unmatched."""
    good = df.where(~bad).groupBy(key).agg(F.min(F.struct(*columns)).alias("low"), F.max(F.struct(*columns)).alias("high"))
    both = df.join(good, key, "left")
    status = F.when(~bad, "kept").when(F.col("low").isNull(), "unmatched").when(F.col("low") == F.col("high"), "repaired").otherwise("ambiguous")
    told = both.withColumn("repair", status)
    new = {c: F.when(F.col("repair") == "repaired", F.col(f"low.{c}")).otherwise(F.col(c)) for c in columns}
    return told.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], "repair")


def side_by_side(left: DataFrame, right: DataFrame, place: str, guard: str) -> DataFrame:
    """Rows with the same ``place`` beside each other; an error if the tables differ in places or in the column ``guard`` of any row."""
    r = right.withColumnsRenamed({guard: "other_guard"})
    both = left.join(r, place, "full_outer")
    odd = both.where(~F.col(guard).eqNullSafe(F.col("other_guard"))).select(place).first()
    if odd is not None:
        raise ValueError(f"rows differ at {odd[0]}")
    return both.drop("other_guard")


def keys_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether two tables cover the same keys."""
    one = a.select(*keys).distinct().withColumn("a", F.lit(1)).unionByName(b.select(*keys).distinct().withColumn("a", F.lit(-1)))
    return one.groupBy(*keys).agg(F.sum("a").alias("d")).where("d <> 0").isEmpty()


def aligned_union(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables, columns by name; a column that a table lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
