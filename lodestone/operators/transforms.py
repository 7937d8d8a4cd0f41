"""Transforms of columns: parameters are fitted on some rows and applied to all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite
from lodestone.sources.scratch import written

#: One over the relative error of a sketch of quantiles.
SKETCH = 1000

# --- imputation and scaling


def fill_values(df: DataFrame, numbers: list[str], categories: list[str]) -> dict:
    """The median of each number column and the commonest value (the smaller in ties) of each category column; one row reaches the driver."""
    modes = df.agg(F.lit(0).alias("z"), *[F.mode(F.col(c), deterministic=True).alias(c) for c in categories]).first()
    medians = {c: exact_quantiles(df.select(finite(F.col(c)).alias(c)), [], c, [0.5]).first() for c in numbers}
    return {c: r["q"][0] for c, r in medians.items() if r is not None} | {c: modes[c] for c in categories if modes[c] is not None}


def filled(df: DataFrame, values: dict) -> DataFrame:
    kinds = dict(df.dtypes)
    one = lambda c, v: F.coalesce(finite(F.col(c)) if isinstance(v, float) else F.col(c), F.lit(v).cast("double" if isinstance(v, float) else kinds[c])).alias(c)
    return df.select(*[one(c, values[c]) if c in values else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column; a deviation of 0 counts as 1."""
    v = {c: finite(F.col(c)) for c in columns}
    row = df.agg(F.lit(0), *[x for c in columns for x in (F.avg(v[c]), F.stddev_pop(v[c]))]).first()[1:]
    return {c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(columns) if row[2 * i] is not None}


def robust_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range of each column; a range of 0 counts as 1."""
    rows = {c: exact_quantiles(df.select(finite(F.col(c)).alias(c)), [], c, [0.25, 0.5, 0.75]).first() for c in columns}
    return {c: (r["q"][1], (r["q"][2] - r["q"][0]) or 1.0) for c, r in rows.items() if r is not None}


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]], clip: float | None = None) -> DataFrame:
    """``df`` with the columns that both it and ``scale`` have scaled, and clipped to +-``clip``; all others stay as they are."""
    value = lambda c: (finite(F.col(c)) - scale[c][0]) / scale[c][1]
    limit = lambda x: x if clip is None else F.least(F.greatest(x, F.lit(-clip)), F.lit(clip))
    return df.select(*[limit(value(c)).alias(c) if c in scale else F.col(c) for c in df.columns])


def varying(df: DataFrame, columns: list[str], least: float = 0.0) -> list[str]:
    """Columns whose population variance is above ``least``."""
    row = df.agg(F.lit(0), *[F.var_pop(finite(F.col(c))) for c in columns]).first()[1:]
    return [c for c, x in zip(columns, row, strict=True) if x is not None and x > least]


# --- categories and bins


def categories(df: DataFrame, column: str, most: int = 1000) -> list:
    """The values of a category column in ascending order; an error beyond ``most``, as each becomes a column."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def one_hot(df: DataFrame, column: str, known: list, prefix: str | None = None) -> DataFrame:
    """Adds a 0/1 column for each known value; a value that is not known, or null, has 0 in all."""
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix or column}_{v}") for v in known])


def label_codes(df: DataFrame, column: str, known: list, name: str) -> DataFrame:
    """Adds the place of the value among the known ones, from 0; null for others."""
    return df.withColumn(name, F.nullif(F.array_position(F.array(*map(F.lit, known)), F.col(column)), F.lit(0)) - 1)


def quantile_edges(df: DataFrame, column: str, q: int) -> list[float]:
    """The q - 1 inner quantiles of a column, without repeats: fewer bins where values are tied."""
    row = exact_quantiles(df.select(finite(F.col(column)).alias(column)), [], column, [i / q for i in range(q + 1)]).first()
    return sorted(set(row["q"]))[1:-1] if row is not None else []


def binned(df: DataFrame, column: str, edges: list[float], name: str) -> DataFrame:
    """Adds the number of edges below the value: bins are open on the left and closed on the right."""
    v = finite(F.col(column))
    return df.withColumn(name, F.when(v.isNotNull(), reduce(lambda a, e: a + (v > e).cast("int"), edges, F.lit(0))))


def missing_flags(df: DataFrame, columns: list[str], suffix: str = "_missing") -> DataFrame:
    """Adds <c><suffix>, 0 or 1, for each column that has a missing value."""
    row = df.agg(F.lit(0), *[F.max(finite(F.col(c)).isNull().cast("int")) for c in columns]).first()[1:]
    return df.select("*", *[finite(F.col(c)).isNull().cast("int").alias(c + suffix) for c, any_ in zip(columns, row, strict=True) if any_])


def numeric_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    return [c for c, kind in df.dtypes if c not in exclude and (kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"))]


def mostly_numbers(df: DataFrame, columns: list[str], share: float = 0.5) -> list[str]:
    """Text columns of whose values more than ``share`` read as numbers."""
    text = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns}
    row = df.agg(F.lit(0), *[x for c in columns for x in (F.count(text[c]), F.count(text[c].try_cast("double")))]).first()[1:]
    return [c for i, c in enumerate(columns) if row[2 * i] and row[2 * i + 1] > share * row[2 * i]]


# --- ranks


#: Distinct values of a column up to which average_ranks() sends its ranks to all tasks.
FEW_VALUES = 50_000


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as average ranks (ties share their mean), nulls as null.

    Ranks come from counts of distinct values: these are range-partitioned and summed partition by partition, so no task orders all rows.
    Ranks of columns of at most ``FEW_VALUES`` values are broadcast, so that rows are not sent. The other columns are one table of (row,
    column, value), which meets the ranks in one join.
    """
    if not columns:
        return df.select()
    rows = written(df.select(*[finite(F.col(c)).alias(c) for c in columns]).withColumn("row_", F.monotonically_increasing_id()))
    listed = lambda some: F.posexplode(F.array(*[F.when(F.lit(c in some), F.col(c)) for c in columns])).alias("c", "v")
    ranks = value_places(rows.select(listed(columns)).where("v IS NOT NULL"), ["c"], "v")
    ranks = written(ranks.select("g.c", F.col("value").alias("v"), (F.col("below") + (F.col("n") + 1) / 2).alias("rank")))
    sizes = {r["c"]: r["n"] for r in ranks.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
    many = [c for i, c in enumerate(columns) if sizes.get(i, 0) > FEW_VALUES]
    out = rows
    for i, c in enumerate(columns):
        if c not in many:
            out = out.join(F.broadcast(ranks.where(F.col("c") == i).select(F.col("v").alias(c), F.col("rank").alias(f"rank_{i}"))), c, "left")
    if many:
        long = rows.select("row_", listed(many)).where("v IS NOT NULL")
        wide = long.join(ranks, ["c", "v"]).groupBy("row_").agg(*[F.max(F.when(F.col("c") == i, F.col("rank"))).alias(f"rank_{i}") for i, c in enumerate(columns) if c in many])
        out = out.join(wide, "row_", "left")
    return out.select(*[F.col(f"rank_{i}").alias(c) for i, c in enumerate(columns)])


def value_places(df: DataFrame, group: list[str], column: str, parts: int = 64) -> DataFrame:
    """g (a struct of the group's columns), value, n and below (rows of the group with smaller values) of each distinct value of a group.

    A group's values are dealt to ranges of about equal size, whose bounds are quantiles of its distinct values, and counted range by
    range: neither a large group nor a few of them end up in few tasks. Null values are left out; null group columns are a group.
    """
    g = (F.struct(*group) if group else F.lit(0)).alias("g")
    counts = df.where(F.col(column).isNotNull()).groupBy(g, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.groupBy("g").agg(F.array_distinct(F.percentile_approx("value", [i / parts for i in range(1, parts)], 10 * parts)).alias("bounds"))
    placed = counts.join(bounds, "g").withColumn("part", F.size(F.filter("bounds", lambda b: b <= F.col("value")))).drop("bounds")
    sizes = placed.groupBy("g", "part").agg(F.sum("n").alias("size"))
    ahead = lambda *by: Window.partitionBy("g", *by).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("g", "part", F.coalesce(F.sum("size").over(ahead().orderBy("part")), F.lit(0)).alias("before"))  # at most ``parts`` rows a group
    inside = F.coalesce(F.sum("n").over(ahead("part").orderBy("value")), F.lit(0))
    return placed.withColumn("inside", inside).join(before, ["g", "part"]).select("g", "value", "n", (F.col("before") + F.col("inside")).alias("below"))


def distinct_ranks(df: DataFrame, column: str, parts: int = 256) -> DataFrame:
    """value, n, below (rows with smaller values) and rank (the average rank, from 1) of each distinct value."""
    got = value_places(df, [], column, parts)
    return got.select("value", "n", "below", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def exact_quantiles(df: DataFrame, group: list[str], column: str, qs: list[float], few_groups: bool = False) -> DataFrame:
    """The group's columns and q, an array of the exact quantiles of its values, between neighbours in proportion; groups without values
    have no row.

    A sketch brackets each quantile, and a second pass counts what is below the bracket and the values in it, some thousandths of all. So
    the input is read twice, and neither a large group nor a common value meets in one task. Brackets of ``few_groups`` (columns of a
    table, say) are broadcast, so that rows are not sent to their group.
    """
    sent = F.broadcast if few_groups or not group else lambda told: told
    rows = df.where(F.col(column).isNotNull()).select((F.struct(*group) if group else F.lit(0)).alias("g"), F.col(column).alias("v"))
    edges = [min(max(q + side * 3 / SKETCH, 0.0), 1.0) for q in qs for side in (-1, 1)]
    found = rows.groupBy("g").agg(F.count(F.lit(1)).alias("all"), F.percentile_approx("v", edges, SKETCH).alias("e"))
    few = F.col("all") <= 4 * SKETCH  # neighbours could be outside a bracket: all values are counted
    at = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)]), lambda w: F.struct(w["i"].alias("i"), w["q"].alias("q"), F.when(~few, F.element_at("e", 2 * w["i"] + 1)).alias("low"), F.when(~few, F.element_at("e", 2 * w["i"] + 2)).alias("high")))
    wanted = found.select("g", "all", at.alias("w"))
    v = F.col("v")
    told = F.filter("w", lambda w: w["high"].isNull() | (v <= w["high"]))
    each = F.explode(F.transform(told, lambda w: F.struct(w["i"].alias("i"), F.when(w["low"].isNull() | (v >= w["low"]), v).alias("v"))))
    met = rows.join(sent(wanted), "g")
    counts = met.select("g", each.alias("x")).groupBy("g", "x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).where("v IS NOT NULL")
    quantile = F.element_at(F.array(*map(F.lit, map(float, qs))), F.col("i") + 1)
    x = (F.col("all") - 1) * quantile
    has = lambda k: (F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))
    sizes = found.select("g", "all")
    near = placed.join(sent(sizes), "g").withColumn("x", x).where(has(F.floor("x")) | has(F.ceil("x")))
    ends = near.groupBy("g", "i", "x").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("x") - F.floor("x"))
    listed = ends.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias("q"))
    return listed.select(*["g.*"] * bool(group), "q")
