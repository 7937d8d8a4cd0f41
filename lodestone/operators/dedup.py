"""Exact, conflicting and approximate duplicates; blocked pairs; families and their representatives."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representatives(df: DataFrame, group: list[str], order: list[Column], key: str) -> DataFrame:
    """Adds family_size, representative (``key`` of the first row by ``order``) and is_representative. One shuffle on ``group``."""
    every = Window.partitionBy(*group)
    first = F.first(key).over(every.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns({"family_size": F.count(F.lit(1)).over(every), "representative": first}).withColumn("is_representative", F.col(key) == F.col("representative"))


def best_of_group(df: DataFrame, group: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row per group: ``columns`` of the row with the least ``order`` and the group's size, combined before the shuffle."""
    return df.groupBy(*group).agg(F.min_by(F.struct(*columns), order).alias("best"), F.count(F.lit(1)).alias("family_size")).select(*group, "best.*", "family_size")


def size_histogram(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("family_size")).groupBy("family_size").agg(F.count(F.lit(1)).alias("families"))


def merge_conflicts(df: DataFrame, key: list[str], target: str, ids: list[str], order: list[str]) -> DataFrame:
    """One row per key and, where rows agree on ``target``, per target: the target (the median where rows disagree), conflict, each id of the
    first row by ``order``, and ids_merged_<id>: its distinct values in first-seen order where rows disagree, else its own. Null keys form
    a group; null targets are no targets. A key's rows meet in one task only as (ids, order) lists of its own duplicates.
    """
    of = F.struct(*order, *[F.col(i).alias(f"id_{n}") for n, i in enumerate(ids)])
    got = df.groupBy(*key).agg(F.min(target).alias("low"), F.max(target).alias("high"), F.min(of).alias("first"))
    conflict = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    few = df.alias("l").join(got.where(conflict).select(*key).alias("r"), same, "left_semi")  # only keys with a conflict need their rows
    few = few.groupBy(*key).agg(F.percentile(target, F.lit(0.5)).alias("middle"), F.sort_array(F.collect_list(of)).alias("rows"))
    listed = lambda n: F.array_distinct(F.transform("rows", lambda r: text(r[f"id_{n}"])))
    seen = [F.array_join(listed(n), "|").alias(f"seen_{n}") for n in range(len(ids))]
    both = got.withColumn("conflict", conflict).alias("l").join(few.select(*key, "middle", *seen).alias("r"), same, "left")
    own = [F.col(f"first.id_{n}").alias(i) for n, i in enumerate(ids)]
    merged = [F.when(F.col("conflict"), F.col(f"seen_{n}")).otherwise(text(F.col(f"first.id_{n}"))).alias(f"ids_merged_{i}") for n, i in enumerate(ids)]
    value = F.when(F.col("conflict"), F.col("middle")).otherwise(F.col("low").cast("double")).alias(target)
    return both.select(*[F.col(f"l.{k}") for k in key], "conflict", value, *own, *merged)


def conflict_report(df: DataFrame, key: list[str], target: str) -> DataFrame:
    """Keys whose rows have several targets: rows, distinct targets, least and greatest target. Only their rows are counted in detail."""
    bad = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(target).alias("low"), F.max(target).alias("high")).where("low <> high")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    few = df.select(*key, target).distinct().alias("l").join(bad.alias("r"), same, "left_semi").groupBy(*key).agg(F.count(target).alias("n_targets"))
    return few.alias("l").join(bad.alias("r"), same).select(*[F.col(f"l.{k}") for k in key], "n_rows", "n_targets", "low", "high")


def near_vectors(df: DataFrame, digits: dict[str, int], key: str) -> DataFrame:
    """Groups of rows whose numbers agree after rounding to ``digits``: the group's least ``key`` and its size, per distinct vector."""
    return df.groupBy(*[F.bround(c, n).alias(c) for c, n in digits.items()]).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n_rows"))


def exact_rows(df: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """One row of those that agree in all columns but ``ids``: the first by ``order``, and how many there were. Nulls agree."""
    key = [c for c in df.columns if c not in ids]
    return df.groupBy(*key).agg(F.min_by(F.struct(*ids), F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n_rows")).select(*key, "first.*", "n_rows")


#: Keys in a list of copies that blocked_pairs() sends as one, and rows of a cell's part.
LISTED, PART = 256, 16_384


def blocked_pairs(df: DataFrame, block: str, key: str, value: str, within: float, carry: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Pairs (key_a < key_b) of a block whose values differ by a share of at most ``within`` of the greater, the share (rounded to ``digits``),
    and <c>_a and <c>_b of the columns ``carry``.

    Values are dealt to logarithmic cells so wide that a pair is in one cell or in neighbours; a cell meets itself and the next cell only.
    Equal values are lists of at most ``LISTED`` or so of their keys, and a cell's lists are parts of ``PART`` rows or so. Pairs of parts are
    dealt to all tasks: a row is sent about seven times where a cell is one part, however many pairs it has. In a task lists meet first; the
    pairs of rows, which may be many more than rows, come last and are not sent. Rows whose value is null, 0 or less have no such share and
    no pairs.
    """
    rows = df.where((F.col(value) > 0) & F.col(key).isNotNull()).select(F.col(block), F.col(value).alias("value"), F.struct(F.col(key).alias("key"), *carry).alias("row"))
    sizes = rows.groupBy(block, "value").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", _cell(within))
    cells = sizes.groupBy(block, "cell").agg(F.ceil(F.sum("n") / PART).alias("parts"))
    deal = F.pmod(F.xxhash64("row.key"), F.ceil(F.col("n") / LISTED))
    lists = rows.join(sizes, [block, "value"]).groupBy(block, "cell", "value", deal.alias("list")).agg(F.collect_list("row").alias("rows"))
    dealt = lists.join(cells, [block, "cell"]).withColumn("part", F.pmod(F.xxhash64("value", "list"), F.col("parts")))
    parts = dealt.groupBy(block, "cell", "part").agg(F.collect_list(F.struct("value", "list", "rows")).alias("lists"))
    xs = parts.select(block, "cell", F.col("part").alias("part_x"), F.col("lists").alias("xs"))
    ys = parts.select(block, F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("cell"), F.col("cell").alias("own"), F.col("part").alias("part_y"), F.col("lists").alias("ys"))
    both = xs.join(ys, [block, "cell"]).where((F.col("own") > F.col("cell")) | (F.col("part_x") <= F.col("part_y")))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks, block, "cell", "own", "part_x", "part_y").withColumn("one", (F.col("own") == F.col("cell")) & (F.col("part_x") == F.col("part_y")))
    met = both.select(block, "one", F.explode("xs").alias("x"), "ys").select(block, "one", "x", F.explode("ys").alias("y"))
    met = met.select(block, "one", F.col("x.value").alias("value"), F.col("y.value").alias("other"), F.col("x.list").alias("list_x"), F.col("y.list").alias("list_y"), F.col("x.rows").alias("xs"), F.col("y.rows").alias("ys"))
    same, after = F.col("value") == F.col("other"), F.col("value") < F.col("other")
    met = met.where(~F.col("one") | after | (same & (F.col("list_x") <= F.col("list_y")))).withColumn("difference", _share()).where(F.col("difference") <= within)
    if digits is not None:
        met = met.withColumn("difference", F.round("difference", digits))
    met = met.withColumn("turn", ~same | (F.col("list_x") != F.col("list_y"))).select(block, "difference", "turn", F.explode("xs").alias("x"), "ys")
    met = met.select(block, "difference", "turn", "x", F.explode("ys").alias("y")).where("x.key < y.key OR (turn AND x.key > y.key)")
    forth = F.col("x.key") < F.col("y.key")
    ends = [F.when(forth, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{c}_{e}") for c in ["key", *carry] for e, p, q in (("a", "x", "y"), ("b", "y", "x"))]
    return met.select(block, *ends, "difference")


def _positive(df: DataFrame, block: str, key: str, value: str) -> DataFrame:
    return df.where(F.col(value) > 0).select(F.col(block), F.col(key).alias("key"), F.col(value).alias("value"))


def _cell(within: float) -> Column:
    return F.floor(F.log("value") / (math.log1p(within / (1 - within)) * (1 + 1e-9)))


def _share() -> Column:
    return F.abs(F.col("value") - F.col("other")) / F.greatest("value", "other")


def _met(rows: DataFrame, block: str, within: float) -> DataFrame:
    """block, value, other and difference of the distinct values that match, each pair once, and each value with itself."""
    a = rows.select(block, "value").distinct().withColumn("cell", _cell(within))
    b = a.select(block, F.col("value").alias("other"), F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("cell"), F.col("cell").alias("own"))
    met = a.join(b, [block, "cell"]).where((F.col("own") > F.col("cell")) | (F.col("value") <= F.col("other")))
    return met.withColumn("difference", _share()).where(F.col("difference") <= within)


def linked_pairs(df: DataFrame, block: str, key: str, value: str, within: float) -> DataFrame:
    """key_a, key_b and difference: those of blocked_pairs() that are enough to join the same families, at ``within`` and any smaller share.

    If two values match, so do all between them: the least key of a value is linked with the value's other keys and with the next value's
    least key. There are fewer links than rows.
    """
    rows = _positive(df, block, key, value)
    first = rows.groupBy(block, "value").agg(F.min("key").alias("first"))
    same = rows.join(first, [block, "value"]).where(F.col("key") != F.col("first")).select("first", F.col("key").alias("next"), F.lit(0.0).alias("difference"))
    placed = first.withColumn("cell", _cell(within))
    before = Window.partitionBy(block, "cell").orderBy("value")
    inside = placed.withColumns({"other": F.lag("value").over(before), "next": F.lag("first").over(before)}).select("first", "next", _share().alias("difference"))
    ends = placed.groupBy(block, "cell").agg(F.min(F.struct("value", "first")).alias("low"), F.max(F.struct("value", "first")).alias("high"))
    after = ends.select(block, (F.col("cell") - 1).alias("cell"), "low.*").withColumnsRenamed({"value": "other", "first": "next"})
    across = ends.select(block, "cell", "high.*").join(after, [block, "cell"]).select("first", "next", _share().alias("difference"))
    links = same.union(inside).union(across).where(F.col("difference") <= within)
    return links.select(F.least("first", "next").alias("key_a"), F.greatest("first", "next").alias("key_b"), "difference")


def blocked_classes(df: DataFrame, block: str, key: str, value: str, within: float) -> tuple[DataFrame, DataFrame]:
    """blocked_pairs() without the copies: ``key`` and class (the least key of the same block and value) of each row, and the pairs (key_a <
    key_b, difference) of classes. Rows of a class match each other and the same rows; a row without a value is its own class."""
    rows = _positive(df, block, key, value)
    first = rows.groupBy(block, "value").agg(F.min("key").alias("first"))
    classes = df.select(F.col(block), F.col(key), F.col(value).alias("value")).join(first, [block, "value"], "left").select(key, F.coalesce("first", key).alias("class"))
    met = _met(rows, block, within).where("value <> other")
    both = met.join(first.withColumnRenamed("first", "x"), [block, "value"]).join(first.select(block, F.col("value").alias("other"), F.col("first").alias("y")), [block, "other"])
    return classes, both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "difference")
