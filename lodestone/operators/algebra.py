"""Columns made of other columns, shares of categories, tiers, numbers of groups and nested tolerance profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite
from lodestone.functions.numbers import ratio
from lodestone.operators.families import components
from lodestone.operators.order import numbered
from lodestone.operators.shaping import shared_suffixes
from lodestone.sources.scratch import written


def pairwise(df: DataFrame, a: str = "M__", b: str = "H__", out: str = "mh__", weights: tuple[str, str] | None = None, signed: bool = False, only: dict[str, set[str]] | None = None) -> DataFrame:
    """Adds, for each suffix that is there with both prefixes, <out><suffix>__diff (absolute unless ``signed``), __ratio (null for a divisor of
    0) and, with the names of two ``weights`` columns, __wmean. ``only`` names the suffixes that get a kind; kinds it lacks go to all."""
    made = []
    for s in shared_suffixes(df.columns, a, b):
        x, y = finite(F.col(f"`{a}{s}`")), finite(F.col(f"`{b}{s}`"))
        kinds = {"diff": x - y if signed else F.abs(x - y), "ratio": ratio(x, y)}
        if weights:
            u, v = (finite(F.col(w)) for w in weights)
            kinds["wmean"] = ratio(u * x + v * y, u + v)
        made += [c.alias(f"{out}{s}__{k}") for k, c in kinds.items() if only is None or k not in only or s in only[k]]
    return df.select("*", *made)


def category_shares(df: DataFrame, group: str, category: str, known: dict[str, list], other: str = "other") -> DataFrame:
    """group and share_<name> of its rows whose category is one of a name's values, and share_<other> of those of no name; nulls count as other."""
    inside = {n: F.coalesce(F.col(category).isin(v), F.lit(False)) for n, v in known.items()}
    rest = F.lit(True)
    for c in inside.values():
        rest = rest & ~c
    return df.groupBy(group).agg(*[F.avg(c.cast("int")).alias(f"share_{n}") for n, c in {**inside, other: rest}.items()])


def tiers(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds; a rule that gives null does not hold."""
    out = F.lit(default)
    for holds, name in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def group_numbers(df: DataFrame, keys: list[str], start: int = 1, name: str = "number") -> DataFrame:
    """The distinct ``keys`` with numbers from ``start`` in their order; numbered part by part, not in one task."""
    return numbered(df.select(*keys).distinct(), [F.asc_nulls_last(k) for k in keys], name).withColumn(name, F.col(name) + start)


def tolerance_profiles(nodes: DataFrame, pairs: DataFrame, score: str, profiles: dict[str, float], node: str = "node") -> DataFrame:
    """profile, families and removed (rows beyond one a family) when pairs whose ``score`` is within each profile's tolerance are joined.

    Wider profiles begin with what tighter ones have joined.
    """
    found, rows = written(nodes.select(node, F.col(node).alias("family"))), []
    for name, within in sorted(profiles.items(), key=lambda p: p[1]):
        of = lambda end: found.select(F.col(node).alias(end), F.col("family").alias(f"{end}_family"))
        links = pairs.where(F.col(score) <= within).join(of("a"), "a").join(of("b"), "b").where("a_family <> b_family")
        links = links.select(F.col("a_family").alias("a"), F.col("b_family").alias("b")).distinct()
        new = components(found.select(F.col("family").alias("old")).distinct(), links, "old")
        found = written(found.withColumnRenamed("family", "old").join(new, "old").select(node, "family"))
        n, k = found.agg(F.count(F.lit(1)), F.countDistinct("family")).first()
        rows.append((name, k, n - k))
    return nodes.sparkSession.createDataFrame(rows, "profile string, families long, removed long")
