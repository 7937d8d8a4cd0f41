"""How well a selection stands up to other weights, and portfolios drawn from it section by section."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scoring import capped_head
from lodestone.operators.transforms import exact_quantiles
from lodestone.sources.scratch import written


@dataclass(frozen=True)
class Scenario:
    """One way to score: a weight and a distance scale for each part (None: the part is a similarity already)."""

    weights: dict[str, float]
    scales: dict[str, float | None]


def scenarios(weights: list[dict[str, float]], scales: dict[str, list[float | None]]) -> list[Scenario]:
    """Every set of weights (brought to a sum of 1) with every combination of scales; an error if a set has no positive weight."""
    out = []
    for w in weights:
        if any(x < 0 for x in w.values()) or not sum(w.values()) > 0:
            raise ValueError("weights must not be negative, and one must be positive")
        total = sum(w.values())
        out += [Scenario({k: x / total for k, x in w.items()}, dict(zip(scales, s, strict=True))) for s in product(*scales.values())]
    return out


def scored(scenario: Scenario) -> Column:
    """The weighted sum of the parts; distances d of scale s count as exp(-(d / s)^2)."""
    part = lambda c: F.col(c).cast("double") if scenario.scales.get(c) is None else F.exp(-F.pow(F.col(c) / scenario.scales[c], F.lit(2.0)))
    return sum((F.lit(w) * part(c) for c, w in scenario.weights.items()), F.lit(0.0))


def robustness(df: DataFrame, item: str, ways: list[Scenario], calibrates: Column, fraction: float, grades: tuple[float, float] = (0.8, 0.5)) -> DataFrame:
    """item, frequency, score_mean, score_std (population), n_runs and grade of each item.

    ``df`` has a row per item and prototype; an item's score in a scenario is the best of its rows'. It is selected if that reaches the
    1 - ``fraction`` quantile of the scores of the items that calibrate (any of whose rows does). Frequencies of ``grades`` or more are
    A and B, others C. A scenario in which a part is missing gives no score and selects nothing. All scenarios are one scan.
    """
    best = df.groupBy(item).agg(F.max(calibrates.cast("int")).alias("counts"), *[F.max(scored(s)).alias(f"s{i}") for i, s in enumerate(ways)])
    best = written(best)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.col(f"s{i}").alias("score")) for i in range(len(ways))]))
    long = lambda rows: rows.select(item, each.alias("x")).select(item, "x.*")
    cut = exact_quantiles(long(best.where("counts = 1")), ["way"], "score", [1 - fraction]).collect()  # a row a scenario
    limit = {r["way"]: r["q"][0] for r in cut}
    n = len(ways)
    got = F.array(*[F.col(f"s{i}") for i in range(n)])
    hits = sum((F.coalesce((F.col(f"s{i}") >= limit[i]).cast("int"), F.lit(0)) for i in limit), F.lit(0))
    there = F.filter(got, lambda x: x.isNotNull())
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    told = best.select(item, (hits / n).alias("frequency"), there.alias("there")).withColumn("score_mean", F.when(F.size("there") > 0, add("there", lambda x: x) / F.size("there")))
    spread = F.when(F.size("there") > 0, F.sqrt(add("there", lambda x: (x - F.col("score_mean")) * (x - F.col("score_mean"))) / F.size("there")))
    grade = F.when(F.col("frequency") >= grades[0], "A").when(F.col("frequency") >= grades[1], "B").otherwise("C")
    return told.select(item, "frequency", "score_mean", spread.alias("score_std"), F.lit(n).alias("n_runs"), grade.alias("grade"))


@dataclass(frozen=True)
class Section:
    """A part of a portfolio: which rows it may take, in what order, and how many items."""

    name: str
    allows: Column
    order: list[Column]
    most: int


def portfolio(df: DataFrame, item: str, group: str, sections: list[Section], each: int) -> DataFrame:
    """Rows of ``df`` with section and place (from 1): section by section the first items that no earlier one has taken, no more than
    ``each`` of a group, and one row an item. An item's rows are of one group.

    Sections come one after the other, rows do not: items and groups are cut in parallel, and what one section leaves out for another is
    at most its own few items.
    """
    from pyspark.sql import Window

    parts: list[DataFrame] = []
    for s in sections:
        rows = df.where(s.allows)
        for p in parts:
            rows = rows.join(p.select(item), item, "left_anti")
        first = rows.withColumn("place", F.row_number().over(Window.partitionBy(item).orderBy(*s.order))).where("place = 1").drop("place")
        head = capped_head(first, group, s.order, each, s.most)
        parts.append(written(head.withColumn("section", F.lit(s.name)).withColumn("place", F.row_number().over(Window.orderBy(*s.order)))))  # at most ``most`` rows
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
