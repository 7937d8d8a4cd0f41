"""Column functions on numbers: guarded arithmetic, kernels and simple physics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite


def ratio(a: Column, b: Column, least: float = 1e-12) -> Column:
    """a / b; null where either is not finite or b is nearer to 0 than ``least``."""
    return finite(a) / F.when(F.abs(finite(b)) >= least, finite(b))


def difference(a: Column, b: Column) -> Column:
    return F.abs(finite(a) - finite(b))


def weighted_mean(*pairs: tuple[Column, Column]) -> Column:
    """Of (value, weight): pairs with a null or a weight of 0 or less do not count; null if none is left."""
    ok = [(finite(v), F.when((finite(w) > 0) & finite(v).isNotNull(), finite(w))) for v, w in pairs]
    weight = sum((F.coalesce(w, F.lit(0.0)) for _, w in ok), F.lit(0.0))
    return sum((F.coalesce(v * w, F.lit(0.0)) for v, w in ok), F.lit(0.0)) / F.nullif(weight, F.lit(0.0))


def geometric_mean(a: Column, b: Column) -> Column:
    """Null unless both are finite and their product is not negative."""
    product = finite(a) * finite(b)
    return F.when(product >= 0, F.sqrt(product))


def ionic_character(a: Column, b: Column) -> Column:
    return 1 - F.exp(-((finite(a) - finite(b)) ** 2) / 4)


def reduced_mass(a: Column, b: Column) -> Column:
    return ratio(finite(a) * finite(b), finite(a) + finite(b))


def field_strength(charge: Column, radius: Column) -> Column:
    return ratio(finite(charge), finite(radius) ** 2)


def hsab_strength(ionisation_a: Column, affinity_a: Column, ionisation_b: Column, affinity_b: Column) -> Column:
    """Squared difference of the electronegativities (I + A) / 2 over the sum of the hardnesses |I - A|; null if that is 0."""
    chi = lambda i, a: 0.5 * (finite(i) + finite(a))
    hard = lambda i, a: F.abs(finite(i) - finite(a))
    return ratio((chi(ionisation_a, affinity_a) - chi(ionisation_b, affinity_b)) ** 2, hard(ionisation_a, affinity_a) + hard(ionisation_b, affinity_b))


def kapustinskii(charge: Column, radius_a: Column, radius_b: Column, other_a: Column, other_b: Column) -> Column:
    """|charge| over the sum of two radii, or of the other two where one is missing; null unless the sum is positive."""
    missing = finite(radius_a).isNull() | finite(radius_b).isNull()
    sum_ = F.when(missing, finite(other_a) + finite(other_b)).otherwise(finite(radius_a) + finite(radius_b))
    return F.when(sum_ > 0, F.abs(finite(charge)) / sum_)


def summed_field_strength(parts: Column) -> Column:
    """Sum of f * z / r^2 over an array of (f, z, r); parts without a positive radius do not count, and without any it is null."""
    some = F.filter(parts, lambda p: (finite(p["r"]) > 0) & finite(p["z"]).isNotNull() & finite(p["f"]).isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, p: s + p["f"] * p["z"] / (p["r"] * p["r"])))


def mean_field_strength(parts: Column) -> Column:
    """The sum of f * z / r^2 over the sum of f of the same parts."""
    some = F.filter(parts, lambda p: (finite(p["r"]) > 0) & finite(p["z"]).isNotNull() & finite(p["f"]).isNotNull())
    return ratio(summed_field_strength(parts), F.aggregate(some, F.lit(0.0), lambda s, p: s + p["f"]))


def london_c6(polarisability: Column, ionisation: Column) -> Column:
    return 0.75 * finite(polarisability) ** 2 * finite(ionisation)


def gaussian(value: Column, centre: float, width: float) -> Column:
    return F.exp(-((finite(value) - centre) ** 2) / (2 * width**2))


def decay(distance: Column, scale: float) -> Column:
    return F.exp(-((finite(distance) / scale) ** 2))


def relative_difference(a: Column, b: Column) -> Column:
    """max(a/b, b/a) - 1."""
    return F.greatest(ratio(a, b), ratio(b, a)) - 1


def worst_of(metrics: dict[Column, float] | list[tuple[Column, float]]) -> Column:
    """The largest of metric / tolerance: at most 1 where all tolerances hold; null if a metric is missing."""
    pairs = list(metrics.items() if isinstance(metrics, dict) else metrics)
    shares = [finite(m) / t for m, t in pairs]
    return F.when(F.array_contains(F.array(*[s.isNull() for s in shares]), True), None).otherwise(F.array_max(F.array(*shares)))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(finite(value), F.lit(low)), F.lit(high))


def exact_quotient(total: Column, count: Column) -> Column:
    """A struct of the whole quotient (null if the division leaves a rest) and the reason why it is missing."""
    bad = F.when(total.isNull() | count.isNull(), "missing").when(count == 0, "no_atoms").when(total % count != 0, "not_whole")
    return F.struct(F.when(bad.isNull(), (total / count).cast("long")).alias("value"), bad.alias("reason"))
