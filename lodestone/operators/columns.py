"""Which columns of a feature table to drop, and why.

All statistics come from a few aggregations over the table; what reaches the driver is one row a column or a pair of columns, however many
rows there are. Decisions are taken there and put down in a ledger.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite
from lodestone.operators.gram import correlation_matrix
from lodestone.operators.quality import near_zero_variance, value_counts

LEDGER = "feature string, action string, reason string, kept_for string"


def statistics(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column: rows, nulls (NaN and infinities count as null), missing share, sample and population variance."""
    v = {c: finite(F.col(c)) for c in columns}
    names = {"full": F.count, "var": F.var_samp, "var_pop": F.var_pop, "low": F.min, "high": F.max}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[f(v[c]).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in names.items()]).first()
    out = {c: {k: row[f"{k}{i}"] for k in names} for i, c in enumerate(columns)}
    for c in columns:
        out[c]["missing"] = 1 - out[c]["full"] / row["n"] if row["n"] else 0.0
    return out


def correlation_table(df: DataFrame, columns: list[str], method: str = "pearson") -> dict[tuple[str, str], float]:
    """|r| of each pair (in both orders) over the rows where both are finite; pairs without a defined r are left out."""
    if method == "spearman":
        from lodestone.operators.transforms import average_ranks

        df = average_ranks(df, columns)
    r = np.abs(correlation_matrix(df, columns)) if columns else np.zeros((0, 0))
    return {(a, b): float(r[i, j]) for i, a in enumerate(columns) for j, b in enumerate(columns) if i != j and np.isfinite(r[i, j])}


def scan(columns: list[str], table: dict, over, keep, exempt: set[str] = frozenset(), stop: bool = False, back: bool = False) -> dict[str, str]:
    """dropped -> kept for: in table order each column meets those after it (``back``: before it); of two whose r is ``over``, ``keep`` names
    the one that stays.

    A column that is gone begins no comparisons and is met by none, but one that goes while it is compared is still compared with the
    rest, unless ``stop``; so another can go for one that is gone itself. The last reason is told.
    """
    dropped: dict[str, str] = {}
    for i, a in enumerate(columns):
        if a in dropped:
            continue
        for b in columns[:i] if back else columns[i + 1 :]:
            if (stop and a in dropped) or b in dropped or (a, b) not in table or not over(table[a, b]):
                continue
            stays = keep(a, b)
            goes = b if stays == a else a
            if goes in exempt:
                stays, goes = goes, stays
            if goes not in exempt:
                dropped[goes] = stays
    return dropped


def collinear_by_missing(df: DataFrame, columns: list[str], threshold: float, method: str = "pearson", exempt: set[str] = frozenset()) -> dict[str, str]:
    """Policy A: of two, the one with fewer missing values stays, then the larger variance, then the smaller name."""
    stats, free = statistics(df, columns), [c for c in columns if c not in exempt]
    best = lambda c: (stats[c]["missing"], -(stats[c]["var"] or 0.0), c)
    return scan(free, correlation_table(df, free, method), lambda r: r >= threshold, lambda a, b: min(a, b, key=best))


def collinear_by_target(df: DataFrame, columns: list[str], target: str, threshold: float) -> dict[str, str]:
    """Policy B: the one with the higher |r| to the target stays, then the smaller name."""
    with_target = correlation_table(df, [*columns, target])
    best = lambda c: (-with_target.get((c, target), 0.0), c)
    return scan(columns, with_target, lambda r: r >= threshold, lambda a, b: min(a, b, key=best), back=True)


def collinear_by_variance(df: DataFrame, columns: list[str], threshold: float) -> dict[str, str]:
    """Policy C: r over median-filled values, above the threshold; the larger population variance stays, the earlier one in ties."""
    from lodestone.operators.transforms import fill_values, filled

    stats, full = statistics(df, columns), filled(df, fill_values(df, columns, []))
    return scan(columns, correlation_table(full, columns), lambda r: r > threshold, lambda a, b: a if (stats[a]["var_pop"] or 0) >= (stats[b]["var_pop"] or 0) else b)


def collinear_by_spread(df: DataFrame, columns: list[str], threshold: float) -> dict[str, str]:
    """Policy D: by Spearman's rho, columns are visited from the largest standard deviation on and drop all that go with them."""
    stats = statistics(df, columns)
    order = sorted(columns, key=lambda c: -(stats[c]["var"] or 0.0))
    return scan(order, correlation_table(df, columns, "spearman"), lambda r: r >= threshold, lambda a, b: a, stop=True)


def average_link(columns: list[str], table: dict, threshold: float) -> list[list[str]]:
    """Clusters of columns by average link on 1 - |r| until no two are nearer than 1 - threshold; the earlier pair first in ties."""
    groups = [[c] for c in columns]
    while len(groups) > 1:
        far = lambda g, h: float(np.mean([1 - table.get((a, b), 0.0) for a in g for b in h]))
        d, i, j = min((far(groups[i], groups[j]), i, j) for i, j in combinations(range(len(groups)), 2))
        if d > 1 - threshold:
            break
        groups[i] += groups.pop(j)
    return groups


def collinear_by_cluster(df: DataFrame, columns: list[str], target: str, threshold: float) -> dict[str, str]:
    """Policy E: of each average-link cluster the column with the highest |r| to the target stays, then the smaller name."""
    table = correlation_table(df, [*columns, target])
    out = {}
    for group in average_link(columns, table, threshold):
        stays = min(group, key=lambda c: (-table.get((c, target), 0.0), c))
        out |= {c: stays for c in group if c != stays}
    return out


def collinear_with_earlier(df: DataFrame, columns: list[str], threshold: float) -> dict[str, str]:
    """Policy F: a column goes if any earlier one, dropped or not, has |r| above the threshold with it."""
    table = correlation_table(df, columns)
    found = ((c, next((b for b in columns[:i] if table.get((b, c), 0.0) > threshold), None)) for i, c in enumerate(columns))
    return {c: b for c, b in found if b is not None}


def equal_columns(df: DataFrame, columns: list[str], digits: int = 12) -> dict[str, str]:
    """dropped -> kept for: columns with the values of an earlier one in every row, after rounding; nulls are equal.

    Columns with equal sums of two hashes of (value, row) are candidates; only those are compared value by value. So a wide table asks for
    two numbers a column, not one a pair.
    """
    if len(columns) < 2:
        return {}
    v = {c: F.bround(finite(F.col(c)), digits) + 0.0 for c in columns}
    flat = df.select(*[v[c].alias(f"v{i}") for i, c in enumerate(columns)]).select("*", F.xxhash64(*[f"v{i}" for i in range(len(columns))]).alias("row"))
    sums = [F.sum(F.xxhash64(F.lit(seed), f"v{i}", "row").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(38,0)")) for i in range(len(columns)) for seed in (1, 2)]
    told = flat.agg(F.lit(0), *sums).first()[1:]
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(columns):
        groups.setdefault(told[2 * i : 2 * i + 2], []).append(c)
    pairs = [(a, b) for g in groups.values() for a, b in combinations(g, 2)]
    row = df.agg(*[F.bool_and(v[a].eqNullSafe(v[b])).alias(f"e{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    return scan(columns, {p: 1.0 for p, e in zip(pairs, row, strict=True) if e}, lambda r: True, lambda a, b: a)


def equivalent(df: DataFrame, a: str, b: str, least_r: float = 0.995, tolerance: float = 1e-6, overlap: int = 10) -> bool:
    """Whether two columns say the same: |r| of ``least_r``, a median difference within ``tolerance``, over ``overlap`` rows or more."""
    x, y = finite(F.col(a)), finite(F.col(b))
    both = df.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    n, r, gap = both.agg(F.count(F.lit(1)), F.corr("x", "y"), F.percentile_approx(F.abs(F.col("x") - F.col("y")), 0.5, 10_000)).first()
    return n >= overlap and r is not None and abs(r) >= least_r and gap <= tolerance


def correlations_with_zeros(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlations where a missing value counts as 0, and so does an r that is not defined."""
    m = np.nan_to_num(correlation_matrix(df.select(*[F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in columns]), columns))
    np.fill_diagonal(m, 1.0)
    return m


def factors(m: np.ndarray) -> np.ndarray:
    return np.diag(np.linalg.pinv(m) if np.linalg.cond(m) > 1e12 else np.linalg.inv(m))


def inflation_factors(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation factor of each column, from the inverse of the correlation matrix (a pseudo-inverse where there is none)."""
    return dict(zip(columns, factors(correlations_with_zeros(df, columns)).tolist(), strict=True))


def prune_by_inflation(df: DataFrame, columns: list[str], threshold: float) -> list[str]:
    """The columns that stay when the one with the largest factor goes until none is above the threshold or two are left.

    The table is read once: what is left after each step is a part of one matrix.
    """
    m, left = correlations_with_zeros(df, columns), list(range(len(columns)))
    while len(left) > 2:
        told = factors(m[np.ix_(left, left)])
        worst = int(np.argmax(told))
        if told[worst] <= threshold:
            break
        left.pop(worst)
    return [columns[i] for i in left]


def near_constant(df: DataFrame, columns: list[str], share: float) -> list[str]:
    """Columns of (almost) no variance, or of which one value, to 12 places, has ``share`` of all."""
    stats = statistics(df, columns)
    tops = {r["column"]: r["top"] / r["all"] for r in value_counts(df.select(*[F.round(finite(F.col(c)), 12).alias(c) for c in columns]), columns).groupBy("column").agg(F.max("n").alias("top"), F.sum("n").alias("all")).collect()}  # a row a column
    return [c for c in columns if (stats[c]["var_pop"] or 0.0) < 1e-12 or tops.get(c, 1.0) >= share]


def clean(df: DataFrame, columns: list[str], missing: float = 0.5, distinct_share: float = 0.01, ratio: float = 95.0, threshold: float = 0.95, exempt: set[str] = frozenset()) -> tuple[list[str], DataFrame]:
    """The columns that stay, and the ledger of the others: feature, action, reason, kept_for.

    Steps, each on what the one before left: empty, missing in more than a share ``missing``, constant, near-zero variance, equal to an
    earlier one, collinear (policy A). Exempt columns always stay.
    """
    left, rows, stats = [c for c in columns if c not in exempt], [], statistics(df, columns)

    def drop(reason: str, gone: dict[str, str | None]) -> None:
        rows.extend((c, "drop", reason, gone[c]) for c in left if c in gone)
        left[:] = [c for c in left if c not in gone]

    drop("empty", {c: None for c in left if not stats[c]["full"]})
    drop("missing", {c: None for c in left if stats[c]["missing"] > missing})
    drop("constant", {c: None for c in left if stats[c]["low"] == stats[c]["high"]})
    drop("near_zero_variance", {r["column"]: None for r in near_zero_variance(df, left, distinct_share, ratio).where("near_zero").collect()} if left else {})
    drop("duplicate", equal_columns(df, left))
    drop("collinear", collinear_by_missing(df, left, threshold))
    return [c for c in columns if c in left or c in exempt], df.sparkSession.createDataFrame(rows, LEDGER)
