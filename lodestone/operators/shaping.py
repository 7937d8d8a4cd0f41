"""Which rows and columns a table keeps, in what order and by what names, and how its rows are split."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite
from lodestone.operators.transforms import value_places

# --- rows


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` are all finite numbers; nothing is filled in."""
    return df.where(F.forall(F.array(*[finite(F.col(c)) for c in columns]), lambda v: v.isNotNull()))


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target; NaN counts as none in a column of floating numbers."""
    there = F.col(target).isNotNull()
    return df.where(there & ~F.isnan(target) if dict(df.dtypes)[target] in ("double", "float") else there)


def without_rare(df: DataFrame, label: str, least: int = 3) -> DataFrame:
    """Rows of the classes that have ``least`` rows or more; rows without a class go. Classes are counted before the shuffle."""
    few = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_")).where((F.col("n_") >= least) & F.col(label).isNotNull()).select(label)
    return df.join(few, label, "left_semi")


def isolated(df: DataFrame, key: str, exclude: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not in ``exclude``, or is in ``only``; exactly one of them must be given. A null key is in neither."""
    if (exclude is None) == (only is None):
        raise ValueError("give exclude or only, not both")
    return df.join(exclude.select(key), key, "left_anti") if only is None else df.join(only.select(key), key, "left_semi")


def leaks(tables: dict[str, DataFrame], forbidden: DataFrame, key: str) -> DataFrame:
    """table and n, the rows whose key is forbidden, of each table that has such rows."""
    found = [t.join(forbidden.select(key).distinct(), key, "left_semi").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.where("n > 0")


def leaking_files(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """path and n, the lines that hold one of a few ``words`` as a whole word, of each text file below ``path`` that has such lines."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    any_ = "(?<![A-Za-z0-9])(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")(?![A-Za-z0-9])"
    return lines.where(F.col("value").rlike(any_) if words else F.lit(False)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def random_rows(df: DataFrame, group: str, id_: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows of each group (all, if there are fewer), told by the seed and the ids alone."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(id_)), id_)
    return df.withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= k).drop("place_")  # each task keeps the first k of a group


def top_of_clusters(df: DataFrame, label: str, score: str, id_: str, k: int) -> DataFrame:
    """The ``k`` rows of each cluster with the highest score (ties: smaller id); noise, negative or null labels, has none."""
    w = Window.partitionBy(label).orderBy(F.desc_nulls_last(score), id_)
    return df.where(F.col(label) >= 0).withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= k).drop("place_")


def folds(df: DataFrame, id_: str, k: int, seed: int = 0, strata: list[str] | None = None, name: str = "fold") -> DataFrame:
    """``df`` with the fold, 0 to ``k`` - 1, of each row, by a hash of the seed and the id. With ``strata`` each stratum is dealt out evenly,
    in the order of the hash; its rows are counted range by range, so that a large one is not sorted in one task."""
    h = F.xxhash64(F.lit(seed), F.col(id_))
    if not strata:
        return df.withColumn(name, F.pmod(h, F.lit(k)).cast("int"))
    keyed = df.withColumn("h_", h).withColumn("g_", F.struct(*strata))
    places = value_places(keyed, strata, "h_").select(F.col("g").alias("g_"), F.col("value").alias("h_"), (F.col("below") % k).cast("int").alias(name))
    return keyed.join(places, ["g_", "h_"]).drop("g_", "h_")


def to_representatives(table: DataFrame, representatives: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is a representative's, with the columns of ``representatives`` that it lacks.

    An error if a key of the table is null or repeats, or if it does not cover the inventory exactly.
    """
    counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("n_"))
    if not counts.where(F.col(key).isNull() | (F.col("n_") > 1)).isEmpty():
        raise ValueError(f"{key} must be there and unique")
    both = counts.select(key, F.lit(1).alias("in_table")).join(inventory.select(key).distinct().withColumn("in_inventory", F.lit(1)), key, "full_outer")
    if (odd := both.where("in_table IS NULL OR in_inventory IS NULL").select(key).first()) is not None:
        raise ValueError(f"the table does not cover the inventory exactly: {odd[0]}")
    return table.join(representatives.select(key, *[c for c in representatives.columns if c not in table.columns]), key)


# --- columns


def flat_or_missing(df: DataFrame, columns: list[str], missing: float = 0.5, tolerance: float = 0.0) -> DataFrame:
    """feature, missing and variance of the columns to drop: more than a share ``missing`` null, or a sample variance of ``tolerance`` or less.

    One pass. A column of fewer than two numbers has no variance, and goes by its nulls alone.
    """
    v = {c: finite(F.col(c)) for c in columns}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(v[c]).alias(f"k{i}") for i, c in enumerate(columns)], *[F.when(F.count(v[c]) > 1, F.var_samp(v[c])).alias(f"v{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), (1 - F.col(f"k{i}") / F.col("n")).alias("missing"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])
    return row.select(F.inline(each)).where((F.col("missing") > missing) | (F.col("variance") <= tolerance))


def aligned(df: DataFrame, columns: list[str], kinds: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """``columns`` in this order. One that the table lacks is an error, or, if not ``strict``, null of its kind (double)."""
    if strict and (lost := [c for c in columns if c not in df.columns]):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast((kinds or {}).get(c, "double")).alias(c) for c in columns])


def front(df: DataFrame, first: list[str]) -> DataFrame:
    """The columns of ``first`` that are there, then all others, both in their order."""
    ahead = [c for c in first if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in [*ahead, *[c for c in df.columns if c not in ahead]]])


def shared_suffixes(columns: list[str], a: str = "M__", b: str = "H__") -> list[str]:
    """The suffixes, in order, that are there with both prefixes."""
    of = lambda p: {c[len(p) :] for c in columns if c.startswith(p)}
    return sorted(of(a) & of(b))


def by_suffix(columns: list[str], base: list[str], a: str = "M__", b: str = "H__", both: str = "mh__", kinds: tuple[str, ...] = ("ratio", "diff", "wmean")) -> list[str]:
    """Base columns, those of the first prefix alone, those of the second alone, then suffix by suffix what both have (first, second and the
    kinds made of both), then the rest."""
    suffixes = {p: {c[len(p) :] for c in columns if c.startswith(p)} for p in (a, b)}
    made = {(m[1], m[2]) for c in columns if (m := re.fullmatch(f"{re.escape(both)}(.+)__({'|'.join(kinds)})", c))}
    lone = [[f"{p}{s}" for s in sorted(suffixes[p] - suffixes[q])] for p, q in ((a, b), (b, a))]
    of_one = suffixes[a] ^ suffixes[b]
    grouped = []
    for s in sorted((suffixes[a] & suffixes[b]) | {s for s, _ in made} - of_one):
        grouped += [f"{p}{s}" for p in (a, b) if s in suffixes[p]] + [f"{both}{s}__{k}" for k in kinds if (s, k) in made]
    out = [c for c in base if c in columns] + lone[0] + lone[1] + grouped
    return out + [c for c in columns if c not in out]


def renamed(df: DataFrame, rules: list[tuple[str, str]], units: list[tuple[str, str]] = (), same: dict[str, str] | None = None) -> DataFrame:
    """Columns by the first rule (pattern of the whole name, new name) that matches, with the unit of the first pattern found in the old name.

    ``same`` renames single columns first, without a unit; columns that no rule matches stay. An error if two get one name.
    """
    names = {}
    for c in df.columns:
        rule = next(((p, r) for p, r in rules if re.fullmatch(p, c)), None)
        if c in (same or {}):
            names[c] = same[c]
        elif rule:
            names[c] = re.sub(rule[0], rule[1], c, count=1) + next((u for p, u in units if re.search(p, c)), "")
        else:
            names[c] = c
    if len(set(names.values())) < len(names):
        raise ValueError(f"names repeat: {', '.join(sorted({n for n in names.values() if list(names.values()).count(n) > 1}))}")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def collapsed(df: DataFrame) -> DataFrame:
    """One column a name: of several with the same one the first value that is not null, at the place of the first."""
    places: dict[str, list[int]] = {}
    for i, c in enumerate(df.columns):
        places.setdefault(c, []).append(i)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.coalesce(*[f"c{i}" for i in at]).alias(c) for c, at in places.items()])


def wanted(columns: list[str], exclude: set[str] = frozenset(), patterns: list[str] = (), keep: set[str] = frozenset()) -> list[str]:
    """Columns that are kept by name, or neither excluded by name nor by a pattern found in them (in any case)."""
    return [c for c in columns if c in keep or (c not in exclude and not any(re.search(p, c, re.IGNORECASE) for p in patterns))]


def key_stats(df: DataFrame, key: str, value: str, sub: str | None = None, known: list = ()) -> DataFrame:
    """key, mean, low and high of a value, and a column of its mean for each known value of ``sub``; rows without key or value do not count."""
    rows = df.withColumn("v_", finite(F.col(value))).where(F.col(key).isNotNull() & F.col("v_").isNotNull())
    per = [F.avg(F.when(F.col(sub) == k, F.col("v_"))).alias(f"{sub}_{k}_mean") for k in known] if sub else []
    return rows.groupBy(key).agg(F.avg("v_").alias("mean"), F.min("v_").alias("low"), F.max("v_").alias("high"), *per)


def top_correlated(df: DataFrame, columns: list[str], k: int) -> list[tuple[str, str, float]]:
    """The ``k`` pairs of columns with the largest |r|, and r; ties by their order."""
    from lodestone.operators.gram import correlation_matrix

    r = correlation_matrix(df, columns)
    pairs = [(a, b, float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j and r[i, j] == r[i, j]]
    return sorted(pairs, key=lambda p: -round(abs(p[2]), 12))[:k]


def saved_scale(spark: SparkSession, scale: dict[str, tuple[float, float]], path: str) -> None:
    """The parameters of a scaler as one table: feature, mean and scale."""
    spark.createDataFrame([(c, float(m), float(s)) for c, (m, s) in scale.items()], "feature string, mean double, scale double").coalesce(1).write.mode("errorifexists").parquet(path)


def read_scale(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["mean"], r["scale"]) for r in spark.read.parquet(path).collect()}  # a row a column


def binary_compounds(symbols: Column, known: list[str]) -> Column:
    """Why a list of symbols is no binary compound with one of the ``known``: null, or the reason."""
    n = F.size(F.array_distinct(symbols))
    held = F.size(F.filter(F.array_distinct(symbols), lambda s: s.isin(known)))
    return F.when(n != 2, "not_binary").when(held == 0, "none_known").when(held == 2, "both_known")


def drop_reasons(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The rows without a reason to drop them, and reason and n of the others."""
    return df.where(reason.isNull()), df.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
