"""Lists and maps in columns, text keys, flags, and small tables of settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lodestone.functions.cleaning import finite

# --- vectors, lists and maps


def subspace(vector: Column, which: str) -> Column:
    """The components of even or odd place (from 0), or all; vectors of two components or fewer stay whole."""
    if which not in ("all", "even", "odd"):
        raise ValueError(f"unknown subspace {which}")
    some = F.filter(vector, lambda v, i: i % 2 == (1 if which == "odd" else 0))
    return vector if which == "all" else F.when(F.size(vector) <= 2, vector).otherwise(some)


def joined_vectors(*vectors: Column) -> Column:
    """The vectors one after the other; null if one is missing."""
    return F.concat(*vectors)


def common(a: Column, b: Column) -> Column:
    """What two lists have in common, once each, ascending."""
    return F.array_sort(F.array_intersect(a, b))


def merged(old: Column, new: Column) -> Column:
    """A map with the entries of both; where both have a key the new value counts, unless it is null."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(new, k), F.element_at(old, k)).alias("value"))))


def overridden(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by key (unique in each): all columns of both, the new value where it is not null."""
    names = [c for c in old.columns if c != key] + [c for c in new.columns if c not in old.columns]
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    of = lambda c: F.coalesce(*[F.col(f"{t}.`{c}`") for t, df in (("n", new), ("o", old)) if c in df.columns])
    return both.select(key, *[of(c).alias(c) for c in names])


def flattened(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """``df`` with the plain fields of a struct as columns <prefix>__<field> in its place; lists, maps and structs in it are left out."""
    fields = [f for f in df.schema[column].dataType.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    out = []
    for c in df.columns:
        out += [F.col(f"`{column}`.`{f.name}`").alias(f"{prefix or column}__{f.name}") for f in fields] if c == column else [F.col(f"`{c}`")]
    return df.select(*out)


# --- text keys and flags


def signature(columns: list[str], digits: int = 8) -> Column:
    """Numbers with ``digits`` places, half rounded to even and no negative zero, NA for what is missing, joined by |."""
    one = lambda c: F.format_string(f"%.{digits}f", F.bround(finite(F.col(c)), digits) + 0.0)
    return F.concat_ws("|", *[F.when(finite(F.col(c)).isNull(), "NA").otherwise(one(c)) for c in columns])


def risk_flags(df: DataFrame, symbols: Column, groups: dict[str, list[str]], selected: list[str] | None = None, flag_only: bool = False) -> DataFrame:
    """``df`` with risk_<group> (whether the list of symbols has one of the group's) and risk_elements (those of the ``selected`` groups,
    ascending, joined by ;). Rows with a flag of a selected group go, unless ``flag_only``."""
    chosen = list(groups) if selected is None else selected
    if unknown := set(chosen) - set(groups):
        raise ValueError(f"unknown groups: {', '.join(sorted(unknown))}")
    held = F.coalesce(symbols, F.array().cast("array<string>"))
    every = sorted({s for g in chosen for s in groups[g]})
    out = df.select("*", *[F.arrays_overlap(held, F.array(*map(F.lit, v))).alias(f"risk_{g}") for g, v in groups.items()], F.array_join(common(held, F.array(*map(F.lit, every)).cast("array<string>")), ";").alias("risk_elements"))
    return out if flag_only else out.where(F.col("risk_elements") == "")


def highlighted(df: DataFrame, name: str, queries: list[str], suffix: str = ".cif") -> tuple[DataFrame, list[str]]:
    """Rows whose name has one of a few ``queries`` in it, in any case (a query's suffix does not count), and the queries that no row has."""
    asked = [q.strip().lower().removesuffix(suffix) for q in queries if q.strip()]
    if not asked:
        return df.where("false"), []
    hit = lambda q: F.lower(F.col(name)).contains(q)
    seen = df.agg(*[F.coalesce(F.max(hit(q)), F.lit(False)).alias(f"q{i}") for i, q in enumerate(asked)]).first()
    any_ = hit(asked[0])
    for q in asked[1:]:
        any_ = any_ | hit(q)
    return df.where(any_), [q for q, found in zip(asked, seen, strict=True) if not found]


def labelled_paths(values: list[str], safe: str = "[A-Za-z0-9][A-Za-z0-9_.-]*") -> dict[str, str]:
    """LABEL=PATH texts as a dict; an error for other forms, labels that are not safe, and repeats."""
    out: dict[str, str] = {}
    for value in values:
        label, given, path = value.partition("=")
        if not given:
            raise ValueError(f"{value} has not the form LABEL=PATH")
        if not re.fullmatch(safe, label):
            raise ValueError(f"{label!r} is no safe label")
        if label in out:
            raise ValueError(f"label {label} repeats")
        out[label] = path
    return out


def orbital_electrons(configuration: Column, orbital: str = "d") -> Column:
    """Electrons in the orbitals of a kind, of a text like 3d6 4s2; null for no text."""
    found = F.regexp_extract_all(configuration, F.lit(f"[0-9]+{orbital}([0-9]+)"), F.lit(1))
    return F.when(configuration != "", F.aggregate(found, F.lit(0), lambda s, x: s + x.cast("int")))


def doped(parts: Column, extra: dict[str, float]) -> Column:
    """An array of (symbol, amount) with amounts added (negative ones count as 0), divided by their new sum."""
    added = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(max(0.0, float(x))).alias("amount")) for s, x in extra.items()])
    every = F.concat(parts, added)
    symbols = F.array_distinct(F.transform(every, lambda p: p["symbol"]))
    of = lambda s: F.aggregate(F.filter(every, lambda p: p["symbol"] == s), F.lit(0.0), lambda a, p: a + p["amount"])
    total = F.aggregate(every, F.lit(0.0), lambda a, p: a + p["amount"])
    return F.when(total > 0, F.transform(symbols, lambda s: F.struct(s.alias("symbol"), (of(s) / total).alias("amount"))))


# --- counts and ranks


def row_ranks(df: DataFrame, columns: list[str], name: str = "rank") -> DataFrame:
    """``df`` with <name>_<column>, the rank of each column's value among the columns of its row: 1 the least, ties share their mean, and a
    missing value has none."""
    values = F.array(*[finite(F.col(c)) for c in columns])
    rank = lambda c: F.when(finite(F.col(c)).isNotNull(), F.size(F.filter(values, lambda v: v < F.col(c))) + (F.size(F.filter(values, lambda v: v == F.col(c))) + 1) / 2)
    return df.select("*", *[rank(c).alias(f"{name}_{c}") for c in columns])


def mean_of_ranks(df: DataFrame, item: str, scores: list[str]) -> DataFrame:
    """item and mean_rank: each row's scores are ranked among themselves, and the ranks' mean is told; items without a score have null."""
    ranked = row_ranks(df, scores, "r_")
    there = F.filter(F.array(*[f"r__{c}" for c in scores]), lambda v: v.isNotNull())
    return ranked.select(item, (F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(there), F.lit(0))).alias("mean_rank"))


def by_frequency(df: DataFrame, ratio: str, kinds: list[str], digits: int = 3) -> DataFrame:
    """ratio (rounded), kinds, n and place: how often each combination of kinds comes with a ratio, the commonest first (ties by kinds)."""
    counts = df.where(F.col(ratio).isNotNull()).groupBy(F.round(ratio, digits).alias(ratio), *kinds).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(ratio).orderBy(F.desc("n"), *kinds)))


def best_by(df: DataFrame, group: str, ladder: list[tuple[str, bool]], id_: str) -> DataFrame:
    """The row of each group that comes first by a ladder of (column, whether larger is better), then by id; missing values come last.

    Combined before the shuffle.
    """
    steps = []
    for i, (c, larger) in enumerate(ladder):
        v = finite(F.col(c))
        steps += [v.isNull().alias(f"m{i}"), (-v if larger else v).alias(f"v{i}")]
    return df.groupBy(group).agg(F.min_by(F.struct(*[c for c in df.columns if c != group]), F.struct(*steps, F.col(id_))).alias("best")).select(group, "best.*")


def selected_by(selections: list[DataFrame], item: str) -> DataFrame:
    """item and n, in how many of the selections it is."""
    every = None
    for s in selections:
        one = s.select(item).distinct()
        every = one if every is None else every.union(one)
    return every.groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def column_blocks(columns: list[str], size: int = 40) -> list[list[str]]:
    return [columns[i : i + size] for i in range(0, len(columns), size)]


# --- tables of settings


def dimension_tables(spark: SparkSession, folder: str, key: str = "symbol") -> dict[str, DataFrame]:
    """The CSV tables of a folder that have the key, by file name, in its order; merge them with overridden()."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()  # a row a file
    tables = {p.rsplit("/", 1)[-1]: spark.read.csv(p, header=True, inferSchema=True) for p in sorted(r["path"] for r in found)}
    return {n: t for n, t in tables.items() if key in t.columns}


def report(df: DataFrame, kind: str = "markdown", most: int = 1000) -> str:
    """A small table as Markdown, HTML or JSON text; an error beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    if kind == "json":
        import json

        return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, sort_keys=True, default=str)
    text = [["" if v is None else str(v) for v in r] for r in rows]
    if kind == "markdown":
        line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        return "\n".join([line(df.columns), "|" + "-|" * len(df.columns), *map(line, text)])
    if kind == "html":
        from html import escape

        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
        return "<table>" + row(df.columns, "th") + "".join(row(r, "td") for r in text) + "</table>"
    raise ValueError(f"unknown kind {kind}")
