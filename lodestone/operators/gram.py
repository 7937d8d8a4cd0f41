"""Gram matrices of wide tables, and what stands on them: correlations, principal components, truncated singular values.

Each task multiplies its batches as matrices and gives a row per pair of columns; the sums of these, as many numbers as pairs, are all that
reaches the driver, however many rows there are. Columns are moved by their means first, so that large offsets cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite


def numbers(df: DataFrame, columns: list[str] | str) -> tuple[DataFrame, int]:
    """``df`` as one array column x of doubles, NaN where a value is missing; ``columns`` are names, or one array column's name."""
    if isinstance(columns, str):
        width = df.select(F.max(F.size(columns))).first()[0] or 0
        value = F.transform(F.col(columns), lambda v: F.coalesce(finite(v), F.lit(float("nan"))))
        return df.select(F.when(F.size(columns) == width, value).alias("x")).where("x IS NOT NULL"), max(width, 0)
    return df.select(F.array(*[F.coalesce(finite(F.col(c)), F.lit(float("nan"))) for c in columns]).alias("x")), len(columns)


def rows_of(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


#: Columns up to which moments() are plain aggregates.
NARROW = 8


def _narrow_moments(rows: DataFrame, width: int, complete: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    x = [F.nanvl(F.col("x")[i], F.lit(None).cast("double")) for i in range(width)]
    flat = rows.select(*[x[i].alias(f"x{i}") for i in range(width)])
    means = flat.agg(F.lit(0), *[F.avg(f"x{i}") for i in range(width)]).first()[1:]
    shift = np.array([0.0 if m is None else m for m in means])
    moved = flat.where(F.lit(not complete) | F.forall(F.array(*flat.columns), lambda v: v.isNotNull())).select(*[(F.col(f"x{i}") - float(shift[i])).alias(f"x{i}") for i in range(width)])
    sums, at = [], [(i, j) for i in range(width) for j in range(i, width)]
    for i, j in at:
        a, b = F.col(f"x{i}"), F.col(f"x{j}")
        both = lambda v, w=b: F.sum(F.when(w.isNotNull(), v))
        sums += [F.count(a * b), both(a), both(b, a), both(a * a), both(b * b, a), F.sum(a * b)]
    told = [float(v or 0) for v in moved.agg(F.lit(0), *sums).first()[1:]]
    out = {c: np.zeros((width, width)) for c in ("n", "sx", "sxx", "sxy")}
    for k, (i, j) in enumerate(at):
        n, a, b, aa, bb, ab = told[6 * k : 6 * k + 6]
        for u, v, s, ss in ((i, j, a, aa), (j, i, b, bb)):
            out["n"][u, v], out["sx"][u, v], out["sxx"][u, v], out["sxy"][u, v] = n, s, ss, ab
    return shift, out


def moments(rows: DataFrame, width: int, complete: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Shifts of the columns of ``rows`` (x), and matrices over the rows where both columns are there: n, sum of the row's column (sx), of its
    squares (sxx), and of products (sxy), all of shifted values. ``complete``: only rows where all columns are there count. Tables of at most
    ``NARROW`` columns are summed by Spark alone, without Python workers."""
    if 0 < width <= NARROW:
        return _narrow_moments(rows, width, complete)

    def first(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, count = np.zeros(width), np.zeros(width)
        for batch in batches:
            x = rows_of(batch.column(0))
            sums += np.nansum(x, 0)
            count += (~np.isnan(x)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(sums), pa.array(count)], ["i", "s", "n"])

    shift = np.zeros(width)
    for r in rows.mapInArrow(first, "i long, s double, n double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # a row a column
        shift[r["i"]] = r["s"] / r["n"] if r["n"] else 0.0

    def second(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sx, sxx, sxy = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            x = rows_of(batch.column(0))
            if complete:
                x = x[~np.isnan(x).any(1)]
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x - shift, 0.0)
            n += there.T @ there
            sx += x.T @ there
            sxx += (x * x).T @ there
            sxy += x.T @ x
        i, j = np.indices((width, width))
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, n, sx, sxx, sxy)], ["i", "j", "n", "sx", "sxx", "sxy"])

    out = {c: np.zeros((width, width)) for c in ("n", "sx", "sxx", "sxy")}
    sums = rows.mapInArrow(second, "i long, j long, n double, sx double, sxx double, sxy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in out])
    for r in sums.collect():  # a row a pair of columns
        for c, m in out.items():
            m[r["i"], r["j"]] = r[c]
    return shift, out


def correlation_matrix(df: DataFrame, columns: list[str] | str) -> np.ndarray:
    """Pearson's r of all pairs over the rows where both are there; NaN where it is not defined."""
    rows, width = numbers(df, columns)
    _, m = moments(rows, width)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = m["sxx"] - m["sx"] ** 2 / m["n"]
        low = spread <= 1e-14 * m["sxx"]
        r = (m["sxy"] - m["sx"] * m["sx"].T / m["n"]) / np.sqrt(spread * spread.T)
    r[low | low.T | (m["n"] < 2)] = np.nan
    return np.clip(r, -1, 1)


@dataclass(frozen=True)
class Projection:
    """Directions as rows, what is taken from the columns first, and the variance (or singular value) and share of each direction."""

    columns: list[str] | str
    shift: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def signed(directions: np.ndarray) -> np.ndarray:
    """Each row turned so that its largest entry (the first, if several are as large) is positive."""
    at = np.argmax(np.round(np.abs(directions), 12), 1)
    return directions * np.where(directions[np.arange(len(directions)), at] < 0, -1.0, 1.0)[:, None]


def principal(df: DataFrame, columns: list[str] | str, keep: float | int) -> Projection:
    """The first ``keep`` principal components, or as many as explain more than a share ``keep`` of the variance; of rows without a missing value."""
    rows, width = numbers(df, columns)
    shift, m = moments(rows, width, complete=True)
    n = m["n"][0, 0] if width else 0
    if n < 2:
        raise ValueError("principal components need two complete rows at least")
    mean = m["sx"][:, 0] / n
    values, vectors = np.linalg.eigh((m["sxy"] - n * np.outer(mean, mean)) / (n - 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    shares = values / values.sum() if values.sum() else values
    k = keep if isinstance(keep, int) else int(np.searchsorted(np.cumsum(shares), keep, side="right")) + 1
    k = min(k, width)
    return Projection(columns, shift + mean, signed(vectors[:k]), values[:k], shares[:k])


def truncated(df: DataFrame, columns: list[str] | str, k: int) -> Projection:
    """The ``k`` largest singular values and right singular vectors of the table as it is, not centred; missing values count as 0.

    ``shares`` are of the sum of all squared singular values.
    """
    rows, width = numbers(df, columns)
    filled = rows.select(F.transform("x", lambda v: F.when(F.isnan(v), 0.0).otherwise(v)).alias("x"))
    shift, m = moments(filled, width)
    n = m["n"][0, 0] if width else 0
    s = m["sx"][:, 0] if width else np.zeros(0)
    gram = m["sxy"] + np.outer(shift, s) + np.outer(s, shift) + n * np.outer(shift, shift)
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    return Projection(columns, np.zeros(width), signed(vectors[:k]), np.sqrt(values[:k]), (values / (values.sum() or 1.0))[:k])


def projected(df: DataFrame, model: Projection, name: str = "components") -> DataFrame:
    """``df`` with an array column of its rows' coordinates; null where a value that the model needs is missing."""
    shift, turn, columns = model.shift, model.directions.T, model.columns
    if isinstance(columns, str):
        value = F.when(F.size(columns) == len(shift), F.transform(F.col(columns), lambda v: finite(v)))
    else:
        value = F.array(*[finite(F.col(c)) for c in columns])
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType([*df.schema.fields, StructType().add(name, ArrayType(DoubleType())).fields[0]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            good = np.array(x.is_valid())
            out = np.zeros((batch.num_rows, turn.shape[1]))
            if good.any():
                out[good] = (rows_of(x.filter(pa.array(good))) - shift) @ turn
            offsets = np.append(0, np.cumsum(np.where(good, turn.shape[1], 0))).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[good].ravel()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], name])

    whole = F.when(~F.exists(value, lambda v: v.isNull()), value)
    return df.select(*[F.col(f"`{c}`") for c in df.columns], whole.alias(name)).mapInArrow(run, schema)
