"""Yeo-Johnson transforms: the likelihood of a grid of exponents for all columns in one pass, then of finer grids around the best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite
from lodestone.operators.gram import numbers, rows_of


def bent(x: np.ndarray, power: float) -> np.ndarray:
    out, up = np.empty_like(x), x >= 0
    out[up] = np.log1p(x[up]) if abs(power) < 1e-12 else np.expm1(power * np.log1p(x[up])) / power
    out[~up] = -np.log1p(-x[~up]) if abs(power - 2) < 1e-12 else -np.expm1((2 - power) * np.log1p(-x[~up])) / (2 - power)
    return out


def likelihoods(rows: DataFrame, grids: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The log-likelihood of each exponent of each column's grid; one pass, and a row a column and exponent reaches the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((*grids.shape, 4))
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                x = rows_of(batch.column(0))
                for i, grid in enumerate(grids):
                    v = x[:, i][~np.isnan(x[:, i])]
                    slope = (np.sign(v) * np.log1p(np.abs(v))).sum()
                    for k, power in enumerate(grid):
                        y = bent(v, power) - bent(middle[i : i + 1], power)
                        sums[i, k] += len(v), y.sum(), (y * y).sum(), slope
        i, k = np.indices(grids.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, k, *np.moveaxis(sums, 2, 0))], ["i", "k", "n", "s", "ss", "slope"])

    out = np.full(grids.shape, np.nan)
    got = rows.mapInArrow(run, "i long, k long, n double, s double, ss double, slope double").groupBy("i", "k").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "slope")])
    for r in got.collect():
        if r["n"] and np.isfinite(r["ss"]) and (var := r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2) > 1e-300:
            out[r["i"], r["k"]] = -r["n"] / 2 * np.log(var) + (grids[r["i"], r["k"]] - 1) * r["slope"]
    return out


def fit(df: DataFrame, columns: list[str], low: float = -5.0, high: float = 5.0, steps: int = 41, rounds: int = 4) -> dict[str, float]:
    """The exponent of each column, of the highest likelihood on a grid from ``low`` to ``high`` and on ``rounds`` - 1 finer ones; missing
    values do not count, and a column without spread has 1."""
    rows, width = numbers(df, columns)
    means = df.agg(F.lit(0), *[F.avg(finite(F.col(c))) for c in columns]).first()[1:]
    middle = np.array([0.0 if m is None else m for m in means])
    grids, best = np.tile(np.linspace(low, high, steps), (width, 1)), np.ones(width)
    for _ in range(rounds):
        told = likelihoods(rows, grids, middle)
        step = grids[:, 1] - grids[:, 0]
        for i in range(width):
            if np.isfinite(told[i]).any():
                best[i] = grids[i, int(np.nanargmax(told[i]))]
        grids = best[:, None] + step[:, None] * np.linspace(-1, 1, steps)[None]
    return dict(zip(columns, best.tolist(), strict=True))


def value(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-12 else F.expm1(power * F.log1p(x)) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-12 else -F.expm1((2 - power) * F.log1p(-x)) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def powered(df: DataFrame, exponents: dict[str, float]) -> DataFrame:
    """``df`` with its columns that ``exponents`` names bent; missing values are null."""
    return df.select(*[value(finite(F.col(c)), exponents[c]).alias(c) if c in exponents else F.col(c) for c in df.columns])
