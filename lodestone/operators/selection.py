"""Which features matter: mutual information and mRMR, permutation importance, stability of a selection over subsamples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite
from lodestone.operators.gram import moments, numbers, rows_of
from lodestone.operators.order import numbered, sent_values
from lodestone.operators.transforms import exact_quantiles

# --- mutual information


def quantile_cuts(df: DataFrame, columns: list[str], q: int) -> dict[str, list[float]]:
    """The inner quantiles of each column, without repeats; all columns in one table of (column, value)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), finite(F.col(c)).alias("v")) for c in columns])).alias("x")).select("x.*")
    found = {r["c"]: r["q"] for r in exact_quantiles(long, ["c"], "v", [i / q for i in range(q + 1)], few_groups=True).collect()}  # a row a column
    return {c: sorted(set(found[c]))[1:-1] if c in found else [] for c in columns}


def joint_counts(df: DataFrame, columns: list[str], cuts: dict[str, list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in each pair of bins of each pair of columns, as one matrix, and where each column's bins begin in it. A bin is the number of cuts
    below the value. One pass: a task's bins are a 0/1 matrix that is multiplied with itself."""
    edges = [np.array(cuts[c], dtype=float) for c in columns]
    begin = np.append(0, np.cumsum([len(e) + 1 for e in edges]))
    rows, _ = numbers(df, columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out = np.zeros((begin[-1], begin[-1]))
        for batch in batches:
            x = rows_of(batch.column(0))
            z = np.zeros((len(x), begin[-1]))
            for i, e in enumerate(edges):
                there = np.flatnonzero(~np.isnan(x[:, i]))
                z[there, begin[i] + np.searchsorted(e, x[there, i], side="left")] = 1
            out += z.T @ z
        i, j = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(out[i, j].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((begin[-1], begin[-1]))
    for r in rows.mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # a row a pair of bins
        out[r["i"], r["j"]] = r["n"]
    return out, begin


def mutual_information(df: DataFrame, columns: list[str], q: int = 10, cuts: dict[str, list[float]] | None = None) -> dict[tuple[str, str], float]:
    """Mutual information in nats of each pair (in both orders) over the rows where both are there, by bins: ``q`` of equal size, or by ``cuts``."""
    counts, begin = joint_counts(df, columns, cuts or quantile_cuts(df, columns, q))
    out = {}
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            n = counts[begin[i] : begin[i + 1], begin[j] : begin[j + 1]]
            if i != j and n.sum():
                p = n / n.sum()
                free = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
                out[a, b] = float((p[p > 0] * np.log(p[p > 0] / free[p > 0])).sum())
    return out


def mrmr(df: DataFrame, columns: list[str], target: str, k: int, q: int = 10) -> list[tuple[str, float]]:
    """``k`` features and their scores in the order they are taken: the highest mutual information with the target first, then by that less the
    mean |Spearman's rho| with those taken (0 where it is not defined); ties to the earlier column."""
    from lodestone.operators.columns import correlation_table

    worth = mutual_information(df, [*columns, target], q)
    near, taken = correlation_table(df, columns, "spearman"), []
    while len(taken) < min(k, len(columns)):
        left = [c for c in columns if c not in [t for t, _ in taken]]
        score = {c: worth.get((c, target), 0.0) - (float(np.mean([near.get((c, t), 0.0) for t, _ in taken])) if taken else 0.0) for c in left}
        best = max(left, key=lambda c: score[c])
        taken.append((best, score[best]))
    return taken


# --- importance by permutation


def linear(df: DataFrame, columns: list[str], target: str, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of least squares over the rows without a missing value, from one Gram matrix."""
    rows, width = numbers(df, [*columns, target])
    shift, m = moments(rows, width, complete=True)
    n = max(m["n"][0, 0], 1.0)
    mean = m["sx"][:, 0] / n
    s = m["sxy"] - n * np.outer(mean, mean)
    coef = np.linalg.lstsq(s[:-1, :-1] + ridge * np.eye(width - 1), s[:-1, -1], rcond=None)[0]
    centre = shift + mean
    return coef, float(centre[-1] - coef @ centre[:-1])


def ablation(df: DataFrame, ranked: list[str], target: str, sizes: list[int] | None = None) -> list[tuple[int, float]]:
    """Number of features and R2 of least squares for the first 1, 2, ... of a ranking (or for ``sizes``), over rows without a missing value.

    One Gram matrix of all columns serves every size; the table is not read again.
    """
    rows, width = numbers(df, [*ranked, target])
    _, m = moments(rows, width, complete=True)
    n = max(m["n"][0, 0], 1.0)
    mean = m["sx"][:, 0] / n
    s = m["sxy"] - n * np.outer(mean, mean)
    out = []
    for k in sizes or range(1, len(ranked) + 1):
        coef = np.linalg.lstsq(s[:k, :k], s[:k, -1], rcond=None)[0]
        out.append((k, float(coef @ s[:k, -1] / s[-1, -1]) if s[-1, -1] > 0 else 0.0))
    return out


def permutation_importance(df: DataFrame, id_: str, columns: list[str], target: str, predict: Callable[[list[Column]], Column], repeats: int = 5, seed: int = 0) -> DataFrame:
    """feature, importance (mean over ``repeats`` of how much R2 falls when the column is permuted) and std (population) of it.

    ``predict`` makes a prediction of the columns' values. Rows with a missing value do not count. All columns and repeats are one join:
    each row meets, for each of them, the value of the row where a keyed permutation of the row numbers sends it. Values go to the rows that
    meet them, by the inverse permutation, so they are sent once.
    """
    whole = df.select(F.col(id_).alias("id"), F.array(*[finite(F.col(c)) for c in columns]).alias("x"), finite(F.col(target)).alias("y"))
    rows = numbered(whole.where(~F.exists("x", lambda v: v.isNull()) & F.col("y").isNotNull()), [F.xxhash64("id"), F.col("id")])
    n, p = rows.count(), len(columns)
    met = sent_values(rows, n, p, repeats, seed).withColumn("column", F.col("key") % p).join(rows, "number")
    moved = [F.when(F.col("column") == i, F.col("v")).otherwise(F.col("x")[i]) for i in range(p)]
    lost = lambda guess: F.sum((F.col("y") - guess) ** 2)
    base = rows.agg(lost(predict([F.col("x")[i] for i in range(p)])).alias("base"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("n"))
    runs = met.groupBy("key", "column").agg(lost(predict(moved)).alias("loss"))
    fall = runs.join(F.broadcast(base)).withColumn("fall", (F.col("loss") - F.col("base")) / (F.col("v") * F.col("n")))  # one row
    names = F.element_at(F.array(*map(F.lit, columns)), F.col("column") + 1)
    return fall.groupBy(names.alias("feature")).agg(F.avg("fall").alias("importance"), F.stddev_pop("fall").alias("std"))


# --- stability


def hashed_share(id_: str, share: float) -> Callable[[int], Column]:
    """Whether a row is in a subsample: a share of all ids, by hash."""
    return lambda run: F.pmod(F.xxhash64(F.lit(run), F.col(id_)), F.lit(1_000_000)) < round(share * 1_000_000)


def stability(df: DataFrame, columns: list[str], target: str, inside: Callable[[int], Column], runs: int = 50, top: int = 10) -> DataFrame:
    """feature, frequency (share of the ``runs`` subsamples in which it is among the ``top`` by |r| with the target; ties to the earlier
    column) and mean_r (mean of |r|). All subsamples are summed in one pass over the table."""
    member = F.array(*[inside(r).cast("double") for r in range(runs)])
    values = F.array(*[F.coalesce(finite(F.col(c)), F.lit(float("nan"))) for c in [*columns, target]])
    rows, width = df.select(F.concat(values, member).alias("x")), len(columns)
    means = df.agg(F.lit(0), *[F.avg(finite(F.col(c))) for c in [*columns, target]]).first()[1:]
    shift = np.array([0.0 if m is None else m for m in means])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((6, runs, width))
        for batch in batches:
            x = rows_of(batch.column(0))
            w, v, y = np.nan_to_num(x[:, width + 1 :]), x[:, :width] - shift[:-1], x[:, width] - shift[-1]
            there = ~np.isnan(v) & ~np.isnan(y)[:, None]
            v, y = np.where(there, v, 0.0), np.where(there, y[:, None], 0.0)
            for k, part in enumerate((there.astype(float), v, y, v * v, y * y, v * y)):
                sums[k] += w.T @ part
        r, c = np.indices((runs, width))
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (r, c, *sums)], ["run", "c", "n", "x", "y", "xx", "yy", "xy"])

    names = ["n", "x", "y", "xx", "yy", "xy"]
    got = rows.mapInArrow(run, "run long, c long, " + ", ".join(f"{s} double" for s in names)).groupBy("run", "c").agg(*[F.sum(s).alias(s) for s in names])
    r = np.zeros((runs, width))
    for g in got.collect():  # a row a run and column
        n, x, y, xx, yy, xy = (g[s] for s in names)
        below = (xx - x * x / n) * (yy - y * y / n) if n else 0.0
        r[g["run"], g["c"]] = round(abs(xy - x * y / n) / below**0.5, 12) if below > 0 else 0.0
    taken = np.zeros((runs, width))
    for k in range(runs):
        taken[k, np.argsort(-r[k], kind="stable")[:top]] = 1
    table = [(c, float(f), float(m)) for c, f, m in zip(columns, taken.mean(0), r.mean(0), strict=True)]
    return df.sparkSession.createDataFrame(table, "feature string, frequency double, mean_r double")
