"""Moments, projections and quantiles equal numpy's on tables with gaps, offsets and constant columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import columns, gram, quality, ranking, transforms

RNG = np.random.default_rng(3)


def frame(spark, x):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [[None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(row)] for i, row in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3), names


def gaps(n=160, p=6):
    x = RNG.normal(size=(n, p)) @ RNG.normal(size=(p, p)) + 1e6
    x[:, -1] = 4.0
    x[RNG.random(x.shape) < 0.1] = np.nan
    x[3, 0] = math.inf
    return x


def test_correlations_of_pairs_that_are_there(spark):
    x = gaps()
    df, names = frame(spark, x)
    got = gram.correlation_matrix(df, names)
    x = np.where(np.isinf(x), np.nan, x)
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 5 in (i, j):
                assert np.isnan(got[i, j])
            else:
                assert got[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    table = columns.correlation_table(df, names)
    assert len(table) == 20 and table["c0", "c1"] == pytest.approx(abs(got[0, 1]))
    assert np.isnan(gram.correlation_matrix(df.where("false"), names)).all()


def test_many_columns_are_one_matrix(spark):
    x = RNG.normal(size=(120, 200))
    x[:, 150] = x[:, 20]
    df, names = frame(spark, x)
    told = {(r["a"], r["b"]): r["r"] for r in quality.correlations(df, names).collect()}
    assert len(told) == 200 * 199 // 2 and told["c20", "c150"] == 1.0
    assert told["c3", "c9"] == pytest.approx(np.corrcoef(x[:, 3], x[:, 9])[0, 1], abs=1e-6)
    assert columns.equal_columns(df, names) == {"c150": "c20"}


def test_principal_components(spark):
    x = gaps()
    df, names = frame(spark, x)
    whole = x[np.isfinite(x).all(1)]
    values, vectors = np.linalg.eigh(np.cov(whole.T))
    model = gram.principal(df, names, 3)
    assert model.values == pytest.approx(values[::-1][:3], rel=1e-6)
    assert np.abs(np.sum(model.directions * vectors[:, ::-1].T[:3], 1)) == pytest.approx(np.ones(3), abs=1e-6)
    assert all(d[np.argmax(np.abs(d))] > 0 for d in model.directions)
    shares = values[::-1] / values.sum()
    assert len(gram.principal(df, names, float(shares[0] + shares[1] / 2)).values) == 2
    got = gram.projected(df, model).collect()
    assert sum(r["components"] is None for r in got) == len(x) - len(whole)
    for r in got:
        if r["components"] is not None:
            assert r["components"] == pytest.approx(list((np.array([r[c] for c in names]) - whole.mean(0)) @ model.directions.T), abs=1e-5)
    with pytest.raises(ValueError, match="two complete rows"):
        gram.principal(df.where("false"), names, 2)


def test_truncated_singular_values(spark):
    x = np.where(RNG.random((90, 8)) < 0.6, 0.0, RNG.normal(size=(90, 8)) + 3)
    df = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(x)], "id long, v array<double>")
    model = gram.truncated(df, "v", 4)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert model.values == pytest.approx(s[:4], rel=1e-9)
    assert np.abs(np.sum(model.directions * v[:4], 1)) == pytest.approx(np.ones(4), abs=1e-9)
    got = {r["id"]: r["components"] for r in gram.projected(df, model).collect()}
    assert got[7] == pytest.approx(list(x[7] @ model.directions.T), abs=1e-9)


@pytest.mark.parametrize("sketch", [1000, 40])
def test_quantiles_are_exact(spark, monkeypatch, sketch):
    monkeypatch.setattr(transforms, "SKETCH", sketch)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), (None, 7), ("c", 900), ("d", 3000)) for v in (np.round(RNG.normal(size=n), 2) if g == "c" else RNG.normal(size=n))] + [("d", 0.25)] * 500 + [("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in transforms.exact_quantiles(df, ["g"], "v", qs).collect()}
    assert set(got) == {"a", "b", None, "c", "d"}
    for g, q in got.items():
        assert q == pytest.approx(list(np.quantile([v for k, v in rows if k == g and v is not None], qs)), abs=1e-12)
    assert transforms.exact_quantiles(df, [], "v", qs).first()["q"] == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], qs)), abs=1e-12)
    far = ranking.outliers(df.where("g = 'd'").withColumn("i", F.monotonically_increasing_id()), "g", "v", 3.0, 0.0)
    d = np.array([v for k, v in rows if k == "d"])
    mad = np.median(np.abs(d - np.median(d)))
    assert far.count() == (np.abs(d - np.median(d)) > 3 * 1.4826 * mad).sum()
    plan = transforms.exact_quantiles(spark.read.parquet("/root/testdata/sf0.01/part.parquet"), ["p_brand"], "p_retailprice", qs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3
