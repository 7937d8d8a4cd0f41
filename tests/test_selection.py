"""Selection of features, power transforms, row numbers, robustness and portfolios against numpy and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import order, power, robustness, selection, transforms

RNG = np.random.default_rng(11)


def frame(spark, x, gaps=True):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(i, *[None if gaps and RNG.random() < 0.05 else float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3), names, rows


def test_exponents_have_the_highest_likelihood(spark):
    x = np.stack([RNG.lognormal(size=300), RNG.normal(size=300) ** 3, np.full(300, 2.0), -RNG.lognormal(size=300) * 50 + 3], 1)
    df, names, rows = frame(spark, x)
    got = power.fit(df, names)
    assert got["c2"] == 1.0
    for i in (0, 1, 3):
        v = np.array([r[i + 1] for r in rows if r[i + 1] is not None])
        like = lambda p, v=v: -len(v) / 2 * np.log(power.bent(v, p).var()) + (p - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()
        fine = np.linspace(-5, 5, 20001)
        assert got[f"c{i}"] == pytest.approx(fine[np.argmax([like(p) for p in fine])], abs=1e-3)
    one = power.powered(df, got).orderBy("id").first()
    assert one["c0"] is None or one["c0"] == pytest.approx(power.bent(np.array([rows[0][1]]), got["c0"])[0])
    for p in (0.0, 2.0, -1.3):
        back = df.select(power.value(F.col("c1"), p).alias("y"), "c1").where("c1 IS NOT NULL").collect()
        assert [r["y"] for r in back] == pytest.approx(list(power.bent(np.array([r["c1"] for r in back]), p)))
    assert power.fit(df.where("false"), names) == dict.fromkeys(names, 1.0)


def plain_information(a, b):
    n, out = len(a), 0.0
    for x in set(a):
        for y in set(b):
            p = sum(u == x and v == y for u, v in zip(a, b, strict=True)) / n
            if p:
                out += p * np.log(p / (a.count(x) / n) / (b.count(y) / n))
    return out


def test_mutual_information_and_mrmr(spark):
    x = RNG.normal(size=(250, 4))
    x[:, 1] = x[:, 0] + RNG.normal(size=250) * 0.1
    x[:, 3] = x[:, 0] * 2 + x[:, 2] + RNG.normal(size=250) * 0.2
    df, names, rows = frame(spark, x)
    cuts = selection.quantile_cuts(df, names, 5)
    for i, c in enumerate(names):
        assert cuts[c] == pytest.approx(list(np.quantile([r[i + 1] for r in rows if r[i + 1] is not None], [0.2, 0.4, 0.6, 0.8])))
    got = selection.mutual_information(df, names, 5)
    assert len(got) == 12
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i != j:
                both = [(r[i + 1], r[j + 1]) for r in rows if r[i + 1] is not None and r[j + 1] is not None]
                bins = [[sum(v > e for e in cuts[c]) for v in values] for c, values in zip((a, b), zip(*both, strict=True), strict=True)]
                assert got[a, b] == pytest.approx(plain_information(*bins), abs=1e-9)
    taken = selection.mrmr(df, names[:3], "c3", 3, 5)
    assert taken[0][0] in ("c0", "c1") and taken[1][0] == "c2"  # not the twin of the first
    assert taken[0][1] == pytest.approx(got[taken[0][0], "c3"])
    assert selection.mutual_information(df.where("false"), names) == {}


def test_ranks_of_all_columns_in_one_join(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0), (1.0, 2.0), (None, None), (2.0, 9.0)], "a double, b double").repartition(2)
    got = sorted(map(tuple, transforms.average_ranks(df, ["a", "b"]).collect()), key=repr)
    assert got == sorted([(1.5, None), (4.0, 1.5), (1.5, 1.5), (None, None), (3.0, 3.0)], key=repr)


def test_numbers_and_permutations(spark):
    df = spark.range(500).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(40)))
    got = [(r["n"], r["v"], r["id"]) for r in order.numbered(df.repartition(5), [F.desc("v"), F.col("id")], "n").collect()]
    assert [(v, i) for _, v, i in sorted(got)] == sorted(((v, i) for _, v, i in got), key=lambda x: (-x[0], x[1]))
    assert sorted(n for n, _, _ in got) == list(range(500))
    for n in (1, 2, 3, 17, 500):
        for key in (0, 7):
            assert sorted(order.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert (order.permuted(np.arange(500), 500, 1) != order.permuted(np.arange(500), 500, 2)).mean() > 0.9
    assert abs(np.corrcoef(np.arange(500), order.permuted(np.arange(500), 500, 3))[0, 1]) < 0.15
    told = order.permutations(df.select(F.col("id").alias("number")), 500, 3, seed=4).collect()
    assert {(r["key"], r["other"]) for r in told} == {(k, i) for k in range(3) for i in range(500)}


def test_permutation_importance(spark):
    x = RNG.normal(size=(400, 4))
    x[:, 3] = 3 * x[:, 0] + x[:, 1] + RNG.normal(size=400) * 0.1
    df, names, rows = frame(spark, x)
    coef, intercept = selection.linear(df, names[:3], "c3")
    whole = np.array([r[1:] for r in rows if None not in r])
    a = np.c_[whole[:, :3], np.ones(len(whole))]
    assert [*coef, intercept] == pytest.approx(list(np.linalg.lstsq(a, whole[:, 3], rcond=None)[0]), abs=1e-8)
    y, told = whole[:, 3] - whole[:, 3].mean(), selection.ablation(df, names[:3], "c3")
    for k, r2 in told:
        left = y - (c := whole[:, :k] - whole[:, :k].mean(0)) @ np.linalg.lstsq(c, y, rcond=None)[0]
        assert r2 == pytest.approx(1 - (left @ left) / (y @ y))
    assert [k for k, _ in told] == [1, 2, 3] and selection.ablation(df, names[:3], "c3", [2]) == [told[1]]
    predict = lambda c: sum((float(w) * v for w, v in zip(coef, c, strict=True)), F.lit(intercept))
    got = {r["feature"]: r for r in selection.permutation_importance(df, "id", names[:3], "c3", predict, 4, seed=2).collect()}
    by_number = order.numbered(df.where(" AND ".join(f"{c} IS NOT NULL" for c in names)).select("id", F.array(*names).alias("x")), [F.xxhash64("id"), F.col("id")]).orderBy("number").collect()
    v = np.array([r["x"] for r in by_number])
    y, n = v[:, 3], len(v)
    r2 = lambda z: 1 - ((y - z[:, :3] @ coef - intercept) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for c in range(3):
        falls = []
        for k in range(4):
            z = v.copy()
            z[:, c] = v[order.permuted(np.arange(n), n, 2 * 1_000_003 + k * 3 + c), c]
            falls.append(r2(v) - r2(z))
        assert got[f"c{c}"]["importance"] == pytest.approx(np.mean(falls))
        assert got[f"c{c}"]["std"] == pytest.approx(np.std(falls))
    assert got["c0"]["importance"] > got["c1"]["importance"] > abs(got["c2"]["importance"])


def test_stability_of_a_selection(spark):
    x = RNG.normal(size=(200, 6))
    x[:, 5] = x[:, 0] + 0.3 * x[:, 1] + RNG.normal(size=200) * 0.5
    df, names, rows = frame(spark, x)
    got = {r["feature"]: r for r in selection.stability(df, names[:5], "c5", lambda run: (F.col("id") * 7 + run * 3) % 10 < 7, runs=12, top=2).collect()}
    taken, mean = dict.fromkeys(names[:5], 0), dict.fromkeys(names[:5], 0.0)
    for run in range(12):
        r = {}
        for i, c in enumerate(names[:5]):
            both = np.array([(row[i + 1], row[6]) for row in rows if (row[0] * 7 + run * 3) % 10 < 7 and row[i + 1] is not None and row[6] is not None])
            r[c] = abs(np.corrcoef(both.T)[0, 1])
            mean[c] += r[c] / 12
        for c in sorted(r, key=lambda c: -r[c])[:2]:
            taken[c] += 1
    assert {c: g["frequency"] for c, g in got.items()} == pytest.approx({c: n / 12 for c, n in taken.items()})
    assert {c: g["mean_r"] for c, g in got.items()} == pytest.approx(mean, abs=1e-9)
    share = df.where(selection.hashed_share("id", 0.7)(3)).count() / 200
    assert 0.55 < share < 0.85


def test_robustness_of_a_selection(spark):
    rng = random.Random(5)
    rows = [(i, p, rng.random() * 2, rng.random(), None if i == 7 else rng.random(), i % 3 > 0) for i in range(60) for p in "xy"]
    df = spark.createDataFrame(rows, "i long, p string, far double, near double, other double, fit boolean")
    ways = robustness.scenarios([{"far": 2, "near": 1, "other": 1}, {"far": 1, "near": 3, "other": 0}], {"far": [0.5, 1.0, 2.0]})
    assert len(ways) == 6 and sum(ways[0].weights.values()) == pytest.approx(1)
    got = {r["i"]: r for r in robustness.robustness(df, "i", ways, F.col("fit"), 0.1).collect()}
    score = lambda r, w: None if r[4] is None else w.weights["far"] * np.exp(-((r[2] / w.scales["far"]) ** 2)) + w.weights["near"] * r[3] + w.weights["other"] * r[4]
    table = [{i: max((s for r in rows if r[0] == i and (s := score(r, w)) is not None), default=None) for i in range(60)} for w in ways]
    for i in range(60):
        mine = [t[i] for t in table if t[i] is not None]
        hit = [t[i] is not None and t[i] >= np.quantile([v for k, v in t.items() if k % 3 and v is not None], 0.9) for t in table]
        assert got[i]["frequency"] == pytest.approx(np.mean(hit))
        if mine:
            assert (got[i]["score_mean"], got[i]["score_std"]) == pytest.approx((np.mean(mine), np.std(mine)))
        assert got[i]["grade"] == ("A" if np.mean(hit) >= 0.8 else "B" if np.mean(hit) >= 0.5 else "C")
    assert got[7]["score_mean"] is None and got[7]["frequency"] == 0
    with pytest.raises(ValueError, match="positive"):
        robustness.scenarios([{"far": 0}], {"far": [1.0]})


def test_portfolio_equals_a_loop_over_rows(spark):
    rng = random.Random(6)
    rows = [(i, f"item{rng.randrange(45)}", rng.random(), rng.random(), rng.choice("ab")) for i in range(200)]
    rows = [(*r, f"g{int(r[1][4:]) % 4}") for r in rows]
    df = spark.createDataFrame(rows, "i long, item string, score double, second double, near string, g string")
    sections = [
        robustness.Section("a", F.col("near") == "a", [F.desc("score"), F.col("i")], 5),
        robustness.Section("bridge", F.col("second") > 0.4, [F.desc("second"), F.col("i")], 6),
        robustness.Section("rare", F.col("score") > 0.5, [F.asc("second"), F.col("i")], 50),
    ]
    keys = [(lambda r: r[4] == "a", lambda r: (-r[2], r[0]), 5), (lambda r: r[3] > 0.4, lambda r: (-r[3], r[0]), 6), (lambda r: r[2] > 0.5, lambda r: (r[3], r[0]), 50)]
    used, want = set(), set()
    for s, (allows, key, most) in zip(sections, keys, strict=True):
        count, groups = 0, {}
        for r in sorted(filter(allows, rows), key=key):
            if count < most and r[1] not in used and groups.get(r[5], 0) < 2:
                used.add(r[1])
                groups[r[5]] = groups.get(r[5], 0) + 1
                count += 1
                want.add((s.name, count, r[0]))
    assert {(r["section"], r["place"], r["i"]) for r in robustness.portfolio(df, "item", "g", sections, 2).collect()} == want


def test_inverse_permutations_send_each_value_once():
    for n in (1, 2, 3, 17, 500):
        for key in (0, 7, 2 * 1_000_003 + 5):
            assert order.unpermuted(order.permuted(np.arange(n), n, key), n, key).tolist() == list(range(n))


def test_ranks_of_few_values_send_no_rows(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 7), float(i), None if i % 5 else 2.0) for i in range(60)], "a double, b double, c double").repartition(3)
    want = sorted(map(tuple, transforms.average_ranks(df, ["a", "b", "c"]).collect()), key=repr)
    assert "Exchange" not in transforms.average_ranks(df, ["a", "b", "c"])._jdf.queryExecution().sparkPlan().toString().replace("BroadcastExchange", "")
    assert "Aggregate" not in transforms.average_ranks(df, ["a", "b", "c"])._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(transforms, "FEW_VALUES", 10)  # b goes by rows
    assert sorted(map(tuple, transforms.average_ranks(df, ["a", "b", "c"]).collect()), key=repr) == want


def test_moments_of_narrow_tables_need_no_python(spark, monkeypatch):
    from lodestone.operators import gram

    x = RNG.normal(size=(200, 3)) + 1e6
    df, names, _ = frame(spark, x)
    rows, width = gram.numbers(df, names)
    for complete in (False, True):
        shift, got = gram._narrow_moments(rows, width, complete)
        monkeypatch.setattr(gram, "NARROW", 0)
        with_python = gram.moments(rows, width, complete)
        monkeypatch.undo()
        assert shift == pytest.approx(with_python[0])
        for c, m in with_python[1].items():
            assert got[c] == pytest.approx(m, abs=1e-4)
