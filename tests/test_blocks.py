"""Blocks tell their failures; prototypes, seeds, left-out ranks and composition statistics against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocks, prototypes


def test_failures_stay_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "REGISTRY", {})

    @blocks.block("size", "half", "log", by=2.0)
    def size(row, by):
        return {"half": row["x"] / by, "log": None} | ({"odd": 1} if row["x"] == 6 else {})

    @blocks.block("slow", "v")
    def slow(row):
        if row["x"] == 4:
            time.sleep(5)
        return {}

    with pytest.raises(ValueError, match="already"):
        blocks.block("size", "x")(size)
    with pytest.raises(ValueError, match="no block none"):
        blocks.chosen(["none"])
    with pytest.raises(ValueError, match="no parameter to"):
        blocks.chosen(["size"], {"size": {"to": 1}})
    both = blocks.chosen(["size", "slow"], {"size": {"by": 4.0}})
    df = spark.createDataFrame([(1, 4), (2, None), (3, 6), (4, 8)], "i long, x long")
    got = {r["i"]: r for r in blocks.featurized(df, both, seconds=0.5).collect()}
    assert [got[i]["size__half"] for i in (1, 2, 3, 4)] == [1.0, None, None, 2.0]
    assert [got[i]["size__status"] for i in (1, 2, 3, 4)] == ["ok", "failed", "failed", "ok"]
    assert got[2]["size__error"].startswith("TypeError") and got[3]["size__error"] == "ValueError: gives odd too" and got[1]["size__error"] is None
    assert (got[1]["slow__status"], got[1]["slow__error"], got[4]["slow__status"]) == ("timeout", "more than 0.5 s", "ok")
    counts = {tuple(r) for r in blocks.error_counts(blocks.featurized(df, both[:1]), both[:1]).collect()}
    assert counts == {("size", "ok", 2), ("size", "failed", 2)}
    assert blocks.featurized(df.where("false"), both).count() == 0
    with pytest.raises(ValueError, match="size__half are there already"):
        blocks.featurized(df.withColumn("size__half", F.lit(1)), both)


def test_anchors_and_scores(spark):
    df = spark.createDataFrame([(1, "p", 2.0, True), (2, "p", 1.0, True), (3, "p", 0.0, False), (4, "q", 1.0, True), (5, None, 0.0, True), (0, "p", 1.0, True)], "id long, proto string, hull double, ok boolean")
    assert {tuple(r) for r in prototypes.anchors(df, "proto", F.col("ok"), [F.col("hull")], "id").collect()} == {("p", 0), ("q", 4)}
    rng = random.Random(1)
    d = {(i, p): rng.random() for i in range(30) for p in "pq"}
    s = {(i, p): rng.random() for i in range(30) for p in "pq" if i % 4}
    fits = [i for i in range(30) if i % 3]
    got = prototypes.neighbourhood_scores(
        spark.createDataFrame([(*k, v) for k, v in d.items()], "id long, prototype string, d double"),
        spark.createDataFrame([(*k, v) for k, v in s.items()], "id long, prototype string, support double"),
        spark.createDataFrame([(i,) for i in fits], "id long"), ["p", "q"], 0.6,
    ).collect()
    want = {}
    for (i, p), x in d.items():
        survival = (len(fits) - sum(d[j, p] < x for j in fits) + 1) / (len(fits) + 1)
        want[i, p] = 0.6 * survival + 0.4 * s.get((i, p), 0.0)
    assert {(r["id"], r["prototype"]): pytest.approx(r["score"]) for r in got} == want
    assert {r["id"]: r["prototype"] for r in got if r["best"]} == {i: max("pq", key=lambda p: want[i, p]) for i in range(30)}


def test_seeds(spark):
    df = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(20)] + [(99, None)], "id long, v array<double>")
    seeds = spark.createDataFrame([(2,), (4,)], "id long")
    assert {r["id"] for r in prototypes.seed_labels(df, seeds).where("label = 1").collect()} == {2, 4}
    near = prototypes.seed_neighbours(df, seeds, "v", 3).collect()
    want = sorted((((i - 3) ** 2 + (i % 3 - 1.5) ** 2) ** 0.5, i) for i in range(20) if i not in (2, 4))[:3]
    assert [(r["distance"], r["id"]) for r in near] == [(pytest.approx(x), i) for x, i in want]
    with pytest.raises(ValueError, match="no seed"):
        prototypes.seed_neighbours(df, seeds.where("false"), "v", 3)


def test_left_out_ranks(spark):
    rng = random.Random(2)
    held = [3, 8, 15]
    s = {(i, a): rng.choice([None, round(rng.random(), 1)]) if i != a else 1.0 for i in range(25) for a in held}
    got = {r["anchor"]: (r["score"], r["rank"]) for r in prototypes.left_out_ranks(spark.createDataFrame([(*k, v) for k, v in s.items()], "id long, anchor long, s double"), held).collect()}
    for h in held:
        score = {i: max((s[i, a] for a in held if a != h and s[i, a] is not None), default=None) for i in range(25)}
        if score[h] is None:
            assert h not in got
        else:
            assert got[h] == (score[h], 1 + sum(v is not None and v > score[h] for v in score.values()))


def test_composition_statistics(spark):
    parts = spark.createDataFrame([("AB2", "A", 1.0), ("AB2", "B", 2.0), ("AC", "A", 1.0), ("AC", "C", 3.0), ("X", "X", 1.0), ("A0", "A", 0.0)], "formula string, symbol string, amount double")
    elements = spark.createDataFrame([("A", 1.0, 5.0), ("B", 4.0, None), ("C", 2.0, 7.0)], "symbol string, en double, r double")
    got = {r["formula"]: r for r in prototypes.composition_stats(parts, elements, ["en", "r"]).collect()}
    assert set(got) == {"AB2", "AC", "X"}
    assert (got["AB2"]["en__mean"], got["AB2"]["en__std"], got["AB2"]["en__range"], got["AB2"]["en__known"]) == (3.0, pytest.approx(2**0.5), 3.0, 1.0)
    assert (got["AB2"]["r__mean"], got["AB2"]["r__std"], got["AB2"]["r__known"]) == (5.0, 0.0, pytest.approx(1 / 3))
    assert (got["X"]["en__mean"], got["X"]["en__known"]) == (None, 0.0)


def test_proxy_of_percentiles(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.uniform(-1, 2)]), rng.choice([None, rng.random()]), rng.choice([None, float(rng.randrange(5))]), float(i % 4), i % 3 > 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, share double, bend double, cn double, dim double, fit boolean")
    got = {r["id"]: r["score"] for r in prototypes.proxy_score(df, "id", F.col("fit"), ["share"], {"bend": (0.6, 0.2), "cn": (0.5, 0.3)}, {"bend"}, ("dim", {0.0: 0.8, 1.0: 1.0, 2.0: 0.85}, 0.3)).collect()}
    known = sorted(r[3] for r in rows if r[5] and r[3] is not None)
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    bend, cn = [r[2] or 0.0 for r in rows], [middle if r[3] is None else r[3] for r in rows]

    def gauss(values, x, optimum, width):
        reference = [v for v, r in zip(values, rows, strict=True) if r[5]]
        p = (sum(v < x for v in reference) + sum(v <= x for v in reference)) / (2 * len(reference))
        return 2.718281828459045 ** (-((p - optimum) ** 2) / (2 * width**2))

    for i, r in enumerate(rows):
        parts = [min(max(r[1] or 0.0, 0.0), 1.0), gauss(bend, bend[i], 0.6, 0.2), gauss(cn, cn[i], 0.5, 0.3), {0: 0.8, 1: 1.0, 2: 0.85}.get(int(r[4]), 0.3)]
        assert got[i] == pytest.approx(sum(parts) / 4)
    with pytest.raises(ValueError, match="share has missing"):
        prototypes.proxy_score(df, "id", F.col("fit"), [], {}, set(), ("share", {}, 0.0))
