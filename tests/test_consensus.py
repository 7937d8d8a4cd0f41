"""Consensus, support and stable families equal plain versions over all pairs of rows."""

import random
from itertools import combinations

import pytest

from lodestone.operators import clusters, consensus, families

SCHEMA = "id long, run int, label int"


def table(seed: int, n: int, runs: int) -> dict[int, list[int]]:
    """Labels of rows that keep to a few groups, with noise, one run of noise alone, and rows of noise alone."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        group = rng.randrange(6)
        out[i * 3] = [-1 if i % 11 == 0 or r == 2 or rng.random() < 0.15 else group if rng.random() < 0.9 else rng.randrange(8) for r in range(runs)]
    for i in range(0, n, 4):
        out[i * 3 + 1] = list(out[i * 3])
    return out


def frame(spark, labels):
    return spark.createDataFrame([(i, r, None if x < 0 and i % 2 else x) for i, row in labels.items() for r, x in enumerate(row)], SCHEMA).repartition(3)


def together(a, b):
    return sum(x == y >= 0 for x, y in zip(a, b, strict=True)) / len(a)


@pytest.mark.parametrize(("seed", "runs", "threshold"), [(1, 10, 0.6), (2, 7, 0.5), (3, 12, 0.8), (4, 5, 1.0), (5, 6, 0.01)])
def test_pairs_equal_all_pairs(spark, seed, runs, threshold):
    labels = table(seed, 60, runs)
    df = frame(spark, labels)
    _, members = consensus.profiles(df)
    of = {r["id"]: r["profile"] for r in members.collect()}
    got = consensus.consensus(df, threshold).collect()
    found = {(r["a"], r["b"]): round(r["consensus"], 9) for r in got}
    assert len(found) == len(got)
    want = {}
    for a, b in combinations(sorted(labels), 2):
        if (c := together(labels[a], labels[b])) >= threshold - 1e-12:
            want[tuple(sorted((of[a], of[b])))] = round(c, 9)
    assert found == want


@pytest.mark.parametrize(("seed", "runs", "threshold"), [(1, 10, 0.6), (2, 7, 0.5), (6, 9, 0.34)])
def test_families_equal_a_plain_version(spark, seed, runs, threshold):
    labels = table(seed, 70, runs)
    groups: dict[tuple, list[int]] = {}
    for i, row in sorted(labels.items()):
        groups.setdefault(tuple(row), []).append(i)
    parts = [g for row, g in sorted(groups.items(), key=lambda x: x[1]) if together(row, row) >= threshold - 1e-12]
    while True:
        far = [(max(1 - together(labels[x], labels[y]) for x in g for y in h), g[0], h[0]) for g, h in combinations(parts, 2)]
        d, x, y = min(far, default=(9, 0, 0))
        if d > 1 - threshold + 1e-12:
            break
        g, h = (next(p for p in parts if p[0] == z) for z in (x, y))
        parts = sorted([p for p in parts if p not in (g, h)] + [sorted(g + h)])
    want = {i: -1 for i in labels}
    for number, part in enumerate(p for p in sorted(parts) if len(p) > 1):
        want |= dict.fromkeys(part, number)
    got = {r["id"]: r["family"] for r in consensus.stable_families(frame(spark, labels), threshold).collect()}
    assert got == want
    assert len(set(want.values())) > 2


def test_support_and_summaries(spark):
    labels = table(7, 40, 6)
    df = frame(spark, labels)
    anchors = {"p": [0, 3], "q": [6]}
    got = {(r["id"], r["prototype"]): r["support"] for r in consensus.support(df, spark.createDataFrame([(p, i) for p, x in anchors.items() for i in x], "prototype string, id long")).collect()}
    assert got == {(i, p): sum(row[r] >= 0 and row[r] in {labels[a][r] for a in held} for r in range(6)) / 6 for i, row in labels.items() for p, held in anchors.items()}
    noise = {r["id"]: r["noise_frequency"] for r in consensus.noise_frequency(df).collect()}
    assert noise == {i: sum(x < 0 for x in row) / 6 for i, row in labels.items()}
    told = {r["run"]: (r["n_rows"], r["n_clusters"], r["n_noise"], r["largest"]) for r in consensus.diagnostics(df).collect()}
    for r in range(6):
        column = [row[r] for row in labels.values()]
        kept = [x for x in column if x >= 0]
        assert told[r] == (len(column), len(set(kept)), len(column) - len(kept), max((kept.count(x) for x in kept), default=0))
    assert consensus.wide(df, [0, 1]).columns == ["id", "run_000", "run_001"]


def test_grid_and_empty_tables(spark):
    assert consensus.grid([5, 9], [3], ["eom", "leaf"])[3] == clusters.Run(9, 3, "leaf")
    with pytest.raises(ValueError, match="repeat"):
        consensus.grid([5, 5], [3], ["eom"])
    with pytest.raises(ValueError, match="unknown"):
        consensus.grid([5], [3], ["best"])
    empty = spark.createDataFrame([], SCHEMA)
    assert consensus.stable_families(empty, 0.5).count() == consensus.consensus(empty, 0.5).count() == 0


def test_ensemble_to_families(spark):
    rng = random.Random(4)
    rows = [(i, 5 * (i % 3) + rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for i in range(90)] + [(900, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    labels = clusters.hdbscan(df, "id", ["x", "y"], consensus.grid([5, 8], [3], ["eom"]))
    got = {r["id"]: r["family"] for r in consensus.stable_families(labels, 0.5).collect()}
    assert got == {i: i % 3 for i in range(90)} | {900: -1}


def test_complete_link_merges_ties_by_name(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    pairs = spark.createDataFrame([(1, 0, 0.2), (1, 2, 0.2), (0, 2, 0.4), (2, 3, 0.2), (4, 3, 0.2), (4, 5, 0.1)], "a long, b long, far double")
    got = {r["node"]: r["family"] for r in families.complete_link(nodes, pairs, "far", 0.3).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
