"""Density clusters equal a plain version that looks at all pairs and condenses from the top."""

import math
import random

import pytest

from lodestone.operators import clusters
from lodestone.operators.clusters import Run


def plain(rows: list[tuple], runs: list[Run]) -> dict[tuple, tuple]:
    """(id, run) -> (label, probability)."""
    out, points = {}, {}
    for i, *x in rows:
        if any(v is None or not math.isfinite(v) for v in x):
            out |= {(i, r): (None, None) for r in range(len(runs))}
        else:
            points.setdefault(tuple(v + 0.0 for v in x), []).append(i)
    ids = {min(v): v for v in points.values()}
    at = {min(v): k for k, v in points.items()}
    nodes = sorted(ids)
    far = {}
    for a in nodes:
        for b in nodes:
            sum_ = 0.0
            for x, y in zip(at[a], at[b], strict=True):
                sum_ += (x - y) ** 2
            far[a, b] = math.sqrt(sum_)
    for number, run in enumerate(runs):
        core = {}
        for a in nodes:
            near = [0.0] * (len(ids[a]) - 1) + sorted(far[a, b] for b in nodes if b != a for _ in ids[b])
            core[a] = near[min(run.min_samples, len(near)) - 1] if near else 0.0
        pairs = sorted((max(far[a, b], core[a], core[b]), a, b) for a in nodes for b in nodes if a < b)
        # the dendrogram: a tree is a node, or (edge, left, right)
        tree, of = {a: a for a in nodes}, {a: a for a in nodes}

        def find(x, of=of):
            return x if of[x] == x else find(of[x])

        for w, a, b in pairs:
            x, y = find(a), find(b)
            if x != y:
                of[y] = x
                tree[x] = (w, tree[x], tree[y])
        members = lambda t: [t] if not isinstance(t, tuple) else members(t[1]) + members(t[2])
        size = lambda t: sum(len(ids[m]) for m in members(t))
        lam = lambda w: 1 / max(w, 1e-12)
        made = []  # of a cluster: parent, birth, falls (node, lambda), parts, points

        def grow(t, parent, birth):
            c = len(made)
            made.append({"parent": parent, "birth": birth, "falls": [], "parts": [], "points": members(t)})
            while True:
                if not isinstance(t, tuple):
                    made[c]["falls"].append((t, lam(core[t])))
                    return c
                w, left, right = t
                big = [s for s in (left, right) if size(s) >= run.min_cluster_size]
                if len(big) == 2:
                    made[c]["parts"] = [(grow(s, c, lam(w)), size(s), lam(w)) for s in big]
                    return c
                for s in (left, right):
                    if s not in big or not big:
                        made[c]["falls"] += [(m, lam(w)) for m in members(s)]
                if not big:
                    return c
                t = big[0]

        import sys

        sys.setrecursionlimit(10_000)
        if nodes and size(tree[find(nodes[0])]) >= run.min_cluster_size:
            grow(tree[find(nodes[0])], None, 0.0)
        value, chosen = {}, set()

        def weigh(c):
            got = made[c]
            own = sum(len(ids[m]) * (x - got["birth"]) for m, x in got["falls"]) + sum(n * (x - got["birth"]) for _, n, x in got["parts"])
            under = sum(weigh(p) for p, _, _ in got["parts"])
            if not got["parts"] or (run.method == "eom" and under <= own):
                chosen.add(c)
            value[c] = max(own, under) if got["parts"] else own
            return value[c]

        if made:
            weigh(0)
        label = {}

        def name(c, top):
            top = top if top is not None else c if c in chosen and made[c]["parent"] is not None else None
            for m, x in made[c]["falls"]:
                most = 0 if top is None else max([y for _, y in made[top]["falls"]] + [y for _, _, y in made[top]["parts"]])
                label[m] = (-1, 0.0) if top is None else (min(made[top]["points"]), min(1.0, x / most))
            for p, _, _ in made[c]["parts"]:
                name(p, top)

        if made:
            name(0, None)
        order = sorted({c for c, _ in label.values() if c != -1})
        for a in nodes:
            c, p = label.get(a, (-1, 0.0))
            out |= {(i, number): (order.index(c) if c != -1 else -1, round(p, 9)) for i in ids[a]}
    return out


def blobs(seed: int, n: int, dims: int, copies: int = 0, grid: bool = False) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        centre = rng.choice([(0.0,) * dims, (4.0,) * dims, (4.0,) + (-3.0,) * (dims - 1), (9.0,) * dims])
        x = [c + rng.gauss(0, 0.4 if i % 9 else 4.0) for c in centre]
        rows.append((7 * i + 3, *(round(v) * 1.0 if grid else v for v in x)))
    rows += [(-i - 1, *rows[i % 5][1:]) for i in range(copies)]
    return rows


RUNS = [Run(5, 3), Run(5, 3, "leaf"), Run(12, 3), Run(4, 8), Run(10, 8, "leaf")]


def labels(spark, rows, runs, **how):
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"x{i} double" for i in range(len(rows[0]) - 1)))
    got = clusters.hdbscan(df.repartition(3), "id", df.columns[1:], runs, **how).collect()
    found = {(r["id"], r["run"]): (r["label"], None if r["probability"] is None else round(r["probability"], 9)) for r in got}
    assert len(found) == len(got) == len(rows) * len(runs)
    return found


@pytest.mark.parametrize(("rows", "how"), [
    (blobs(1, 150, 2), {}),
    (blobs(2, 140, 3, copies=30), {"per_pivot": 10, "block": 8}),
    (blobs(3, 120, 2, copies=8, grid=True), {"per_pivot": 5, "block": 16}),
])
def test_equals_a_plain_version(spark, rows, how):
    rows = [*rows, (10_001, *[None, *rows[0][2:]]), (10_002, *[float("nan"), *rows[0][2:]])]
    want = plain(rows, RUNS)
    assert labels(spark, rows, RUNS, **how) == want
    assert len({v[0] for v in want.values()}) > 3


@pytest.mark.parametrize("rows", [blobs(6, 90, 2, copies=12), blobs(7, 80, 2, copies=20, grid=True), [(i, float(i * i)) for i in range(40)]])
def test_spark_condenses_as_the_driver_does(spark, monkeypatch, rows):
    monkeypatch.setattr(clusters, "LOCAL", 30)  # points are above it, peaks below
    runs = [Run(4, 2), Run(4, 2, "leaf"), Run(9, 2)]
    assert labels(spark, rows, runs) == plain(rows, runs)


def test_few_rows(spark):
    assert labels(spark, [(1, 0.0), (2, 0.0), (3, 5.0)], [Run(2, 5)]) == plain([(1, 0.0), (2, 0.0), (3, 5.0)], [Run(2, 5)])
    assert labels(spark, [(1, 2.0)], [Run(2, 1)]) == {(1, 0): (-1, 0.0)}
    df = spark.createDataFrame([(1, None)], "id long, x double")
    assert [tuple(r) for r in clusters.hdbscan(df, "id", ["x"], [Run(2, 1)]).collect()] == [(1, 0, None, None)]
    assert clusters.hdbscan(df.where("false"), "id", ["x"], [Run(2, 1)]).count() == 0


def test_cells_are_passed_over(spark):
    rows = blobs(5, 1500, 2)
    df = spark.createDataFrame(rows, "id long, x double, y double")
    points = df.selectExpr("id AS node", "1L AS copies", "array(x, y) AS x")
    dealt = clusters.space(points, per_pivot=30)
    asked = dealt.visits(dealt.points.selectExpr("node", "x", "0.3D AS limit"), ["node", "limit"], lambda got, d, radius, weight: d - radius <= got["limit"][:, None])
    assert asked.count() < 0.4 * len(rows) * len(dealt.pivots)
