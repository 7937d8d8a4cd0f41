"""E8 points are the nearest, and near vectors equal brute force over all pairs."""

import math

import numpy as np
import pytest

from lodestone.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<double>, label int, node string, bucket int, key int, id int, n int"
EXTRA = (0, "x", 1, 2, 3, 4)


def brute(rows, threshold=0.9):
    good = {}
    for i, (_, v, *_) in enumerate(rows):
        x = np.array([np.nan if y is None else y for y in v or []], dtype=float)
        if len(x) and np.isfinite(x).all() and x.any():
            good[i] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    near = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold] for i in good}
    label = {i: i for i in range(len(rows))}
    parent = lambda i: i if label[i] == i else parent(label[i])
    for i, js in near.items():
        for j in js:
            label[parent(i)] = parent(j)
    out = []
    for i, (vec, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if parent(j) == parent(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((vec, len(near.get(i, [])), least, vec is not None and vec == least))
    return sorted(map(repr, out))


def at_cosine(random, x, c):
    z = random.normal(size=len(x))
    z -= (z @ x) * x / (x @ x)
    return c * x / np.linalg.norm(x) + math.sqrt(1 - c * c) * z / np.linalg.norm(z)


def cloud(n=220, width=64, seed=3):
    """Lone vectors, chains of near ones, a crowd, copies, multiples and all that links with nothing."""
    random = np.random.default_rng(seed)
    out = list(random.normal(size=(n, width)))
    for i in range(30):
        out += [at_cosine(random, out[i], c) for c in (0.99, 0.95, 0.93)]
        out.append(at_cosine(random, out[-1], 0.96) * 1e-200)
    crowd = random.normal(size=width)
    out += [at_cosine(random, crowd, 0.97) for _ in range(90)]
    out += [out[5], out[5] * 3, -out[5], out[5]]
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(out)]
    odd = [None, [], [0.0] * width, [float("nan")] * width, [None, *[1.0] * (width - 1)], [float("inf"), *[1.0] * (width - 1)], [1.0], [2.0], [-1.0], [1.0, 1.0], [1e300] * width, [1e300] * width, [-0.0] * (width - 1) + [1.0], [0.0] * (width - 1) + [1.0]]
    rows += [(i, v) for i, v in enumerate(odd)] + [(None, rows[0][1]), (None, None), (1000, rows[0][1]), (1000, rows[0][1])]
    return [(*r, *EXTRA) for r in rows]


def test_points_are_the_nearest():
    random = np.random.default_rng(1)
    steps = ed.roots()
    assert len(np.unique(steps, axis=0)) == 240
    assert np.allclose((steps**2).sum(1), 2)
    x = random.normal(size=(2000, 8)) * 3
    p = ed.decode(x)
    doubled = np.rint(2 * p).astype(int)
    assert (2 * p == doubled).all() and ((doubled % 2).sum(1) % 8 == 0).all() and (doubled.sum(1) % 4 == 0).all()
    far = ((x - p) ** 2).sum(1)
    assert (far[:, None] <= (((x - p)[:, None] - steps[None]) ** 2).sum(2) + 1e-9).all()
    assert far.max() <= 1 + 1e-9  # the lattice's covering radius


def test_probes_are_the_nearest_neighbours():
    random = np.random.default_rng(2)
    v = random.normal(size=(40, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    own, probed = ed.Lattice(64, probes=6)(v)
    assert own.shape == (40, 8) and probed.shape == (40, 8, 6)
    again, fewer = ed.Lattice(64, probes=2)(v)
    assert (own == again).all() and (probed[:, :, :2] == fewer).all()
    assert all(len({a, *b}) == 7 for a, b in zip(own.ravel(), probed.reshape(-1, 6), strict=True))


@pytest.mark.parametrize(("block", "probes"), [(1024, 2), (16, 2), (16, 0)])
def test_equals_brute_force(spark, block, probes):
    rows = cloud()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = ed.near_vectors(df, block=block, probes=probes, tables=16).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_recall_at_the_threshold(spark):
    random = np.random.default_rng(8)
    x = random.normal(size=(400, 64))
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *[at_cosine(random, v, 0.9 + 1e-9) for v in x]])]
    got = {r["vec_id"]: r for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[400 + i]["component_id"] == i and got[i]["n_links"] == 1 for i in range(400)) >= 0.98 * 400
    assert sum(r["n_links"] for r in got.values()) <= 800


def test_empty_table_and_the_given_one(spark):
    df = spark.createDataFrame(cloud(), SCHEMA)
    assert ed.near_vectors(df.where("false")).count() == 0
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in ed.op12_embedding_near_dedup(spark, folder).collect()) == brute(rows)
