"""Near-duplicate classes equal those of all pairs, and hard rows have defined results."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, node string, label int"


def texts() -> list[str]:
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, 120)) for _ in range(6)]
    out = [" ".join(b) for b in base]
    for b in base[:4]:
        for edits in (1, 2, 6, 20):
            c = list(b)
            for at in rng.choice(len(c), edits, replace=False):
                c[at] = "edited"
            out.append(" ".join(c))
    return out


def plain_shingles(text: str) -> Counter:
    ws = text.lower().split()
    n = min(5, len(ws))
    return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if ws else Counter()


def plain_jaccard(p: Counter, q: Counter) -> float:
    both = p.keys() | q.keys()
    return sum(1 / sum(max(p[j] / p[i], q[j] / q[i]) for j in both) for i in p.keys() & q.keys())


def plain_classes(docs: list[str]) -> dict[int, int]:
    sets, label = [plain_shingles(x) for x in docs], list(range(len(docs)))
    for a, b in combinations(range(len(docs)), 2):
        if label[a] != label[b] and plain_jaccard(sets[a], sets[b]) >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return dict(enumerate(label))


def test_classes_equal_brute_force(spark):
    docs = texts()
    got = nd.classes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    want = plain_classes(docs)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert sum(r["kept"] for r in got) == len(set(want.values()))


def test_crowded_buckets_equal_brute_force(spark):
    """Copies of one text with more and more edits share buckets of far over SMALL members, many of them below the threshold."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    base, docs = list(rng.choice(words, 60)), []
    for i in range(90):
        c = list(base)
        for at in rng.choice(len(c), i % 6, replace=False):
            c[at] = f"edit{i}"
        docs.append(" ".join(c))
    got = nd.classes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    want = plain_classes(docs)
    assert 10 < len(set(want.values())) < 90
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f", "v1", "v2", 0), (2, "a b c d e f", "v1", "v2", 0), (3, "other", "v1", None, 1)]
    for names in ("k_id", "K_ID", "row"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {names} string, kept_id string, __row int")
        for table in (docs, docs.union(docs)):
            kept = nd.keep_one(table)
            assert kept.columns == docs.columns
            assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_probability_jaccard_by_definition():
    a, x, b, y = np.array([1, 2, 3]), np.array([1, 2, 3]), np.array([2, 3, 4]), np.array([4, 1, 1])
    p, q = dict(zip(a, x)), dict(zip(b, y))
    want = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in {1, 2, 3, 4}) for i in (2, 3))
    assert nd.probability_jaccard(a, x, b, y) == pytest.approx(want)


def test_registers_estimate_similarity():
    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(21, 121, dtype=np.uint64)
    sig = nd.prob_minhash([(nd.mix(a), np.ones(100)), (nd.mix(b), np.ones(100))], 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(80 / 120, abs=0.04)


def test_hard_rows(spark):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (None, "  ", "x", 0), (4, "a b", "x", 0), (4, "a b", "x", 0), (5, "long " * 30_000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = nd.classes(docs).collect()
    assert len(got) == 6 and sum(r["kept"] for r in got) == 3
    assert {r["class_id"] for r in got} == {1, 4, 5}
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert nd.classes(docs.where("false")).count() == 0
