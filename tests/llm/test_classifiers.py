"""Held-out accuracy of the two classifiers, and defined results for hard rows."""

import random
import zlib

import pytest

from lodestone.llm import learning, quality, toxicity

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, target int, model int"


def auc(pairs):
    low, high = [s for s, y in pairs if not y], [s for s, y in pairs if y]
    return sum((h > x) + (h == x) / 2 for h in high for x in low) / (len(low) * len(high))


@pytest.mark.parametrize("query,target,mod,held", [(quality.op3_quality_classifier, "quality", 4, 2), (toxicity.op5_toxicity, "toxic", 3, 1)])
def test_held_out(spark, query, target, mod, held):
    got = {r["doc_id"]: r for r in query(spark, FOLDER).collect()}
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % mod == held) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in got.items())
    labels = [(got[r["doc_id"]], r[target]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r["doc_id"] in got and r[target] is not None]
    unseen = [(r, y) for r, y in labels if r["held_out"]]
    assert auc([(r["score"], y) for r, y in unseen]) > 0.9
    assert sum(r["predicted"] == y for r, y in unseen) / len(unseen) > 0.85


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_hard_rows(spark, scores):
    rows = [(i, f"good plain prose number {i} of the river" if i % 2 else f"zzgrawk you zzgrawk {i}", "x", 0, 0) for i in range(40)]
    rows += [(None, None, None, None, None), (100, "", "x", 0, 0), (101, "word " * 60_000, "x", 0, 0), (5, "repeated id", "x", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert not [r for r in got if r["doc_id"] is None][0]["held_out"]
    assert {r["score"] for r in scores(docs, labels.where("false")).collect()} == {0.5}
    assert scores(docs.where("false"), labels).count() == 0


def test_clean_rows_stay_with_their_columns(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    clean = {r["doc_id"] for r in toxicity.toxicity_scores(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == clean


def test_sample_is_bounded_by_characters(spark):
    rows = [(i, ("good plain prose" if i % 2 else "zzgrawk") + f" {i}") for i in range(60)] + [(100, "huge " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(100, 1)], "doc_id long, toxic int")
    seen = learning.fit(docs, labels, "toxic", 3, 1, lambda rows: [t for t, _ in rows], chars=600)
    assert 20 < len(seen) < 45 and sum(map(len, seen)) <= 600 and len(max(seen, key=len)) < 30


def test_quotation_counts_less_than_abuse():
    rows = [(f"you are a vexgrol and number {i}", 1) for i in range(30)] + [(f"a quiet day by the river, number {i}", 0) for i in range(60)]
    model = toxicity.train(iter(rows))
    assert "vexgrol" in model["closed"]
    abuse, misspelt, quoted, reported, plain = toxicity.scorer(model)(
        ["go away you vexgrol", "go away you vexgroll", 'go away, the text reads "you vexgrol" here', "they wrote the word vexgrol there", "the river is quiet"], raw=True
    )
    assert plain == 0 < quoted < misspelt <= abuse and reported < misspelt
    assert quoted < abuse / 3


def test_automaton_equals_edit_distance():
    """The best term of a word is one within the edits allowed, by plain dynamic programming."""
    rng = random.Random(4)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 12))): 1.0 for _ in range(25)}
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 13))) for _ in range(400)] + list(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for word, (weight, edits) in zip(words, toxicity.Lexicon(terms, {}).match(words), strict=True):
        near = [distance(word, t) for t in terms if distance(word, t) <= toxicity.edits_allowed(t)]
        assert bool(weight) == bool(near) and (not near or edits == min(near))
