"""Removed bytes equal those of counting every string of 200 bytes."""

import hashlib
import random
from collections import Counter

from lodestone.llm import repeats

LENGTH = 200


def brute(texts: list[str]) -> list[tuple[int, str]]:
    data = [t.encode() for t in texts]
    n = Counter(b[i : i + LENGTH] for b in data for i in range(len(b) - LENGTH + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - LENGTH + 1):
            if n[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(120))
    texts = []
    for i in range(40):
        own = " ".join(word() for _ in range(80))
        a = rng.randint(0, 200)
        texts.append(own + passage[a : a + rng.randint(150, 420)] + own[::-1])
    texts += ["", "short", "a" * 199, "a" * 205, "ab" * 300, texts[0], texts[1][:300] + "!" + texts[1][300:]]
    got = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got} == dict(enumerate(brute(texts)))


def test_hard_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 2), (2, "x y " * 500, 3)], "doc_id long, text string, node int")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.without_repeats(docs).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (2000, 2000, 1)]
    assert repeats.without_repeats(docs.where("false")).count() == 0


def test_random_passages_equal_brute_force(spark):
    """Few letters, periods of all lengths, repeated rows and ids that do not tell rows apart."""
    rng = random.Random(8)
    bits = ["".join(rng.choice("ab") for _ in range(rng.randint(100, 700))) for _ in range(6)] + ["abc" * 120, "z" * 400, "é" * 150]
    texts = ["".join(rng.choice(bits)[rng.randint(0, 60) :][: rng.randint(50, 500)] for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts += texts[:3]
    for ids in (list(range(len(texts))), [i % 7 if i % 5 else None for i in range(len(texts))], [f"id{i}" for i in range(len(texts))]):
        kind = "string" if isinstance(ids[0], str) else "long"
        got = repeats.without_repeats(spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string"), with_text=True).collect()
        want = Counter((i, n, sha) for i, (n, sha) in zip(ids, brute(texts)))
        assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == want
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in repeats.op9_suffix_array_dedup(spark, folder).collect()}
    assert got == dict(zip(docs, brute(list(docs.values())), strict=True))
