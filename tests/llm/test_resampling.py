"""Resampling equals plain Python for any order of runs and size of chunks, and DuckDB on the table."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lodestone.llm import resampling as rs

SCHEMA = "doc_id long, text string, row int, rank string, weight long, at int, place int"
RNG = np.random.default_rng(5)
VOCABULARY = ["The", "cat", "Straße", "日本語", "don't", "x1", "É́", "a_b", "\U0001f600ok", "ÀB", "end."]
TEXTS = [None, "", " \n.,;", "one", *[" ".join(RNG.choice(VOCABULARY, n)) for n in RNG.integers(1, 90, 60)], "-".join(RNG.choice(VOCABULARY, 3000)), "z" * 5000 + " tail words " * 30]
DOCS = [(i if i % 9 else None, t, 0, "x", 7, 1, 2) for i, t in enumerate(TEXTS)] + [(70, "same text " * 15, 0, "x", 7, 1, 2)] * 3
TARGET = [("The cat don't end. Straße " * 3,), (None,), ("x1 x1",)]


def runs(text, order):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(words), [" ".join(words[i : i + n]).encode() for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, order, buckets=10_000, least=20, percent=10):
    of = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in runs(t, order)[1])
    s, t = of(d[1] for d in docs), of(x[0] for x in target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, text, *_ in docs:
        words, found = runs(text, order)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((words, doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = len(fit) * percent // 100
    return [(*r[1:], i + 1 if i < drawn else None) for i, r in enumerate(fit)] + [(*r[1:], None) for r in out if r[0] < least]


@pytest.mark.parametrize(("order", "chunk", "percent"), [(1, 1 << 16, 10), (1, 100, 55), (2, 64, 30), (3, 17, 100)])
def test_equals_brute_force(spark, order, chunk, percent):
    docs, target = spark.createDataFrame(DOCS, SCHEMA).repartition(5), spark.createDataFrame(TARGET, "text string")
    got = rs.resampled(docs, target, order=order, chunk=chunk, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(DOCS, TARGET, order, percent=percent)))


def test_chunks_are_the_text(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    got = rs.chunks(docs.selectExpr("doc_id", "text", "monotonically_increasing_id() AS row"), 3, 50).groupBy("row").agg(rs.F.sum(rs.F.length("text")).alias("n")).collect()
    assert sorted(r["n"] for r in got) == sorted(len(d[1] or "") for d in DOCS)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame(DOCS, SCHEMA), spark.createDataFrame(TARGET, "text string")
    assert rs.resampled(docs.where("false"), target).count() == 0
    got = rs.resampled(docs, target.where("false")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(DOCS, [], 1)))


def test_query_equals_sql(spark):
    folder = Path("/root/testdata/sf0.01")
    got = [tuple(r) for r in rs.op13_importance_resampling(spark, str(folder)).collect()]
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder / name}.parquet'")
    assert sorted(got, key=repr) == sorted(con.execute(rs.ORACLE_SQL).fetchall(), key=repr)
