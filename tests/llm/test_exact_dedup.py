"""Exact duplicates equal those of DuckDB and of plain Python, also when hashes of chunks clash."""

import hashlib
import re

import duckdb
import pytest

from lodestone.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, row long, h int, chunks string"
ROWS = [
    (1, None, 0, 0, "x"), (2, "", 0, 0, "x"), (3, " \t\n\v\f\r", 0, 0, "x"), (None, "a b", 0, 0, "x"), (5, "ab", 0, 0, "x"), (4, "a b", 0, 0, "x"),
    (6, "same", 0, 0, "x"), (6, "same", 0, 0, "x"), (7, "a b", 0, 0, "x"), (8, "long text, rather " * 20_000, 0, 0, None), (9, "long text,rather " * 20_000, 0, 0, None),
    (10, "long text, rather " * 19_999 + "other", 0, 0, None),
]


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(doc_id, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for doc_id, _ in members]
    return out


@pytest.mark.parametrize("bits", [64, 3])
def test_hard_rows_equal_brute_force(spark, bits):
    got = ed.exact_groups(spark.createDataFrame(ROWS, SCHEMA), hash_bits=bits).collect()
    assert sorted(map(repr, [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got])) == sorted(map(repr, brute(ROWS)))
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_kept_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = ed.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7, 8, 10]
    assert ed.keep_first(docs.where("false")).count() == ed.exact_groups(docs.where("false")).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = {tuple(r) for r in ed.op2_exact_dedup(spark, folder).collect()}
    want = duckdb.sql(ed.ORACLE_SQL.replace("FROM documents", f"FROM '{folder}/documents.parquet'")).fetchall()
    assert got == set(want)
