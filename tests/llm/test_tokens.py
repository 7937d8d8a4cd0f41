"""Counts and ids equal the library's; packing is gapless, whole and as tight as plain best-fit decreasing."""

import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing, token_counts

HARD = [
    "", " ", "  \n\n  a", "it's THEY'LL we'Ve 12345 x9", "tab\tand\x0bmore\x0c\r\n", "naïve Ünïcode straße ÇA", "日本語 と 한국어 и русский", "🙂🙂👍🏽 é",
    "a" * 5000, "<|endoftext|>", "x<|endoftext|> y", "\x1c\x1d\x1e\x1f w", " 　 z", "-- ... !!!??? $5.00", "</w> <unk> [UNK] <s>", "\x00\x01", "İstanbul ſ ﬁ",
]
SCHEMA = "doc_id long, text string, length string, shard int, n string"


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def of_table(spark):
    return [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]


def test_counts_equal_library(spark):
    texts = HARD + of_table(spark)
    want = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json")).counts(texts) == want


def test_ids_equal_library(spark):
    texts = HARD + of_table(spark)
    want = [np.array(e.ids, "<u4").tobytes() for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).ids(texts) == want


COUNTER, IDS = token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json")), packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
BYTES, WORDS = library("byte_bpe_50k.json"), library("word_bpe_49k.json")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aA'st 1\n\t\xa0\x85.<|>")), max_size=40), max_size=4))
def test_any_text_equals_library(texts):
    assert COUNTER.counts(texts) == [len(BYTES.encode(t, add_special_tokens=False).ids) for t in texts]
    assert IDS.ids(texts) == [np.array(WORDS.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_count_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 0, "n"), (1, "", "x", 0, "n"), (None, "a b", None, 0, "n"), (3, "word " * 60_000, "x", 0, "n")], SCHEMA)
    got = {tuple(r) for r in token_counts.token_counts(docs, "byte_bpe_50k.json").collect()}
    n = len(BYTES.encode("word " * 60_000).ids)
    assert got == {(1, 0, 0, False), (None, 3, 2, False), (3, 300_000, n, True)}
    assert token_counts.token_counts(docs.where("false"), "byte_bpe_50k.json").count() == 0


def plain_best_fit(lengths, capacity):
    """Bins used by best-fit decreasing, piece by piece."""
    left = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(left, n)
        room = left.pop(at) if at < len(left) else capacity
        insort(left, room - n)
    return len(left)


@pytest.mark.parametrize("capacity,top,n", [(10, 10, 50), (64, 64, 500), (64, 20, 3000), (4096, 4096, 2000), (7, 3, 40)])
def test_plan_equals_plain_best_fit(capacity, top, n):
    rng = random.Random(capacity + n)
    for _ in range(20):
        lengths = [rng.randint(1, top) for _ in range(rng.randint(1, n))]
        counts = defaultdict(int)
        for x in lengths:
            counts[x] += 1
        p = packing.best_fit_plan(dict(counts), capacity)
        runs = list(zip(p["length"], p["rank"], p["bin"], p["per"], p["offset"], strict=True))
        bins = defaultdict(list)
        for length, count in counts.items():
            mine = [r for r in runs if r[0] == length]
            for i in range(count):
                _, rank, first, per, offset = max((r for r in mine if r[1] <= i), key=lambda r: r[1])
                bins[first + (i - rank) // per].append((offset + (i - rank) % per * length, length))
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) == plain_best_fit(lengths, capacity)


def check_packing(rows, texts, capacity=4096):
    """Every document's pieces are its ids in order, and sequences have no gaps."""
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for doc_id, text in texts.items():
        ids = np.array([*WORDS.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want = [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted(pieces[doc_id]) == want
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plain_best_fit([r["length"] for r in rows], capacity)


def test_query_packs_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_packing(packing.op10_best_fit_packing(spark, "/root/testdata/sf0.01").collect(), {r["doc_id"]: r["text"] or "" for r in docs.collect()})


def test_pack_hard_rows(spark):
    rows = [(1, None, "x", 0, "n"), (None, "", "x", 0, "n"), (3, "word other " * 20_000, None, 0, "n"), (4, "tie", "x", 0, "n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    check_packing(packing.pack(docs, "word_bpe_49k.json").collect(), {r[0]: r[1] or "" for r in rows})
    assert packing.pack(docs.union(docs), "word_bpe_49k.json").count() == 2 * packing.pack(docs, "word_bpe_49k.json").count()
    assert packing.pack(docs.where("false"), "word_bpe_49k.json").count() == 0
