"""Each stage of the pipeline against a plain version on the stage's own input."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np

import corpus_pipeline
from lodestone.llm import mixing, near_dedup, packing, toxicity
from tests.llm.test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = {}, docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    rows = {name: df.collect() for name, df in inputs.items()}

    scored = toxicity.toxicity_scores(inputs["toxicity"], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids["toxicity"] == {r["doc_id"] for r in scored.where("predicted = 0").collect()}

    groups = defaultdict(list)
    for r in rows["exact_dedup"]:
        groups[re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "")].append(r)
    assert ids["exact_dedup"] == {min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"]))["doc_id"] for g in groups.values()}

    known, label = {}, {r["doc_id"]: r["doc_id"] for r in rows["near_dedup"]}
    sets = {r["doc_id"]: np.unique(near_dedup.shingles(r["text"] or "", known), return_counts=True) for r in rows["near_dedup"]}
    for a, b in combinations(sets, 2):
        if near_dedup.probability_jaccard(*sets[a], *sets[b]) >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert ids["near_dedup"] == set(label.values())

    assert sorted(map(repr, kept["mixing"])) == sorted(map(repr, rows["mixing"]))
    check_packing(kept["packing"], {r["doc_id"]: r["text"] or "" for r in rows["packing"]})
    again = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in again} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept["packing"]}


def test_stages_take_empty_and_hard_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    hard = spark.createDataFrame([(1, None, None, None, None), (None, "", "x", "y", 0), (3, "a b c", None, "y", 1), (3, "a b c", None, "y", 1)], docs.schema)
    for table, n in ((docs.where("false"), 0), (hard, 2)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, FOLDER)
        assert table.count() == n


def test_source_shares_follow_the_targets_along_sequences(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(i, f"{i:04d} " + "word " * 799, "en", "small" if i < 60 else "big", 4000) for i in range(300)]
    packed = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(rows, docs.schema).repartition(3, "doc_id"), FOLDER).collect()
    place = {r["doc_id"]: (r["m_slot"], r["m_offset"]) for r in mixing.schedule(spark.createDataFrame(rows, docs.schema)).collect()}
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append(r["doc_id"])
    assert sorted(sequences) == list(range(len(sequences))) and len(packed) == len(rows)
    assert [d for s in sorted(sequences) for d in sorted(sequences[s], key=place.get)] == sorted(place, key=place.get)
    # blocks of 5 to 3 while both sources last, then the big one alone
    at = sorted(sequences)
    share = lambda part: sum(d < 60 for s in part for d in sequences[s]) / sum(len(sequences[s]) for s in part)
    assert abs(share(at[: len(at) // 4]) - 3 / 8) < 0.1 and abs(share(at[: len(at) // 2]) - 3 / 8) < 0.1 and share(at[2 * len(at) // 3 :]) == 0


def test_stages_keep_columns_of_any_name(spark):
    names = ["k_id", "k_chars", "__sha", "__chars", "m_slot", "m_source", "m_offset", "f_slot", "row", "__row", "m_order", "kept_id", "node", "M_FINE"]
    docs = spark.createDataFrame(
        [(1, "a b c", "x", *["v1"] * len(names)), (2, "a b c", "x", *["v1"] * len(names)), (3, "other words here", None, *["v2"] * len(names))],
        "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names),
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns[3:] == names
    rows = sorted(docs.collect())
    assert [tuple(r)[3:] for r in rows] == [("v1",) * len(names), ("v2",) * len(names)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.pack_sequences(spark, docs, FOLDER).collect()) == [1, 3]


def test_packing_remembers_fewer_words_in_the_pipeline(spark, monkeypatch):
    docs, asked, pack = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}, packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: asked.update(b) or pack(*a, **b | {"remember": 50, "at_once": 1000}))
    got = corpus_pipeline.pack_sequences(spark, docs, FOLDER).collect()
    assert asked["remember"] < packing.REMEMBER and asked["at_once"] < packing.AT_ONCE
    monkeypatch.setattr(packing, "pack", pack)
    assert sorted(got) == sorted(corpus_pipeline.pack_sequences(spark, docs, FOLDER).collect())
