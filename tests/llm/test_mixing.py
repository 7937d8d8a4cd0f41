"""Every source stays within one block of its share at every slot, and rows fill blocks whole and in order."""

from collections import Counter, defaultdict

import pytest

from lodestone.llm import mixing

SCHEMA = "doc_id long, text string, source string, m_slot int, coarse string"


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 5, "b": 3, "c": 1}, {f"s{i}": 1 / (i + 1) for i in range(40)}, {"x": 1e6, "y": 1e-6}])
def test_frame_is_pfair(weights):
    slots = mixing.whole_slots(weights, 512)
    assert sum(slots.values()) == 512 and min(slots.values()) >= 1
    seen = Counter()
    for s, i, slot, release, deadline in sorted(mixing.one_frame(slots), key=lambda x: x[2]):
        assert release <= slot < deadline and i == seen[s]
        seen[s] += 1
        assert all(abs(seen[k] - q * (slot + 1) / 512) < 1 for k, q in slots.items())
    assert seen == Counter(slots)


def test_query_keeps_every_row_and_the_share(spark):
    folder = "/root/testdata/sf0.1"
    got = mixing.op6_pfair_mixing(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert Counter((r["doc_id"], r["source"], r["n_chars"]) for r in got) == Counter((r["doc_id"], r["source"], len(r["text"] or "")) for r in docs)
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"] or ""].append(r)
        assert r["release"] <= r["slot"] < r["deadline"]
    owner = {}
    for s, rows in by_source.items():
        at = 0
        for r in sorted(rows, key=lambda r: (r["block"], r["offset"], r["n_chars"])):
            assert r["block"] * mixing.BLOCK_CHARS + r["offset"] == at
            at += r["n_chars"]
        for r in rows:
            assert owner.setdefault(r["slot"], (s, r["block"], r["phase"])) == (s, r["block"], r["phase"])
    # a long text has blocks of its own in which no row begins, so blocks are told by their numbers
    totals = {s: sum(r["n_chars"] for r in rows) for s, rows in by_source.items()}
    blocks = {s: -(-n // mixing.BLOCK_CHARS) for s, n in totals.items()}
    frame = max(4 * len(totals), mixing.FRAME)  # the same for tables of any size
    slots = mixing.whole_slots({s: n**mixing.TEMPERATURE for s, n in totals.items()}, frame)
    first = [(slot, s, block) for slot, (s, block, phase) in owner.items() if phase == 1]
    assert first
    for slot, s, block in first:
        weight = slots[s] / frame
        assert block - weight * slot < 1 and block + 1 - weight * (slot + 1) > -1


def test_hard_rows(spark):
    rows = [(1, None, None, 0, "x"), (1, "", "", 0, "x"), (None, "a b", "s", 0, "x"), (4, "word " * 50_000, "s", None, None), (5, "tie", "t", 0, "x"), (5, "tie", "t", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("m_slot", "slot")
    assert mixing.schedule(docs).count() == 6
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(rows)
    assert mixing.schedule(docs, {"s": 0.5, "gone": 0.5}).count() == 6
    assert mixing.schedule(docs.where("false")).count() == 0


def test_weights_hold_until_one_source_is_left(spark):
    blocks = {"hot": 500, **{f"s{i}": 70 + i for i in range(8)}, "": 1}
    target = {s: n**0.5 for s, n in blocks.items()}
    parts, table = mixing.phases(blocks, target, 256)
    nth = {(p, s, i): slot for p, s, i, slot, *_ in table}
    order = {begin + k // q * size + nth[p, s, k % q]: (s, first + k) for p, s, first, until, q, size, begin in parts for k in range(until - first)}
    assert sorted(order) == list(range(sum(blocks.values()))) and sorted(order.values()) == [(s, i) for s in sorted(blocks) for i in range(blocks[s])]
    phase = 0
    while True:
        phase += 1
        mine = [x for x in parts if x[0] == phase]
        left = {s for p, s, *_ in parts if p >= phase}
        if len(left) < 2:
            break
        begin, end = mine[0][6], min((x[6] for x in parts if x[0] == phase + 1), default=sum(blocks.values()))
        share = mixing.whole_slots({s: target[s] for s in left}, mine[0][5])
        seen = Counter()
        for slot in range(begin, end):
            seen[order[slot][0]] += 1
            assert all(abs(seen[s] - q * (slot - begin + 1) / mine[0][5]) < 1 for s, q in share.items())
    assert all(order[slot][0] == "hot" for slot in range(mine[0][6], sum(blocks.values())))


def test_a_tiny_source_does_not_end_the_weights(spark):
    rows = [(i, "x" * 100, "big" if i % 5 else "small", 0, "x") for i in range(2000)] + [(2000, "y", None, 0, "x"), (2001, "", "big", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("m_slot", "slot")
    got = mixing.schedule(docs, block_chars=100, frame=64).collect()
    assert len(got) == len(rows) and max(r["m_slot"] for r in got) == 2000
    small = sorted(r["m_slot"] for r in got if r["source"] == "small")
    assert len(small) == 400 and 1100 < small[-1] < 1300  # weights 2 to 1: all of the 400 are in the first 1200 slots or so
    assert all(abs(sum(s < at for s in small) - at / 3) < 0.03 * at + 5 for at in range(100, 1100, 100))
