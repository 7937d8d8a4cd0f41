"""Fingerprints, edited texts and neighbours equal those of plain Python."""

import hashlib
import re
from functools import reduce

import xxhash

from lodestone.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, bucket string, marks int"


def edited(rows):
    """(doc_id, edited text) of rows in ascending order of id."""
    rows = sorted(rows)
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        yield doc_id, text[: len(text) - half] + after[:half]


def likeness(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in fp.op4_syncmer_fingerprints(spark, folder).collect()}
    assert len(got) == len(rows)
    changed = dict(edited(rows))
    own = spark.createDataFrame(list(changed.items()), "doc_id long, text string").select("doc_id", fp.F.array_join(fp.fingerprint(fp.F.col("text")), " ").alias("f"))
    own = {r["doc_id"]: r["f"] for r in own.collect()}
    ids = sorted(changed)
    for doc_id, after in zip(ids, ids[1:] + ids[:1], strict=True):
        r = got[doc_id]
        assert r["edited_sha256"] == hashlib.sha256(changed[doc_id].encode()).hexdigest()
        assert r["edited_fingerprint"] == own[doc_id]
        assert abs(r["near_edited"] - likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-12
        assert abs(r["near_next"] - likeness(r["fingerprint"], got[after]["fingerprint"])) < 1e-12
    by_text = {}
    for doc_id, text in rows:
        assert by_text.setdefault(text, got[doc_id]["fingerprint"]) == got[doc_id]["fingerprint"]


def test_choice_depends_on_the_k_mer_alone(spark):
    words = [f"w{i * i % 97}" for i in range(200)]
    table = spark.createDataFrame([(" ".join(words),), (" ".join(["new", *words]),)], "text string").select(fp.syncmers(fp.F.col("text")).alias("s"))
    a, b = ({(x["at"] - shift, x["hash"]) for x in r["s"]} for shift, r in enumerate(table.collect()))
    inner = lambda s: {x for x in s if x[0] >= 0}  # the blank words before a text are beside another word in each
    assert inner(a) == inner(b) and len(inner(a)) > 50
    at = sorted(x for x, _ in a)
    assert max(y - x for x, y in zip(at, at[1:])) <= fp.K - fp.S


def test_hard_rows(spark):
    docs = spark.createDataFrame([(None, None, "x", 0), (1, "", "x", 0), (1, "a b", None, 0), (1, "a b", None, 0), (9, "é 🙂 word " * 9000, "x", 0)], SCHEMA)
    got = fp.edited_likeness(docs).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 3, 3, 81_000 + 9 * 0]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    one = fp.edited_likeness(docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0
    assert fp.edited_likeness(docs.where("false")).count() == 0


def test_short_texts_have_fingerprints_that_tell_them_apart(spark):
    texts = [" ".join(f"w{(i * 31 + j * 17) % 101}" for j in range(n)) for n in range(1, 14) for i in range(40)]
    table = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fp.fingerprint(fp.F.col("text")).alias("f"))
    got = {r["text"]: tuple(r["f"]) for r in table.collect()}
    assert all(got.values()) and len(set(got.values())) == len(set(texts))
    none = spark.createDataFrame([("", " \n"), ("", "word")], "a string, b string").select(fp.likeness(fp.fingerprint(fp.F.col("a")), fp.fingerprint(fp.F.col("b")))).collect()
    assert [r[0] for r in none] == [1.0, 0.0]


def test_one_rule_for_all_lengths(spark):
    """Likeness of a text and the same with a word more equals that of plain sets of k-mers, and does not fall at any length."""
    pairs = [(n, " ".join(f"{a}{j}" for j in range(n)), " ".join(f"{a}{j}" for j in range(n + 1))) for n in range(1, 40) for a in "uvwxyz"]
    table = spark.createDataFrame(pairs, "n int, a string, b string")
    marks = table.withColumns({c: fp.syncmers(fp.F.col(c)) for c in "ab"}).withColumns({f"{c}_set": fp.hashes(fp.F.col(c)) for c in "ab"})
    both = marks.select("n", fp.likeness(fp.F.col("a_set"), fp.F.col("b_set")).alias("near"), fp.likeness(fp.anchors(fp.F.col("a")), fp.anchors(fp.F.col("b"))).alias("placed"))
    got = {}
    for r, (n, a, b) in zip(both.collect(), pairs, strict=True):
        x, y = set(plain_syncmers(a)), set(plain_syncmers(b))
        assert abs(r["placed"] - jaccard(x, y)) < 1e-12
        assert abs(r["near"] - jaccard({k for _, k in x}, {k for _, k in y})) < 1e-12
        got.setdefault(n, []).append(r["near"])
    mean = {n: sum(x) / len(x) for n, x in got.items()}
    assert min(mean[10], mean[11]) > 0.2 and mean[39] > 0.6  # 10 and 11 words that share 10


def test_places_tell_moved_texts(spark):
    words = [f"w{i * i % 997}" for i in range(300)]
    table = spark.createDataFrame([(" ".join(words), " ".join(words[:150] + ["new"] + words[150:]))], "a string, b string")
    a, b = (fp.syncmers(fp.F.col(c)) for c in "ab")
    near, placed = table.select(fp.likeness(fp.hashes(a), fp.hashes(b)), fp.likeness(fp.anchors(a), fp.anchors(b))).first()
    assert near > 0.9 and 0.3 < placed < 0.4  # the first half stands where it stood


def plain_syncmers(text):
    """(place, key) of the closed syncmers, by the definition, with the public hash of each stretch of words."""
    ws, chain = [""] * (fp.K - 1) + text.split() + [""] * (fp.K - 1), lambda words: reduce(lambda seed, w: xxhash.xxh64_intdigest(w.encode(), seed), words, 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    small = [signed(chain(ws[i : i + fp.S])) for i in range(len(ws) - fp.S + 1)]
    inside = fp.K - fp.S + 1
    chosen = [i for i in range(len(small) - inside + 1) if min(small[i : i + inside]) in (small[i], small[i + inside - 1])]
    return [(i - fp.K + 1, tuple(ws[i : i + fp.K])) for i in chosen]


def plain_positions(text):
    return [at for at, _ in plain_syncmers(text)]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_places_equal_the_definition(spark):
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"] and len(r["text"].split()) > 1]
    rows = [" ".join(x.split()) for x in rows if not re.search(r"[^\x00-ɏ -⃿]", x)]
    got = spark.createDataFrame([(x,) for x in rows], "text string").select("text", fp.syncmers(fp.F.col("text")).alias("s")).collect()
    assert len(got) > 100 and all([x["at"] for x in r["s"]] == plain_positions(r["text"]) for r in got)


def test_text_without_blanks(spark):
    text = "".join(chr(0x4E00 + i * i % 701) for i in range(1400))
    got = {r["doc_id"]: r for r in fp.edited_likeness(spark.createDataFrame([(1, text), (2, text[:700] + "新" + text[700:])], "doc_id long, text string")).collect()}
    assert len(got[1]["fingerprint"].split()) > 200 and got[1]["near_next"] > 0.95


def test_ids_that_are_no_numbers(spark):
    rows = [(f"id{i:04d}", f"text of number {i} and more words like {i * 7} or so") for i in range(300)] + [(None, "none")]
    got = {r["doc_id"]: r for r in fp.edited_likeness(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = dict(edited([(i or "", x) for i, x in rows]))
    assert {i or "": r["edited_sha256"] for i, r in got.items()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in want.items()}
