"""Near duplicates by ProbMinHash, banding and verification.

Every distinct 5-word shingle of a text is a Poisson process whose rate is its count. An arrival goes to a random register, and the register
keeps the shingle that came first. Arrivals are made in rounds for many texts at once, and a shingle stops as soon as its next arrival is
later than all registers of its text. Two registers agree with the probability Jaccard of the two texts. Bands of registers propose pairs;
each pair is verified by the probability Jaccard of all its shingles (32-bit hashes of them), and verified pairs join texts into classes.

Pairs are never listed bucket by bucket. First all members of a bucket meet one of them. A bucket whose members are in one class by then is
done. In a small one that is not, members of different classes meet. The members of large ones, whose texts are alike but mostly below the
threshold, get a sketch of more registers and many narrower bands, whose buckets hold few pairs below it; there, members of different
classes meet whose registers agree about as often as those of a pair at the threshold. A pair exactly at the threshold shares a narrow band
with a chance of 99 %, one of 0.85 with 99.99 %, and a class is found by any chain of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, fresh, mix, spent, text_or_empty

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
#: Members of a bucket up to which those of different classes meet at once; beyond it, narrower bands decide who meets.
SMALL = 16
#: Registers of the second sketch, and its bands and the registers of each (bands overlap).
FINE, FINE_BANDS, FINE_ROWS = 640, 256, 18
#: Words whose hashes a task remembers, and characters that it works on at once.
REMEMBER, AT_ONCE = 200_000, 1 << 20


def shingles(text: str, known: dict[str, int], words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the stretches of ``words`` lower-case words between white space; a shorter text is one stretch, an empty one none."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    for w in {w for w in ws if w not in known}:
        known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i])
    return out


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """A row of ``registers`` winners (shingle hashes) for each (distinct hashes, weights); rows of empty sets are 0."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    best, winner = np.full(len(sets) * registers, np.inf), np.zeros(len(sets) * registers, np.uint64)
    if not len(doc):
        return winner.reshape(len(sets), registers)
    item = np.concatenate([s for s, _ in sets])
    rate = np.concatenate([w for _, w in sets]).astype(float)
    time, arrival = np.zeros(len(doc)), 0
    while len(doc):
        arrival += 1
        draw = mix(item + np.uint64(arrival * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        at = doc * registers + (mix(draw ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
        first = time < best[at]
        np.minimum.at(best, at[first], time[first])
        won = np.flatnonzero(first)[time[first] == best[at[first]]]
        winner[at[won]] = item[won]
        still, place = np.unique(doc, return_inverse=True)
        live = time < best.reshape(-1, registers)[still].max(1)[place]
        doc, item, rate, time = doc[live], item[live], rate[live], time[live]
    return winner.reshape(len(sets), registers)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row of ``winners``."""
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(winners), 1))
    parts = winners.reshape(-1, bands, rows)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common items i of 1 / sum over j of max(x_j / x_i, y_j / y_i), for ascending items with weights; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = x.astype(float), y.astype(float)
    cx, cy = x[i], y[j]
    order = np.argsort(cx / cy, kind="stable")
    cx, cy = cx[order], cy[order]
    only_x, only_y = x.sum() - cx.sum(), y.sum() - cy.sum()
    above = only_x + cx[::-1].cumsum()[::-1]  # those whose ratio is not below i's count by x, the others by y
    below = only_y + cy.cumsum() - cy
    return float((1 / (above / cx + below / cy)).sum())


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row per document: node (its number), doc_id, key (of its list of words), keys (of its bands; empty for no words) and items.

    ``items`` has 32-bit shingle hashes in ascending order, as often as they occur.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        node, known = TaskContext.get().partitionId() << 36, {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                part, chars = [], 0
                while at + len(part) < batch.num_rows and chars < AT_ONCE:
                    part.append(texts[at + len(part)].as_py())
                    chars += len(part[-1])
                if len(known) > REMEMBER:
                    known.clear()
                found = [shingles(t, known) for t in part]
                winners = prob_minhash([np.unique(s, return_counts=True) for s in found], bands * rows)
                keys = band_keys(winners, bands, rows)
                full = np.array([len(s) > 0 for s in found])
                offsets = np.append(0, np.cumsum(np.where(full, bands, 0))).astype(np.int32)
                made = [
                    pa.array(node + np.arange(len(part))),
                    ids.slice(at, len(part)),
                    pa.array([hashlib.blake2b(" ".join(t.lower().split()).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in part], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel())),
                    pa.array([np.sort((s >> np.uint64(32)).astype("<u4")).tobytes() for s in found], pa.binary()),
                ]
                node += len(part)
                at += len(part)
                yield pa.RecordBatch.from_arrays(made, ["node", "doc_id", "key", "keys", "items"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"node long, doc_id {kind}, key binary, keys array<long>, items binary")


def verified(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose items (32-bit hashes of shingles) have a probability Jaccard of ``threshold`` or more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def weighted(blob):
            return np.unique(np.frombuffer(blob, "<u4"), return_counts=True)

        for batch in batches:
            near = [probability_jaccard(*weighted(x.as_py()), *weighted(y.as_py())) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = items.select(F.col("node").alias("a"), F.col("items").alias("left_items"))
    right = items.select(F.col("node").alias("b"), F.col("items").alias("right_items"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left_items", "right_items").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the least node of each connected component, by hooking and pointer jumping."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("b_label")), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("b_label").alias("near"))
        hooked = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut(hooked.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        done = new.where("label < old").isEmpty()
        spent(labels)
        labels = new
        if done:
            spent(both)
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``edges`` (a, b) have joined classes; only the classes that an edge touches are worked on."""
    if edges.isEmpty():
        return labels
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    between = edges.join(of("a"), "a").join(of("b"), "b").where("a_label != b_label")
    found = components(between.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    new = found.select(F.col("node").alias("label"), F.col("label").alias("new"))
    out = cut(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")))
    spent(labels, found)
    return out


def shared_buckets(places: DataFrame) -> DataFrame:
    """The rows of ``places`` (bucket, node) whose bucket has several, with the number ``n`` and the least node of them."""
    several = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    return cut(places.join(several, "bucket").select("bucket", "node", "n", "leader"))


def unsettled(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``open_`` in buckets with several classes, with their label and the commonest label of the bucket, ``top``."""
    told = open_.select("bucket", "node", "n", "leader").join(labels, "node")
    per = told.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    per = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("size", "label")).alias("most")).where("classes > 1")
    return cut(told.join(per.select("bucket", F.col("most.label").alias("top")), "bucket").select("bucket", "node", "n", "leader", "label", "top"))


def across(open_: DataFrame, alike=None) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket and have different labels, if ``alike`` holds of columns a_marks and b_marks."""
    marks = [c for c in ("marks",) if alike is not None]
    left = open_.where("label != top").select("bucket", F.col("node").alias("x"), F.col("label").alias("x_label"), *[F.col(c).alias("a_marks") for c in marks])
    right = open_.select("bucket", F.col("node").alias("y"), F.col("label").alias("y_label"), "top", *[F.col(c).alias("b_marks") for c in marks])
    once = (F.col("y_label") == F.col("top")) | (F.col("x") < F.col("y"))
    met = (F.col("x_label") != F.col("y_label")) & once & (alike(F.col("a_marks"), F.col("b_marks")) if alike is not None else F.lit(True))
    both = left.join(right, (left["bucket"] == right["bucket"]) & met)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def fine_sketches(items: DataFrame) -> DataFrame:
    """node, marks (a bit of each of FINE registers, as longs) and keys (of FINE_BANDS bands) of the texts of ``items``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chosen = np.argsort(np.random.default_rng(FINE_BANDS).random((FINE_BANDS, FINE)), axis=1)[:, :FINE_ROWS]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part, n = [], 0
                while at + len(part) < batch.num_rows and n < 1 << 17:
                    hashes, counts = np.unique(np.frombuffer(batch.column(1)[at + len(part)].as_py(), "<u4"), return_counts=True)
                    part.append((mix(hashes.astype(np.uint64) + np.uint64(FINE)), counts))
                    n += len(hashes)
                winners = prob_minhash(part, FINE)
                bits = np.packbits((winners & np.uint64(1)).astype(bool), axis=1)
                keys = np.tile(np.arange(FINE_BANDS, dtype=np.uint64), (len(part), 1))
                for r in range(FINE_ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + winners[:, chosen[:, r]])
                offsets = lambda width: pa.array(np.arange(0, width * len(part) + 1, width, dtype=np.int32))
                marks = pa.ListArray.from_arrays(offsets(FINE // 64), pa.array(bits.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), marks, pa.ListArray.from_arrays(offsets(FINE_BANDS), pa.array(keys.view(np.int64).ravel()))], ["node", "marks", "keys"])
                at += len(part)

    return items.select("node", "items").mapInArrow(run, "node long, marks array<long>, keys array<long>")


def alike(threshold: float):
    """Whether marks differ no more often than those of a pair at ``threshold``, give or take three standard deviations."""
    p = (1 - threshold) / 2
    most = int(FINE * p + 3 * (FINE * p * (1 - p)) ** 0.5)

    def test(a, b):
        return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(FINE // 64)), F.lit(0)) <= most

    return test


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, class_size, n_links and kept.

    Texts are in one class if a chain of pairs of ``threshold`` or more joins them. ``class_id`` is the smallest doc_id of the class, and
    that row is kept (of several rows with that doc_id, or where all are null, one). Null texts count as empty; all texts without words
    are one class. ``n_links`` is the number of verified pairs through which a text was joined, of distinct texts. Repeated rows are one
    class. Very long texts are compared by all their shingles. An empty table gives an empty result; other columns are not read.
    """
    made = cut(sketches(docs, bands, rows))
    thin = cut(made.select("node", "doc_id", "key"))
    first = cut(thin.groupBy("key").agg(F.min("node").alias("node")))
    places = cut(made.join(first.select("node"), "node", "left_semi").select(F.explode("keys").alias("bucket"), "node"))
    open_ = shared_buckets(places)
    spent(places)
    items = cut(made.select("node", "items").join(open_.select("node").distinct(), "node", "left_semi"))
    spent(made)
    labels = cut(items.select("node", F.col("node").alias("label")))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct())
        good = cut(verified(pairs, items, threshold))
        spent(pairs)
        return good

    with_leader = lambda rows: rows.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    found = [linked(with_leader(open_))]
    labels = joined(labels, found[-1])
    mixed = unsettled(open_, labels)
    spent(open_)
    crowd = mixed.where(F.col("n") > SMALL).select("node").distinct()
    sketched = cut(fine_sketches(items.join(crowd, "node", "left_semi")))
    places = cut(sketched.select(F.explode("keys").alias("bucket"), "node"))
    fine = shared_buckets(places)
    spent(places)
    met = unsettled(fine, labels)
    found.append(linked(across(mixed.where(F.col("n") <= SMALL)).union(with_leader(met))))
    labels = joined(labels, found[-1])
    spent(mixed, met)
    left = unsettled(fine, labels)
    marked = left.join(sketched.select("node", "marks"), "node")
    found.append(linked(across(marked, alike(threshold))))
    labels = joined(labels, found[-1])
    spent(fine, left, sketched, items)
    edges = found[0].union(found[1]).union(found[2]).distinct()
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    of_rep = first.join(labels, "node", "left").join(links, "node", "left")
    of_rep = of_rep.select("key", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = cut(thin.join(of_rep, "key").drop("key"))
    spent(thin, first, labels, *found)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("node"))
    sizes = out.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"), F.min(order).alias("best"))
    sizes = sizes.select("label", "class_size", F.col("best.doc_id").alias("class_id"), F.col("best.node").alias("best"))
    return out.join(sizes, "label").select("doc_id", "class_id", "class_size", "n_links", (F.col("node") == F.col("best")).alias("kept"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near duplicates (see classes), with all its columns; of rows that share a doc_id, too, each by its text.

    Columns may have any names. An empty table stays empty.
    """
    name, key = fresh(docs.columns, "row", "kept_id")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = classes(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias(key))
        return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    numbered = cut(docs.withColumn(name, F.monotonically_increasing_id()))  # rows need names of their own
    named = numbered.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(name).alias("row")).alias("doc_id"), "text")
    kept = classes(named).where("kept").select(F.col("doc_id.row").alias(name))
    return numbered.join(kept, name, "left_semi").drop(name)
