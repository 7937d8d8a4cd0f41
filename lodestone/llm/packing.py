"""Best-fit-decreasing packing of token sequences.

Texts are tokenised where they lie. What a piece needs to be placed is its length alone, so the driver packs the histogram of lengths
(at most one row a length, however large the input): lengths descend, a segment tree over remaining capacities finds the tightest open
bins, and bins of one remaining capacity are handled as a run. The outcome is a table of runs; each piece finds its place in it by its
rank among the pieces of its length. Ranks come from counts of each task's pieces, without gathering pieces of a length in one task. If
rows have an order, ranks follow it and sequences are numbered by the earliest place in it, both by counts of its buckets.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, once, text_or_empty

CAPACITY, END = 4096, 1
#: Remembered words of a task, at most, and characters that it works on at once.
REMEMBER, AT_ONCE = 400_000, 1 << 22
#: Buckets of a given order: about so many pieces each, at most so many buckets (what the driver holds).
BUCKET_ROWS, MOST_BUCKETS = 64, 4096
#: Python's split() takes these for white space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: fixed values: in texts of these characters alone (basic Latin, Latin-1, common punctuation) the tokenizer's own pattern is PRETOKEN
OTHER = re.compile("[^\t-\r -~\x85\xa0-\xff\u2010-\u2027\u2030-\u205e\u20ac]|<\\|")
LETTER, DIGIT, BLANK = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{BLANK}{LETTER}{DIGIT}]+")


class WordIds:
    """Ids of whole texts by a lower-casing tokenizer whose tokens never cross white space, as little-endian 32-bit bytes.

    Plain texts are split by the tokenizer's pattern and each distinct pre-token is given to the tokenizer once; other texts are given to
    it word by word, or whole where Python and the tokenizer disagree on white space.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each further thread would keep memory of its own
        self.tokenizer, self.seen, self.remember = Tokenizer.from_file(path), {}, remember
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [PRETOKEN.findall(t.lower()) if not OTHER.search(t) else None if ODD_SPACE.search(t) else t.split() for t in texts]
        words = set().union(*(s for s in split if s))
        if len(self.seen) > self.remember:  # those that come again stay, and so do the common ones
            self.seen = {w: self.seen[w] for w in words & self.seen.keys()}
        seen = self.seen
        new = words - seen.keys()
        letters = [x for x in new if x.isalpha() and x.islower() and max(x) <= "ÿ"]
        seen.update(zip(letters, self._letters(letters), strict=True))
        rest = [x for x in new if x not in seen]
        seen.update(zip(rest, self._words(rest), strict=True))
        return [self._encode([t])[0] if s is None else b"".join(map(seen.__getitem__, s)) for t, s in zip(texts, split, strict=True)]

    def _letters(self, new: list[str]) -> list[bytes]:
        """Runs of letters, each of which is one pre-token: an id that ends a word ends one of them."""
        if not new:
            return []
        out: list[bytes] = []
        for at in range(0, len(new), 4096):
            ids = np.frombuffer(self._encode([" ".join(new[at : at + 4096])])[0], dtype="<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            blob = ids.tobytes()
            out += [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _words(self, new: list[str]) -> list[bytes]:
        """Many words at once, as one text: offsets tell where each word's tokens begin."""
        out: list[bytes] = []
        for at in range(0, len(new), 512):
            part = new[at : at + 512]
            lengths = np.array([len(w) + 1 for w in part])
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            first = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e.offsets))
            ids, word = np.array(e.ids, dtype="<u4"), np.searchsorted(np.cumsum(lengths), first, side="right")
            ends = np.searchsorted(word, np.arange(len(part) + 1))
            out += [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over ``counts`` pieces of each length: runs (length, first rank, first bin, pieces a bin, offset in the bin).

    In a run, piece ``first rank + i`` goes to bin ``first bin + i // per`` at ``offset + (i % per) * length``.
    """
    size = 1
    while size <= capacity:
        size *= 2
    tree = [False] * (2 * size)
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(r: int, run: tuple[int, int]) -> None:
        if r:
            open_bins[r].append(run)
            i = r + size
            while i and not tree[i]:
                tree[i] = True
                i //= 2

    def take(r: int) -> tuple[int, int]:
        run = open_bins[r].pop()
        if not open_bins[r]:
            i = r + size
            tree[i] = False
            i //= 2
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = False
                i //= 2
        return run

    def tightest(least: int) -> int:
        """The smallest remaining capacity of ``least`` or more that an open bin has; 0 if none."""
        i = least + size
        if tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - size
            i //= 2
        return 0

    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tightest(length)
            per = (r or capacity) // length
            if r:
                first, n = take(r)
                full = min(n, left // per)
                if full < n and (rest := n - max(full, 1)):
                    put(r, (first + max(full, 1), rest))
            else:
                r, first, full = capacity, bins, left // per
                bins += max(full, 1)
            placed, used = (full * per, full) if full else (left, 1)
            each = per if full else left
            runs.append((length, rank, first, each, capacity - r))
            put(r - each * length, (first, used))
            left -= placed
            rank += placed
    columns = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "per", "offset"), columns, strict=True))


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool, order: str | None = None, remember: int = REMEMBER, at_once: int = AT_ONCE) -> DataFrame:
    """The pieces of each text, with the task that made them and the rank of each among the task's pieces of its length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, shard int, nth long" + ", ids binary" * with_ids + f", {order} long" * bool(order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import public_tokenizers
        from pyspark import TaskContext

        made, shard = np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        path, last = public_tokenizers.path(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        words = once(f"words {path} {remember}", lambda: WordIds(path, remember))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                part, chars = [], 0
                while at + len(part) < batch.num_rows and chars < at_once:
                    part.append(texts[at + len(part)].as_py())
                    chars += len(part[-1])
                which, rows, blobs = [], [], []
                for i, ids in enumerate(words.ids(part)):
                    ids += last
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        blob = ids[4 * start : 4 * (start + capacity)]
                        n = len(blob) // 4
                        which.append(at + i)
                        rows.append((k, start, n, zlib.crc32(blob), shard, made[n]))
                        made[n] += 1
                        if with_ids:
                            blobs.append(blob)
                at += len(part)
                columns = np.array(rows, dtype=np.int64).T
                arrays = [keys.take(pa.array(which, pa.int64())), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:4]), pa.array(columns[4].astype(np.int32)), pa.array(columns[5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "nth"] + ["ids"] * with_ids
                if order:
                    names.append(order)
                places = [batch.column(2).take(pa.array(which, pa.int64()))] if order else []
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(blobs, pa.binary())] * with_ids + places, names)

    return docs.select("doc_id", text_or_empty().alias("text"), *[order] * bool(order)).mapInArrow(run, schema)


def in_buckets(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Adds column ``name``: the bucket of each row by ascending ``order``, whole numbers from 0."""
    n, top = rows.agg(F.count(F.lit(1)), F.max(order)).first()
    width = (top or 0) // min(MOST_BUCKETS, max(1, n // BUCKET_ROWS)) + 1
    return rows.withColumn(name, F.floor(F.col(order) / width).cast("long"))


def numbered(packed: DataFrame, order: str) -> DataFrame:
    """``packed`` with its sequences numbered anew, by the least ``order`` in each."""
    firsts = cut(packed.groupBy("sequence_id").agg(F.min(order).alias("first")))
    firsts = in_buckets(firsts, "first", "bucket")
    sizes = sorted(map(tuple, firsts.groupBy("bucket").count().collect()))  # a row a bucket
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    bases = packed.sparkSession.createDataFrame([(b, n) for (b, _), n in zip(sizes, before[:-1], strict=True)], "bucket long, base long")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("first", "sequence_id")) - 1
    new = firsts.withColumn("rank", rank).join(F.broadcast(bases), "bucket").select("sequence_id", (F.col("base") + F.col("rank")).alias("new_id"))
    return packed.join(new, "sequence_id").withColumn("sequence_id", F.col("new_id"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END, with_ids: bool = False, order: str | None = None, remember: int = REMEMBER, at_once: int = AT_ONCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, the piece's ids as 32-bit bytes).

    A text's ids are the tokenizer's, without special tokens added, then ``end_id``; null and empty texts are that id alone. Only longer
    ones are cut, every ``capacity`` ids. Sequences are filled without gaps from offset 0. Rows are neither merged nor dropped (repeated
    doc_ids give their own pieces); an empty table gives an empty result; other columns are not read. With ``order``, a column of whole
    numbers from 0, pieces of one length are dealt out in that order and sequences are numbered by the earliest place of their pieces.
    ``remember`` bounds the words whose ids a task remembers, ``at_once`` the characters it works on; the result depends on neither.
    """
    spark = docs.sparkSession
    made = cut(pieces_of(docs, tokenizer, capacity, end_id, with_ids, order, remember, at_once))
    if order:
        by_order = Window.partitionBy("shard", "length").orderBy(order, "doc_id", "piece", "ids_crc32")
        made = in_buckets(made, order, "shard").withColumn("nth", (F.row_number().over(by_order) - 1).cast("long"))
    by_shard = made.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = by_shard.select("shard", "length", F.coalesce(before, F.lit(0)).alias("base"))
    import pandas as pd

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, n = plan.value, length.to_numpy(np.int64)
        runs = p["length"] << 44 | p["rank"]
        at = np.searchsorted(runs, n << 44 | rank.to_numpy(np.int64), side="right") - 1
        i = rank.to_numpy(np.int64) - p["rank"][at]
        return pd.DataFrame({"sequence_id": p["bin"][at] + i // p["per"][at], "offset": p["offset"][at] + i % p["per"][at] * n})

    place.__annotations__ = {"length": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    where = F.pandas_udf(place, "sequence_id long, offset long")
    ranked = made.join(base, ["shard", "length"]).withColumn("place", where(F.col("length"), F.col("base") + F.col("nth")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    packed = ranked.select(*columns[:5], "place.sequence_id", "place.offset", *columns[7:], *[order] * bool(order))
    return numbered(cut(packed), order).select(*columns) if order else packed


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), "word_bpe_49k.json")
