"""Removal of repeated passages by sparse, distributed prefix doubling.

A position stands for the string that starts there; in each round Spark groups the ranks of longer strings, and positions whose string is
unique leave. Three things keep the rows few. Positions are anchors at first, which the surrounding bytes pick by a local minimum, so that
equal strings have equal anchors: every window of LENGTH bytes belongs to the first anchor in it. A round ranks two strings for each
position: the one that all its windows hold, whose being unique settles that none repeats, and the one that holds all its windows, whose
repeating settles that all do. Only positions that neither settles go on to the next round, as smaller blocks of windows, and in the last
one as single windows; of strings that repeat one copy goes with them, so that every window still meets all others like it.

Ranks are fingerprints of 128 bits where they decide on removal and of 64 bits where they only spare work, so no round needs one total
order; which of them occur twice is found by a distributed aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import INVERSE, ODD, cut, documents, mix, spent, text_or_empty

LENGTH = 200
#: Bytes of a gram; grams in a row of which an anchor is the least (a power of two); windows of a block.
GRAM, SPAN, BLOCK = 16, 128, 8
#: Bytes of texts that are worked on at once, at least one text.
AT_ONCE = 1 << 18
OTHER = 0xC2B2AE3D27D4EB4F
OTHER_INVERSE = pow(OTHER, -1, 1 << 64)


class Powers:
    """Powers of some bases modulo 2**64, made as far as they are asked for."""

    def __init__(self):
        self.known: dict[int, np.ndarray] = {}

    def __call__(self, base: int, n: int) -> np.ndarray:
        if len(self.known.get(base, ())) < n:
            out = np.full(max(n, AT_ONCE * 2), base, dtype=np.uint64)
            out[0] = 1
            self.known[base] = np.multiply.accumulate(out)
        return self.known[base][:n]


class Prints:
    """Fingerprints of the strings in ``data``, of GRAM bytes or more, from sums over its grams."""

    def __init__(self, data: np.ndarray, powers: Powers):
        n = max(0, len(data) - GRAM + 1)
        words = np.ndarray((n + 8,), "<u8", buffer=data, strides=(1,)) if n else np.zeros(8, np.uint64)
        x, y = words[:n] * np.uint64(ODD), words[8 : n + 8] * np.uint64(OTHER)
        y ^= y >> np.uint64(29)
        x ^= y * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        self.grams = x ^ (x >> np.uint64(31))
        self.powers, self.sums = powers, {}

    def _sum(self, base: int) -> np.ndarray:
        if base not in self.sums:
            g = self.grams if base == ODD else (self.grams ^ np.uint64(INVERSE)) * (self.grams | np.uint64(1))
            self.sums[base] = np.append(np.uint64(0), np.cumsum(g * self.powers(base, len(g))))
        return self.sums[base]

    def of(self, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
        """The first or second 64 bits of the strings from ``starts`` to ``ends``."""
        base, inverse = (OTHER, OTHER_INVERSE) if second else (ODD, INVERSE)
        total = self._sum(base)
        found = (total[ends - GRAM + 1] - total[starts]) * self.powers(inverse, len(total))[starts]
        return mix(found + (ends - starts).astype(np.uint64)).view(np.int64)


def extreme(h: np.ndarray, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of the SPAN values from each place on."""
    step = 1
    while step < SPAN:
        h = pick(h[:-step], h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def anchors(prints: Prints, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in the texts from ``starts`` to ``ends``: text, place, and the first and last start of the windows that belong to it.

    A window belongs to the leftmost least of its first SPAN grams; the windows of an anchor start in a row.
    """
    top = np.maximum(prints.grams >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    least = extreme(top, np.minimum)
    if not len(least):
        return (np.zeros(0, np.int64),) * 4
    edge = np.zeros(len(least) + 1, np.int32)
    full = ends - starts >= length
    np.add.at(edge, starts[full], 1)
    np.add.at(edge, ends[full] - length + 1, -1)
    least[np.cumsum(edge[:-1]) == 0] = 0
    pad = np.zeros(SPAN - 1, np.uint32)
    at = np.flatnonzero(extreme(np.concatenate([pad, least, pad]), np.maximum) == top)
    text = np.searchsorted(starts, at, side="right") - 1
    while True:
        value = top[at]
        new = np.append(True, text[1:] != text[:-1]) if len(at) else np.zeros(0, bool)
        before = np.append(0, at[:-1])[: len(at)]
        low = np.where(new, starts[text], np.where(value < np.append(0, value[:-1])[: len(at)], at - SPAN + 1, before + 1))
        high = np.minimum(np.minimum(at, ends[text] - length), np.where(np.append(new[1:], True)[: len(at)], ends[text], np.append(low[1:], 0)[: len(at)] - 1))
        owns = low <= high
        if owns.all():
            return text, at, low, high
        text, at = text[owns], at[owns]  # of equal grams, one that is never the leftmost


def parts_of(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row, bytes and offsets of consecutive parts of an Arrow column of strings, of AT_ONCE bytes or one row more."""
    import pyarrow as pa

    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE)))
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def numbered(docs: DataFrame) -> DataFrame:
    """node, doc_id and text; node is doc_id where that tells rows apart, and else a number written with the row."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
        if counts.isEmpty():
            return texts.select(F.col("doc_id").cast("long").alias("node"), "doc_id", "text")
    return cut(texts.select(F.monotonically_increasing_id().alias("node"), "doc_id", "text"))


RANKED = "node long, low int, high int, at int, held long, whole long, check long"


def ranked(rows, nodes: np.ndarray, prints: Prints, begin: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, inner: tuple[np.ndarray, np.ndarray], length: int):
    """A batch of RANKED: for each group of windows that start from ``low`` to ``high``, the ranks of what all of them hold (at ``inner``)
    and of what holds all of them. ``begin`` is where each group's text begins; places are told from there."""
    import pyarrow as pa

    shape = ((at - low) * SPAN + (at - high)).astype(np.uint64)  # where the windows lie about their anchor
    whole, check = (mix(prints.of(low, high + length, second).view(np.uint64) ^ shape).view(np.int64) for second in (False, True))
    columns = [nodes, (low - begin).astype(np.int32), (high - begin).astype(np.int32), (at - begin).astype(np.int32), prints.of(*inner), whole, check]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "low", "high", "at", "held", "whole", "check"])


def anchor_ranks(texts: DataFrame, length: int) -> DataFrame:
    """A row of RANKED for each anchor, with all its windows."""

    def run(batches: Iterator) -> Iterator:
        powers = Powers()
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for first, _, data, offsets in parts_of(batch.column(1)):
                prints, starts = Prints(data, powers), offsets[:-1]
                text, at, low, high = anchors(prints, starts, offsets[1:], length)
                if len(at):
                    yield ranked(batch, nodes[first + text], prints, starts[text], at, low, high, (at, at + length - SPAN + 1), length)

    return texts.select("node", "text").mapInArrow(run, RANKED)


def listed(asked: DataFrame) -> DataFrame:
    return asked.groupBy("node").agg(F.collect_list(F.struct("low", "high", "at")).alias("asked"))


def groups_of(batch, powers: Powers) -> Iterator[tuple[np.ndarray, Prints, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows node, text, asked: node, fingerprints, begin of the text, anchor, low and high of all that is asked, in the part's places."""
    nodes = batch.column(0).to_numpy()
    for first, last, data, offsets in parts_of(batch.column(1)):
        lists = batch.column(2).slice(first, last - first)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        low, high, at = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        begin = np.repeat(offsets[:-1], sizes)
        yield np.repeat(nodes[first:last], sizes), Prints(data, powers), begin, at + begin, low + begin, high + begin


def block_ranks(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """A row of RANKED for each block of BLOCK windows (fewer at the ends) of the anchors in ``asked``."""

    def run(batches: Iterator) -> Iterator:
        powers = Powers()
        for batch in batches:
            for nodes, prints, begin, at, low, high in groups_of(batch, powers):
                first, last = (at - high) // BLOCK, (at - low) // BLOCK
                n = last - first + 1
                of = np.repeat(np.arange(len(at)), n)
                block = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                near = at[of] - BLOCK * block  # the last start that the grid gives the block
                inner = (near, near - BLOCK + 1 + length)
                yield ranked(batch, nodes[of], prints, begin[of], at[of], np.maximum(low[of], near - BLOCK + 1), np.minimum(high[of], near), inner, length)

    return texts.join(listed(asked), "node").select("node", "text", "asked").mapInArrow(run, RANKED)


def window_ranks(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """node, low, whole and check of every single window of the blocks in ``asked``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            for nodes, prints, begin, _, low, high in groups_of(batch, powers):
                n = high - low + 1
                of = np.repeat(np.arange(len(low)), n)
                p = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                columns = [nodes[of], (p - begin[of]).astype(np.int32), prints.of(p, p + length), prints.of(p, p + length, True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "low", "whole", "check"])

    return texts.join(listed(asked), "node").select("node", "text", "asked").mapInArrow(run, "node long, low int, whole long, check long")


def twice(rows: DataFrame, *rank: str, more: list[Column] | None = None) -> DataFrame:
    """The ranks that more than one row has, written, so that a join with them can split a rank that many rows have."""
    return cut(rows.groupBy(*rank).agg(F.count(F.lit(1)).alias("n"), *more or []).where("n > 1").drop("n"))


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Of ``rows`` (RANKED): the groups whose windows all repeat (node, low, high), and those that are still open, with one copy of each
    repeating one that could meet these (node, low, high, at); and the tables that both stand on."""
    made = cut(rows)
    held = twice(made, "held")
    some = cut(made.join(held, "held", "left_semi"))
    spent(made, held)
    again = twice(some, "whole", "check", more=[F.min(F.struct("node", "low")).alias("first")])
    told = some.join(again, ["whole", "check"], "left")
    told = told.select("node", "low", "high", "at", "held", F.col("first").isNotNull().alias("repeats"), (F.col("first") == F.struct("node", "low")).alias("shown"))
    told = cut(told)
    spent(some, again)
    open_ = cut(told.where(~F.col("repeats")).select("held").distinct())
    asked = told.where("NOT repeats OR shown").join(open_, "held", "left_semi").select("node", "low", "high", "at")
    return told.where("repeats").select("node", "low", "high"), asked, [told, open_]


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept_sha256 (and kept, the remaining bytes).

    Each UTF-8 byte that a string of ``length`` bytes covers which starts anywhere else too is removed, wherever it stands; repeats may
    overlap and may lie in one text, and never cross texts. Null texts count as empty; very long ones are worked on whole, each in one
    piece. Repeated rows of ``length`` bytes or more lose all. An empty table gives an empty result; other columns are not read.
    """
    if length < SPAN + GRAM:
        raise ValueError(f"length must be {SPAN + GRAM} or more")
    texts = numbered(docs)
    by_anchor, asked, first = settled(anchor_ranks(texts, length))
    by_block, asked, second = settled(block_ranks(texts, asked, length))
    windows = cut(window_ranks(texts, asked, length))
    same = twice(windows, "whole", "check")
    by_window = windows.join(same, ["whole", "check"], "left_semi").select("node", "low", F.col("low").alias("high"))
    spans = cut(by_anchor.union(by_block).union(by_window).groupBy("node").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    spent(windows, same, *first, *second)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for first, last, data, offsets in parts_of(batch.column(1)):
                for i in range(first, last):
                    text, found = data[offsets[i - first] : offsets[i - first + 1]].tobytes(), batch.column(2)[i]
                    kept, runs = [text], 0
                    if found.is_valid:
                        low = found.values.field(0).to_numpy(zero_copy_only=False)
                        order = np.argsort(low, kind="stable")
                        low, end = low[order], np.maximum.accumulate(found.values.field(1).to_numpy(zero_copy_only=False)[order] + length)
                        begins = np.flatnonzero(np.append(True, low[1:] > end[:-1]))
                        runs = len(begins)
                        ends = end[np.append(begins[1:] - 1, len(end) - 1)].tolist()
                        kept = [text[a:b] for a, b in zip([0, *ends], [*low[begins].tolist(), len(text)], strict=True)]
                    rest = b"".join(kept)
                    out.append((len(text), len(text) - len(rest), runs, hashlib.sha256(rest).hexdigest(), *[rest] * with_text))
            columns = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]], names)

    rows = texts.join(spans, "node", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
