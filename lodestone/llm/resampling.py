"""Resampling of documents towards a target distribution, by importance weights of hashed word runs.

Documents and target texts are bags of hashed features: runs of 1 to n consecutive words. A bucket's gain is the logarithm of how much
commoner it is in the target; a document's weight is the sum over its features. Gumbel noise is added and the highest scores are drawn,
which is sampling without replacement in proportion to exp(weight).

Long texts are skewed work: they are split at word boundaries into chunks, each with the first n - 1 words of what follows, and dealt out
anew. A chunk owns the features that begin in its own words, so no run is lost or counted twice at a cut. Counts and weights of chunks are
summed by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, spent, text_or_empty

#: Words in a run, at most; buckets (what the driver and each task hold a number of); words of a document that can be drawn; percent drawn.
ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Characters of a chunk, before the rest of its last word.
CHUNK = 1 << 16
#: What words are made of, before A-Z become lower case.
IN_WORD = "A-Z0-9a-z\\x{80}-\\x{10FFFF}"
#: Bytes as the words have them: lower case, and blanks for all that stands between.
FOLDED = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Words whose hashes a task remembers.
REMEMBER = 400_000


def chunks(docs: DataFrame, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, text (of a chunk) and carry (the ``order`` - 1 words after it) of all texts; the rows of ``docs`` need a column row.

    Texts up to ``chunk`` characters stay where they are; the chunks of longer ones are dealt to all tasks.
    """
    base = docs.select("row", "doc_id", text_or_empty().alias("text"))
    short = base.where(F.length("text") <= chunk).select("row", "doc_id", "text", F.lit("").alias("carry"))
    pattern = f"(?s)(.{{1,{chunk}}}[{IN_WORD}]*+)" + (f"(?=((?:[^{IN_WORD}]*+[{IN_WORD}]++){{0,{order - 1}}}))" if order > 1 else "()")
    part = lambda group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    cut_up = base.where(F.length("text") > chunk).select("row", "doc_id", F.posexplode(F.arrays_zip(part(1).alias("text"), part(2).alias("carry"))).alias("nth", "x"))
    dealt = cut_up.select("row", "doc_id", "nth", "x.text", "x.carry").repartition(F.col("row"), F.col("nth"))
    return short.unionByName(dealt.select("row", "doc_id", "text", "carry"))


class Buckets:
    """The buckets of a text's features; the hashes of words are remembered within a task."""

    def __init__(self, order: int, buckets: int):
        self.order, self.buckets, self.known = order, buckets, {}

    def of_words(self, words: list[bytes]) -> np.ndarray:
        known, n = self.known, self.buckets
        if len(known) > REMEMBER:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = zlib.crc32(w) % n
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def __call__(self, text: str, carry: str) -> tuple[int, np.ndarray]:
        """Words of ``text``, and the bucket of each feature that begins in it and may end in ``carry``."""
        words = text.encode("utf-8", "surrogatepass").translate(FOLDED).split(b" ")
        own = [w for w in words if w]
        found = [self.of_words(own)]
        if self.order > 1:
            all_ = own + [w for w in carry.encode("utf-8", "surrogatepass").translate(FOLDED).split(b" ") if w]
            for n in range(2, self.order + 1):
                starts = min(len(own), max(0, len(all_) - n + 1))
                found.append(np.fromiter((zlib.crc32(b" ".join(all_[i : i + n])) % self.buckets for i in range(starts)), np.int64, starts))
        return len(own), np.concatenate(found)


def features(chunked: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features and the buckets of a chunk: ``at``, ascending, and ``times``, how often each."""
    kind = chunked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find = Buckets(order, buckets)
        for batch in batches:
            texts, carries, begin = batch.column(2), batch.column(3), 0
            for part in bounded_slices(texts):
                made = [find(t.as_py(), c.as_py()) for t, c in zip(texts.slice(begin, part), carries.slice(begin, part), strict=True)]
                sets = [np.unique(b, return_counts=True) for _, b in made]
                offsets = pa.array(np.append(0, np.cumsum([len(a) for a, _ in sets])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([s[i] for s in sets]).astype(np.int32))) for i in (0, 1)]
                counts = [pa.array([x for x, _ in made], pa.int64()), pa.array([len(b) for _, b in made], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, part), batch.column(1).slice(begin, part), *counts, *lists], ["row", "doc_id", "n_words", "n_features", "at", "times"])
                begin += part

    return chunked.select("row", "doc_id", "text", "carry").mapInArrow(run, f"row long, doc_id {kind}, n_words long, n_features long, at array<int>, times array<int>")


def bounded_slices(texts, most: int = 1 << 22) -> Iterator[int]:
    """Lengths of consecutive slices of an Arrow column of texts, of about ``most`` characters each."""
    from pyarrow import compute

    rows, chars = 0, 0
    for n in compute.utf8_length(texts).to_pylist():
        rows, chars = rows + 1, chars + n
        if chars >= most:
            yield rows
            rows, chars = 0, 0
    if rows:
        yield rows


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, summed task by task first; what reaches the driver is a number a bucket, however many rows there are."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(sums, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("at", "times").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, doc_id, n_words, n_features and weight of each document: its chunks' sums."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, times = batch.column(4), batch.column(5)
            each = np.append(0, np.cumsum(gain[at.flatten().to_numpy()] * times.flatten().to_numpy()))
            ends = np.append(0, np.cumsum(at.value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(each[ends[1:]] - each[ends[:-1]])], ["row", "doc_id", "n_words", "n_features", "weight"])

    columns = ["row", "doc_id", "n_words", "n_features", "at", "times"]
    per_chunk = found.select(*columns).mapInArrow(run, f"row long, doc_id {kind}, n_words long, n_features long, weight long")
    return per_chunk.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Adds rank, 1 for the first by ``order``: rows are range-partitioned, numbered part by part, and the parts' sizes are added up.

    What reaches the driver is a number a part. Rows that agree in all of ``order`` end up in one part.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, sum_ = [], 0
    for r in sizes:
        before.append((r["part"], sum_))
        sum_ += r["n"]
    told = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))  # a row a partition
    return placed.withColumn("part", part).join(told, "part", "left").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "place")


def resampled(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score and rank among those drawn (null: not drawn).

    ``percent`` of the documents of ``least_words`` words or more are drawn, by the highest scores (ties: smaller doc_id, null last, then
    any order). ``target`` has texts in a column text. Null and empty texts have no features and weight 0; repeated rows count as often as
    they occur, as do features. A null doc_id is hashed as an empty one. Very long texts are worked on in chunks. Empty tables give empty
    results; an empty target makes all buckets alike but for how common they are in ``docs``. Other columns are not read.
    """
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    found = cut(features(chunks(numbered, order, chunk), order, buckets))
    aims = target.select(F.lit(None).cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(chunks(aims, order, chunk), order, buckets), buckets))
    per_doc = weights(found, gain)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = cut(per_doc.withColumn("score", F.col("weight") + noise))
    spent(found)
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    placed = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 by its definition, over the bytes of each distinct word.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS b, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    m AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    dw AS (SELECT doc_id, unnest(ws) AS w FROM d), mw AS (SELECT unnest(ws) AS w FROM m),
    words AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || hex(encode(w))[2 * i + 1:2 * i + 2] AS BIGINT)) AS bytes FROM (SELECT w FROM dw UNION SELECT w FROM mw)),
    hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS b FROM words, crc),
    s AS (SELECT b, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM mw JOIN hashed USING (w) GROUP BY b),
    gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000.0::DOUBLE) / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
    per AS (SELECT doc_id, sum(g) AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (b) GROUP BY doc_id),
    scored AS (SELECT doc_id, len(ws) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS score FROM d LEFT JOIN per USING (doc_id)),
    fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS all_ FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r <= all_ * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN fit USING (doc_id)
"""
