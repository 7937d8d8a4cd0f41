"""Document fingerprints by closed syncmers over words (native: DataFrame functions only).

A k-mer is k words in a row, an s-mer s words in a row. A k-mer is chosen if the smallest of its s-mer hashes is its first or its last.
That depends on the k-mer alone, so an edit changes no choice away from it, and no stretch of k-s k-mers goes without one. Each text is
read with k-1 blank words before and after it, so texts of any length have k-mers, and one rule holds for all: a text of n words has
n+k-1 of them, and one of them is chosen at least. The chosen k-mers' hashes, as a sorted set, are the fingerprint; two fingerprints are as
alike as their sets (Jaccard). Anchors, a k-mer with its place, tell how much of two texts stands at the same place in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import documents, text_or_empty

K, S = 7, 2
#: fixed values: blocks of scripts written without blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han), and all from the first on
UNSPACED = "[\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{2FA1F}]"
BEYOND = "[\\u0E00-\\x{10FFFF}]"
#: Buckets of neighbouring ids: about so many rows each, at most so many buckets (what the driver and each row's lookup hold).
BUCKET_ROWS, MOST_BUCKETS, STEP = 64, 4096, 64


def bound(value: Column, use) -> Column:
    """``use(value)``, computing ``value`` once however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words between white space; of scripts that set none, each character is a word."""
    plain = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    return F.when(text.rlike(BEYOND) & text.rlike(UNSPACED), F.regexp_extract_all(text, F.lit(f"{UNSPACED}|(?:(?!{UNSPACED})\\S)+"), F.lit(0))).otherwise(plain)


def smers(ws: Column) -> Column:
    """Hashes of the S-word stretches."""
    return F.transform(F.sequence(F.lit(0), F.size(ws) - S), lambda i: F.xxhash64(*[ws[i + j] for j in range(S)]))


def is_closed(h: Column, i: Column) -> Column:
    """Whether the k-mer at ``i`` has its smallest s-mer at an edge."""
    last = K - S
    return F.least(*[h[i + j] for j in range(last + 1)]) == F.least(h[i], h[i + last])


def syncmers(text: Column) -> Column:
    """Array of (position in words, hash) of the closed syncmers; ``at`` is the place of the k-mer's first word, negative in the blanks.

    Only a text without words has none.
    """
    last, blanks = K - S, F.array_repeat(F.lit(""), K - 1)

    def of_smers(h):
        chosen = F.filter(F.sequence(F.lit(0), F.size(h) - last - 1), lambda i: is_closed(h, i))
        return F.transform(chosen, lambda i: F.struct((i - (K - 1)).alias("at"), F.hash(*[h[i + j] for j in [*range(0, last, S), last]]).alias("hash")))

    def of_words(ws):
        return F.when(F.size(ws) > 2 * (K - 1), bound(smers(ws), of_smers)).otherwise(F.array().cast("array<struct<at:int,hash:int>>"))

    return bound(F.concat(blanks, words(text), blanks), of_words)


def fingerprint(text: Column) -> Column:
    """The sorted set of the syncmers' hashes."""
    return hashes(syncmers(text))


def hashes(found: Column) -> Column:
    """The sorted set of the hashes of syncmers."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x["hash"])))


def anchors(found: Column) -> Column:
    """Place and hash of each of the syncmers, as one number."""
    return F.transform(found, lambda x: F.shiftleft(x["at"].cast("long"), 32) + x["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints, or of two sets of anchors; 1 if both are empty, which only those of texts without words are."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common).cast("double"))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are not above ``key``, found in two steps; -1 for a null."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    coarse, fine = F.array(*map(F.lit, bounds[::STEP])), F.array(*map(F.lit, bounds))
    low = F.size(F.filter(coarse, lambda b: b <= key))
    within = F.when(low == 0, 0).otherwise((low - 1) * STEP + F.size(F.filter(F.slice(fine, F.greatest(low - 1, F.lit(0)) * STEP + 1, STEP), lambda b: b <= key)))
    return F.when(key.isNull(), -1).otherwise(within)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<c>`` of the following row by ascending doc_id (null first, ties by the text's hash); after the last comes the first.

    Rows are dealt to buckets of neighbouring ids. A copy of each bucket's first row also goes to the bucket before, so every row's
    successor is beside it, and nothing is ordered in one task.
    """
    ids = rows.select("doc_id")
    n = ids.count()
    parts = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    bounds: list[int] = []
    if parts > 1:
        if isinstance(ids.schema["doc_id"].dataType, NumericType):
            got = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("b")).first()["b"]
        else:  # quantiles of a sample of some 20 ids a bucket
            some = ids.where((F.pmod(F.xxhash64(F.lit("bounds"), "doc_id"), F.lit(n)) < 20 * parts) & F.col("doc_id").isNotNull())
            listed = sorted(r["doc_id"] for r in some.collect())
            got = [listed[i * len(listed) // parts] for i in range(1, parts)] if listed else []
        bounds = sorted(set(got or []))
    keyed = rows.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    firsts = sorted((r["bucket"], r["first"]) for r in keyed.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())  # a row a bucket
    before = [(b, f, firsts[i - 1][0]) for i, (b, f) in enumerate(firsts)]
    copies = rows.sparkSession.createDataFrame(before, f"c_bucket int, c_first {ids.schema['doc_id'].dataType.simpleString()}, c_to int")
    joined = keyed.join(F.broadcast(copies), (F.col("bucket") == F.col("c_bucket")) & F.col("doc_id").eqNullSafe(F.col("c_first")), "left")
    here = F.struct(F.col("bucket"), F.lit(False).alias("copy"))
    there = F.struct(F.col("c_to").alias("bucket"), F.lit(True).alias("copy"))
    spread = joined.withColumn("place", F.explode(F.when(F.col("c_to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    order = Window.partitionBy("place.bucket").orderBy("place.copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    out = spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return out.where(~F.col("place.copy")).drop("bucket", "place", "c_bucket", "c_first", "c_to")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of its edited text, whose last half is the beginning of the next row's text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and placed_edited: how alike the
    text and the edited text are if a k-mer counts only at its place. Null texts count as empty and have an empty fingerprint; very long
    ones are marked whole. Ids of any ordered type will do; with one row, it is its own next. An empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("found", syncmers(F.col("text")))
    rows = rows.select("doc_id", "text", hashes(F.col("found")).alias("marks"), anchors(F.col("found")).alias("anchors"))
    near = with_next(rows, ["text", "marks"]).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = near.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars") - half), F.col("next_text").substr(F.lit(1), half)))
    found = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "marks", "anchors", "next_marks", syncmers(F.col("edited")).alias("found"))
    marked = found.withColumns({"edited_marks": hashes(F.col("found")), "edited_anchors": anchors(F.col("found"))})
    return marked.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        F.array_join("marks", " ").alias("fingerprint"),
        F.array_join("edited_marks", " ").alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("placed_edited"),
    )


def op4_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))
