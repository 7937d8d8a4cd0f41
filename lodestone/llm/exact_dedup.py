"""Exact deduplication by content-defined chunk recipes (native: DataFrame functions only).

A text is cut into chunks where its own content says so, so a chunk does not depend on what stands far before it. Each distinct
chunk is moved once and gets an identifier that is verified against all contents with the same hash; texts are equal exactly if their
ordered lists of identifiers are equal, and only these short lists are shuffled and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, fresh, text_or_empty

#: A chunk ends after two letters of these kinds, once it has MIN_CHUNK characters, or at MAX_CHUNK characters.
MIN_CHUNK, MAX_CHUNK = 256, 4096
BOUNDARY = "[aeiouAEIOU0-9][lnrtLNRT.,]"


def normalised(text: Column) -> Column:
    """``text`` without the characters 0x20 and 0x09 to 0x0D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def chunks(norm: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """Content-defined chunks of a string, in order; their concatenation is the string."""
    return F.regexp_extract_all(norm, F.lit(f"(?s).{{{min_chunk},{max_chunk - 2}}}?{BOUNDARY}|.{{1,{max_chunk}}}"), F.lit(0))


def distinct_chunks(table: DataFrame, hash_bits: int = 64) -> DataFrame:
    """chunk and h of every distinct chunk of the array column ``chunks``, shuffled as a key that is compared in full."""
    return table.select(F.explode("chunks").alias("chunk")).select("chunk", chunk_hash(F.col("chunk"), hash_bits).alias("h")).distinct()


def clashing_hashes(table: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Hashes that several distinct chunks share (normally none). Every distinct chunk moves once, and then its hash alone."""
    return distinct_chunks(table, hash_bits).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def chunk_identifiers(table: DataFrame, clash: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Contents of the chunks whose hash is in ``clash``: ``chunk, h, ordinal``."""
    some = distinct_chunks(table, hash_bits).join(clash, "h", "left_semi")
    return some.groupBy("h").agg(F.sort_array(F.collect_list("chunk")).alias("all")).select("h", F.posexplode("all").alias("ordinal", "chunk"))


def chunk_hash(chunk: Column, hash_bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if hash_bits == 64 else F.shiftrightunsigned(h, 64 - hash_bits)


def recipes(docs: DataFrame, row: str, hash_bits: int = 64, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """Adds ``recipe``, the ordered identifiers of the chunks of column ``norm``. Equal recipes mean equal ``norm``.

    An identifier is the chunk's hash; only where two contents share a hash, an ordinal is put beside it (``row`` names a column that
    identifies rows for that repair).
    """
    cut_up = docs.withColumn("chunks", chunks(F.col("norm"), min_chunk, max_chunk))
    clash = cut(clashing_hashes(cut_up.select("chunks"), hash_bits))
    if clash.isEmpty():
        return cut_up.withColumn("recipe", F.transform("chunks", lambda c: chunk_hash(c, hash_bits))).drop("chunks")
    clashes = cut(chunk_identifiers(cut_up.select("chunks"), clash, hash_bits))
    cut_up = cut(docs).withColumn("chunks", chunks(F.col("norm"), min_chunk, max_chunk))  # the repair needs rows that keep their numbers
    pairs = cut_up.select(row, F.posexplode("chunks").alias("at", "chunk")).withColumn("h", chunk_hash(F.col("chunk"), hash_bits))
    fixed = (
        pairs.join(clashes, ["h", "chunk"], "left")
        .groupBy(row)
        .agg(F.sort_array(F.collect_list(F.struct("at", "h", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("list"))
        .select(row, F.flatten(F.transform("list", lambda x: F.array(x["h"], x["ordinal"].cast("long")))).alias("recipe"))
    )
    return cut_up.drop("chunks").join(fixed, row, "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<bigint>")))


def exact_groups(docs: DataFrame, hash_bits: int = 64, **sizes: int) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): its group of equal normalised texts.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, n_chars. The row with the most code points in the original text stays;
    among ties the smallest doc_id (a null doc_id comes last). Null texts count as empty, and all empty texts form one group. If a
    (doc_id, length) pair repeats within a group, exactly one of its rows is kept. An empty table gives an empty result; other columns
    of ``docs`` are not read.
    """
    base = docs.select("doc_id", text_or_empty().alias("text"))
    base = base.select("doc_id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    base = base.withColumn("row", F.monotonically_increasing_id())
    thin = cut(recipes(base, "row", hash_bits, **sizes).select("doc_id", "row", "n_chars", "recipe", F.unhex(F.sha2("norm", 256)).alias("sha")))
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    groups = thin.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")).where("group_size > 1")
    groups = groups.select("recipe", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.lit(True).alias("found"))
    out = thin.join(groups, "recipe", "left")
    return out.select(
        "doc_id",
        F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("found"), F.col("row") == F.col("keep_row")).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256, CAST(n_chars AS BIGINT) AS n_chars
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns: one of each group of equal normalised texts (see exact_groups).

    Of rows that agree in doc_id, length and normalised text, any one stays. Columns may have any names. An empty table stays empty.
    """
    chars, sha, k_id, k_chars, k_sha = fresh(docs.columns, "chars", "sha", "kept_id", "kept_chars", "kept_sha")
    kept = exact_groups(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias(k_id), F.col("n_chars").alias(k_chars), F.col("text_sha256").alias(k_sha))
    keyed = docs.withColumns({chars: F.length(text_or_empty()).cast("long"), sha: F.sha2(normalised(F.col("text")), 256)})
    rows = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(chars) == F.col(k_chars)) & (F.col(sha) == F.col(k_sha)), "left_semi")
    key = ["doc_id", chars, sha]
    if not keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # rows that agree in all that decides: any one of them stays
        rows = rows.dropDuplicates(key)
    return rows.drop(chars, sha)
