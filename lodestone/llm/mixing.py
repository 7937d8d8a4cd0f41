"""Mixing sources to target weights by Pfair scheduling (native: DataFrame functions only).

A source's rows, in a hashed order, fill blocks of equal text length. With weight w, its block i may not come before slot floor(i/w) and
must come before ceil((i+1)/w); earliest deadline first then keeps every source within one block of its share at every point. Weights are
whole slots of a frame, so the schedule repeats frame by frame. When a source runs out, at whatever slot of a frame, a phase ends: the
source is dropped and the next phase goes on with the target weights of the others, until all have run out. The driver schedules one
frame a phase, from the sources' block counts alone, and each block finds its slot from it. Running lengths come from sums of small
buckets, at two levels.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

BLOCK_CHARS, FRAME, TEMPERATURE = 16_384, 4096, 0.5
BUCKET_ROWS = 64
#: Slots of the scheduled frames of all phases, about: with more sources than MOST_SLOTS / FRAME, frames are shorter.
MOST_SLOTS = 1 << 20


def whole_slots(weights: dict[str, float], frame: int) -> dict[str, int]:
    """Slots of a frame for each source, at least one and ``frame`` in all, nearest to the weights (largest remainders)."""
    total = sum(weights.values())
    exact = {s: w / total * frame for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (slots[s] - exact[s], s))[: max(0, frame - sum(slots.values()))]:
        slots[s] += 1
    while (over := sum(slots.values()) - frame) > 0:
        s = max(slots, key=lambda s: (slots[s] - exact[s] if slots[s] > 1 else float("-inf"), s))
        slots[s] -= min(over, max(1, slots[s] // 2))
    return slots


def one_frame(slots: dict[str, int], ends: dict[str, int] | None = None) -> list[tuple[str, int, int, int, int]]:
    """(source, block in the frame, slot, release, deadline) by earliest deadline first among released blocks.

    The list stops after the first block that is its source's last by ``ends`` (source, block in the frame).
    """
    frame, ends = sum(slots.values()), ends or {}
    releases: dict[int, list[tuple[str, int]]] = {0: [(s, 0) for s in slots]}
    ready, out = [], []
    for slot in range(frame):
        for s, i in releases.pop(slot, ()):
            heapq.heappush(ready, (-(-(i + 1) * frame // slots[s]), s, i))
        deadline, s, i = heapq.heappop(ready)
        out.append((s, i, slot, i * frame // slots[s], deadline))
        if ends.get(s) == i:
            break
        if i + 1 < slots[s]:
            releases.setdefault(max(slot + 1, (i + 1) * frame // slots[s]), []).append((s, i + 1))
    return out


def phases(blocks: dict[str, int], target: dict[str, float], frame: int) -> tuple[list[tuple], list[tuple]]:
    """The schedule of ``blocks`` of each source: what each phase takes of each source, and the slots of one frame a phase.

    The first list has (phase, source, first block, first block after, slots of a frame, frame, first slot); the second has (phase,
    source, block in the frame, slot, release, deadline). A phase ends when one source has run out. Sources without a target weight
    follow when all others have run out, in proportion to their blocks.
    """
    parts, table = [], []
    done, begin, phase = dict.fromkeys(blocks, 0), 0, 0
    for weights in (target, {s: n for s, n in blocks.items() if s not in target}):
        active = {s: w for s, w in weights.items() if blocks[s] > 0}
        while active:
            phase += 1
            size = max(4 * len(active), min(frame, MOST_SLOTS // len(blocks)))
            slots = whole_slots(active, size)
            whole = min((blocks[s] - done[s] - 1) // q for s, q in slots.items())
            ends = {s: n % q for s, q in slots.items() if (n := blocks[s] - done[s] - 1) // q == whole}
            last = one_frame(slots, ends)
            table += [(phase, *x) for x in (one_frame(slots) if whole else last)]
            took = {s: whole * q for s, q in slots.items()}
            for s, *_ in last:
                took[s] += 1
            parts += [(phase, s, done[s], done[s] + n, slots[s], size, begin) for s, n in took.items() if n]
            done |= {s: done[s] + n for s, n in took.items()}
            begin += whole * size + len(last)
            active = {s: w for s, w in active.items() if done[s] < blocks[s]}
    return parts, table


#: What a schedule tells of a row.
PLACES = ["m_block", "m_phase", "m_release", "m_deadline", "m_slot", "m_offset"]


def keyed(docs: DataFrame, kept: list[str], bits: int) -> DataFrame:
    """``docs`` as one column ``row`` of the columns ``kept``, beside what the schedule needs; so no name of theirs can clash."""
    h = F.xxhash64(F.lit("mix"), "doc_id", "text")
    fine = F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"),
        docs["doc_id"].alias("m_id"),
        F.coalesce(docs["source"], F.lit("")).alias("m_source"),
        F.coalesce(F.length(docs["text"]), F.lit(0)).cast("long").alias("m_chars"),
        h.alias("m_hash"),
        fine.alias("m_fine"),
    )


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, frame: int = FRAME, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with m_block, m_phase, m_release, m_deadline, m_slot and m_offset: the mixed order is by (m_slot, m_offset).

    Every row stays, very long texts too (they begin in one block and reach into the next). In each phase the sources that are left keep
    to their target weights, within one block; it ends when one of them has run out. ``weights`` defaults to the sources' text lengths to
    the power ``temperature``; sources it does not name come after all others, in proportion to their lengths. A null source is the
    source "". Null texts have length 0. Rows that agree in id and text may swap places. An empty table gives an empty result. Columns may
    have any names but those added (ValueError).
    """
    if clash := sorted({c.lower() for c in docs.columns} & set(PLACES)):
        raise ValueError(f"columns {clash} would be added")
    return placed(docs, docs.columns, weights, block_chars, frame, temperature).select("row.*", *PLACES)


def placed(docs: DataFrame, kept: list[str], weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, frame: int = FRAME, temperature: float = TEMPERATURE) -> DataFrame:
    """The columns ``kept`` as a struct ``row``, m_chars, and the columns that schedule adds."""
    spark = docs.sparkSession
    bits = max(0, (docs.count() // BUCKET_ROWS).bit_length())
    rows = keyed(docs, kept, bits)
    coarse = F.shiftright("m_fine", bits // 2)
    sums = rows.groupBy("m_source", "m_fine").agg(F.sum("m_chars").alias("chars")).withColumn("coarse", coarse)
    upper = sums.groupBy("m_source", "coarse").agg(F.sum("chars").alias("chars"))
    totals = {r["m_source"]: r["chars"] for r in upper.groupBy("m_source").agg(F.sum("chars").alias("chars")).collect()}  # a row a source
    if not totals:
        return rows.select("row", "m_chars", *[F.lit(0).cast("long").alias(c) for c in PLACES])
    blocks = {s: max(1, -(-n // block_chars)) for s, n in totals.items()}
    target = {s: max(1, totals[s]) ** temperature for s in totals} if weights is None else {s: w for s, w in weights.items() if w > 0 and s in totals}
    parts, table = phases(blocks, target, frame)
    quota = spark.createDataFrame([(*x, blocks[x[1]] - 1) for x in parts], "m_phase long, m_source string, m_first long, m_until long, m_q long, m_size long, m_begin long, m_last long")
    slots = spark.createDataFrame(table, "m_phase long, m_source string, m_nth long, f_slot long, f_release long, f_deadline long")

    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    base_up = upper.select("m_source", "coarse", F.coalesce(F.sum("chars").over(ahead("m_source").orderBy("coarse")), zero).alias("up"))
    base = sums.select("m_source", "m_fine", "coarse", F.coalesce(F.sum("chars").over(ahead("m_source", "coarse").orderBy("m_fine")), zero).alias("base"))
    base = base.join(base_up, ["m_source", "coarse"]).select("m_source", "m_fine", (F.col("base") + F.col("up")).alias("m_base"))
    run = F.coalesce(F.sum("m_chars").over(ahead("m_source", "m_fine").orderBy("m_hash", "m_id")), zero)
    start = rows.withColumn("m_run", run).join(base, ["m_source", "m_fine"]).withColumn("m_start", F.col("m_base") + F.col("m_run"))
    filled = start.withColumn("m_full", F.floor(F.col("m_start") / block_chars).cast("long"))
    block = F.least("m_full", "m_last")  # empty texts at a source's end begin where its last block ends
    placed = filled.join(F.broadcast(quota.withColumnRenamed("m_source", "q_source")), (F.col("m_source") == F.col("q_source")) & (block >= F.col("m_first")) & (block < F.col("m_until")))
    placed = placed.withColumn("m_block", block).withColumn("m_offset", F.col("m_start") - F.col("m_block") * block_chars).withColumn("m_k", F.col("m_block") - F.col("m_first"))
    placed = placed.withColumns({"m_nth": F.col("m_k") % F.col("m_q"), "m_frame": F.floor(F.col("m_k") / F.col("m_q")).cast("long")})
    placed = placed.join(F.broadcast(slots), ["m_phase", "m_source", "m_nth"])
    begin = F.col("m_begin") + F.col("m_frame") * F.col("m_size")
    out = placed.withColumns({"m_release": begin + F.col("f_release"), "m_deadline": begin + F.col("f_deadline"), "m_slot": begin + F.col("f_slot")})
    return out.select("row", "m_chars", *PLACES)


def op6_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    return placed(documents(spark, sf_dir), ["doc_id", "source"]).select("row.*", F.col("m_chars").alias("n_chars"), *[F.col(c).alias(c[2:]) for c in PLACES])


def with_order(docs: DataFrame, name: str = "m_order") -> DataFrame:
    """``docs`` with the place of each row in the mixed order as one number. It depends on the rows alone, not on how they are stored.

    Columns may have any names; one called ``name`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    return placed(docs, kept).select("row.*", (F.col("m_slot") * (BLOCK_CHARS + 1) + F.col("m_offset")).alias(name))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all of them, in the mixed order (the order of the files written and of the rows in each).

    Null, empty and very long texts, repeated rows and empty tables are as in schedule; columns may have any names.
    """
    return placed(docs, docs.columns).orderBy("m_slot", "m_offset").select("row.*")
