"""Near duplicates of embeddings by lattice hashing.

In each of several tables a unit vector is projected on random directions, eight at a time, scaled and moved, and each eight coordinates are
decoded to the nearest point of the E8 lattice; a cell is the tuple of these points. Near vectors share a cell or have neighbouring ones,
so a vector is put down in its own cell and in the few neighbouring cells that it is nearest to. Two vectors meet where one's own cell is
the other's own or probed one, and are linked if their cosine, in double precision, reaches the threshold.

Equal vectors are one representative with a count. Vectors that meet are compared by blocks: the members of a large cell are dealt to
blocks of bounded size, each pair of blocks is a unit of its own, and what leaves a unit is a number of links and a label per vector, not
its pairs. A pair that meets several times counts where it meets first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, spent, with_group
from .near_dedup import components

THRESHOLD = 0.9
#: Tables, E8 points in a cell, scale of unit vectors (of 64 components; in proportion to the root of their number), and probed cells besides
#: its own that a vector has in each table. A pair with a cosine of 0.9 meets in a table with a chance of 0.55, so in one of 8 with 0.998; two
#: independent random vectors of 64 components meet in a table with 0.004. Larger tables need a finer scale or more points, and more tables.
TABLES, POINTS, SCALE, PROBES = 8, 2, 2.5, 2
#: Members of a block.
BLOCK = 1024


def roots() -> np.ndarray:
    """The 240 steps from a point of E8 to its nearest neighbours."""
    whole = [[a if k == i else b if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1.0, -1.0), repeat=2)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half])


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number points of even sum: round, and where the sum is odd, round the least certain coordinate the other way."""
    out = np.rint(x)
    off = x - out
    odd = np.flatnonzero(out.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of the rows of ``x`` (8 columns): of the even points, or of these moved by a half."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Cells of unit vectors with ``width`` components; the same for the same parameters everywhere."""

    def __init__(self, width: int, tables: int = TABLES, points: int = POINTS, scale: float = SCALE, probes: int = PROBES):
        random = np.random.default_rng([width, tables, points])
        turns = [np.linalg.qr(random.normal(size=(max(width, 8 * points), 8 * points)))[0][:width] for _ in range(tables)]
        self.turn, self.shift = np.concatenate(turns, 1) * (scale * (width / 64) ** 0.5), random.random(8 * points * tables) * 2
        self.tables, self.points, self.probes, self.width, self.roots = tables, points, probes, width, roots()

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit key for each (row, table) of cells of shape (rows, tables, 8 * points)."""
        out = np.tile(np.arange(self.tables, dtype=np.uint64) + np.uint64(self.width << 8), (len(cells), 1))
        for i in range(cells.shape[2]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + (2 * cells[:, :, i]).astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def __call__(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the own cells (rows, tables) and of the probed ones (rows, tables, probes), nearest first."""
        n, p, k = len(units), self.points, self.probes
        at = (units @ self.turn + self.shift).reshape(-1, 8)
        own = decode(at)
        cells = own.reshape(n, self.tables, 8 * p)
        if not k:
            return self.keys(cells), np.zeros((n, self.tables, 0), np.int64)
        farther = (2 - 2 * (at - own) @ self.roots.T).reshape(n * self.tables, p * 240)  # how much farther each neighbour is than the own point
        best = np.argpartition(farther, k - 1, 1)[:, :k]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(farther, best, 1), 1, kind="stable"), 1).reshape(n, self.tables, k)
        probed = np.empty((n, self.tables, k), np.int64)
        for j in range(k):
            moved = cells.reshape(n, self.tables, p, 8).copy()
            point, step = best[:, :, j] // 240, best[:, :, j] % 240
            moved[np.arange(n)[:, None], np.arange(self.tables)[None], point] += self.roots[step]
            probed[:, :, j] = self.keys(moved.reshape(n, self.tables, 8 * p))
        return self.keys(cells), probed


def units(vectors: DataFrame, id_: str, embedding: str) -> DataFrame:
    """id, key (a digest of the vector) and unit (its direction as bytes of doubles); both null where it can link with nothing."""
    kind = vectors.schema[id_].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made: list[tuple] = []
            for v in batch.column(1):
                x = np.array([np.nan if y is None else y for y in v.as_py() or []], dtype=np.float64)
                top = np.abs(x).max(initial=0.0)
                if not 0 < top < np.inf:  # nan, too
                    made.append((None, None))
                    continue
                made.append((hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest(), ((x / top) / np.linalg.norm(x / top)).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[i] for m in made], pa.binary()) for i in (0, 1)]], ["id", "key", "unit"])

    return vectors.select(F.col(id_), F.col(embedding)).mapInArrow(run, f"id {kind}, key binary, unit binary")


def meetings(reps: DataFrame, tables: int, points: int, scale: float, probes: int) -> DataFrame:
    """node, copies and unit of each representative, with the keys of its own and its probed cells in all tables."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[int, Lattice] = {}
        for batch in batches:
            raw = batch.column(2).to_pylist()
            for size in sorted({len(u) for u in raw}):
                rows = [i for i, u in enumerate(raw) if len(u) == size]
                if size not in known:
                    known[size] = Lattice(size // 8, tables, points, scale, probes)
                own, probed = known[size](np.frombuffer(b"".join(raw[i] for i in rows), np.float64).reshape(len(rows), -1))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.array(x.ravel())) for x, width in ((own, tables), (probed, tables * probes))]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in batch.columns], *lists], ["node", "copies", "unit", "own", "probed"])

    return reps.select("node", "copies", "unit").mapInArrow(run, "node long, copies long, unit binary, own array<long>, probed array<long>")


def blocks(cells: DataFrame, probes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``cells`` for each unit (bucket, i, j) in which they are compared, with nth, home and side (0: of block i, 1: of block j);
    and the written table that this reads.

    A bucket in which nothing is at home, or that has one vector, has no unit. The members of a bucket of up to ``block`` are one block.
    """
    own = F.transform("own", lambda k, i: F.struct(k.alias("bucket"), i.alias("nth"), F.lit(True).alias("home")))
    probed = F.transform("probed", lambda k, i: F.struct(k.alias("bucket"), F.floor(i / max(probes, 1)).cast("int").alias("nth"), F.lit(False).alias("home")))
    places = cut(cells.select("node", F.explode(F.concat(own, probed)).alias("x")).select("node", "x.*"))
    sizes = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("any AND n > 1").select("bucket", "n")
    told = with_group(places, sizes, ["bucket"], F.xxhash64("node")).where("n IS NOT NULL")
    k = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), "node"), k).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"), (o < mine).cast("int").alias("side")))
    each = told.select("node", "bucket", "nth", "home", F.explode(pairs).alias("p")).select("node", "bucket", "nth", "home", "p.*")
    return each.join(cells, "node"), places


def compare(rows: DataFrame, tables: int, probes: int, threshold: float) -> DataFrame:
    """node, n (weighted links of it found in a unit and counted there) and label (the least node that it is joined with in the unit)."""
    columns = ["bucket", "i", "j", "side", "nth", "home", "node", "copies", "unit", "own", "probed"]

    def links(unit: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """node, n and label of the vectors of a unit."""
        node, copies, own, probed, home, nth = unit["node"], unit["copies"], unit["own"], unit["probed"], unit["home"], int(unit["nth"][0])
        twofold = unit["i"][0] != unit["j"][0]
        left = np.flatnonzero(unit["side"] == 0) if twofold else np.arange(len(node))
        right = np.flatnonzero(unit["side"] == 1) if twofold else left
        met = np.zeros((len(left), len(right)), bool)
        width = np.array([len(u) for u in unit["unit"]])
        for size in np.unique(width):
            a, b = left[width[left] == size], right[width[right] == size]
            of = lambda x: np.frombuffer(b"".join(unit["unit"][k] for k in x), np.float64).reshape(len(x), -1)
            if len(a) and len(b):
                met[np.ix_(width[left] == size, width[right] == size)] = of(a) @ of(b).T >= threshold
        met &= home[left][:, None] | home[right][None, :]
        if not twofold:
            met = np.triu(met, 1)
        x, y = np.nonzero(met)
        if not len(x):
            return
        x, y = left[x], right[y]
        label = node.copy()
        while True:  # the least node of what is joined inside the unit
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            if (new == label).all():
                break
            label = new
        first = np.ones(len(x), bool)
        sees = lambda a, b, t: (probed[a, t] == own[b, t][:, None]).any(1)  # noqa: E731  whether a probes b's own cell in table t
        for t in range(nth):
            first &= ~((own[x, t] == own[y, t]) | sees(x, y, t) | sees(y, x, t))
        both = sees(x, y, nth) & sees(y, x, nth) & (own[x, nth] != own[y, nth])  # these meet twice in this table: the lower cell counts
        first &= ~both | (np.minimum(own[x, nth], own[y, nth]) == unit["bucket"][0])
        n = np.zeros(len(node), np.int64)
        np.add.at(n, x[first], copies[y[first]])
        np.add.at(n, y[first], copies[x[first]])
        told = np.flatnonzero((n > 0) | (label != node))
        yield node[told], n[told], label[told]

    def results(table, last: bool) -> tuple[list, object]:
        """Results of the units that end in ``table``, and the rows of its last one, which wait for more unless ``last``."""
        got = {c: table.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "nth", "home", "node", "copies")}
        new = np.ones(table.num_rows, bool)
        new[1:] = (got["bucket"][1:] != got["bucket"][:-1]) | (got["i"][1:] != got["i"][:-1]) | (got["j"][1:] != got["j"][:-1])
        starts = np.append(np.flatnonzero(new), table.num_rows)
        until = len(starts) - 1 if last else len(starts) - 2
        got |= {c: table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, *shape) for c, shape in (("own", (tables,)), ("probed", (tables, probes)))}
        made = []
        for a, b in zip(starts[:until], starts[1 : until + 1], strict=True):
            if b - a > 1:
                made += links({c: v[a:b] for c, v in got.items()} | {"unit": table.column("unit").slice(a, b - a).to_pylist()})
        return made, table.slice(starts[until])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(made: list) -> Iterator:
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[i] for m in made])) for i in range(3)], ["node", "n", "label"])

        rest = None
        for batch in batches:
            if batch.num_rows:
                more = pa.Table.from_batches([batch])
                made, rest = results(more if rest is None else pa.concat_tables([rest, more]), False)
                yield from told(made)
        if rest is not None:
            yield from told(results(rest, True)[0])

    unit = ["bucket", "i", "j"]
    return rows.select(*columns).repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "node long, n long, label long")


def near_vectors(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, points: int = POINTS, scale: float = SCALE, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """A row per row of ``vectors``: its id, n_links, component_id and kept.

    n_links counts the other rows linked with it: equal vectors, and those that it met with a cosine of ``threshold`` or more. component_id
    is the least id that links reach, its own included (null if all of these are null); ``kept`` marks the rows whose id that is, so of
    rows that repeat an id all, or none. Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, and
    vectors of different lengths not with each other. An empty table gives an empty result; other columns are not read.
    """
    made = cut(units(vectors, id_, embedding))
    good = made.where("key IS NOT NULL")
    reps = good.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.min("unit").alias("unit"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    cells = cut(meetings(reps, tables, points, scale, probes))
    met, places = blocks(cells, probes, block)
    found = cut(compare(met, tables, probes, threshold))
    spent(cells, places)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.where("label <> node").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct())
    told = cut(reps.drop("unit").join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    spent(reps, found, labels)
    least = told.groupBy("label").agg(F.min("least").alias("component"))
    of_key = told.join(least, "label").select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    out = with_group(good.select("id", "key"), of_key, ["key"], F.xxhash64("id")).select("id", "n_links", "component")
    out = out.unionByName(made.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op12_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
