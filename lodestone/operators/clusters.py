"""Density clusters (HDBSCAN) of feature rows.

Rows with equal features are one point with a count. Points are dealt to cells around pivots, and large cells to blocks. A point visits only
the cells that the triangle inequality leaves open: first for its nearest neighbours, whose last is its core distance; then, round by round,
for the lightest edge that leaves its component, by mutual reachability (Boruvka). What a task holds at once is a block and a batch of its
visitors. The minimum spanning tree is condensed by the least size of a cluster, and clusters are chosen by excess of mass or as leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cleaning import finite
from lodestone.operators.families import components
from lodestone.sources.scratch import dropped, written

#: Pivots at most (what the driver and each task hold), points a pivot, and members of a block.
PIVOTS, PER_PIVOT, BLOCK = 1024, 128, 1024
#: Points, components or edges up to which the driver joins and condenses them; beyond it, Spark does.
LOCAL = 200_000
#: Distances below it count as it: the density of equal points is finite.
LEAST = 1e-12


@dataclass(frozen=True)
class Run:
    """One clustering: least rows of a cluster, which neighbour gives the core distance, and ``eom`` or ``leaf``."""

    min_cluster_size: int
    min_samples: int
    method: str = "eom"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``, summed column by column, so that d(x, y) = d(y, x) to the last bit."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out)


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def met(rows: DataFrame, held: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(members, visitors)`` for each unit (cell, block) of ``rows``, which have ``visits``: members (false) come before visitors.

    Members of a unit are held, visitors stream by in batches. ``work`` gets dicts of arrays (``x`` as rows) and gives a list of arrays.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, members = None, None
        for batch in batches:
            got = {c: matrix(batch.column(c)) if c == "x" else batch.column(c).to_numpy(zero_copy_only=False) for c in held}
            of, visits = np.stack([batch.column(c).to_numpy() for c in ("cell", "block")], 1), batch.column("visits").to_numpy(zero_copy_only=False)
            cut = np.ones(len(visits), bool)
            cut[1:] = (of[1:] != of[:-1]).any(1) | (visits[1:] != visits[:-1])
            starts, made = np.append(np.flatnonzero(cut), len(visits)), []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                part = {c: v[a:b] for c, v in got.items()}
                if visits[a]:
                    if key == tuple(of[a]) and (found := work(members, part)) is not None:
                        made.append(found)
                elif key == tuple(of[a]):
                    members = {c: np.concatenate([members[c], part[c]]) for c in held}
                else:
                    key, members = tuple(of[a]), part
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[i] for m in made])) for i in range(len(names))], names)

    return rows.select("cell", "block", "visits", *held).repartition("cell", "block").sortWithinPartitions("cell", "block", "visits").mapInArrow(run, schema)


@dataclass
class Space:
    """Points dealt to cells around pivots: ``points`` has node, copies, x, cell, block and far (from its pivot)."""

    points: DataFrame
    pivots: np.ndarray
    nodes: np.ndarray
    radius: np.ndarray
    weight: np.ndarray
    blocks: np.ndarray
    tables: list[DataFrame] = field(default_factory=list)

    def visits(self, rows: DataFrame, carried: list[str], limit: Callable) -> DataFrame:
        """A row of ``rows`` (node, x and ``carried``) for each block of the cells that ``limit(columns, distances to pivots, space)`` leaves open."""
        radius, blocks = self.radius, self.blocks
        pivots, weight = self.pivots, self.weight
        kinds = dict(rows.dtypes)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
                got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in carried}
                d = distances(matrix(batch.column("x")), pivots)
                row, cell = np.nonzero(limit(got, d, radius, weight))
                n = blocks[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                block = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
                for a in range(0, len(row), 20_000):
                    at = slice(a, a + 20_000)
                    kept = batch.take(pa.array(row[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at].astype(np.int32)), pa.array(block[at].astype(np.int32)), *kept.columns], ["cell", "block", *kept.schema.names])

        columns = ["node", "x", *[c for c in carried if c != "node"]]
        out = rows.select(*columns).mapInArrow(run, ", ".join(["cell int", "block int", *[f"{c} {kinds[c]}" for c in columns]]))
        return out.withColumn("visits", F.lit(True))


def space(points: DataFrame, pivots: int = PIVOTS, per_pivot: int = PER_PIVOT, block: int = BLOCK) -> Space:
    """Cells of ``points`` (node, copies, x), around as many of them as their number asks for, at most ``pivots``."""
    n = points.count()
    chosen = points.orderBy(F.xxhash64("node"), "node").limit(max(1, min(pivots, n // per_pivot))).select("node", "x").collect()  # at most ``pivots`` rows
    at, nodes = np.array([r["x"] for r in chosen], dtype=float).reshape(len(chosen), -1), np.array([r["node"] for r in chosen])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            d = distances(matrix(batch.column(2)), at)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["node", "copies", "x", "cell", "far"])

    celled = written(points.select("node", "copies", "x").mapInArrow(run, "node long, copies long, x array<double>, cell int, far double"))
    radius, weight, blocks = np.zeros(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for r in celled.groupBy("cell").agg(F.max("far").alias("radius"), F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
        radius[r["cell"]], weight[r["cell"]], blocks[r["cell"]] = r["radius"] * (1 + 1e-12), r["weight"], -(-r["n"] // block)
    parts = F.array(*[F.lit(int(b)) for b in blocks])[F.col("cell")]
    return Space(celled.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), parts).cast("int")), at, nodes, radius, weight, blocks, [celled])


def nearest(space_: Space, k: int) -> DataFrame:
    """node and near, its neighbours (d, other, copies) in ascending order, until the ``k`` nearest other rows are there (or all).

    Copies of a point count as rows at distance 0, but are not listed.
    """
    pts = space_.points
    held = ["node", "copies", "x"]

    def bound(members: dict, visitors: dict) -> list:
        d = np.where(members["node"][None] == visitors["node"][:, None], np.inf, distances(visitors["x"], members["x"]))
        order = np.argsort(d, 1, kind="stable")
        rows = np.cumsum(members["copies"][order], 1) + visitors["copies"][:, None] - 1
        enough = rows >= k
        at = np.minimum(enough.argmax(1), d.shape[1] - 1)
        limit = np.where(enough.any(1), np.take_along_axis(d, order, 1)[np.arange(len(d)), at], np.inf)
        return [visitors["node"], np.where(visitors["copies"] > k, 0.0, limit)]

    twice = pts.select("cell", "block", F.explode(F.array(F.lit(False), F.lit(True))).alias("visits"), *held)
    limits = met(twice, held, bound, "node long, limit double")
    limited = written(pts.join(limits, "node").select("node", "copies", "x", "limit"))

    def open_(got: dict, d: np.ndarray, radius: np.ndarray, weight: np.ndarray) -> np.ndarray:
        far = d + radius  # all rows of a cell are within it
        order = np.argsort(far, 1)
        enough = np.cumsum(weight[order], 1) > k
        by_cells = np.where(enough.any(1), np.take_along_axis(far, order, 1)[np.arange(len(d)), enough.argmax(1)], np.inf)
        got["limit"] = np.minimum(got["limit"], by_cells)
        return d - radius <= got["limit"][:, None]

    visitors = space_.visits(limited, ["node", "copies", "limit"], open_)
    every = pts.select("cell", "block", F.lit(False).alias("visits"), *held, F.lit(0.0).alias("limit")).unionByName(visitors.select("cell", "block", "visits", *held, "limit"))

    def near(members: dict, visitors: dict) -> list | None:
        d = distances(visitors["x"], members["x"])
        d[members["node"][None] == visitors["node"][:, None]] = np.inf
        if d.shape[1] > k:
            limit = np.partition(d, k - 1, 1)[:, k - 1]
            row, at = np.nonzero((d <= limit[:, None]) & (d <= visitors["limit"][:, None]) & (d < np.inf))
        else:
            row, at = np.nonzero((d <= visitors["limit"][:, None]) & (d < np.inf))
        return [visitors["node"][row], d[row, at], members["node"][at], members["copies"][at]] if len(row) else None

    found = met(every, [*held, "limit"], near, "node long, d double, other long, copies long")
    listed = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "other", "copies"))).alias("near"))
    out = written(pts.select("node", "copies").join(listed, "node", "left").select("node", F.col("copies").alias("own"), F.coalesce("near", F.array().cast("array<struct<d:double,other:bigint,copies:bigint>>")).alias("near")))
    dropped(limited)
    return out


def core(k: int):
    """The distance of the ``k``-th nearest other row (the last, if there are fewer) in a table of nearest()."""
    start = F.struct((F.col("own") - 1).alias("rows"), F.when(F.col("own") > k, F.lit(0.0)).alias("d"))
    step = lambda s, x: F.struct((s["rows"] + x["copies"]).alias("rows"), F.coalesce(s["d"], F.when(s["rows"] + x["copies"] >= k, x["d"])).alias("d"))
    return F.coalesce(F.aggregate("near", start, step, lambda s: s["d"]), F.try_element_at("near", F.lit(-1))["d"], F.lit(0.0))


def relabelled(pairs: DataFrame) -> DataFrame:
    """comp, new (the least component that it is joined with) of the components in ``pairs`` (comp, other)."""
    spark = pairs.sparkSession
    if pairs.count() > LOCAL:
        both = pairs.select(F.col("comp").alias("a"), F.col("other").alias("b"))
        nodes = both.select(F.col("a").alias("comp")).union(both.select("b")).distinct()
        return components(nodes, both, "comp").withColumnRenamed("family", "new")
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs.select("comp", "other").collect():  # at most LOCAL rows
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return spark.createDataFrame([(c, find(c)) for c in list(root)], "comp long, new long")


def spanning_tree(space_: Space, cores: DataFrame, near: DataFrame) -> DataFrame:
    """w, a, b (a < b) of the minimum spanning tree by mutual reachability; among equal weights the smaller (a, b) comes first.

    ``cores`` has node and core. In each round every component takes the lightest edge that leaves it. A known edge (to a listed neighbour
    or a pivot) limits the search, and cells inside a component are passed over.
    """
    pts = written(space_.points.join(cores, "node").select("node", "x", "cell", "block", "core"))
    known = near.select("node", F.explode("near").alias("n")).select("node", F.col("n.other").alias("other"), F.col("n.d").alias("d"))
    cost = known.join(cores, "node").join(cores.select(F.col("node").alias("other"), F.col("core").alias("other_core")), "other")
    listed = written(cost.select("node", "other", F.greatest("d", "core", "other_core").alias("w")))
    label = written(pts.select("node", F.col("node").alias("comp")))
    spark, parts, held = pts.sparkSession, [], ["node", "x", "core", "comp"]
    pivot_core = {r["node"]: r["core"] for r in cores.where(F.col("node").isin([int(x) for x in space_.nodes])).collect()}
    pivots, pcore = space_.pivots, np.array([pivot_core[x] for x in space_.nodes])

    while True:
        now = pts.join(label, "node")
        cells = now.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("core").alias("core")).collect()  # a row a pivot
        sole, least = np.full(len(pivots), -1, np.int64), np.full(len(pivots), np.inf)
        for r in cells:
            sole[r["cell"]], least[r["cell"]] = (r["low"] if r["low"] == r["high"] else -1), r["core"]
        if len({r["low"] for r in cells} | {r["high"] for r in cells}) == 1 and cells:
            break
        where = {r["node"]: r["comp"] for r in label.where(F.col("node").isin([int(x) for x in space_.nodes])).collect()}
        pcomp = np.array([where[x] for x in space_.nodes])

        def by_pivots(batches: Iterator, pcomp=pcomp) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                comp, own = batch.column("comp").to_numpy(), batch.column("core").to_numpy()
                w = np.maximum(np.maximum(distances(matrix(batch.column("x")), pivots), own[:, None]), pcore[None])
                w[comp[:, None] == pcomp[None]] = np.inf
                yield pa.RecordBatch.from_arrays([pa.array(comp), pa.array(w.min(1))], ["comp", "w"])

        ends = listed.join(label, "node").join(label.select(F.col("node").alias("other"), F.col("comp").alias("other_comp")), "other").where("comp <> other_comp")
        bounds = ends.select("comp", "w").union(now.select("comp", "core", "x").mapInArrow(by_pivots, "comp long, w double"))
        limits = written(bounds.groupBy("comp").agg(F.min("w").alias("limit")).where(F.col("limit") < float("inf")))
        asking = now.join(F.broadcast(limits) if limits.count() <= LOCAL else limits, "comp").where("core <= limit").select("node", "x", "core", "comp", "limit")

        def open_(got: dict, d: np.ndarray, radius: np.ndarray, weight: np.ndarray, sole=sole, least=least) -> np.ndarray:
            return (np.maximum(d - radius, least[None]) <= got["limit"][:, None]) & (sole[None] != got["comp"][:, None])

        visitors = space_.visits(asking, ["node", "core", "comp", "limit"], open_)
        every = now.select("cell", "block", F.lit(False).alias("visits"), *held).unionByName(visitors.select("cell", "block", "visits", *held))

        def lightest(members: dict, visitors: dict) -> list | None:
            w = np.maximum(np.maximum(distances(visitors["x"], members["x"]), visitors["core"][:, None]), members["core"][None])
            w[visitors["comp"][:, None] == members["comp"][None]] = np.inf
            low = w.min(1)
            row, at = np.nonzero((w == low[:, None]) & (w < np.inf))
            if not len(row):
                return None
            a, b = np.minimum(visitors["node"][row], members["node"][at]), np.maximum(visitors["node"][row], members["node"][at])
            order = np.lexsort((b, a, w[row, at], visitors["comp"][row]))
            first = order[np.append(True, np.diff(visitors["comp"][row][order]) != 0)]
            return [visitors["comp"][row][first], w[row, at][first], a[first], b[first], members["comp"][at][first]]

        best = met(every, held, lightest, "comp long, w double, a long, b long, other long")
        picked = written(best.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("comp", "e.*"))
        parts.append(picked)
        new = relabelled(picked)
        old = label
        label = written(label.join(new, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")))
        dropped(old, limits)
    dropped(pts, listed, label)
    if not parts:
        return spark.createDataFrame([], "w double, a long, b long")
    out = parts[0].select("w", "a", "b")
    for p in parts[1:]:
        out = out.union(p.select("w", "a", "b"))
    tree = written(out.distinct())
    dropped(*parts)
    return tree


@dataclass
class Tree:
    """A condensed tree: of each cluster its parent (-1: none; a parent comes after its parts) and the edge (w, a, b) at which it joins it."""

    parent: list[int]
    top: list[tuple[float, int, int]]


NEVER = (float("inf"), 0, 0)


def condensed(nodes: np.ndarray, copies: np.ndarray, cores: np.ndarray, edges: list[tuple[float, int, int]], least: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The condensed tree of points (ascending ids, counts and core distances) and of edges in order, whose clusters have ``least`` rows or
    more; and of each point the cluster that it falls out of (-1: none) and the weight at which it does."""
    at = {int(x): i for i, x in enumerate(nodes)}
    root, size = list(range(len(nodes))), copies.tolist()
    of, small = [-1] * len(nodes), [[i] for i in range(len(nodes))]
    tree, cluster, fall = Tree([], []), np.full(len(nodes), -1), np.full(len(nodes), np.inf)

    def begin(r: int) -> None:
        of[r] = len(tree.parent)
        tree.parent.append(-1)
        tree.top.append(NEVER)

    def falls(r: int, points: list[int], w: float) -> None:
        cluster[points], fall[points] = of[r], w

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(nodes)):
        if size[i] >= least:
            begin(i)
            falls(i, small[i], cores[i])
            small[i] = []
    for w, a, b in edges:
        x, y = find(at[a]), find(at[b])
        if len(small[x]) < len(small[y]):
            x, y = y, x
        cx, cy = of[x], of[y]
        root[y], size[x] = x, size[x] + size[y]
        if cx >= 0 and cy >= 0:
            for c in (cx, cy):
                tree.parent[c], tree.top[c] = len(tree.parent), (w, a, b)
            begin(x)
        elif cx >= 0 or cy >= 0:
            of[x] = max(cx, cy)
            falls(x, small[x] + small[y], w)
            small[x] = []
        else:
            small[x] += small[y]
            if size[x] >= least:
                begin(x)
                falls(x, small[x], w)
                small[x] = []
        small[y] = []
    return tree, cluster, fall


def contracted(points: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, list[tuple]]:
    """node, copies, leaf (null: none), w, a, b: where each point of ``points`` (node, copies, core) first comes to be in a component of
    ``least`` rows, and by which edge; and the edges (w, a, b, leaf, leaf) between these components.

    In each round every smaller component takes the lightest edge that leaves it. Two that take the same one join: no lighter edge leaves
    either, so what they make up is a component at that weight. One whose edge leads to a component that is large enough, at once or by the
    edges of others, is done. What is left is one component for each peak of density.
    """
    low = F.lit(-(1 << 63))
    members = written(points.where(F.col("copies") < least).select("node", "copies", F.col("node").alias("c")))
    comps = written(points.select(F.col("node").alias("c"), F.col("copies").alias("size"), (F.col("copies") >= least).alias("big")))
    done = [written(points.where(F.col("copies") >= least).select("node", "copies", F.col("node").alias("leaf"), F.col("core").alias("w"), low.alias("a"), low.alias("b")))]
    links = written(edges.select("w", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    while True:
        e = F.struct("w", "a", "b")
        ends = links.select(e.alias("e"), F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("other")))).alias("x")).select("e", "x.*")
        picks = ends.join(comps.where("NOT big").select("c"), "c", "left_semi").groupBy("c").agg(F.min(F.struct("e", "other")).alias("p")).select("c", "p.e", "p.other")
        picks = written(picks.join(comps.where("big").select(F.col("c").alias("other"), F.lit(True).alias("hit")), "other", "left").select("c", "e", "other", F.coalesce("hit", F.lit(False)).alias("hit")))
        if picks.isEmpty():
            break
        back = picks.select(F.col("c").alias("other"), F.col("other").alias("c"), "e", F.lit(True).alias("mutual"))
        ptr = picks.join(back, ["c", "other", "e"], "left").select("c", "e", F.col("other").alias("next"), "hit", F.coalesce("mutual", F.lit(False)).alias("mutual"))
        for _ in range(3):
            ahead = ptr.select(F.col("c").alias("next"), F.col("next").alias("further"), F.col("hit").alias("then"), F.col("mutual").alias("stop"))
            step = ~F.col("hit") & ~F.col("mutual") & ~F.coalesce("stop", F.lit(True))
            ptr = written(ptr.join(ahead, "next", "left").select("c", "e", F.when(step, F.col("further")).otherwise(F.col("next")).alias("next"), F.when(step, F.col("then")).otherwise(F.col("hit")).alias("hit"), "mutual"))
        pairs = ptr.where("mutual").select("c", "e", F.least("c", "next").alias("new"))
        sizes = pairs.join(comps, "c").groupBy("new").agg(F.sum("size").alias("size")).withColumn("big", F.col("size") >= least)
        merged = pairs.join(sizes, "new").select("c", "e", "new", "big")
        moved = written(merged.union(ptr.where("hit").select("c", "e", F.col("next").alias("new"), F.lit(True).alias("big"))))
        told = members.join(moved, "c", "left")
        done.append(written(told.where("big").select("node", "copies", F.col("new").alias("leaf"), "e.*")))
        old = members, comps, links
        members = written(told.where("big IS NULL OR NOT big").select("node", "copies", F.coalesce("new", "c").alias("c")))
        comps = written(comps.join(moved.select("c"), "c", "left_anti").union(sizes.select(F.col("new").alias("c"), "size", "big")))
        to = lambda c: moved.select(F.col("c").alias(c), F.col("new").alias(f"{c}_new"))
        links = links.join(to("ca"), "ca", "left").join(to("cb"), "cb", "left").select("w", "a", "b", F.coalesce("ca_new", "ca").alias("ca"), F.coalesce("cb_new", "cb").alias("cb"))
        links = written(links.where("ca <> cb"))
        dropped(*old, picks, ptr, moved)
    left = links.count()
    if left > LOCAL:
        raise ValueError(f"{left + 1} peaks of density; at most {LOCAL} can be put in order")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    none = members.select("node", "copies", F.lit(None).cast("long").alias("leaf"), F.lit(None).cast("double").alias("w"), low.alias("a"), low.alias("b"))
    return out.union(none), [tuple(r) for r in links.orderBy("w", "a", "b").collect()]


def fallen(points: DataFrame, edges: DataFrame, least: int) -> tuple[Tree, DataFrame]:
    """The condensed tree, and node, copies, cluster and w (the weight at which the point falls out of it) of points in clusters.

    Up to LOCAL points the driver puts edges in order; beyond it Spark contracts them, and the driver sees one edge a peak of density.
    """
    spark = points.sparkSession
    if points.count() <= LOCAL:
        known = points.orderBy("node").collect()  # at most LOCAL rows
        nodes, copies, far = (np.array([r[c] for r in known]) for c in ("node", "copies", "core"))
        tree, cluster, fall = condensed(nodes, copies, far, [tuple(e) for e in edges.orderBy("w", "a", "b").collect()], least)
        rows = [(int(n), int(k), int(c), float(w)) for n, k, c, w in zip(nodes, copies, cluster, fall, strict=True) if c >= 0]
        return tree, spark.createDataFrame(rows, "node long, copies long, cluster int, w double")
    table, between = contracted(points, edges, least)
    found = [r["leaf"] for r in table.where("leaf IS NOT NULL").select("leaf").distinct().collect()]  # a row a peak
    if len(found) > LOCAL + 1:
        raise ValueError(f"{len(found)} peaks of density; at most {LOCAL} can be put in order")
    leaves = np.array(sorted(found), dtype=np.int64)
    place = {int(x): i for i, x in enumerate(leaves)}
    tree, _, _ = condensed(np.arange(len(leaves)), np.full(len(leaves), least), np.zeros(len(leaves)), [(k, place[x], place[y]) for k, (_, _, _, x, y) in enumerate(between)], least)
    top = [NEVER if p < 0 else between[int(t[0])][:3] for p, t in zip(tree.parent, tree.top, strict=True)]
    parent = np.array(tree.parent, dtype=np.int64)
    tops = [np.array([t[i] for t in top]) for i in range(3)]

    def climb(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            w, a, b = (batch.column(c).to_numpy() for c in ("w", "a", "b"))
            at = np.searchsorted(leaves, batch.column("leaf").to_numpy())
            while True:
                u, x, y = (t[at] for t in tops)
                above = (w > u) | ((w == u) & ((a > x) | ((a == x) & (b > y))))
                if not above.any():
                    break
                at = np.where(above, parent[at], at)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(at.astype(np.int32)), batch.column("w")], ["node", "copies", "cluster", "w"])

    return Tree(tree.parent, top), table.where("leaf IS NOT NULL").mapInArrow(climb, "node long, copies long, cluster int, w double")


def picked(tree: Tree, stats: dict[int, tuple], methods: set[str]) -> dict[str, list[tuple[int, int, float]]]:
    """Of each method a row a cluster whose points have a label: cluster, label (by the least id inside) and the density that has probability 1.

    ``stats`` has rows, sum of their densities, highest density and least id of the points that fall out of each cluster. ``eom``: a cluster
    is chosen unless its parts have more stability together; ``leaf``: those without parts. The root never is.
    """
    n = len(tree.parent)
    birth = [0.0 if p < 0 else 1 / max(t[0], LEAST) for p, t in zip(tree.parent, tree.top, strict=True)]
    size, total, most, first = ([stats.get(c, (0, 0.0, 0.0, None))[i] for c in range(n)] for i in range(4))
    stability, parts = [total[c] - size[c] * birth[c] for c in range(n)], [[] for _ in range(n)]
    for c, p in enumerate(tree.parent):  # parts come before what they make up
        if p >= 0:
            parts[p].append(c)
            stability[p] += size[c] * (birth[c] - birth[p])
            size[p] += size[c]
            most[p] = max(most[p], birth[c])
            first[p] = first[c] if first[p] is None else min(first[p], first[c])
    out = {}
    for method in methods:
        value, pick, home = list(stability), [not p for p in parts], [-1] * n
        if method == "eom":
            for c in range(n):
                if parts[c]:
                    together = sum(value[x] for x in parts[c])
                    pick[c] = together <= stability[c]
                    value[c] = max(together, stability[c])
        for c in reversed(range(n)):  # the highest that is chosen
            p = tree.parent[c]
            home[c] = -1 if p < 0 else home[p] if home[p] >= 0 else c if pick[c] else -1
        number = {c: i for i, c in enumerate(sorted({h for h in home if h >= 0}, key=lambda c: first[c]))}
        out[method] = [(c, number[h], most[h]) for c, h in enumerate(home) if h >= 0]
    return out


def hdbscan(df: DataFrame, id_: str, columns: list[str], runs: list[Run], pivots: int = PIVOTS, per_pivot: int = PER_PIVOT, block: int = BLOCK) -> DataFrame:
    """id, run (its place in ``runs``), label (from 0, by the least id in a cluster; -1: noise) and probability of each row and run.

    ``id_`` is a long column without nulls or repeats. Rows with a missing feature (null, NaN or infinite) have a null label. Core distances
    are to the ``min_samples``-th nearest other row. Neighbours and spanning trees are shared by the runs that agree in ``min_samples``.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_).cast("long").alias("id"), F.array(*[finite(F.col(c).cast("double")) + 0.0 for c in columns]).alias("x"))
    base = base.withColumn("x", F.when(~F.exists("x", lambda v: v.isNull()), F.col("x")))
    points = written(base.where("x IS NOT NULL").groupBy("x").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")))
    of = base.join(points.select("x", "node"), "x", "left").select("id", "node")
    number = F.explode(F.array(*[F.lit(i) for i in range(len(runs))])).alias("run")
    lone = of.where("node IS NULL").select(F.col("id").alias(id_), number, F.lit(None).cast("long").alias("label"), F.lit(None).cast("double").alias("probability"))
    if points.isEmpty():
        return lone
    dealt = space(points, pivots, per_pivot, block)
    near = nearest(dealt, max(r.min_samples for r in runs))
    tables = []
    for k in sorted({r.min_samples for r in runs}):
        cores = written(near.select("node", core(k).alias("core")))
        edges = spanning_tree(dealt, cores, near)
        known = written(points.join(cores, "node").select("node", "copies", "core"))
        for m in sorted({r.min_cluster_size for r in runs if r.min_samples == k}):
            tree, rows = fallen(known, edges, m)
            rows = written(rows.withColumn("density", 1 / F.greatest("w", F.lit(LEAST))))
            per = rows.groupBy("cluster").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("density")).alias("s"), F.max("density").alias("m"), F.min("node").alias("f"))
            stats = {r["cluster"]: (r["n"], r["s"], r["m"], r["f"]) for r in per.collect()}  # a row a cluster
            mine = [(i, r) for i, r in enumerate(runs) if r.min_samples == k and r.min_cluster_size == m]
            for method, told in picked(tree, stats, {r.method for _, r in mine}).items():
                labels = spark.createDataFrame(told, "cluster int, label long, most double")
                got = rows.join(labels, "cluster").select("node", "label", F.least(F.col("density") / F.col("most"), F.lit(1.0)).alias("probability"))
                every = points.select("node").join(got, "node", "left").select("node", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
                tables += [every.select("node", F.lit(i).alias("run"), "label", "probability") for i, r in mine if r.method == method]
        dropped(edges)
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    labels = written(out)
    dropped(near, *dealt.tables)
    return of.where("node IS NOT NULL").join(labels, "node").select(F.col("id").alias(id_), "run", "label", "probability").union(lone)
