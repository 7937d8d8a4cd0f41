"""Bipartite graphs: degrees, shared neighbours and majority votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import dropped, written


#: Rows and pairs that a task of shared_neighbours() holds, about.
TASK_ROWS = 1_000_000


def shared_neighbours(edges: DataFrame, node: str, via: str) -> DataFrame:
    """a, b and n_shared for pairs of nodes with a common ``via``. A pair needs one; nodes of a via meet, so its degree must be small.

    Pairs are counted first, so that they are dealt to as many tasks as keep each one's part at ``TASK_ROWS``, however many there are. They
    are not summed before they are dealt, as few repeat among one task's.
    """
    e = edges.select(node, via).where(F.col(node).isNotNull() & F.col(via).isNotNull())
    rows, pairs = e.groupBy(via).agg(F.count(F.lit(1)).alias("d")).agg(F.sum("d"), F.sum(F.col("d") * (F.col("d") - 1) / 2)).first()
    tasks = lambda n: min(int((n or 0) // TASK_ROWS) + 1, 20_000)
    listed = e.repartition(max(tasks(rows), tasks(pairs)), via).groupBy(via).agg(F.collect_set(node).alias("all"))
    left = listed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    return left.repartition(tasks(pairs), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def sharing_types(pairs: DataFrame) -> DataFrame:
    """How many pairs share one neighbour (corner), two (edge) or more (face)."""
    kind = F.when(F.col("n_shared") == 1, "corner").when(F.col("n_shared") == 2, "edge").otherwise("face")
    return pairs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("pairs"))


def degrees(edges: DataFrame, node: str, via: str) -> DataFrame:
    return edges.groupBy(node).agg(F.countDistinct(via).alias("degree"))


def majority(df: DataFrame, group: str, label: str) -> DataFrame:
    """group, label, votes: the commonest label of each group, the smaller one in ties."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(group).orderBy(F.col("votes").desc(), F.col(label))
    return n.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


# --- plain graphs


def simple(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each undirected edge once (a < b), without loops and repeats."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _kept(table: DataFrame) -> DataFrame:
    return table if hasattr(table, "_lodestone_scratch") else written(table)


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z of each triangle of a table of simple edges.

    Every edge points to its end of higher degree (then of the greater name), so that a node of any degree has few edges from it: the pairs
    that are looked up are at most the edges times the root of twice their number. Each edge takes the list of its lower end to its upper end,
    where what is in both lists closes a triangle: a shuffle of one row an edge, not one a pair.
    """
    edges = _kept(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    of = lambda end: degree.select(F.col("n").alias(end), F.struct("d", "n").alias(f"{end}_rank"))
    ends = edges.join(of("a"), "a").join(of("b"), "b")
    up = written(ends.select(F.least("a_rank", "b_rank")["n"].alias("s"), F.greatest("a_rank", "b_rank")["n"].alias("t")))
    out = written(up.groupBy("s").agg(F.collect_list("t").alias("out")))
    both = out.where(F.size("out") > 1).select(F.col("s").alias("x"), F.explode("out").alias("s"), F.col("out").alias("mine")).join(out, "s")
    return both.select("x", F.col("s").alias("y"), F.explode(F.array_intersect("mine", "out")).alias("z"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """node and core, the largest k such that it is in a part of the graph where all have k neighbours or more.

    Every node lowers its number to the largest h of which h neighbours have h or more, until none changes; neighbours are counted by their
    numbers, so a node of high degree is no long list.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")))
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("core")))
    while True:
        # a row a node, however small its file: without the hints it is broadcast through the driver in every round
        seen = both.join(state.select(F.col("node").alias("b"), F.col("core").alias("c")).hint("shuffle_hash"), "b").groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
        h = seen.withColumn("h", F.least(F.col("c"), above)).groupBy(F.col("a").alias("node")).agg(F.max("h").alias("h"))
        new = written(state.join(h.hint("shuffle_hash"), "node").select("node", F.col("core").alias("old"), F.least("core", "h").alias("core")))
        done = new.where("core < old").isEmpty()
        dropped(state)
        state = new
        if done:
            dropped(both)
            return state.select("node", "core")


def clustering(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node, degree, triangles and clustering (share of the pairs of its neighbours that are linked; 0 below two) of all ``nodes``; those
    without an edge have 0 throughout. ``edges`` are simple (a, b)."""
    edges = _kept(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias(node)).groupBy(node).agg(F.count(F.lit(1)).alias("degree"))
    closed = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias(node)).groupBy(node).agg(F.count(F.lit(1)).alias("triangles"))
    got = nodes.select(node).join(degree, node, "left").join(closed, node, "left").na.fill(0)
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return got.select(node, "degree", "triangles", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0).alias("clustering"))


def node_metrics(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """The columns of clustering() and core of all ``nodes``, 0 for those without an edge."""
    edges = _kept(edges)
    core = core_numbers(edges).select(F.col("node").alias(node), "core")
    return clustering(nodes, edges, node).join(core, node, "left").na.fill(0, ["core"])


def consensus_edges(edges: DataFrame, methods: int, how: str = "majority") -> DataFrame:
    """a, b and votes of the edges that several methods agree on: half of them, rounded down (at least one), or any (``union``).

    ``edges`` has method, a and b; an edge counts once a method, whichever way it is told.
    """
    least = max(1, methods // 2) if how == "majority" else 1
    told = edges.where("a <> b").select("method", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return told.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least)
