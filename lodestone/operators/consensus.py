"""Ensembles of clusterings: which rows go together in how many runs, and families that are stable over them.

A table of labels has a row per row and run: id, run, label (-1, or null: noise). Rows with the same labels in all runs are one profile with
a count, and pairs are of profiles. Two profiles that agree in a share of the runs agree throughout some part of them, if the runs are cut
into one part more than they may disagree in; only profiles that share the labels of such a part meet, so no label lists its pairs.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.clusters import Run
from lodestone.operators.families import complete_link
from lodestone.operators.order import numbered
from lodestone.sources.scratch import written


def grid(min_cluster_sizes: list[int], min_samples: list[int], methods: list[str]) -> list[Run]:
    """A run for each combination; an error if the methods are unknown or a run comes twice."""
    if unknown := set(methods) - {"eom", "leaf"}:
        raise ValueError(f"unknown methods: {', '.join(sorted(unknown))}")
    runs = [Run(*x) for x in product(min_cluster_sizes, min_samples, methods)]
    if len(set(runs)) < len(runs):
        raise ValueError("runs of the grid repeat")
    return runs


def n_runs(labels: DataFrame) -> int:
    return max(1, labels.select("run").distinct().count())


def profiles(labels: DataFrame, id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(profile, labels by run, size, share of runs without noise), and (id, profile); a profile is named by the least id that has it."""
    known = F.when(F.col("label") >= 0, F.col("label").cast("long"))
    rows = labels.groupBy(F.col(id_).alias("id")).agg(F.sort_array(F.collect_list(F.struct("run", known.alias("label")))).alias("x"))  # a list of all runs
    rows = written(rows.select("id", F.transform("x", lambda s: F.coalesce(s["label"], F.lit(-1).cast("long"))).alias("labels")))
    found = written(rows.groupBy("labels").agg(F.min("id").alias("profile"), F.count(F.lit(1)).alias("size")))
    share = F.size(F.filter("labels", lambda x: x >= 0)) / F.size("labels")
    return found.select("profile", "labels", "size", share.alias("share")), rows.join(found.select("labels", "profile"), "labels").select("id", "profile")


def agreement(a: str, b: str):
    """Number of places where two arrays of labels agree and are no noise."""
    same = F.zip_with(a, b, lambda x, y: ((x == y) & (x >= 0)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def consensus_pairs(found: DataFrame, runs: int, threshold: float) -> DataFrame:
    """a, b (profiles, a < b) and consensus, the share of runs with equal labels other than noise, where it is ``threshold`` or more.

    All such pairs are found: with k runs at least in common, one of runs - k + 1 parts is in common as a whole. A pair counts in the first.
    """
    least = max(1, -(-int(round(threshold * runs * 1e9)) // 10**9))
    parts = runs - least + 1
    cuts = [(runs * i // parts, runs * (i + 1) // parts) for i in range(parts)]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.slice("labels", a + 1, b - a).alias("key")) for i, (a, b) in enumerate(cuts)])
    kept = found.where(F.col("share") * runs >= least - 0.5)
    placed = kept.select("profile", "labels", F.explode(F.filter(keys, lambda k: ~F.exists(k["key"], lambda x: x < 0))).alias("k")).select("profile", "labels", "k.*")
    left = placed.select(F.col("profile").alias("a"), F.col("labels").alias("x"), "part", "key")
    right = placed.select(F.col("profile").alias("b"), F.col("labels").alias("y"), "part", "key")
    both = left.join(right, ["part", "key"]).where("a < b")
    alike = [(F.slice("x", a + 1, b - a) == F.slice("y", a + 1, b - a)) & ~F.exists(F.slice("x", a + 1, b - a), lambda v: v < 0) for a, b in cuts]
    first = F.coalesce(*[F.when(same, F.lit(i)) for i, same in enumerate(alike)])
    pairs = both.where(F.col("part") == first).select("a", "b", agreement("x", "y").alias("n"))
    return pairs.where(F.col("n") >= least).select("a", "b", (F.col("n") / runs).alias("consensus"))


def consensus(labels: DataFrame, threshold: float, id_: str = "id") -> DataFrame:
    """a, b and consensus of the profiles of a table of labels that agree in ``threshold`` of the runs or more.

    A profile of several rows has a pair with itself, (a, a): any two of these rows, if they are no noise often enough.
    """
    found, _ = profiles(labels, id_)
    runs = n_runs(labels)
    own = found.where((F.col("size") > 1) & (F.col("share") >= threshold - 1e-12)).select(F.col("profile").alias("a"), F.col("profile").alias("b"), F.col("share").alias("consensus"))
    return consensus_pairs(found, runs, threshold).union(own)


def stable_families(labels: DataFrame, threshold: float, least: int = 2, id_: str = "id") -> DataFrame:
    """id and family: complete-link clusters of 1 - consensus, cut at 1 - ``threshold``; numbered from 0 by their least id.

    Rows with equal labels come together first if they are no noise in a share ``threshold`` of the runs. Families of fewer rows than
    ``least`` are -1. An empty table gives an empty result.
    """
    found, members = profiles(labels, id_)
    runs = n_runs(labels)
    pairs = consensus_pairs(found, runs, threshold).select("a", "b", (1 - F.col("consensus")).alias("far"))
    nodes = found.where(F.col("share") >= threshold - 1e-12).select("profile")
    joined = complete_link(nodes, pairs, "far", 1 - threshold + 1e-12, "profile")
    placed = members.join(joined, "profile", "left").withColumn("family", F.coalesce("family", "id"))  # a row that links with none is alone
    sizes = placed.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") >= least)
    number = numbered(sizes, [F.col("first")])
    return placed.join(number.select("family", "number"), "family", "left").select(F.col("id").alias(id_), F.coalesce("number", F.lit(-1)).cast("long").alias("family"))


def support(labels: DataFrame, anchors: DataFrame, id_: str = "id") -> DataFrame:
    """id, prototype and support: the share of runs in which the row has the label, other than noise, of one of the prototype's anchors.

    ``anchors`` has prototype and id. Every row has a support for every prototype, 0 too.
    """
    runs = n_runs(labels)
    names = [r[0] for r in anchors.select("prototype").distinct().orderBy("prototype").collect()]  # a row a prototype
    if not names:
        return labels.select(id_, F.lit(None).cast("string").alias("prototype"), F.lit(0.0).alias("support")).where("false")
    of = labels.where("label >= 0").join(anchors.select(F.col("id").alias(id_), "prototype"), id_)
    told = of.groupBy("run", "label").agg(F.collect_set("prototype").alias("held"))  # at most all prototypes
    seen = labels.join(told, ["run", "label"], "left")
    counts = seen.groupBy(id_).agg(*[F.sum(F.coalesce(F.array_contains("held", p).cast("int"), F.lit(0))).alias(f"n{i}") for i, p in enumerate(names)])
    each = F.array(*[F.struct(F.lit(p).alias("prototype"), (F.col(f"n{i}") / runs).alias("support")) for i, p in enumerate(names)])
    return counts.select(id_, F.inline(each))


def diagnostics(labels: DataFrame) -> DataFrame:
    """run, n_rows, n_clusters, n_noise, noise_fraction, largest and largest_fraction."""
    sizes = labels.groupBy("run", F.when(F.col("label") >= 0, F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    got = sizes.groupBy("run").agg(
        F.sum("n").alias("n_rows"),
        F.count("label").alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("n_noise"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)).alias("largest"),
    )
    return got.select("run", "n_rows", "n_clusters", "n_noise", (F.col("n_noise") / F.col("n_rows")).alias("noise_fraction"), "largest", (F.col("largest") / F.col("n_rows")).alias("largest_fraction"))


def noise_frequency(labels: DataFrame, id_: str = "id") -> DataFrame:
    """id and the share of runs in which it is noise."""
    return labels.groupBy(id_).agg(F.avg(F.coalesce(F.col("label") < 0, F.lit(True)).cast("int")).alias("noise_frequency"))


def wide(labels: DataFrame, runs: list[int], id_: str = "id") -> DataFrame:
    """id and a column run_000, run_001, ... for each of ``runs``."""
    return labels.groupBy(id_).agg(*[F.max(F.when(F.col("run") == r, F.col("label"))).alias(f"run_{r:03d}") for r in runs])
