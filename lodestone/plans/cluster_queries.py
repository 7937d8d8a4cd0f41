"""Queries of density clusters and of what an ensemble of clusterings has in common."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import clusters, consensus
from lodestone.plans.base import query
from lodestone.sources.tables import table as t

RUNS = 8
#: A label for each vector and run; run 4 is noise alone, and each vector is noise in another run or two.
LABELS = f"WITH l AS (SELECT vec_id AS id, r AS run, CASE WHEN r = 4 OR (vec_id + r) % 7 = 0 THEN -1 ELSE (vec_id // 4) % 25 END AS label FROM embeddings, range({RUNS}) x(r))"
PROFILES = LABELS + ", v AS (SELECT id, list(label ORDER BY run) AS labels FROM l GROUP BY id), p AS (SELECT labels, min(id) AS profile, count(*) AS size, len(list_filter(labels, lambda x: x >= 0)) AS known FROM v GROUP BY labels)"
AGREE = "len(list_filter(list_zip(a.labels, b.labels), lambda x: x[1] = x[2] AND x[1] >= 0))"


def runs(spark, d):
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.explode(F.array(*map(F.lit, range(RUNS)))).alias("run"))
    noise = (F.col("run") == 4) | ((F.col("id") + F.col("run")) % 7 == 0)
    return rows.withColumn("label", F.when(noise, -1).otherwise(F.floor(F.col("id") / 4) % 25).cast("int"))


@query(None)
def density_clusters(spark, d):
    """Parts by size and price: excess of mass and leaves, for two core distances."""
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") / 10).alias("size"), (F.col("p_retailprice") / 100).alias("price"))
    return clusters.hdbscan(p, "p_partkey", ["size", "price"], consensus.grid([10], [4, 8], ["eom", "leaf"])).withColumn("probability", F.round("probability", 9))


@query(
    PROFILES
    + f""" SELECT a.profile AS a, b.profile AS b, {AGREE} / {RUNS} AS consensus FROM p a JOIN p b ON a.profile < b.profile WHERE {AGREE} >= 4
    UNION ALL SELECT profile, profile, known / {RUNS} FROM p WHERE size > 1 AND known >= 4"""
)
def consensus_pairs(spark, d):
    return consensus.consensus(runs(spark, d), 0.5)


@query(
    PROFILES
    + f""", c AS (SELECT a.profile, min(b.profile) AS family FROM p a JOIN p b ON {AGREE} >= 4 GROUP BY 1), f AS (SELECT id, family FROM v JOIN p USING (labels) JOIN c USING (profile)),
    s AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS number FROM f GROUP BY family HAVING count(*) > 1) SELECT id, coalesce(number, -1) AS family FROM f LEFT JOIN s USING (family)"""
)
def stable_families(spark, d):
    return consensus.stable_families(runs(spark, d), 0.5)


@query(
    LABELS
    + f""", a AS (SELECT * FROM (VALUES ('even', 0), ('even', 8), ('odd', 5)) x(prototype, id)), n AS (SELECT DISTINCT prototype, run, label FROM a JOIN l USING (id) WHERE label >= 0)
    SELECT l.id, p.prototype, count(n.run) / {RUNS} AS support FROM l CROSS JOIN (SELECT DISTINCT prototype FROM a) p LEFT JOIN n ON n.prototype = p.prototype AND n.run = l.run AND n.label = l.label GROUP BY ALL"""
)
def prototype_support(spark, d):
    return consensus.support(runs(spark, d), spark.createDataFrame([("even", 0), ("even", 8), ("odd", 5)], "prototype string, id long"))


@query(
    LABELS
    + """, s AS (SELECT run, label, count(*) AS n FROM l GROUP BY ALL) SELECT run, sum(n) AS n_rows, count(CASE WHEN label >= 0 THEN 1 END) AS n_clusters, coalesce(sum(CASE WHEN label < 0 THEN n END), 0) AS n_noise,
    coalesce(sum(CASE WHEN label < 0 THEN n END), 0) / sum(n) AS noise_fraction, coalesce(max(CASE WHEN label >= 0 THEN n END), 0) AS largest, coalesce(max(CASE WHEN label >= 0 THEN n END), 0) / sum(n) AS largest_fraction FROM s GROUP BY run"""
)
def cluster_diagnostics(spark, d):
    return consensus.diagnostics(runs(spark, d))


@query(LABELS + " SELECT id, avg(CAST(label < 0 AS INT)) AS noise_frequency FROM l GROUP BY id")
def noise_frequency(spark, d):
    return consensus.noise_frequency(runs(spark, d))


@query(LABELS + " SELECT id, " + ", ".join(f"max(CASE WHEN run = {r} THEN label END) AS run_{r:03d}" for r in range(RUNS)) + " FROM l GROUP BY id")
def label_columns(spark, d):
    return consensus.wide(runs(spark, d), list(range(RUNS)))
