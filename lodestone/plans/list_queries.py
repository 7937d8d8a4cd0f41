"""Queries of lists, keys, flags and ranks within rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import lists
from lodestone.plans.base import query
from lodestone.sources.tables import table as t


@query("SELECT vec_id, list_sum([CAST(x AS DOUBLE) FOR x, i IN embedding IF i % 2 = 1]) AS even, len(list_concat([x FOR x, i IN embedding IF i % 2 = 0], embedding)) AS joined FROM embeddings")
def component_subspaces(spark, d):
    e = F.col("embedding")
    sum_ = F.aggregate(lists.subspace(e, "even"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t(spark, d, "embeddings").select("vec_id", sum_.alias("even"), F.size(lists.joined_vectors(lists.subspace(e, "odd"), e)).alias("joined"))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f', l_quantity) || '|' || CASE WHEN l_linenumber = 7 THEN 'NA' ELSE printf('%.2f', l_tax) END AS signature FROM lineitem")
def text_keys(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_linenumber") < 7, F.col("l_tax")).alias("tax"))
    return x.select("l_orderkey", "l_linenumber", lists.signature(["l_quantity", "tax"], 2).alias("signature"))


@query("""WITH o AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS s FROM orders GROUP BY 1) SELECT o_custkey, list_has_any(s, ['1-URGENT', '2-HIGH']) AS risk_soon, list_contains(s, '5-LOW') AS risk_late, CASE WHEN list_contains(s, '1-URGENT') AND list_contains(s, '2-HIGH') THEN '1-URGENT;2-HIGH'
    WHEN list_contains(s, '1-URGENT') THEN '1-URGENT' WHEN list_contains(s, '2-HIGH') THEN '2-HIGH' ELSE '' END AS risk_elements FROM o""")
def risk_flags(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return lists.risk_flags(o, F.col("s"), {"soon": ["1-URGENT", "2-HIGH"], "late": ["5-LOW"]}, ["soon"], flag_only=True).drop("s")


@query("""WITH n AS (SELECT *, row_number() OVER () AS id FROM lineitem), x AS (SELECT id, unnest([l_quantity, l_discount * 500, l_tax * 500]) AS v, l_quantity AS a, l_discount * 500 AS b, l_tax * 500 AS c FROM n),
    r AS (SELECT id, CAST(a < v AS INT) + CAST(b < v AS INT) + CAST(c < v AS INT) + (CAST(a = v AS INT) + CAST(b = v AS INT) + CAST(c = v AS INT) + 1) / 2 AS r FROM x) SELECT round(mean_rank, 9) AS mean_rank, top, count(*) AS n FROM (SELECT id, avg(r) AS mean_rank, max(r) AS top FROM r GROUP BY id) GROUP BY ALL""")
def ranks_across_columns(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"), (F.col("l_tax") * 500).alias("c"))
    got = lists.row_ranks(x, ["a", "b", "c"])
    mean = F.round((F.col("rank_a") + F.col("rank_b") + F.col("rank_c")) / 3, 9).alias("mean_rank")
    return got.groupBy(mean, F.greatest("rank_a", "rank_b", "rank_c").alias("top")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT round(p_retailprice / 100, 1) AS ratio, p_size % 3 AS a, p_size % 2 AS b, count(*) AS n FROM part GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY n DESC, a, b) AS place FROM c""")
def kinds_by_frequency(spark, d):
    x = t(spark, d, "part").select((F.col("p_retailprice") / 100).alias("ratio"), (F.col("p_size") % 3).alias("a"), (F.col("p_size") % 2).alias("b"))
    return lists.by_frequency(x, "ratio", ["a", "b"], 1)


@query("SELECT p_brand, p_partkey, p_size, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) = 1")
def best_by_ladder(spark, d):
    return lists.best_by(t(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), "p_brand", [("p_size", True), ("p_retailprice", False)], "p_partkey")


@query("""WITH a AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal END AS c_acctbal, c_nationkey FROM customer WHERE c_custkey % 5 > 0)
    SELECT c_custkey, coalesce(b.c_acctbal, a.c_acctbal) AS c_acctbal, c_mktsegment, c_nationkey FROM a FULL JOIN b USING (c_custkey)""")
def overridden_rows(spark, d):
    c = t(spark, d, "customer")
    a = c.where("c_custkey % 3 > 0").select("c_custkey", "c_acctbal", "c_mktsegment")
    b = c.where("c_custkey % 5 > 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, -F.col("c_acctbal")).alias("c_acctbal"), "c_nationkey")
    return lists.overridden(a, b, "c_custkey")
