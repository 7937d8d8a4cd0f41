"""Queries of joins with promises, of sets and of checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import checks, joins
from lodestone.plans.base import query
from lodestone.sources.tables import table as t


@query("SELECT n_nationkey, n_name, s_count FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS s_count FROM supplier GROUP BY 1) USING (n_nationkey)")
def one_to_one_join(spark, d):
    per = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s_count"))
    return joins.one_to_one(t(spark, d, "nation").select("n_nationkey", "n_name"), per, ["n_nationkey"])


@query("""SELECT o_custkey, n_f, n_o, n_p FROM (SELECT o_custkey, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT o_custkey, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (o_custkey)
    FULL JOIN (SELECT o_custkey, count(*) AS n_p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (o_custkey)""")
def outer_fold(spark, d):
    per = lambda s: t(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias(f"n_{s.lower()}"))
    return joins.outer_fold([per("F"), per("O"), per("P")], ["o_custkey"])


@query("SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, coalesce(a.segment, b.segment) AS segment, customers, suppliers FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment AS segment, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS n_nationkey, 'BUILDING' AS segment, count(*) AS suppliers FROM supplier GROUP BY ALL) b ON a.n_nationkey = b.n_nationkey AND a.segment = b.segment")
def composite_outer_join(spark, d):
    a = t(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey"), F.lit("BUILDING").alias("segment")).agg(F.count(F.lit(1)).alias("suppliers"))
    return joins.outer_fold([a, b], ["n_nationkey", "segment"])


@query("WITH x AS (SELECT doc_id, nullif(lang, 'de') AS lang, n_chars FROM documents) SELECT doc_id, lang, n_chars, count(*) OVER (PARTITION BY lang) AS n_lang, max(n_chars) OVER (PARTITION BY lang) AS longest FROM x")
def null_safe_group_values(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("de")).alias("lang"), "n_chars")
    return joins.group_values(x, ["lang"], [F.count(F.lit(1)).alias("n_lang"), F.max("n_chars").alias("longest")])


@query("WITH c AS (SELECT p_brand, p_size FROM part GROUP BY ALL HAVING min(p_retailprice) <> max(p_retailprice)) SELECT p_partkey, p_brand, p_size, p_retailprice FROM part JOIN c USING (p_brand, p_size)")
def conflict_join_back(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    bad = p.groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")).where("low <> high")
    return joins.null_safe(p, bad.select("p_brand", "p_size"), ["p_brand", "p_size"], "inner")


@query("""SELECT p_partkey, CASE WHEN abs(p_size - n_nationkey) <= 1 THEN n_nationkey END AS n_nationkey, CASE WHEN abs(p_size - n_nationkey) <= 1 THEN abs(p_size - n_nationkey) END AS gap FROM part, nation
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size - n_nationkey), n_nationkey) = 1""")
def exact_or_next_lookup(spark, d):
    keys = t(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").alias("p_size"))
    return joins.nearest(t(spark, d, "part").select("p_partkey", "p_size"), keys, "p_size", "n_nationkey", 1).select("p_partkey", "n_nationkey", "gap")


@query("""SELECT o_custkey, o_totalprice, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey) = 1""")
def preferred_lookup(spark, d):
    return joins.preferred(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["2-HIGH", "1-URGENT"], "o_totalprice", [F.col("o_orderkey")])


@query("""WITH x AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN n_name END AS n_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey),
    g AS (SELECT c_nationkey, min(n_name) AS name, count(DISTINCT n_name) AS k FROM x WHERE n_name IS NOT NULL GROUP BY 1)
    SELECT c_custkey, CASE WHEN n_name IS NULL AND k = 1 THEN name ELSE n_name END AS n_name, CASE WHEN n_name IS NOT NULL THEN 'kept' WHEN k IS NULL THEN 'unmatched' WHEN k = 1 THEN 'repaired' ELSE 'ambiguous' END AS repair FROM x LEFT JOIN g USING (c_nationkey)""")
def repair_join(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = both.select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("n_name"))
    return joins.repaired(x, F.col("n_name").isNull(), "c_nationkey", ["n_name"]).select("c_custkey", "n_name", "repair")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def side_by_side(spark, d):
    o = t(spark, d, "orders")
    return joins.side_by_side(o.select("o_orderkey", "o_custkey", "o_totalprice"), o.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", "o_custkey")


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def aligned_union(spark, d):
    c = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return joins.aligned_union([c, t(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))])


@query("""SELECT 'unique c_custkey' AS "check", count(*) = 0 AS ok, count(*) AS found FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1)
    UNION ALL SELECT 'no common doc_id', count(*) = 0, count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'covers doc_id', count(*) = 0, count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'rows are kept or removed', true, 0 UNION ALL SELECT 'balance', count(*) = 0, count(*) FROM customer WHERE NOT c_acctbal >= 0""")
def table_checks(spark, d):
    c, docs, labels = t(spark, d, "customer"), t(spark, d, "documents"), t(spark, d, "labels")
    found = [checks.unique_keys(c, ["c_custkey"]), checks.no_overlap(docs, labels, ["doc_id"]), checks.covers(docs, labels, ["doc_id"]), checks.reconciles(c, c.where("c_acctbal >= 0"), c.where("c_acctbal < 0")), checks.all_rows(c, "balance", F.col("c_acctbal") >= 0)]
    return checks.report(spark, found)


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_labelled' WHEN quality IS DISTINCT FROM 1 THEN 'poor' ELSE 'good' END AS status FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""")
def outcome_report(spark, d):
    labels = t(spark, d, "labels")
    return checks.outcomes(t(spark, d, "documents"), "doc_id", [("not_labelled", labels), ("poor", labels.where("quality = 1"))], "good")
