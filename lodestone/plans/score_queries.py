"""Queries of scores, selections, metrics and windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import scoring
from lodestone.plans.base import query
from lodestone.sources.tables import table as t
from lodestone.streaming import windows


@query("""WITH r AS (SELECT p_retailprice AS v FROM part WHERE p_brand = 'Brand#11'), c AS (SELECT p_partkey, count(CASE WHEN v < p_retailprice THEN 1 END) AS smaller, count(CASE WHEN v = p_retailprice THEN 1 END) AS equal, count(*) AS n FROM part, r GROUP BY ALL)
    SELECT p_partkey, round((2 * smaller + equal) / (2.0 * n), 9) AS percentile, round((n - smaller + 1) / (n + 1.0), 9) AS survival FROM c""")
def against_reference(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice", "p_brand")
    got = scoring.against_reference(p, "p_retailprice", p.where("p_brand = 'Brand#11'"), "p_partkey")
    return got.select("p_partkey", F.round("percentile", 9).alias("percentile"), F.round("survival", 9).alias("survival"))


@query("SELECT p_partkey, p_brand, p_retailprice FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2) ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def capped_head(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return scoring.capped_head(p, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 2, 30)


@query("""WITH s AS (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_suppkey) AS place, count(*) OVER (PARTITION BY l_returnflag) AS n FROM s)
    SELECT l_suppkey, round(count(CASE WHEN place <= ceil(n * 0.2) THEN 1 END) / (SELECT count(DISTINCT l_returnflag) FROM lineitem), 9) AS frequency FROM r GROUP BY 1""")
def top_fraction_frequency(spark, d):
    runs = t(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return scoring.top_fraction_frequency(runs, "l_returnflag", "l_suppkey", "q", 0.2).withColumn("frequency", F.round("frequency", 9))


@query("""WITH b AS (SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1)
    SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_nationkey) AS rank FROM b""")
def best_per_group(spark, d):
    return scoring.best_per_group(t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_custkey", "c_acctbal")


@query("""WITH a AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 4) SELECT vec_id, round(max(least(greatest(list_dot_product(CAST(embedding AS DOUBLE[]), v), 0), 1)), 6) AS similarity FROM embeddings, a GROUP BY vec_id""")
def best_kernel(spark, d):
    e = t(spark, d, "embeddings")
    anchors = [[float(x) for x in r["embedding"]] for r in e.where("vec_id < 4").select("embedding").collect()]  # the four named prototypes
    return scoring.best_kernel(e, "vec_id", "embedding", anchors).withColumn("similarity", F.round("similarity", 6))


@query("""WITH s AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) / 500000 AS a, CASE WHEN count(*) > 2 THEN least(count(*) / 20.0, 1) END AS b FROM orders GROUP BY ALL),
    f AS (SELECT o_custkey, o_orderstatus, (a * 0.6 + coalesce(b * 0.4, 0)) / (0.6 + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END) AS score FROM s)
    SELECT o_custkey, o_orderstatus, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderstatus) = 1""")
def best_prototype(spark, d):
    n = F.count(F.lit(1))
    s = t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg((F.avg("o_totalprice") / 500000).alias("a"), F.when(n > 2, F.least(n / 20.0, F.lit(1.0))).alias("b"))
    return scoring.best_prototype(s, "o_custkey", "o_orderstatus", [("a", 0.6), ("b", 0.4)]).withColumn("score", F.round("score", 9))


@query("SELECT round(quantile_cont(p_retailprice, 0.1), 6) AS scale FROM part WHERE p_size > 10")
def distance_scale(spark, d):
    got = scoring.distance_scale(t(spark, d, "part"), "p_retailprice", F.col("p_size") > 10)
    return spark.createDataFrame([(round(got, 6),)], "scale double")


@query("""SELECT p_brand, count(*) AS n, round(1 - avg((p_retailprice - 40 * p_size) ** 2) / var_pop(p_retailprice), 6) AS r2, round(avg(abs(p_retailprice - 40 * p_size)), 6) AS mae, round(sqrt(avg((p_retailprice - 40 * p_size) ** 2)), 6) AS rmse FROM part GROUP BY p_brand""")
def regression_metrics(spark, d):
    got = scoring.regression_metrics(t(spark, d, "part").withColumn("guess", 40 * F.col("p_size")), ["p_brand"], "p_retailprice", "guess")
    return got.select("p_brand", "n", *[F.round(c, 6).alias(c) for c in ("r2", "mae", "rmse")])


@query("SELECT count(*) AS n, round(avg(CASE WHEN p_size <= 40 THEN 1 / p_size ELSE 0 END), 9) AS mrr, round(avg(CAST(p_size <= 5 AS INT)), 9) AS recall_at_5, round(avg(CAST(p_size <= 20 AS INT)), 9) AS recall_at_20 FROM part")
def retrieval_metrics(spark, d):
    p = t(spark, d, "part").select(F.when(F.col("p_size") <= 40, F.col("p_size")).alias("rank"))
    return scoring.retrieval_metrics(p, "rank", [5, 20]).select("n", *[F.round(c, 9).alias(c) for c in ("mrr", "recall_at_5", "recall_at_20")])


@query("""WITH e AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part) SELECT p_partkey, round(((p_size - a) / (b - a) + (p_retailprice - c) / (d - c)) / 2, 9) AS fused FROM part, e""")
def min_max_fused(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return scoring.min_max_fused(p, "p_partkey", ["p_size", "p_retailprice"]).withColumn("fused", F.round("fused", 9))


@query("SELECT p_brand, round(sum(p_retailprice), 6) AS total FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3) GROUP BY p_brand")
def sum_of_top(spark, d):
    return scoring.sum_of_top(t(spark, d, "part"), "p_brand", "p_retailprice", 3).withColumn("total", F.round("total", 6))


@query("SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, 0 AS x, count(*) AS total FROM orders GROUP BY 1")
def pivot_counts(spark, d):
    o = t(spark, d, "orders").select("o_orderpriority", F.lower("o_orderstatus").alias("s"))
    return scoring.pivot_counts(o, ["o_orderpriority"], "s", ["f", "o", "x"])


SECONDS = "CAST(floor(epoch({})) AS BIGINT)"


def seconds(c: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{c}` AS TIMESTAMP_NTZ))").alias(c)


@query(f"SELECT {SECONDS.format('ts')} // 3600 * 3600 AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    got = windows.tumbling(t(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    return got.select(seconds("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"SELECT {SECONDS.format('ts')} // 1800 * 1800 - k * 1800 AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def sliding_windows(spark, d):
    return windows.sliding(t(spark, d, "events"), "ts", "1 hour", "30 minutes", [], [F.count(F.lit(1)).alias("n")]).select(seconds("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 7200 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, i""")
def session_windows(spark, d):
    return windows.sessions(t(spark, d, "events"), "ts", "2 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]).select("user_id", seconds("start"), "n")
