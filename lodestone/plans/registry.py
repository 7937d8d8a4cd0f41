"""All queries of the library by name, each with SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import cleaning
from lodestone.operators import algebra, dedup, graph, joins, quality, ranking, transforms, vectors
from lodestone.plans.base import QUERIES, SQL, query
from lodestone.sources.tables import table as t

# --- families and duplicates


@query("""SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS family_size,
    first_value(o_orderkey) OVER w AS representative, o_orderkey = first_value(o_orderkey) OVER w AS is_representative FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, o_totalprice NULLS LAST, o_orderkey)""")
def dedup_representatives(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = dedup.representatives(o, ["o_custkey"], [status, F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey")], "o_orderkey")
    return out.select("o_orderkey", "o_custkey", "family_size", "representative", "is_representative")


@query("""SELECT p_brand, p_type, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_retailprice, p_partkey) AS p_retailprice, count(*) AS family_size
    FROM part GROUP BY p_brand, p_type""")
def family_best(spark, d):
    return dedup.best_of_group(t(spark, d, "part"), ["p_brand", "p_type"], F.col("p_partkey"), ["p_partkey", "p_retailprice"])


@query("SELECT family_size, count(*) AS families FROM (SELECT count(*) AS family_size FROM orders GROUP BY o_custkey) GROUP BY family_size")
def family_size_histogram(spark, d):
    return dedup.size_histogram(t(spark, d, "orders"), ["o_custkey"])


@query("SELECT dense_rank() OVER (ORDER BY p_brand) AS number, 'fam-' || lpad(CAST(dense_rank() OVER (ORDER BY p_brand) AS VARCHAR), 4, '0') AS family, p_brand FROM (SELECT DISTINCT p_brand FROM part)")
def family_numbers(spark, d):
    return algebra.group_numbers(t(spark, d, "part"), ["p_brand"]).select("number", F.format_string("fam-%04d", "number").alias("family"), "p_brand")


@query("""WITH r AS (SELECT l_partkey, l_suppkey, l_quantity, l_orderkey, l_linenumber FROM lineitem),
    g AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_quantity) > 1 AS conflict, median(l_quantity) AS l_quantity, min(l_orderkey) AS l_orderkey FROM r GROUP BY ALL),
    o AS (SELECT l_partkey, l_suppkey, string_agg(CAST(l_orderkey AS VARCHAR), '|' ORDER BY l_orderkey) AS ids FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM r) GROUP BY ALL)
    SELECT l_partkey, l_suppkey, conflict, l_quantity, l_orderkey, CASE WHEN conflict THEN ids ELSE CAST(l_orderkey AS VARCHAR) END AS ids_merged_l_orderkey FROM g JOIN o USING (l_partkey, l_suppkey)""")
def conflict_merge(spark, d):
    x = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber")
    return dedup.merge_conflicts(x, ["l_partkey", "l_suppkey"], "l_quantity", ["l_orderkey"], ["l_orderkey", "l_linenumber"])


@query("""SELECT l_partkey, l_suppkey, count(*) AS n_rows, count(DISTINCT l_quantity) AS n_targets, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem
    GROUP BY ALL HAVING min(l_quantity) <> max(l_quantity)""")
def conflict_report(spark, d):
    return dedup.conflict_report(t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity")


@query("""SELECT round_even(l_quantity, 0) AS l_quantity, round_even(l_discount, 2) AS l_discount, round_even(l_tax, 2) AS l_tax, min(l_orderkey) AS first_key,
    count(*) AS n_rows FROM lineitem GROUP BY 1, 2, 3""")
def approximate_vectors(spark, d):
    return dedup.near_vectors(t(spark, d, "lineitem"), {"l_quantity": 0, "l_discount": 2, "l_tax": 2}, "l_orderkey")


@query("""SELECT a.p_brand, a.p_partkey AS key_a, b.p_partkey AS key_b, round(abs(a.p_retailprice - b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice), 9) AS difference
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
    WHERE abs(a.p_retailprice - b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) <= 0.01""")
def pair_candidates_range(spark, d):
    return dedup.blocked_pairs(t(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice", 0.01, digits=9)


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS seen, coalesce(l.toxic = 1, false) AS flagged FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""")
def overlap_flags(spark, d):
    known = t(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    joined = t(spark, d, "documents").select("doc_id").join(known.withColumn("found", F.lit(True)), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("found", F.lit(False)).alias("seen"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("flagged"))


# --- profiles and statistics

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in [*NUMBERS, "l_returnflag"]))
def profile_null_distinct(spark, d):
    return quality.profile(t(spark, d, "lineitem"), [*NUMBERS, "l_returnflag"])


FLAGS = {"mostly": "CASE WHEN l_orderkey % 300 = 0 THEN l_quantity ELSE 0 END", "even": "l_orderkey % 2", "many": "l_extendedprice", "same": "l_linenumber * 0 + 1"}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS \"column\", count(*) / sum(n) AS distinct_share, max(n) AS top_count, coalesce((array_agg(n ORDER BY n DESC))[2], 0) AS second_count,
    count(*) > 1 AND count(*) / sum(n) <= 0.01 AND max(n) >= 95.0 * (array_agg(n ORDER BY n DESC))[2] AS near_zero FROM (SELECT count(*) AS n FROM lineitem GROUP BY {e})""" for c, e in FLAGS.items()))
def near_zero_variance(spark, d):
    x = t(spark, d, "lineitem").select(*[F.expr(e).cast("double").alias(c) for c, e in FLAGS.items()])
    return quality.near_zero_variance(x, list(FLAGS), 0.01, 95.0)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def correlation_pairs(spark, d):
    return quality.correlations(t(spark, d, "lineitem"), NUMBERS)


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part)
    SELECT p_brand, round(corr(a, b), 6) AS rho FROM r GROUP BY p_brand""")
def spearman_by_group(spark, d):
    ranked = quality.mean_ranks(t(spark, d, "part"), ["p_size", "p_retailprice"], ["p_brand"])
    return ranked.groupBy("p_brand").agg(F.round(F.corr("rank_p_size", "rank_p_retailprice"), 6).alias("rho"))


@query("""SELECT p_brand, count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std_pop, round(quantile_cont(p_retailprice, 0.5), 6) AS median,
    round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 6) AS iqr, round(min(p_retailprice), 6) AS low, round(max(p_retailprice), 6) AS high,
    round(max(p_retailprice) - min(p_retailprice), 6) AS spread FROM part GROUP BY p_brand""")
def stats_pack(spark, d):
    return quality.robust_stats(t(spark, d, "part"), ["p_brand"], "p_retailprice")


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT o_custkey, count(*) AS k, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM n GROUP BY o_custkey)
    SELECT o_custkey, k AS n_categories, round(h, 6) + 0.0 AS entropy, round(CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END, 6) + 0.0 AS evenness FROM e""")
def entropy_by_group(spark, d):
    return quality.entropy(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("""WITH g AS (SELECT l_suppkey, sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) AS wv, sum(l_quantity * l_extendedprice * l_extendedprice) AS wvv, sum(l_quantity * ln(l_extendedprice)) AS wl
    FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity > 0 GROUP BY l_suppkey)
    SELECT l_suppkey, round(wv / w, 4) AS weighted_mean, round(sqrt(greatest(wvv / w - (wv / w) * (wv / w), 0)), 4) AS weighted_std, round(exp(wl / w), 4) AS geometric_mean FROM g""")
def weighted_mean_std(spark, d):
    return quality.weighted(t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("""SELECT o_custkey, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS share_f, round(avg(CAST(o_orderstatus = 'O' AS INT)), 6) AS share_o,
    round(avg(CAST(o_orderstatus NOT IN ('F', 'O') AS INT)), 6) AS share_other FROM orders GROUP BY o_custkey""")
def category_share(spark, d):
    got = algebra.category_shares(t(spark, d, "orders"), "o_custkey", "o_orderstatus", {"f": ["F"], "o": ["O"]})
    return got.select("o_custkey", *[F.round(c, 6).alias(c) for c in ("share_f", "share_o", "share_other")])


# --- transforms


@query("""WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd, quantile_cont(p_retailprice, 0.5) AS med, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS iqr FROM part)
    SELECT p_partkey, round((p_retailprice - m) / sd, 6) + 0.0 AS standard, round((p_retailprice - med) / iqr, 6) + 0.0 AS robust FROM part, s""")
def scaled(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("standard"), F.col("p_retailprice").alias("robust"))
    one = transforms.scaled(p, transforms.standard_scale(p, ["standard"]))
    both = transforms.scaled(one, transforms.robust_scale(p, ["robust"]))
    return both.select("p_partkey", (F.round("standard", 6) + 0.0).alias("standard"), (F.round("robust", 6) + 0.0).alias("robust"))


@query("""SELECT p_partkey, CAST(p_partkey % 5 AS INTEGER) AS fold, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 35 THEN 2 ELSE 3 END AS bin,
    CAST(p_brand = 'Brand#11' AS INTEGER) AS is_brand_11 FROM part""")
def folds_and_bins(spark, d):
    size = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("fold"), F.when(size <= 10, 0).when(size <= 20, 1).when(size <= 35, 2).otherwise(3).alias("bin"), (F.col("p_brand") == "Brand#11").cast("int").alias("is_brand_11"))


@query("SELECT l_orderkey, l_linenumber, round(abs(l_quantity - p_size), 6) AS diff, round(l_quantity / p_size, 6) AS ratio, round((l_quantity + 2 * p_size) / 3, 6) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey")
def pairwise_algebra(spark, d):
    both = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    two = both.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("M__n"), F.col("p_size").alias("H__n"), F.lit(1).alias("u"), F.lit(2).alias("v"))
    got = algebra.pairwise(two, weights=("u", "v"))
    return got.select("l_orderkey", "l_linenumber", *[F.round(f"mh__n__{k}", 6).alias(n) for k, n in (("diff", "diff"), ("ratio", "ratio"), ("wmean", "mean"))])


# --- joins and sets


@query("SELECT count(*) AS n_left, count(l.doc_id) AS n_matched, count(*) - count(l.doc_id) AS n_missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def join_audit(spark, d):
    known = t(spark, d, "labels").select("doc_id").distinct().withColumn("found", F.lit(1))
    both = t(spark, d, "documents").select("doc_id").join(known, "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_left"), F.count("found").alias("n_matched"), (F.count(F.lit(1)) - F.count("found")).alias("n_missing"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_missing(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT r_name, c_mktsegment, o_orderpriority FROM region, (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT o_orderpriority FROM orders)""")
def parameter_grid(spark, d):
    sides = [t(spark, d, "region").select("r_name"), t(spark, d, "customer").select("c_mktsegment").distinct(), t(spark, d, "orders").select("o_orderpriority").distinct()]
    return reduce(lambda a, b: a.crossJoin(b), sides)  # grids of a few names each, which is the feature


@query("""SELECT p_partkey, n_nationkey AS nearest, abs(p_size - n_nationkey) AS gap FROM part, nation
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size - n_nationkey), n_nationkey) = 1""")
def nearest_key_lookup(spark, d):
    keys = t(spark, d, "nation").select(F.col("n_nationkey").alias("p_size"), F.col("n_nationkey").alias("nearest"))
    return joins.nearest(t(spark, d, "part").select("p_partkey", "p_size"), keys, "p_size", "nearest").select("p_partkey", "nearest", "gap")


@query("""SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def dimension_lookup(spark, d):
    per = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance"))
    named = per.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("n_name", "r_name").agg(F.sum("customers").alias("customers"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_overlap(spark, d):
    return t(spark, d, "documents").select("doc_id").intersect(t(spark, d, "labels").where("quality = 1").select("doc_id"))


@query(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS name, {c} AS value FROM lineitem" for c in NUMBERS))
def melt_wide(spark, d):
    return t(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], NUMBERS, "name", "value")


# --- windows and rankings


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place, round(1 - (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1) / count(*) OVER (PARTITION BY c_nationkey), 6) AS percentile FROM customer WHERE c_acctbal > 0")
def rank_eligible(spark, d):
    c = t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_acctbal")
    return ranking.places(c, ["c_nationkey"], "c_acctbal", ["c_custkey"]).select("c_custkey", "place", F.round("percentile", 6).alias("percentile"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 3600 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events FROM s GROUP BY ALL""")
def gap_sessions(spark, d):
    e = t(spark, d, "events").withColumn("at", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6)
    return ranking.sessions(e, "user_id", "at", ["ts", "event_id"], 3600).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"))


@query("""WITH m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1), e AS (SELECT event_id, event_type, abs(value - c) AS dev FROM events JOIN m USING (event_type)),
    s AS (SELECT event_type, median(dev) AS mad FROM e GROUP BY 1) SELECT event_id, event_type FROM e JOIN s USING (event_type) WHERE dev > greatest(0.001, 1.4826 * 2.5 * mad)""")
def mad_outliers(spark, d):
    return ranking.outliers(t(spark, d, "events"), "event_type", "value", 2.5, 0.001).select("event_id", "event_type")


RANKED = """WITH s AS (SELECT l_suppkey AS s, sum(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT s, 'revenue' AS ranking, row_number() OVER (ORDER BY round(v, 2) DESC, s) AS place FROM s UNION ALL SELECT s, 'volume', row_number() OVER (ORDER BY n DESC, s) FROM s
    UNION ALL SELECT s_suppkey, 'balance', row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) FROM supplier)"""


def supplier_rankings(spark, d, k):
    """The first ``k`` places of three rankings of suppliers."""
    per = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"), F.count(F.lit(1)).alias("n"))
    bal = t(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("v"))
    each = [per.select("s", F.lit("revenue").alias("ranking"), "v"), per.select("s", F.lit("volume"), F.col("n").cast("double")), bal.select("s", F.lit("balance"), "v")]
    place = F.row_number().over(Window.partitionBy("ranking").orderBy(F.desc("v"), "s"))
    placed = reduce(lambda a, b: a.union(b), each).withColumn("n", place).where(F.col("n") <= k)  # each task keeps its first ``k`` before the shuffle
    return placed.select("s", "ranking", F.col("n").cast("long").alias("place"))


@query(RANKED + """, k AS (SELECT * FROM r WHERE place <= 40), i AS (SELECT DISTINCT s FROM k), n AS (SELECT unnest(['revenue', 'volume', 'balance']) AS ranking),
    f AS (SELECT i.s, coalesce(k.place, 1e6) AS place FROM i CROSS JOIN n LEFT JOIN k ON k.s = i.s AND k.ranking = n.ranking)
    SELECT s, CAST(sum(place) AS DOUBLE) AS borda, CAST(sum(CASE WHEN place < 1e6 THEN 1 ELSE 0 END) AS BIGINT) AS votes FROM f GROUP BY s""")
def borda_votes(spark, d):
    return ranking.borda(supplier_rankings(spark, d, 40), "s", "ranking", "place", 3)


@query(RANKED + " SELECT ranking, k AS panel, s FROM r, (SELECT unnest([10, 20, 50]) AS k) WHERE place <= k")
def nested_panels(spark, d):
    got = supplier_rankings(spark, d, 50).withColumn("panel", F.explode(F.array(F.lit(10), F.lit(20), F.lit(50))))
    return got.where("place <= panel").select("ranking", "panel", "s")


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_returnflag) AS i FROM s)
    SELECT l_suppkey, max(CASE WHEN i = 1 THEN l_returnflag END) AS best, max(CASE WHEN i = 1 THEN q END) AS best_score, max(CASE WHEN i = 2 THEN q END) AS second_score,
    round(max(CASE WHEN i = 1 THEN q END) - max(CASE WHEN i = 2 THEN q END), 6) AS margin FROM r GROUP BY l_suppkey""")
def best_two_margin(spark, d):
    s = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return ranking.best_two(s, "l_suppkey", "l_returnflag", F.col("q"))


@query("""WITH s AS (SELECT p_brand, round(sum(p_retailprice), 2) AS v FROM part GROUP BY 1), w AS (SELECT *, coalesce(sum(v) OVER (ORDER BY v DESC, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(v) OVER () AS a FROM s)
    SELECT p_brand, v FROM w WHERE b < 0.5 * a""")
def cumulative_cutoff(spark, d):
    s = t(spark, d, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("v"))
    return ranking.share_until(s, "p_brand", "v", 0.5).select("p_brand", "v")


# --- rules and text


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 5000 AND c_mktsegment = 'BUILDING' THEN 'first' WHEN c_acctbal >= 5000 THEN 'second' ELSE 'third' END AS tier, count(*) AS n FROM customer GROUP BY 1""")
def eligibility_tiers(spark, d):
    b = F.col("c_acctbal")
    tier = algebra.tiers([(b < 0, "debt"), ((b >= 5000) & (F.col("c_mktsegment") == "BUILDING"), "first"), (b >= 5000, "second")], "third")
    return t(spark, d, "customer").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CAST(nullif(regexp_extract(url, '/([0-9]+)$', 1), '') AS BIGINT) AS number, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def id_extract(spark, d):
    return t(spark, d, "pages").select("page_id", cleaning.trailing_id(F.col("url"), "/").alias("number"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


# --- vectors and graphs


@query("SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS mean, min(CAST(x AS DOUBLE)) AS low, max(CAST(x AS DOUBLE)) AS high FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def pool_vectors(spark, d):
    return vectors.pooled(t(spark, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6) + 0.0)


@query("""WITH a AS (SELECT vec_id AS a_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 4), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings)
    SELECT vec_id, CAST(a_id AS VARCHAR) AS anchor, round(list_distance(w, v), 6) AS distance FROM e, a QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(w, v), CAST(a_id AS VARCHAR)) = 1""")
def nearest_anchor_distance(spark, d):
    e = t(spark, d, "embeddings")
    anchors = [(str(r["vec_id"]), [float(x) for x in r["embedding"]]) for r in e.where("vec_id < 4").select("vec_id", "embedding").collect()]  # the four named prototypes
    return vectors.nearest_anchor(e, "vec_id", "embedding", anchors).withColumn("distance", F.round("distance", 6))


PAIRS = "(SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n_shared FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey GROUP BY 1, 2)"


@query(f"SELECT a, b, n_shared FROM {PAIRS}")
def shared_neighbour_pairs(spark, d):
    return graph.shared_neighbours(t(spark, d, "lineitem"), "l_partkey", "l_orderkey")


@query(f"SELECT CASE n_shared WHEN 1 THEN 'corner' WHEN 2 THEN 'edge' ELSE 'face' END AS kind, count(*) AS pairs FROM {PAIRS} GROUP BY 1")
def sharing_types(spark, d):
    return graph.sharing_types(graph.shared_neighbours(t(spark, d, "lineitem"), "l_partkey", "l_orderkey"))


@query("SELECT degree, count(*) AS nodes FROM (SELECT count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY l_partkey) GROUP BY 1")
def degree_stats(spark, d):
    return graph.degrees(t(spark, d, "lineitem"), "l_partkey", "l_orderkey").groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT l_suppkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY l_suppkey, l_returnflag QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) = 1")
def majority_vote(spark, d):
    return graph.majority(t(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


def queries() -> dict:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)


def _all() -> None:
    """Other modules put their queries down when they are imported."""
    from lodestone.plans import cleaning_queries, cluster_queries, family_queries, join_queries, list_queries, score_queries, selection_queries, shaping_queries, text_queries  # noqa: F401
