"""Queries of wide tables, feature selection, power transforms, robustness and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import columns, gram, power, prototypes, quality, robustness, selection
from lodestone.plans.base import query
from lodestone.plans.cleaning_queries import dropped
from lodestone.sources.tables import table as t

# --- three linked columns: a goes for b, and c for a though that is gone

CHAIN = """WITH x AS (SELECT l_quantity AS a, l_quantity + 220 * l_discount AS b, CASE WHEN l_linenumber < 7 THEN l_quantity + 270 * l_tax END AS c,
    (l_quantity + 270 * l_tax) / 10 AS d, l_quantity + 220 * l_discount + l_extendedprice / 1e6 AS y FROM lineitem)"""
FIRST = "SELECT 'a' AS feature, 'b' AS kept_for FROM x HAVING "
SECOND = "SELECT '{0}', 'a' FROM x HAVING "


def chain(spark, d):
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    c = F.when(F.col("l_linenumber") < 7, q + 270 * tax)
    return t(spark, d, "lineitem").select(q.alias("a"), (q + 220 * disc).alias("b"), c.alias("c"), ((q + 270 * tax) / 10).alias("d"), (q + 220 * disc + F.col("l_extendedprice") / 1e6).alias("y"))


@query(CHAIN + FIRST.replace("SELECT", " SELECT", 1) + "corr(a, b) >= 0.85 AND var_samp(b) > var_samp(a) AND corr(b, c) < 0.85 UNION ALL " + SECOND.format("c") + "corr(a, c) >= 0.85 AND count(c) < count(a)")
def collinear_chain_a(spark, d):
    return dropped(spark, columns.collinear_by_missing(chain(spark, d), ["a", "b", "c"], 0.85))


@query(CHAIN + FIRST.replace("SELECT", " SELECT", 1) + "corr(a, b) >= 0.85 AND corr(b, y) > corr(a, y) AND corr(b, d) < 0.85 UNION ALL " + SECOND.format("d") + "corr(a, d) >= 0.85 AND corr(a, y) > corr(d, y)")
def collinear_chain_b(spark, d):
    return dropped(spark, columns.collinear_by_target(chain(spark, d), ["b", "d", "a"], "y", 0.85))


@query(CHAIN + FIRST.replace("SELECT", " SELECT", 1) + "corr(a, b) > 0.85 AND var_pop(b) > var_pop(a) AND corr(b, d) < 0.85 UNION ALL " + SECOND.format("d") + "corr(a, d) > 0.85 AND var_pop(a) > var_pop(d)")
def collinear_chain_c(spark, d):
    return dropped(spark, columns.collinear_by_variance(chain(spark, d), ["a", "b", "d"], 0.85))


# --- wide tables


@query("""WITH e AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT 'e' || x.i AS a, 'e' || y.i AS b, round(corr(x.v, y.v), 6) AS r FROM e x JOIN e y ON x.vec_id = y.vec_id AND x.i < y.i GROUP BY ALL""")
def wide_correlations(spark, d):
    e = t(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return quality.correlations(e, e.columns)


EIGEN = ", e AS (SELECT *, (a + c) / 2 + sqrt((a - c) ** 2 / 4 + b * b) AS high, (a + c) / 2 - sqrt((a - c) ** 2 / 4 + b * b) AS low FROM g)"


@query(f"""WITH g AS (SELECT var_samp(p_size) AS a, covar_samp(p_size, p_retailprice) AS b, var_samp(p_retailprice) AS c, avg(p_size) AS mx, avg(p_retailprice) AS my FROM part){EIGEN},
    v AS (SELECT *, b / sqrt(b * b + (high - a) ** 2) AS x, (high - a) / sqrt(b * b + (high - a) ** 2) AS y FROM e), s AS (SELECT *, CASE WHEN abs(y) > abs(x) THEN sign(y) ELSE sign(x) END AS turn FROM v)
    SELECT p_partkey, round(turn * ((p_size - mx) * x + (p_retailprice - my) * y), 4) AS first, round(high, 4) AS variance, round(high / (high + low), 6) AS share FROM part, s""")
def principal_component(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    model = gram.principal(p, ["p_size", "p_retailprice"], 1)
    return gram.projected(p, model).select("p_partkey", F.round(F.col("components")[0], 4).alias("first"), F.lit(round(float(model.values[0]), 4)).alias("variance"), F.lit(round(float(model.shares[0]), 6)).alias("share"))


@query(f"WITH g AS (SELECT sum(p_size * p_size) AS a, sum(p_size * p_retailprice) AS b, sum(p_retailprice ** 2) AS c FROM part){EIGEN} SELECT 1 AS place, round(sqrt(high), 4) AS value, round(high / (high + low), 6) AS share FROM e UNION ALL SELECT 2, round(sqrt(low), 4), round(low / (high + low), 6) FROM e")
def singular_values(spark, d):
    model = gram.truncated(t(spark, d, "part"), ["p_size", "p_retailprice"], 2)
    return spark.createDataFrame([(i + 1, round(float(v), 4), round(float(s), 6)) for i, (v, s) in enumerate(zip(model.values, model.shares, strict=True))], "place int, value double, share double")


# --- selection of features


@query("""WITH p AS (SELECT l_linenumber AS x, floor(l_quantity / 10) AS y, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT x, y, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM p)
    SELECT 'line' AS a, 'tens' AS b, round(sum(p * ln(p / (px * py))), 9) AS information FROM s""")
def mutual_information(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), F.floor(F.col("l_quantity") / 10).alias("tens"))
    got = selection.mutual_information(x, ["line", "tens"], cuts={c: [float(i) for i in range(10)] for c in x.columns})
    return spark.createDataFrame([("line", "tens", round(got["line", "tens"], 9))], "a string, b string, information double")


LINE = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query(None)
def mrmr_features(spark, d):
    x = t(spark, d, "lineitem").select("l_linenumber", *LINE, (F.col("l_quantity") * 2).alias("twice"))
    taken = selection.mrmr(x, [*LINE[:3], "twice", "l_linenumber"], "l_extendedprice", 4)
    return spark.createDataFrame([(i + 1, c, round(s, 9)) for i, (c, s) in enumerate(taken)], "place int, feature string, score double")


@query(None)
def permutation_importance(spark, d):
    x = t(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    coef, intercept = selection.linear(x, LINE[:3], "l_extendedprice")
    predict = lambda c: sum((float(w) * v for w, v in zip(coef, c, strict=True)), F.lit(intercept))
    return selection.permutation_importance(x, "id", LINE[:3], "l_extendedprice", predict, repeats=3)


@query("""WITH m AS (SELECT r, f, round(abs(CASE f WHEN 0 THEN corr(l_quantity, l_extendedprice) WHEN 1 THEN corr(l_discount, l_extendedprice) ELSE corr(l_tax, l_extendedprice) END), 12) AS c
        FROM lineitem, range(10) a(r), range(3) b(f) WHERE (l_orderkey * 7 + r * 3) % 10 < 7 GROUP BY r, f), p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c DESC, f) AS place FROM m)
    SELECT ['l_quantity', 'l_discount', 'l_tax'][f + 1] AS feature, avg(CAST(place <= 2 AS INT)) AS frequency, round(avg(c), 9) AS mean_r FROM p GROUP BY f""")
def stability_selection(spark, d):
    got = selection.stability(t(spark, d, "lineitem"), LINE[:3], "l_extendedprice", lambda run: (F.col("l_orderkey") * 7 + run * 3) % 10 < 7, runs=10, top=2)
    return got.withColumn("mean_r", F.round("mean_r", 9))


BEND = "CASE WHEN v >= 0 THEN CASE WHEN p = 0 THEN ln(v + 1) ELSE ((v + 1) ** p - 1) / p END ELSE CASE WHEN p = 2 THEN -ln(1 - v) ELSE -((1 - v) ** (2 - p) - 1) / (2 - p) END END"


@query(f"""WITH x AS (SELECT 'price' AS c, p_retailprice / 100 AS v FROM part UNION ALL SELECT 'size', p_size FROM part), g AS (SELECT i * 0.25 - 3 AS p FROM range(25) r(i)),
    l AS (SELECT c, p, -count(*) / 2 * ln(var_pop({BEND})) + (p - 1) * sum(sign(v) * ln(abs(v) + 1)) AS likelihood FROM x, g GROUP BY c, p) SELECT c AS feature, CAST(p AS DOUBLE) AS exponent FROM l QUALIFY row_number() OVER (PARTITION BY c ORDER BY likelihood DESC, p) = 1""")
def power_exponents(spark, d):
    p = t(spark, d, "part").select((F.col("p_retailprice") / 100).alias("price"), F.col("p_size").alias("size"))
    return spark.createDataFrame(list(power.fit(p, ["price", "size"], -3.0, 3.0, 25, 1).items()), "feature string, exponent double")


@query(f"WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS v, p FROM customer, (SELECT unnest([0.0, 2.0, 0.7]) AS p)) SELECT c_custkey, round(sum({BEND}), 6) AS bent FROM x GROUP BY 1")
def power_transformed(spark, d):
    v = F.col("c_acctbal") / 1000
    each = t(spark, d, "customer").select("c_custkey", *[v.alias(c) for c in "abc"])
    return power.powered(each, {"a": 0.0, "b": 2.0, "c": 0.7}).select("c_custkey", F.round(F.col("a") + F.col("b") + F.col("c"), 6).alias("bent"))


# --- robustness and portfolios

WEIGHTS = [{"size": 1.0, "price": 1.0, "brand": 1.0}, {"size": 2.0, "price": 1.0, "brand": 1.0}, {"size": 1.0, "price": 3.0, "brand": 0.5}]
PARTS = "WITH p AS (SELECT p_partkey, abs(p_size - 10 * k) / 10.0 AS size, abs(p_retailprice - 900 - 20 * k) / 50 AS price, (p_partkey * k) % 7 / 7.0 AS brand, p_brand FROM part, range(1, 4) r(k))"


def parts(spark, d):
    k, p = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"), t(spark, d, "part")
    x = p.select("p_partkey", "p_size", "p_retailprice", "p_brand", k)
    return x.select("p_partkey", (F.abs(F.col("p_size") - 10 * F.col("k")) / 10).alias("size"), (F.abs(F.col("p_retailprice") - 900 - 20 * F.col("k")) / 50).alias("price"), (F.col("p_partkey") * F.col("k") % 7 / 7).alias("brand"), "p_brand")


@query(
    PARTS
    + ", w AS (SELECT * FROM (VALUES "
    + ", ".join(f"({w['size'] / sum(w.values())}::DOUBLE, {w['price'] / sum(w.values())}::DOUBLE, {w['brand'] / sum(w.values())}::DOUBLE)" for w in WEIGHTS)
    + """) x(ws, wp, wb), (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS ss), (SELECT unnest([0.5, 1.0])::DOUBLE AS sp)),
    s AS (SELECT p_partkey, p_brand, ws, wp, wb, ss, sp, max(ws * exp(-((size / ss) ** 2)) + wp * exp(-((price / sp) ** 2)) + wb * brand) AS score FROM p, w GROUP BY ALL),
    c AS (SELECT ws, wp, wb, ss, sp, quantile_cont(score, 0.9) AS cut FROM s WHERE p_brand <> 'Brand#1' GROUP BY ALL)
    SELECT p_partkey, round(avg(CAST(score >= cut - 1e-12 AS INT)), 6) AS frequency, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, count(*) AS n_runs,
    CASE WHEN avg(CAST(score >= cut - 1e-12 AS INT)) >= 0.8 THEN 'A' WHEN avg(CAST(score >= cut - 1e-12 AS INT)) >= 0.5 THEN 'B' ELSE 'C' END AS grade FROM s JOIN c USING (ws, wp, wb, ss, sp) GROUP BY 1"""
)
def robustness_grades(spark, d):
    ways = robustness.scenarios(WEIGHTS, {"size": [0.5, 1.0, 2.0], "price": [0.5, 1.0]})
    got = robustness.robustness(parts(spark, d), "p_partkey", ways, F.col("p_brand") != "Brand#1", 0.1)
    return got.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("frequency", "score_mean", "score_std")], "n_runs", "grade")


@query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM (SELECT * FROM part WHERE p_size > 25 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2) ORDER BY p_retailprice DESC, p_partkey LIMIT 12),
    b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM (SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM a) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 2) ORDER BY p_size DESC, p_partkey LIMIT 15)
    SELECT 'dear' AS section, * FROM a UNION ALL SELECT 'large', * FROM b""")
def portfolio_sections(spark, d):
    sections = [robustness.Section("dear", F.col("p_size") > 25, [F.desc("p_retailprice"), F.col("p_partkey")], 12), robustness.Section("large", F.lit(True), [F.desc("p_size"), F.col("p_partkey")], 15)]
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return robustness.portfolio(p, "p_partkey", "p_brand", sections, 2).select("section", "p_partkey", "place")


# --- prototypes and compositions

SEEDS = [0, 3, 11]


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, unnest(range(64)) AS i FROM e WHERE vec_id IN ({", ".join(map(str, SEEDS))})) GROUP BY i))
    SELECT vec_id AS id, round(list_distance(v, c), 6) AS distance FROM e, m WHERE vec_id NOT IN ({", ".join(map(str, SEEDS))}) ORDER BY list_distance(v, c), vec_id LIMIT 20""")
def seed_neighbours(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    seeds = spark.createDataFrame([(i,) for i in SEEDS], "id long")
    return prototypes.seed_neighbours(e, seeds, "v", 20).select("id", F.round("distance", 6).alias("distance"))


SIMILAR = "WITH s AS (SELECT x.vec_id AS id, a.vec_id AS anchor, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 9) AS s FROM embeddings x, embeddings a WHERE a.vec_id IN (0, 3, 11))"


@query(SIMILAR + """, o AS (SELECT h.anchor, s.id, max(s.s) AS score FROM s, (SELECT DISTINCT anchor FROM s) h WHERE s.anchor <> h.anchor GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY anchor ORDER BY score DESC) AS rank FROM o)
    SELECT anchor, round(score, 6) AS score, rank FROM r WHERE id = anchor""")
def left_out_ranks(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    held = {r["vec_id"]: r["v"] for r in e.where(F.col("vec_id").isin(SEEDS)).collect()}  # the three anchors
    dot = lambda a: F.aggregate(F.zip_with("v", F.array(*map(F.lit, held[a])), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    each = F.array(*[F.struct(F.lit(a).cast("long").alias("anchor"), F.round(dot(a), 9).alias("s")) for a in sorted(held)])
    s = e.select(F.col("vec_id").alias("id"), F.inline(each))
    return prototypes.left_out_ranks(s, sorted(held)).withColumn("score", F.round("score", 6))


@query("""WITH x AS (SELECT l_orderkey, l_quantity AS w, CAST(s_acctbal AS DOUBLE) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 7 > 0), a AS (SELECT l_orderkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1),
    g AS (SELECT l_orderkey, sum(w * v) / sum(w) AS mean, sum(w * v * v) / sum(w) AS square, min(v) AS low, max(v) AS high, sum(w) AS w FROM x GROUP BY 1)
    SELECT a.l_orderkey, round(mean, 7) AS mean, round(sqrt(greatest(square - mean * mean, 0)), 4) AS std, round(low, 4) AS low, round(high, 4) AS high, round(coalesce(g.w / a.w, 0), 6) AS known FROM a LEFT JOIN g USING (l_orderkey)""")
def composition_stats(spark, d):
    """Orders as compositions of suppliers, by quantity; some suppliers have no value."""
    parts = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    values = t(spark, d, "supplier").where("s_suppkey % 7 > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("v"))
    got = prototypes.composition_stats(parts, values, ["v"], "l_orderkey", "l_suppkey", "l_quantity")
    return got.select("l_orderkey", F.round("v__mean", 7).alias("mean"), F.round("v__std", 4).alias("std"), F.round("v__min", 4).alias("low"), F.round("v__max", 4).alias("high"), F.round("v__known", 6).alias("known"))


@query("""WITH d AS (SELECT p_partkey AS id, k AS prototype, abs(p_retailprice - 900 - 30 * k) AS d, (p_partkey * k) % 5 / 4.0 AS support FROM part, range(1, 4) r(k)), f AS (SELECT prototype, d FROM d WHERE id % 3 > 0),
    n AS (SELECT d.id, d.prototype, support, count(CASE WHEN f.d < d.d THEN 1 END) AS nearer, count(*) AS n FROM d JOIN f USING (prototype) GROUP BY ALL), s AS (SELECT *, 0.7 * (n - nearer + 1) / (n + 1.0) + 0.3 * support AS score FROM n)
    SELECT id, CAST(prototype AS VARCHAR) AS prototype, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, prototype) = 1""")
def neighbourhood_scores(spark, d):
    k = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("k")
    x = t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", k).withColumn("prototype", F.col("k").cast("string"))
    distances = x.select("id", "prototype", F.abs(F.col("p_retailprice") - 900 - 30 * F.col("k")).alias("d"))
    support = x.select("id", "prototype", (F.col("id") * F.col("k") % 5 / 4).alias("support"))
    got = prototypes.neighbourhood_scores(distances, support, x.where("id % 3 > 0").select("id").distinct(), ["1", "2", "3"], 0.7)
    return got.where("best").select("id", "prototype", F.round("score", 9).alias("score"))
