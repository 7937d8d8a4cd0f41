"""Queries of the operators that prune and transform columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import columns, transforms
from lodestone.plans.base import query
from lodestone.sources.tables import require
from lodestone.sources.tables import table as t

EXPRESSIONS = {
    "nothing": "CAST(NULL AS DOUBLE)",
    "gaps": "CASE WHEN l_linenumber = 7 THEN l_tax END",
    "same": "CAST(1 AS DOUBLE)",
    "rare": "CAST(CASE WHEN l_orderkey % 300 = 0 THEN 1 ELSE 0 END AS DOUBLE)",
    "disc": "l_discount",
    "copy": "l_discount",
    "qty": "l_quantity",
    "qty_tax": "l_quantity + l_tax",
    "price": "l_extendedprice",
    "price_gaps": "CASE WHEN l_linenumber < 6 THEN l_extendedprice END",
}
X = "WITH x AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in EXPRESSIONS.items()) + ", l_tax FROM lineitem)"


def wide(spark, d):
    return require(t(spark, d, "lineitem"), ["l_tax"]).select(*[F.expr(e).alias(c) for c, e in EXPRESSIONS.items()], "l_tax")


def stays(a: str, b: str, first: str) -> str:
    """Which of two goes and for which, by whether ``first`` holds for the first."""
    return f"CASE WHEN {first} THEN '{b}' ELSE '{a}' END AS feature, CASE WHEN {first} THEN '{a}' ELSE '{b}' END AS kept_for"


def agg(select: str, having: str) -> str:
    return f"SELECT {select} FROM x HAVING {having}"


@query(
    X
    + " SELECT feature, 'drop' AS action, reason, kept_for FROM ("
    + " UNION ALL ".join(
        [
            agg("'nothing' AS feature, 'empty' AS reason, CAST(NULL AS VARCHAR) AS kept_for", "count(nothing) = 0"),
            agg("'gaps', 'missing', NULL", "count(gaps) < 0.5 * count(*) AND count(gaps) > 0"),
            agg("'same', 'constant', NULL", "min(same) = max(same)"),
            "SELECT 'rare', 'near_zero_variance', NULL FROM (SELECT count(*) AS n FROM x GROUP BY rare) HAVING count(*) = 2 AND max(n) >= 95 * min(n)",
            agg("'copy', 'duplicate', 'disc'", "bool_and(copy IS NOT DISTINCT FROM disc)"),
            agg("CASE WHEN var_samp(qty) >= var_samp(qty_tax) THEN 'qty_tax' ELSE 'qty' END, 'collinear', CASE WHEN var_samp(qty) >= var_samp(qty_tax) THEN 'qty' ELSE 'qty_tax' END", "abs(corr(qty, qty_tax)) >= 0.95"),
            agg("'price_gaps', 'collinear', 'price'", "abs(corr(price, price_gaps)) >= 0.95 AND count(price) > count(price_gaps)"),
        ]
    )
    + ")"
)
def drop_ledger(spark, d):
    return columns.clean(wide(spark, d), list(EXPRESSIONS))[1]


FEW = ["disc", "qty", "qty_tax", "price", "price_gaps"]


def dropped(spark, found: dict):
    return spark.createDataFrame(sorted(found.items()), "feature string, kept_for string")


def pruned(*rules: tuple[str, str, str, str]) -> str:
    return X + " " + " UNION ALL ".join(agg(stays(a, b, first), over) for a, b, first, over in rules)


@query(pruned(("qty", "qty_tax", "var_samp(qty) >= var_samp(qty_tax)", "abs(corr(qty, qty_tax)) >= 0.95"), ("price", "price_gaps", "count(price) > count(price_gaps)", "abs(corr(price, price_gaps)) >= 0.95")))
def collinear_prune_a(spark, d):
    return dropped(spark, columns.collinear_by_missing(wide(spark, d), FEW, 0.95))


@query(pruned(*[(a, b, f"round(abs(corr({a}, l_tax)), 12) >= round(abs(corr({b}, l_tax)), 12)", f"abs(corr({a}, {b})) >= 0.95") for a, b in (("qty", "qty_tax"), ("price", "price_gaps"))]))
def collinear_prune_b(spark, d):
    return dropped(spark, columns.collinear_by_target(wide(spark, d), FEW, "l_tax", 0.95))


@query(X + ", m AS (SELECT median(price_gaps) AS v FROM x) SELECT * FROM (" + " UNION ALL ".join([
    f"SELECT {stays('qty', 'qty_tax', 'var_pop(qty) >= var_pop(qty_tax)')} FROM x HAVING abs(corr(qty, qty_tax)) > 0.8",
    f"SELECT {stays('price', 'price_gaps', 'var_pop(price) >= var_pop(price_gaps)')} FROM x, m HAVING abs(corr(price, coalesce(price_gaps, v))) > 0.8",
]) + ")")
def collinear_prune_c(spark, d):
    return dropped(spark, columns.collinear_by_variance(wide(spark, d).select("disc", "qty", "qty_tax", "price_gaps", "price"), ["disc", "qty", "qty_tax", "price", "price_gaps"], 0.8))


PAIR = "SELECT rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0 AS b, {0}, {1} FROM x"


@query(X + f" SELECT {stays('qty', 'qty_tax', 'stddev_samp(qty) >= stddev_samp(qty_tax)')} FROM ({PAIR.format('qty', 'qty_tax')}) HAVING abs(corr(a, b)) >= 0.95")
def collinear_prune_d(spark, d):
    return dropped(spark, columns.collinear_by_spread(wide(spark, d), ["disc", "qty", "qty_tax"], 0.95))


@query(pruned(*[(a, b, f"round(abs(corr({a}, l_tax)), 12) >= round(abs(corr({b}, l_tax)), 12)", f"1 - abs(corr({a}, {b})) <= 0.05") for a, b in (("qty", "qty_tax"), ("price", "price_gaps"))]))
def collinear_prune_e(spark, d):
    return dropped(spark, columns.collinear_by_cluster(wide(spark, d), FEW, "l_tax", 0.95))


@query(pruned(("qty", "qty_tax", "true", "abs(corr(qty, qty_tax)) > 0.95"), ("price", "price_gaps", "true", "abs(corr(price, price_gaps)) > 0.95")))
def collinear_prune_f(spark, d):
    return dropped(spark, columns.collinear_with_earlier(wide(spark, d), FEW, 0.95))


@query("""WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), i AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
    SELECT 'l_quantity' AS feature, round((1 - c * c) / det, 6) AS factor FROM i UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 6) FROM i UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) FROM i""")
def inflation_factors(spark, d):
    found = columns.inflation_factors(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return spark.createDataFrame([(c, round(x, 6)) for c, x in found.items()], "feature string, factor double")


@query(X + " " + " UNION ALL ".join([agg("'nothing' AS feature", "count(nothing) = 0"), agg("'same'", "var_pop(same) < 1e-12"), "SELECT 'rare' FROM (SELECT count(*) AS n FROM x GROUP BY rare) HAVING max(n) >= 0.99 * sum(n)"]))
def near_constant_columns(spark, d):
    return spark.createDataFrame([(c,) for c in columns.near_constant(wide(spark, d), ["nothing", "same", "rare", "disc", "qty"], 0.99)], "feature string")


@query(X + " SELECT corr(qty, qty_tax) >= 0.995 AND median(abs(qty - qty_tax)) <= 0.1 AS tax, corr(qty, price) >= 0.995 AS price FROM x")
def equivalent_columns(spark, d):
    x = wide(spark, d)
    return spark.createDataFrame([(columns.equivalent(x, "qty", "qty_tax", tolerance=0.1), columns.equivalent(x, "qty", "price"))], "tax boolean, price boolean")


@query("""WITH m AS (SELECT median(price_gaps) AS v FROM (SELECT CASE WHEN l_linenumber < 6 THEN l_extendedprice END AS price_gaps FROM lineitem))
    SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber < 6 THEN l_extendedprice END, v) AS price_gaps, CAST(l_linenumber >= 6 AS INTEGER) AS price_gaps_missing FROM lineitem, m""")
def imputed(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_linenumber < 6 THEN l_extendedprice END").alias("price_gaps"))
    flagged = transforms.missing_flags(x, ["price_gaps"])
    return transforms.filled(flagged, transforms.fill_values(x, ["price_gaps"], []))


@query("""WITH f AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s, median(p_retailprice) AS med, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS iqr FROM part WHERE p_brand < 'Brand#3')
    SELECT p_partkey, round((p_size - m) / s, 6) + 0.0 AS p_size, round(least(greatest((p_retailprice - med) / iqr, -1), 1), 6) + 0.0 AS p_retailprice FROM part, f""")
def scaled_by_training_rows(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    some = p.where("p_brand < 'Brand#3'")
    one = transforms.scaled(p, transforms.standard_scale(some, ["p_size"]))
    both = transforms.scaled(one, transforms.robust_scale(some, ["p_retailprice"]), clip=1.0)
    return both.select("p_partkey", (F.round("p_size", 6) + 0.0).alias("p_size"), (F.round("p_retailprice", 6) + 0.0).alias("p_retailprice"))


@query("""SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS is_automobile, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS is_building, (SELECT count(DISTINCT c_mktsegment) FROM customer k WHERE k.c_mktsegment < customer.c_mktsegment) AS code FROM customer""")
def encoded_categories(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    known = transforms.categories(c, "c_mktsegment")
    got = transforms.label_codes(transforms.one_hot(c, "c_mktsegment", known, "is"), "c_mktsegment", known, "code")
    return got.select("c_custkey", F.col("is_AUTOMOBILE").alias("is_automobile"), F.col("is_BUILDING").alias("is_building"), "code")


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
    SELECT p_partkey, CAST(p_retailprice > a AS INTEGER) + CAST(p_retailprice > b AS INTEGER) + CAST(p_retailprice > c AS INTEGER) AS bin FROM part, e""")
def quantile_bins(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice")
    return transforms.binned(p, "p_retailprice", transforms.quantile_edges(p, "p_retailprice", 4), "bin").select("p_partkey", "bin")


@query("SELECT DISTINCT p_size AS value, rank() OVER (ORDER BY p_size) - 1 AS below, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part")
def average_ranks(spark, d):
    return transforms.distinct_ranks(t(spark, d, "part"), "p_size").select("value", "below", "rank")
