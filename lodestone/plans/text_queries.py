"""Queries of functions on formulas, names and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import formulas, numbers
from lodestone.functions.cleaning import truth
from lodestone.operators import scoring, vectors
from lodestone.plans.base import query
from lodestone.sources.tables import table as t

FORMULA = "'Fe' || (p_size % 7 + 1) || 'Cl' || (p_size % 3 + 1) || 'OFe2'"
PARTS = f"p AS (SELECT p_partkey, p_retailprice, p_size, {FORMULA} AS formula, p_size % 7 + 3 AS fe, p_size % 3 + 1 AS cl FROM part)"


def with_formula(spark, d):
    p = t(spark, d, "part")
    return p.withColumn("formula", F.concat(F.lit("Fe"), F.col("p_size") % 7 + 1, F.lit("Cl"), F.col("p_size") % 3 + 1, F.lit("OFe2"))).withColumn("parts", formulas.parts(F.col("formula")))


@query(f"WITH {PARTS} SELECT p_partkey, symbol, CAST(amount AS DOUBLE) AS amount FROM (SELECT p_partkey, 'Fe' AS symbol, fe AS amount FROM p UNION ALL SELECT p_partkey, 'Cl', cl FROM p UNION ALL SELECT p_partkey, 'O', 1 FROM p)")
def formula_tokens(spark, d):
    return with_formula(spark, d).select("p_partkey", F.inline("parts"))


@query(f"""WITH {PARTS} SELECT p_partkey, round(fe / (fe + cl + 1), 9) AS share, 'Fe' AS first_m, 'Cl' AS halogen, CASE WHEN fe >= 1 THEN 'Fe' END AS largest, 'Fe' || fe || 'Cl' || CASE WHEN cl = 1 THEN '' ELSE CAST(cl AS VARCHAR) END || 'O' AS rendered, 'not_binary' AS reason FROM p""")
def formula_columns(spark, d):
    p, x = with_formula(spark, d), F.col("parts")
    return p.select("p_partkey", F.round(formulas.fractions(x)[0]["amount"], 9).alias("share"), formulas.first(x, False).alias("first_m"), formulas.largest(x, True).alias("halogen"), formulas.largest(x, False).alias("largest"), formulas.rendered(x).alias("rendered"), formulas.binary_halide(x).alias("reason"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 * 2 + 2 AS a, p_size % 3 * 2 + 2 AS b FROM part) SELECT p_partkey, 'Cl' || CASE WHEN b / gcd(a, b) = 1 THEN '' ELSE CAST(CAST(b / gcd(a, b) AS BIGINT) AS VARCHAR) END || 'Fe' || CASE WHEN a / gcd(a, b) = 1 THEN '' ELSE CAST(CAST(a / gcd(a, b) AS BIGINT) AS VARCHAR) END AS reduced FROM p""")
def reduced_formulas(spark, d):
    s = F.col("p_size")
    formula = F.concat(F.lit("Fe"), s % 4 * 2 + 2, F.lit("Cl"), s % 3 * 2 + 2)
    return t(spark, d, "part").select("p_partkey", formulas.rendered(formulas.reduced(formulas.parts(formula))).alias("reduced"))


@query(f"WITH {PARTS}, l AS (SELECT 'Fe' AS symbol, fe AS amount, p_retailprice AS s FROM p UNION ALL SELECT 'Cl', cl, p_retailprice FROM p UNION ALL SELECT 'O', 1, p_retailprice FROM p) SELECT symbol, CAST(sum(amount) AS DOUBLE) AS weight, round(sum(s * amount) / sum(amount), 6) AS mean FROM l GROUP BY symbol")
def allocated_scores(spark, d):
    return scoring.allocated(with_formula(spark, d), "p_partkey", F.col("parts"), "p_retailprice").withColumn("mean", F.round("mean", 6))


@query("SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 9) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def fuzzy_names(spark, d):
    n = t(spark, d, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(f"key_{x}"), F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, "n_regionkey").where("key_a < key_b").select("a", "b", F.round(formulas.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("SELECT DISTINCT p_size, CASE WHEN p_size <= 16 THEN (['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI'])[p_size] END AS numeral, CASE WHEN p_size <= 16 THEN p_size END AS back FROM part")
def roman_numerals(spark, d):
    n = formulas.roman(F.col("p_size"))
    return t(spark, d, "part").select("p_size", n.alias("numeral"), formulas.from_roman(n).alias("back")).distinct()


@query("""SELECT p_partkey, round(CASE WHEN p_size <> 7 THEN p_retailprice / (p_size - 7) END, 6) AS ratio, abs(p_retailprice - p_size) AS difference, round((p_retailprice * p_size + 3) / (p_size + 1), 6) AS mean, round(sqrt(p_retailprice * p_size), 6) AS geometric,
    round(1 - exp(-((p_size / 50.0 - 0.2) ** 2) / 4), 9) AS ionic, round(p_retailprice * p_size / (p_retailprice + p_size), 6) AS reduced, round(2 / (p_size * p_size), 9) AS field, round(0.75 * p_size * p_size * 5, 6) AS c6,
    round(exp(-((p_size - 25) ** 2) / 200.0), 9) AS kernel, round(exp(-((p_size / 10.0) ** 2)), 9) AS decay, round(greatest(p_retailprice / p_size, p_size / p_retailprice) - 1, 6) AS relative, round(greatest(p_size / 10.0, p_retailprice / 1000), 9) AS worst,
    least(greatest(p_size, 10), 40) + 0.0 AS clipped, CASE WHEN p_size % 3 = 0 THEN p_size // 3 END AS quotient, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'not_whole' END AS reason FROM part""")
def number_functions(spark, d):
    v, s, r = F.col("p_retailprice"), F.col("p_size"), lambda c, n=6: F.round(c, n)
    q = numbers.exact_quotient(s, F.lit(3))
    return t(spark, d, "part").select(
        "p_partkey",
        r(numbers.ratio(v, s - 7)).alias("ratio"),
        numbers.difference(v, s).alias("difference"),
        r(numbers.weighted_mean((v, s), (F.lit(3.0), F.lit(1.0)), (F.lit(None).cast("double"), F.lit(9.0)))).alias("mean"),
        r(numbers.geometric_mean(v, s)).alias("geometric"),
        r(numbers.ionic_character(s / 50.0, F.lit(0.2)), 9).alias("ionic"),
        r(numbers.reduced_mass(v, s)).alias("reduced"),
        r(numbers.field_strength(F.lit(2.0), s), 9).alias("field"),
        r(numbers.london_c6(s, F.lit(5.0))).alias("c6"),
        r(numbers.gaussian(s, 25.0, 10.0), 9).alias("kernel"),
        r(numbers.decay(s, 10.0), 9).alias("decay"),
        r(numbers.relative_difference(v, s)).alias("relative"),
        r(numbers.worst_of([(s, 10.0), (v, 1000.0)]), 9).alias("worst"),
        numbers.clipped(s, 10.0, 40.0).alias("clipped"),
        q["value"].alias("quotient"),
        q["reason"].alias("reason"),
    )


@query("""SELECT DISTINCT o_orderstatus AS word, CASE lower(o_orderstatus) WHEN 'f' THEN 'final' WHEN 'p' THEN 'pending' ELSE 'other' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS done FROM orders""")
def words_and_groups(spark, d):
    w = F.col("o_orderstatus")
    done = truth(F.when(w == "F", " YES ").when(w == "O", "0").otherwise("maybe"))
    return t(spark, d, "orders").select(w.alias("word"), formulas.group_of(F.lower(w), {"f": "final", "p": "pending"}).alias("kind"), done.cast("int").alias("done")).distinct()


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) + 0.0 AS cosine FROM embeddings")
def vector_norms(spark, d):
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(e), 6).alias("norm"), (F.round(vectors.cosine(e, F.reverse(e)), 6) + 0.0).alias("cosine"))
