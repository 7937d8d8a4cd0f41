"""Rows, columns and folds that queries with SQL do not show."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import formulas, numbers
from lodestone.operators import ranking, shaping
from lodestone.sources import files


def test_column_rules(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "b int, id int, `c.d` int, M_len_x int")
    assert shaping.front(df, ["id", "none"]).columns == ["id", "b", "c.d", "M_len_x"]
    assert shaping.aligned(df, ["c.d", "b"]).columns == ["c.d", "b"]
    assert shaping.aligned(df, ["b", "new"], {"new": "string"}, strict=False).dtypes == [("b", "int"), ("new", "string")]
    with pytest.raises(ValueError, match="missing columns: new"):
        shaping.aligned(df, ["b", "new"])
    assert shaping.renamed(df, [("M_(.+)", r"comp_M_\1_wmean")], [("_len_", "__A"), ("", "__1")], {"id": "key"}).columns == ["b", "key", "c.d", "comp_M_len_x_wmean__A"]
    with pytest.raises(ValueError, match="repeat: key"):
        shaping.renamed(df, [("b", "key")], same={"id": "key"})
    twice = spark.createDataFrame([(None, 1, 2), (3, 4, 5)], "a int, b int, c int").toDF("a", "b", "a")
    assert [tuple(r) for r in shaping.collapsed(twice).collect()] == [(2, 1), (3, 4)]
    assert shaping.collapsed(twice).columns == ["a", "b"]
    assert shaping.wanted(["id", "X_note", "v", "note2"], {"v"}, ["NOTE"], {"note2"}) == ["id", "note2"]


def test_order_by_suffix():
    columns = ["z", "H__b", "M__a", "mh__c__diff", "M__c", "score", "H__c", "mh__c__ratio", "mh__c__odd", "mh__q__wmean", "M__b", "formula"]
    assert shaping.shared_suffixes(columns) == ["b", "c"]
    assert shaping.by_suffix(columns, ["formula", "score", "none"]) == ["formula", "score", "M__a", "M__b", "H__b", "M__c", "H__c", "mh__c__ratio", "mh__c__diff", "mh__q__wmean", "z", "mh__c__odd"]


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", float("nan")), (3, None, None), (4, "b", 2.0), (5, "a", 3.0)], "i long, k string, y double")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(shaping.with_target(df, "y")) == [1, 4, 5]
    assert ids(shaping.with_target(df, "k")) == [1, 2, 4, 5]
    assert ids(shaping.without_rare(df, "k")) == [1, 2, 5]
    keys = spark.createDataFrame([("a",), ("a",)], "k string")
    assert ids(shaping.isolated(df, "k", exclude=keys)) == [3, 4]
    assert ids(shaping.isolated(df, "k", only=keys)) == [1, 2, 5]
    for both in ({}, {"exclude": keys, "only": keys}):
        with pytest.raises(ValueError, match="exclude or only"):
            shaping.isolated(df, "k", **both)
    assert [tuple(r) for r in shaping.leaks({"x": df, "y": df.where("i = 4")}, keys, "k").collect()] == [("x", 3)]
    kept, reasons = shaping.drop_reasons(df, F.when(F.col("k").isNull(), "no_key").when(F.col("y") > 2.5, "large"))
    assert ids(kept.where("i <> 2")) == [1, 4] and {tuple(r) for r in reasons.collect()} >= {("no_key", 1)}
    assert len(ids(shaping.random_rows(df, "k", "i", 2))) == 4
    assert ids(shaping.random_rows(df, "k", "i", 2, 5)) == ids(shaping.random_rows(df.repartition(3), "k", "i", 2, 5))
    compounds = spark.createDataFrame([(["F", "Na"],), (["F"],), (["F", "Cl"],), (["Na", "K"],)], "s array<string>")
    assert [r[0] for r in compounds.select(shaping.binary_compounds(F.col("s"), formulas.HALOGENS)).collect()] == [None, "not_binary", "both_known", "none_known"]


def test_folds_are_even_in_each_stratum(spark):
    df = spark.range(300).withColumn("s", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3))
    got = shaping.folds(df, "id", 4, seed=1, strata=["s"])
    assert got.count() == 300
    sizes = {(r["s"], r["fold"]): r["count"] for r in got.groupBy("s", "fold").count().collect()}
    for s in (None, 0, 1, 2):
        mine = [n for (k, _), n in sizes.items() if k == s]
        assert len(mine) == 4 and max(mine) - min(mine) <= 1
    plain = shaping.folds(df, "id", 4, seed=1)
    assert plain.where("fold <> 0").count() < 260 and plain.columns == ["id", "s", "fold"]
    assert plain.join(shaping.folds(df, "id", 4, seed=2).withColumnRenamed("fold", "other"), "id").where("fold = other").count() < 150


def test_representatives_need_exact_cover(spark):
    table = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    reps = spark.createDataFrame([(2, "f", "z")], "k long, family string, v string")
    assert [tuple(r) for r in shaping.to_representatives(table, reps, table, "k").collect()] == [(2, "y", "f")]
    with pytest.raises(ValueError, match="unique"):
        shaping.to_representatives(table.union(table), reps, table, "k")
    with pytest.raises(ValueError, match="exactly: 2"):
        shaping.to_representatives(table.where("k = 1"), reps, table, "k")


def test_files(spark, tmp_path):
    for name, text in {"a.txt": "NaCl and FeBr2\nnothing", "sub/b.txt": "FeBr25\nxFeBr2"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    got = shaping.leaking_files(spark, str(tmp_path / "in"), ["FeBr2", "Na.l"]).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["n"]) for r in got] == [("a.txt", 1)]
    shaping.saved_scale(spark, {"x": (1.0, 2.0), "y": (0.5, 1.0)}, str(tmp_path / "scale"))
    assert shaping.read_scale(spark, str(tmp_path / "scale")) == {"x": (1.0, 2.0), "y": (0.5, 1.0)}
    at = str(tmp_path / "table")
    files.write_csv(spark.range(3), at)
    files.write_csv(spark.read.csv(at, header=True).where("id > 0"), at, replace=True)  # reads what it replaces
    assert spark.read.csv(at, header=True).count() == 2
    files.write_parquet(spark.range(4), str(tmp_path / "p"), replace=True)
    files.write_parquet(spark.read.parquet(str(tmp_path / "p")).where("id > 2"), str(tmp_path / "p"), replace=True)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "p", "scale", "table"]


def test_parameters_of_the_survey(spark):
    one = spark.range(1)
    of = formulas.parts(F.lit("TsAtNa2"))
    assert one.select(formulas.largest(of, True), formulas.largest(of, True, [*formulas.HALOGENS, "At", "Ts"]), formulas.first(of, False)).first()[:] == (None, "Ts", "Ts")
    parts = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(z).alias("z"), F.lit(r).alias("r")) for f, z, r in ((0.25, 2.0, 0.5), (0.5, 1.0, 2.0), (0.25, 1.0, 0.0))])
    assert one.select(numbers.summed_field_strength(parts), numbers.mean_field_strength(parts), numbers.field_strength(F.lit(2.0), F.lit(0.5))).first()[:] == (2.125, 2.125 / 0.75, 8.0)
    votes = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 2)], "item string, r string, place int")
    sums = lambda **k: {r["item"]: r["borda"] for r in ranking.borda(votes, "item", "r", "place", 2, **k).collect()}
    assert sums() == {"a": 4.0, "b": 1_000_002.0} and sums(missing="zero") == {"a": 4.0, "b": 2.0} and sums(missing=7.0)["b"] == 9.0
