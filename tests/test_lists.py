"""Lists, maps, keys, flags, ranks and small reports."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numbers
from lodestone.operators import lists


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()[:]


def test_vectors_lists_and_maps(spark):
    v, w = F.array(*map(F.lit, (1, 2, 3, 4, 5))), F.array(F.lit(7), F.lit(8))
    assert one(spark, *[lists.subspace(v, k) for k in ("all", "even", "odd")], lists.subspace(w, "odd"), lists.joined_vectors(v, w)) == ([1, 2, 3, 4, 5], [1, 3, 5], [2, 4], [7, 8], [1, 2, 3, 4, 5, 7, 8])
    with pytest.raises(ValueError, match="unknown subspace"):
        lists.subspace(v, "most")
    old = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    new = F.create_map(F.lit("b"), F.lit(None).cast("int"), F.lit("c"), F.lit(3), F.lit("a"), F.lit(9))
    assert one(spark, lists.merged(old, new), lists.common(F.array(F.lit("z"), F.lit("a"), F.lit("a")), F.array(F.lit("a"), F.lit("z"), F.lit("q")))) == ({"a": 9, "b": 2, "c": 3}, ["a", "z"])
    a = spark.createDataFrame([("H", 1.0, 5.0), ("He", 2.0, None)], "symbol string, x double, y double")
    b = spark.createDataFrame([("H", None, 7.0), ("Li", 3.0, 8.0)], "symbol string, x double, z double")
    assert sorted(map(tuple, lists.overridden(a, b, "symbol").collect())) == [("H", 1.0, 5.0, 7.0), ("He", 2.0, None, None), ("Li", 3.0, None, 8.0)]
    nested = spark.createDataFrame([(1, (2, [3], "x"), 4)], "i int, e struct<a:int,b:array<int>,c:string>, j int")
    assert lists.flattened(nested, "e", "ev").columns == ["i", "ev__a", "ev__c", "j"]


def test_keys_and_flags(spark):
    df = spark.createDataFrame([(1, 0.1, -0.0), (2, float("nan"), 2.5)], "i int, a double, b double")
    assert [r[0] for r in df.select(lists.signature(["a", "b"], 2)).collect()] == ["0.10|0.00", "NA|2.50"]
    assert one(spark, lists.orbital_electrons(F.lit("[Ar] 3d6 4s2 4d10")), lists.orbital_electrons(F.lit("1s2")), lists.orbital_electrons(F.lit(""))) == (16, 0, None)
    parts = F.array(F.struct(F.lit("Na").alias("symbol"), F.lit(1.0).alias("amount")), F.struct(F.lit("Cl").alias("symbol"), F.lit(1.0).alias("amount")))
    assert [tuple(p) for p in one(spark, lists.doped(parts, {"O": 0.5, "Na": 0.5, "K": -1.0}))[0]] == [("Na", 0.5), ("Cl", pytest.approx(1 / 3)), ("O", pytest.approx(1 / 6)), ("K", 0.0)]
    rows = spark.createDataFrame([(1, ["Tl", "Cl"]), (2, ["Au", "U"]), (3, ["Na"]), (4, None)], "i int, s array<string>")
    groups = {"toxic": ["Tl", "Pb"], "dear": ["Au"], "active": ["U"]}
    got = {r["i"]: (r["risk_toxic"], r["risk_dear"], r["risk_elements"]) for r in lists.risk_flags(rows, F.col("s"), groups, ["toxic", "active"], flag_only=True).collect()}
    assert got == {1: (True, False, "Tl"), 2: (False, True, "U"), 3: (False, False, ""), 4: (False, False, "")}
    assert sorted(r["i"] for r in lists.risk_flags(rows, F.col("s"), groups, ["dear"]).collect()) == [1, 3, 4]
    with pytest.raises(ValueError, match="unknown groups"):
        lists.risk_flags(rows, F.col("s"), groups, ["none"])
    names = spark.createDataFrame([("FeBr2_mp-228.cif",), ("NaCl.cif",)], "f string")
    found, lost = lists.highlighted(names, "f", ["MP-228", " nacl.cif", "x", ""])
    assert found.count() == 2 and lost == ["x"] and lists.highlighted(names, "f", [])[1] == []
    assert lists.labelled_paths(["a=x=y", "b-1=/p"]) == {"a": "x=y", "b-1": "/p"}
    for bad, why in ((["a"], "form"), (["a=1", "a=2"], "repeats"), (["/a=1"], "safe")):
        with pytest.raises(ValueError, match=why):
            lists.labelled_paths(bad)


def test_ranks_and_counts(spark):
    df = spark.createDataFrame([("p", 3.0, 1.0, 3.0), ("q", None, None, 2.0), ("r", None, None, None)], "item string, a double, b double, c double")
    assert [tuple(r)[4:] for r in lists.row_ranks(df, ["a", "b", "c"]).collect()] == [(2.5, 1.0, 2.5), (None, None, 1.0), (None, None, None)]
    assert {r["item"]: r["mean_rank"] for r in lists.mean_of_ranks(df, "item", ["a", "b", "c"]).collect()} == {"p": 2.0, "q": 1.0, "r": None}
    maps = spark.createDataFrame([(2.0001, 1, 5), (2.0004, 1, 5), (2.0, 2, 4), (1.0, 3, 3), (None, 1, 1)], "ratio double, dim int, s int")
    assert sorted(map(tuple, lists.by_frequency(maps, "ratio", ["dim", "s"]).collect())) == [(1.0, 3, 3, 1, 1), (2.0, 1, 5, 2, 1), (2.0, 2, 4, 1, 2)]
    ladder = spark.createDataFrame([("g", 1, 0.5, 0.1), ("g", 2, 0.9, 0.3), ("g", 3, 0.9, 0.2), ("g", 4, None, 0.0), ("h", 5, None, None)], "g string, i int, cover double, mad double")
    assert {r["g"]: r["i"] for r in lists.best_by(ladder, "g", [("cover", True), ("mad", False)], "i").collect()} == {"g": 3, "h": 5}
    some = lists.selected_by([df.select("item"), df.where("item = 'p'").select("item"), df.where("false").select("item")], "item")
    assert {tuple(r) for r in some.collect()} == {("p", 2), ("q", 1), ("r", 1)}
    assert lists.column_blocks(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]]
    near = lambda *x: [F.lit(v).cast("double") for v in x]
    assert one(spark, numbers.hsab_strength(*near(8.0, 2.0, 12.0, 4.0)), numbers.kapustinskii(*near(-2.0, 1.0, None, 2.0, 2.0)), numbers.kapustinskii(*near(3.0, 1.0, 0.5, 9.0, 9.0))) == (pytest.approx(9 / 14), 0.5, 2.0)


def test_small_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,x\nH,1\n")
    (tmp_path / "b.csv").write_text("name,x\nH,1\n")
    assert list(lists.dimension_tables(spark, str(tmp_path))) == ["a.csv"]
    df = spark.createDataFrame([("a|b", 1), ("<c>", None)], "k string, n int")
    assert lists.report(df).splitlines() == ["| k | n |", "|-|-|", "| a\\|b | 1 |", "| <c> |  |"]
    assert "<td>&lt;c&gt;</td><td></td>" in lists.report(df, "html")
    assert json.loads(lists.report(df, "json")) == [{"k": "a|b", "n": 1}, {"k": "<c>", "n": None}]
    with pytest.raises(ValueError, match="at most 1"):
        lists.report(df, most=1)
    with pytest.raises(ValueError, match="unknown kind"):
        lists.report(df, "pdf")
