"""Columns made of others, tiers, shares, numbers of groups and nested profiles."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import algebra


def test_pairs_of_columns(spark):
    df = spark.createDataFrame([(4.0, 2.0, 1.0, 0.0, 1, 3), (None, 2.0, 5.0, 6.0, 1, 3)], "M__a double, H__a double, M__b double, H__b double, u int, v int")
    got = algebra.pairwise(df, weights=("u", "v"), signed=True, only={"ratio": {"b"}}).collect()
    assert got[0].asDict() == df.first().asDict() | {"mh__a__diff": 2.0, "mh__a__wmean": 2.5, "mh__b__diff": 1.0, "mh__b__ratio": None, "mh__b__wmean": 0.25}
    assert (got[1]["mh__a__diff"], got[1]["mh__b__diff"], got[1]["mh__b__ratio"]) == (None, -1.0, pytest.approx(5 / 6))


def test_shares_tiers_and_numbers(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (1, None), (1, "z"), (2, "x")], "g int, c string")
    got = {r["g"]: tuple(r)[1:] for r in algebra.category_shares(df, "g", "c", {"xy": ["x", "y"], "none": ["q"]}).collect()}
    assert got == {1: (0.5, 0.0, 0.5), 2: (1.0, 0.0, 0.0)}
    tier = algebra.tiers([(F.col("c") == "x", "first"), (F.col("g") == 1, "second")])
    assert [r[0] for r in df.select(tier).collect()] == ["first", "second", "second", "second", "first"]
    assert [tuple(r) for r in algebra.group_numbers(df, ["g", "c"]).orderBy("number").collect()] == [(1, "x", 1), (1, "y", 2), (1, "z", 3), (1, None, 4), (2, "x", 5)]


def test_profiles_are_nested(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    pairs = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.5), (3, 4, 2.0)], "a long, b long, d double")
    got = algebra.tolerance_profiles(nodes, pairs, "d", {"loose": 3.0, "tight": 0.2, "main": 1.0}).collect()
    assert [tuple(r) for r in got] == [("tight", 4, 1), ("main", 3, 2), ("loose", 2, 3)]
