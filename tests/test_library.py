"""Operators against plain versions and hand-made tables, where SQL is no help."""

import os
import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import cleaning, formulas
from lodestone.operators import checks, columns, dedup, families, joins, ranking, scoring, transforms
from lodestone.sources import files
from lodestone.streaming import windows

PAIRS = "a long, b long, score double"


def graph(seed: int, n: int = 24) -> dict[tuple[int, int], float]:
    rng = random.Random(seed)
    return {(a, b): rng.random() for a, b in combinations(range(n), 2) if rng.random() < 0.12}


def families_of(df) -> dict[int, int]:
    return {r["node"]: r["family"] for r in df.collect()}


def plain_complete_link(nodes, scores, threshold):
    groups = [[n] for n in nodes]
    while len(groups) > 1:
        far = lambda g, h: max(scores.get((min(a, b), max(a, b)), 1e12) for a in g for b in h)
        d, g, h = min(((far(g, h), g, h) for g, h in combinations(groups, 2)), key=lambda x: (x[0], x[1][0], x[2][0]))
        if d > threshold:
            break
        groups.remove(h)
        g += h
        groups.sort(key=min)
    return {n: min(g) for g in groups for n in g}


@pytest.mark.parametrize("seed", [1, 2])
def test_families_equal_plain_versions(spark, seed):
    edges = graph(seed)
    place = {n: random.Random(seed + n).randint(0, 5) for n in range(24)}
    nodes = spark.createDataFrame(list(place.items()), "node long, place long")
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], PAIRS)
    linked = lambda a, b: (min(a, b), max(a, b)) in edges
    order = sorted(place, key=lambda n: (place[n], n))

    label = {n: n for n in place}
    for a, b in list(edges) * 24:
        label[a] = label[b] = min(label[a], label[b])
    assert families_of(families.components(nodes, pairs)) == label

    lead, cliques = {}, []
    for n in order:
        lead[n] = next((m for m in order if lead.get(m) == m and linked(m, n)), n)
        home = next((g for g in cliques if all(linked(m, n) for m in g)), None)
        home.append(n) if home else cliques.append([n])
    assert families_of(families.leaders(nodes, pairs, ["place"])) == lead
    assert families_of(families.cliques(nodes, pairs, ["place"])) == {n: g[0] for g in cliques for n in g}
    assert families_of(families.cliques(nodes, pairs, ["place"], small=4)) == {n: g[0] for g in cliques for n in g}
    assert families_of(families.complete_link(nodes, pairs, "score", 0.6)) == plain_complete_link(sorted(place), edges, 0.6)
    shuffled = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score").orderBy(F.rand(3))
    assert families_of(families.leaders(nodes.orderBy(F.rand(4)), shuffled, ["place"])) == lead


def test_long_chains_are_few_rounds(spark, monkeypatch):
    names = list(range(300))
    random.Random(5).shuffle(names)
    tables, written = [], families.written
    monkeypatch.setattr(families, "written", lambda df: tables.append(df) or written(df))
    nodes = spark.createDataFrame([(n,) for n in range(301)], "node long")
    pairs = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")
    assert families_of(families.components(nodes, pairs)) == {n: 0 for n in range(300)} | {300: 300}
    assert len(tables) < 20


def test_links_and_classes_stand_for_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("uv"), rng.choice([rng.randint(900, 960) / 1.0, 900.0, 0.0, None])) for i in range(120)]
    df = spark.createDataFrame(rows, "node long, b string, v double")
    ab = lambda pairs: pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "difference")
    near = {(r["a"], r["b"]): r["difference"] for r in ab(dedup.blocked_pairs(df, "b", "node", "v", 0.01)).collect()}
    links = {(r["a"], r["b"]): r["difference"] for r in ab(dedup.linked_pairs(df, "b", "node", "v", 0.01)).collect()}

    def joined(pairs: dict, within: float) -> dict[int, int]:
        label = {r[0]: r[0] for r in rows}
        for a, b in [p for p, d in pairs.items() if d <= within] * 120:
            label[a] = label[b] = min(label[a], label[b])
        return label

    assert links.items() <= near.items() and len(links) == 120 - len(set(joined(near, 0.01).values()))
    assert all(joined(links, within) == joined(near, within) for within in (0.0005, 0.002, 0.01))
    classes, between = dedup.blocked_classes(df, "b", "node", "v", 0.01)
    nodes = spark.createDataFrame([(r[0], r[2]) for r in rows], "node long, v double")
    between, firsts = ab(between).cache(), families.firsts(nodes, classes).cache()
    assert firsts.count() < 100 and between.count() < len(near) / 2
    lead, linked = {}, lambda a, b: (min(a, b), max(a, b)) in near
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))]
    for n in order:
        lead[n] = next((m for m in order if lead.get(m) == m and linked(m, n)), n)
    found = families.leaders(firsts, between, ["v"]).cache()
    assert families_of(families.of_classes(found, classes)) == lead
    got = families.boundary_of_classes(between, found, classes)
    assert sorted(map(tuple, got.select("a", "b", "family_a", "family_b").collect())) == sorted((a, b, lead[a], lead[b]) for a, b in near if lead[a] != lead[b])


def test_pairs_of_many_copies_are_not_sent(spark):
    rows = [(i, 100.0 if i < 300 else 100.5 if i < 310 else None if i == 310 else 200.0 + i, "xy"[i % 2]) for i in range(330)] + [(None, 100.0, "x"), (0, 100.5, "y")]
    df = spark.createDataFrame(rows, "id long, v double, kind string").withColumn("b", F.lit("b")).repartition(3)
    got = dedup.blocked_pairs(df, "b", "id", "v", 0.01, ["kind"], digits=4)
    want = []
    for a, v, k in rows:
        for b, w, m in rows:
            if None not in (a, b, v, w) and a < b and abs(v - w) / max(v, w) <= 0.01:
                want.append((a, b, k, m, round(abs(v - w) / max(v, w), 4)))
    assert sorted(map(tuple, got.select("key_a", "key_b", "kind_a", "kind_b", "difference").collect())) == sorted(want)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("explode(ys") < min(plan.find(x) for x in ("Exchange", "Join") if x in plan)  # rows meet after the last join and shuffle


def test_a_triple_that_is_not_transitive(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    pairs = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1)], PAIRS)
    assert families_of(families.components(nodes, pairs)) == {1: 1, 2: 1, 3: 1}
    assert families_of(families.leaders(nodes, pairs, [])) == {1: 1, 2: 1, 3: 3}
    found = families.leaders(nodes, pairs, [])
    assert [tuple(r) for r in families.boundary_pairs(pairs, found).collect()] == [(2, 3, 1, 3)]


def test_scans_skip_what_is_gone():
    table = {p: 0.99 for p in permutations("abc", 2)}
    over = lambda r: r > 0.9
    assert columns.scan(list("abc"), table, over, lambda a, b: b) == {"a": "c", "b": "c"}  # a meets c though b has it gone by then
    assert columns.scan(list("abc"), table, over, lambda a, b: b, stop=True) == {"a": "b", "b": "c"}
    assert columns.scan(list("abc"), table, over, lambda a, b: a, {"b"}) == {"a": "b", "c": "a"}
    assert columns.scan(list("abc"), table, over, lambda a, b: min(a, b), {"b"}) == {"a": "b", "c": "a"}
    worth = {"b": 3, "a": 2, "c": 1}
    star = {p: 0.99 for x in "bc" for p in (("a", x), (x, "a"))}
    best = lambda a, b: max(a, b, key=worth.get)
    assert columns.scan(list("abc"), star, over, best) == {"a": "b", "c": "a"}
    assert columns.scan(list("abc"), star, over, best, stop=True) == {"a": "b"}
    assert columns.scan(list("bca"), star, over, best, back=True) == {"a": "b", "c": "a"}
    assert columns.average_link(list("abcd"), {("a", "b"): 0.99, ("b", "a"): 0.99, ("c", "d"): 0.97, ("d", "c"): 0.97}, 0.9) == [["a", "b"], ["c", "d"]]


def test_pruning_by_inflation(spark):
    rng = random.Random(1)
    rows = [(x := rng.random(), y := rng.random(), x + y + rng.random() / 100, rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, both double, own double")
    left = columns.prune_by_inflation(df, ["x", "y", "both", "own"], 10.0)
    assert len(left) == 3 and "own" in left
    assert columns.clean(spark.createDataFrame([], df.schema), df.columns)[0] == []


def test_joins_refuse_what_they_cannot_promise(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "z")], "k long, w string")
    with pytest.raises(ValueError, match="left has several"):
        joins.one_to_one(a, b, ["k"])
    with pytest.raises(ValueError, match="both tables have"):
        joins.one_to_one(b, b, ["k"])
    with pytest.raises(ValueError, match="rows differ at 1"):
        joins.side_by_side(b, b.select("k", F.lit("q").alias("w")), "k", "w")
    assert joins.keys_equal(a, b, ["k"]) and not joins.keys_equal(a, b.where("false"), ["k"])
    rows = spark.createDataFrame([(1, "m", None), (2, "m", 5), (3, "n", None), (4, "n", 1), (5, "n", 2), (6, "o", None)], "i long, k string, v long")
    got = {r["i"]: (r["v"], r["repair"]) for r in joins.repaired(rows, F.col("v").isNull(), "k", ["v"]).collect()}
    assert got == {1: (5, "repaired"), 2: (5, "kept"), 3: (None, "ambiguous"), 4: (1, "kept"), 5: (2, "kept"), 6: (None, "unmatched")}


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(2)
    left = [(i, rng.choice([None, rng.randint(0, 400) / 4])) for i in range(200)]
    right = [(rng.randint(0, 100) * 1.0, i) for i in range(150)]
    got = joins.nearest(spark.createDataFrame(left, "i long, x double"), spark.createDataFrame(right, "x double, k long"), "x", "k").collect()
    least = {v: min(k for w, k in right if w == v) for v, _ in right}
    want = {i: None if x is None else least[min(least, key=lambda v: (abs(v - x), v))] for i, x in left}
    assert {r["i"]: r["k"] for r in got} == want


def test_nearest_reads_no_frame_anew(spark):
    left = spark.range(3000).select(F.col("id").alias("i"), (500 + F.col("id") % 2).cast("double").alias("x"))
    right = spark.createDataFrame([(1.0, 1), (2.0, 2)], "x double, k long")
    got = joins.nearest(left, right, "x", "k")
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding$(), currentrow$()" in plan and "currentrow$(), unboundedfollowing$()" not in plan
    assert got.where("k = 2").groupBy("gap").count().orderBy("gap").collect() == [(498.0, 1500), (499.0, 1500)]


def test_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "rank long, v double")
    assert checks.consecutive_ranks(df, "rank")[1] and not checks.consecutive_ranks(df.where("rank <> 2"), "rank")[1]
    changed = df.withColumn("v", F.when(F.col("rank") == 3, 9.0).otherwise(F.col("v")))
    assert checks.unchanged(df, df, "rank", df.limit(0))[1] and not checks.unchanged(df, changed, "rank", df.limit(0))[1]
    assert checks.unchanged(df, changed, "rank", df.where("rank = 3"))[1]
    assert checks.frame_hash(df) == checks.frame_hash(df.repartition(3).select("v", "rank")) != checks.frame_hash(changed)
    assert checks.payload_hash({"b": 1, "a": [2]}) == checks.payload_hash({"a": [2], "b": 1})
    assert checks.checked_config({"k": 2}, {"k": (1, 3)}) == {"k": 2}
    for bad in ({"k": 9}, {"j": 2}, {"k": "x"}):
        with pytest.raises(ValueError):
            checks.checked_config(bad, {"k": (1, 3)})
    with pytest.raises(ValueError, match="unique"):
        checks.report(spark, [checks.unique_keys(df.union(df), ["rank"])], strict=True)


def test_formulas(spark):
    rows = [("NaCl", None), ("FeBr2", "FeBr2_mp-22880.cif"), ("2-Feb", "FeBr2_mp-22880.cif"), ("Al0.5Cl1.5", "x"), ("BrF3", "x"), ("ClCl", "x"), ("", "NaCl_mp-1.cif")]
    x = formulas.parts(F.col("f"))
    got = spark.createDataFrame(rows, "f string, name string").select("f", formulas.repaired(F.col("f"), F.col("name")).alias("r"), formulas.binary_halide(x).alias("why"), formulas.rendered(x).alias("s"), F.round(formulas.fractions(x)[0]["amount"], 3).alias("share")).collect()
    assert [r["r"] for r in got] == ["NaCl", "FeBr2", "FeBr2", "Al0.5Cl1.5", "BrF3", "ClCl", "NaCl"]
    assert [r["why"] for r in got] == [None, None, "not_binary", None, "halogen_pair", "not_binary", "not_binary"]
    assert got[3]["s"] == "Al0.5Cl1.5" and got[3]["share"] == 0.25 and got[5]["s"] == "Cl2"
    codes = spark.createDataFrame([("aaaaaaft",), ("AAAA",), ("aaaaaaab",)], "c string").select(formulas.from_letters(F.col("c")).alias("n")).collect()
    assert [r["n"] for r in codes] == [149, None, 1]
    assert spark.range(1).select(formulas.symbol(F.lit("fE2+"))).first()[0] == "Fe"


def test_missing_values_and_truth(spark):
    rows = spark.createDataFrame([(float("nan"), " ", "True"), (float("inf"), "NA", "0"), (None, None, ""), (-0.0, "x ", "other")], "v double, t string, b string")
    got = rows.select(cleaning.finite(F.col("v")).alias("v"), cleaning.filled(F.col("t")).alias("t"), cleaning.truth(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(None, None, True), (None, "NA", False), (None, None, None), (0.0, "x", None)]


def test_transforms_and_scores(spark):
    df = spark.createDataFrame([(1, 1.0, "a", "1"), (2, None, "b", "x"), (3, 3.0, "a", "2"), (4, 3.0, None, "3")], "i long, v double, c string, t string")
    values = transforms.fill_values(df, ["v"], ["c"])
    assert values == {"v": 3.0, "c": "a"}
    assert [r["v"] for r in transforms.filled(df, values).orderBy("i").collect()] == [1.0, 3.0, 3.0, 3.0]
    assert transforms.mostly_numbers(df, ["c", "t"]) == ["t"] and transforms.numeric_columns(df, {"i"}) == ["v"]
    assert transforms.varying(df.withColumn("k", F.lit(2)), ["v", "k"]) == ["v"]
    assert {r["i"]: r["is_b"] for r in transforms.one_hot(df, "c", ["a", "b"], "is").collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert [r["v"] for r in transforms.average_ranks(df, ["v"]).collect()].count(2.5) == 2
    with pytest.raises(ValueError):
        transforms.categories(df, "c", 1)
    places = spark.createDataFrame([("x", "r1", 1), ("y", "r1", 2), ("x", "r2", 3)], "item string, ranking string, place long")
    assert {r["item"]: (r["borda"], r["votes"]) for r in ranking.borda(places, "item", "ranking", "place", 2).collect()} == {"x": (4.0, 2), "y": (1e6 + 2, 1)}
    assert spark.range(1).select(scoring.kernel_distance(F.lit(1.0), F.lit(1.0), F.lit(0.5))).first()[0] == 1.0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1.5), (2, " ", float("nan")), (3, "007", float("inf"))], "k int, t string, v double")
    at = str(tmp_path / "t")
    files.write_csv(df, at)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_csv(df, at)
    files.write_csv(df, at, replace=True)
    assert files.header(spark, at) == ["k", "t", "v"]
    assert sorted(tuple(r) for r in files.clean_csv(spark, at).select("k", "v").collect()) == [(1, 1.5), (2, None), (3, None)]
    assert {r["t"] for r in files.raw_csv(spark, at).collect()} >= {"x", "007"}
    files.append_csv(df.limit(1), at)
    assert files.csv(spark, at).count() == 4 and files.listing(spark, at, ".csv").count() >= 2
    assert files.some_rows(df, df.where("k = 2"), "k").count() == 1 and files.first_rows(df, "k", 2).count() == 2
    (tmp_path / "s.json").write_text('{"a": [1]}')
    assert files.settings(spark, str(tmp_path / "s.json")) == {"a": [1]}
    (tmp_path / "e.json").write_text("{}")
    with pytest.raises(ValueError):
        files.settings(spark, str(tmp_path / "e.json"))
    files.write_parquet(df, str(tmp_path / "p"), by=["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", 2), ("2024-01-01 03:00:00", "b", 4), ("2024-01-01 00:20:00", "a", 9), ("2024-01-01 06:00:00", "c", 5)]
    for i, part in enumerate((rows[:3], rows[4:], rows[3:4])):  # rows are late by the watermark that the batch before began with
        spark.createDataFrame(part, "ts string, k string, v long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        for file in (tmp_path / "in" / f"part={i}").glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 100 * i,) * 2)  # a stream takes files by their time
    stream = spark.readStream.schema("ts timestamp, k string, v long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spans = windows.tumbling(stream, "ts", "1 hour", ["k"], [F.sum("v").alias("v")], late="30 minutes")
    q = spans.writeStream.outputMode("append").format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["v"]) for r in spark.table("spans").collect()} == {("a", 3), ("b", 4)}  # the row of 00:20 comes after the watermark
    todo = spark.range(5).withColumnRenamed("id", "k")
    done = str(tmp_path / "done")
    assert windows.resumed(spark, todo.where("k < 3"), "k", done, lambda d: d.withColumn("run", F.lit(1))).count() == 3
    table = windows.resumed(spark, todo, "k", done, lambda d: d.withColumn("run", F.lit(2)))
    assert {r["k"]: r["run"] for r in table.collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}


def test_percentiles_without_a_reference(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k long, v double")
    assert sorted(map(tuple, scoring.against_reference(df, "v", df.where("false"), "k").collect())) == [(1, 0.5, 1.0), (2, None, None)]


@pytest.mark.parametrize("links", [50_000, 120])
def test_chains_of_complete_links_are_few_rounds(spark, monkeypatch, links):
    rng, n = random.Random(8), 90
    pairs = {(i, i + 1): 0.5 - i / 1000 for i in range(60)}  # each is nearer to the next than to the one before
    pairs |= {(i, j): rng.choice([0.1, 0.2, 0.3, rng.random()]) for i, j in combinations(range(61, n), 2) if j - i < 6}
    if links == 120:
        pairs |= {(60, j): 0.05 + j / 1000 for j in range(61, 2 * n)}  # more links than a task is to hold
    tables, written = [], families.written
    monkeypatch.setattr(families, "LINKS", links)
    monkeypatch.setattr(families, "written", lambda df: tables.append(df) or written(df))
    nodes = spark.createDataFrame([(i,) for i in range(2 * n)], "node long")
    got = families_of(families.complete_link(nodes, spark.createDataFrame([(*p, d) for p, d in pairs.items()], PAIRS), "score", 0.6, order=["node"]))
    assert got == plain_complete_link(range(2 * n), pairs, 0.6)
    assert links == 120 or len(tables) < 10


def test_pairs_of_many_near_values_are_sent_once(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.choice("uv"), round(100 + rng.randint(0, 300) / 100, 2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, b string, v double")
    want = {(a, c) for (a, b, v), (c, e, w) in permutations(rows, 2) if a < c and b == e and abs(v - w) / max(v, w) <= 0.01}
    sent, plain = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: sent.append(self) or plain(self, *a))
    pairs = lambda: [tuple(r) for r in dedup.blocked_pairs(df, "b", "id", "v", 0.01).select("key_a", "key_b").collect()]
    assert sorted(pairs()) == sorted(want)
    told = lambda x: x.select(F.sum(F.size(F.split(F.to_json(F.struct("xs", "ys")), '"key"')) - 1)).first()[0]
    assert told(sent[-1]) <= 8 * len(rows)  # a row meets some hundred other values
    monkeypatch.setattr(dedup, "LISTED", 2)
    monkeypatch.setattr(dedup, "PART", 50)
    assert sorted(pairs()) == sorted(want)
