"""Golden records equal plain Python on hard rows, and DuckDB on the table."""

import datetime as dt
import math
import re
from pathlib import Path

import duckdb
import pytest

from lodestone.llm import survivorship as sv

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, c int, recent string, chosen long, latest int, email_key int"
T = dt.datetime(2024, 3, 31, 2, 30)
SPAN = dt.timedelta(hours=240)
EXTRA = (1, "x", 2, 3, 4)
ROWS = [
    (1, 1, "web", T, "Ann", "a@x", None, None, "retail", 1.005),
    (2, 1, "store", T - SPAN, "Änn", " \t", "Rome", None, "export", 2.5),
    (3, 1, "crm", T - SPAN - dt.timedelta(microseconds=1), "Annabel", "c@x", "Oslo", 4, None, 7.0),
    (4, 1, "crm", None, "Anna B.", "", "Bern", 5, "retail", float("nan")),
    (-5, 1, "store", T, None, None, None, None, None, None),
    (6, None, "partner", None, "", None, "  ", None, None, float("inf")),
    (7, None, None, T, "one", "e", "c", 1, "s", -0.005),
    (8, None, "odd", dt.datetime(1815, 12, 10, 1, 2, 3, 456789), "two", "e", "c", 1, "s", 0.0),
    (None, None, "crm", T, "nobody", None, None, 3, None, 5.0),
    (None, None, "store", T, "nobodx", None, None, None, None, 6.0),
    (9, 8, "web", dt.datetime(1815, 12, 20, 1, 2, 3, 456789), "\U0001f600" * 3, "late", None, None, "t", 3.0),
    (10, 10, "web", T, "same", "x", "a", None, "m", 1.0), (10, 10, "web", T, "same", "x", "a", None, "m", 1.0),
    (11, 10, "web", T, "same", "y", None, 9, "n", 2.0), (11, 10, "web", T, "sane", "w", "b", None, "k", 1.5),
    (1 << 62, 12, "crm", T, None, "far", None, None, None, None), (-(1 << 62), 12, "crm", T, None, "near", None, None, None, None),
]


def brute(rows):
    clusters, out = {}, []
    for r in rows:
        clusters.setdefault(r[1] if r[1] is not None else r[0], []).append(r)
    text = lambda x: x if x and re.search(r"[^\x20\x09-\x0d]", x) else None
    for cluster, members in clusters.items():
        latest = max((r[3] for r in members if r[3]), default=None)
        new = []
        for cid, _, source, at, name, email, city, nation, segment, balance in members:
            trust = {"store": 0, "crm": 1, "partner": 2, "web": 3}.get(source, 4)
            stale = at is None or at < latest - SPAN
            recent = (at is None, -(at - dt.datetime(1, 1, 1)) // dt.timedelta(microseconds=1) if at else 0, trust, cid is None, cid or 0)
            balance = balance if balance is not None and math.isfinite(balance) else None
            new.append({"id": cid, "stale": stale, "recent": recent, "trusted": (stale, trust, recent), "name": text(name), "email": text(email), "city": text(city), "nation": nation, "segment": text(segment), "balance": balance})

        def first(field, key):
            return min((m for m in new if m[field] is not None), key=lambda m: (key(m), m[field]), default={field: None, "id": None})

        name, email = first("name", lambda m: (-len(m["name"]), m["trusted"])), first("email", lambda m: m["trusted"])
        segment = first("segment", lambda m: m["recent"])
        balance = first("balance", lambda m: (segment["segment"] is None or m["segment"] != segment["segment"], m["recent"]))
        none_first = lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x)
        place = min(new, key=lambda m: ((m["city"] is None) + (m["nation"] is None), m["recent"], none_first(m["city"]) if m["city"] else (False, ""), none_first(m["nation"])))
        cents = None if balance["balance"] is None else math.floor(100 * balance["balance"] + 0.5)
        held = place["city"] is not None or place["nation"] is not None
        out.append((cluster, len(new), sum(m["stale"] for m in new), name["name"], email["email"], segment["segment"], place["city"], place["nation"], cents, name["id"], email["id"], segment["id"], balance["id"], place["id"] if held else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_hard_rows_equal_brute_force(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = sv.golden_records(spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)


def test_a_large_cluster_and_an_empty_table(spark):
    rows = [(i, 3, "web", T - dt.timedelta(hours=i), f"n{i % 7}", None, None, i % 3, f"s{i % 2}", float(i)) for i in range(3000)]
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    assert sorted(map(tuple, sv.golden_records(docs).collect()), key=repr) == brute(rows)
    assert sv.golden_records(docs.where("false")).count() == 0


def test_zoned_times_and_keys(spark):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)
    zoned = docs.withColumn("updated_at", docs["updated_at"].cast("timestamp"))
    assert zoned.select(sv.microseconds(zoned, "updated_at")).collect() == docs.select(sv.microseconds(docs, "updated_at")).collect()
    ids = [-(1 << 63), -1, 0, 1, (1 << 63) - 1, None]
    kept = spark.createDataFrame([(i,) for i in ids], "i long").select("i", sv.F.unhex(sv.ascending(sv.F.col("i"))).alias("up"), sv.F.unhex(sv.descending(sv.F.col("i"))).alias("down"))
    assert [r["i"] for r in kept.orderBy("up").collect()] == ids
    assert [r["i"] for r in kept.orderBy("down").collect()] == [*ids[-2::-1], None]
    assert [r[0] for r in kept.orderBy("up").select(sv.named_by(sv.F.col("up"))).collect()] == ids


def test_query_equals_sql(spark):
    folder = Path("/root/testdata/sf0.01")
    got = [tuple(r) for r in sv.op11_golden_records(spark, str(folder)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clients AS SELECT * FROM '{folder / 'clients.parquet'}'")
    assert sorted(got, key=repr) == sorted(con.execute(sv.ORACLE_SQL).fetchall(), key=repr)
