"""Golden records: one record per cluster of client rows, each field from the row that survives.

Who survives is a plain ``min`` of order-preserving binary keys. A key packs what decides, most important first, into bytes whose unsigned
order is the order of preference: staleness and trust a byte each, microseconds inverted, client_id with its sign bit turned. Partial
minima are taken before any shuffle, so a cluster that has a third of all rows sends one row a task. The chosen keys name their rows, and
a join on these names recovers the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_group

#: Sources by falling trust; all others come last.
TRUST = ("store", "crm", "partner", "web")
#: Microseconds before its cluster's latest beyond which a record is stale.
STALE_AFTER = 10 * 24 * 3600 * 1_000_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Bytes of a recency key: null flag, microseconds, trust, null flag, client_id; and a key that is above all.
RECENT_BYTES = 19
ABOVE = "FF" * RECENT_BYTES
COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


def one_byte(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2, "0")


def eight_bytes(x: Column) -> Column:
    """A long as 16 hexadecimal digits, as it is in memory."""
    return F.lpad(F.hex(x), 16, "0")


def ascending(x: Column) -> Column:
    """Nine bytes in hexadecimal that sort as the long does, null last."""
    return F.when(x.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), eight_bytes(x.bitwiseXOR(F.lit(LOWEST)))))


def descending(x: Column) -> Column:
    """Nine bytes in hexadecimal that sort against the long, null last."""
    return F.when(x.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), eight_bytes(x.bitwiseXOR(F.lit(HIGHEST)))))


def named_by(key: Column) -> Column:
    """The client_id in the last nine bytes of a key; null if it was null or there is no key."""
    digits = F.substring(F.hex(key), -18, 18)
    back = F.conv(F.substring(digits, 3, 16), 16, -10).cast("long").bitwiseXOR(F.lit(LOWEST))
    return F.when(F.substring(digits, 1, 2) == "00", back)


def microseconds(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp, with a zone or without; the session's zone plays no part."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    since = F.expr(f"CAST(`{column}` AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since)
    hours = part("DAY").cast("long") * 24 + part("HOUR").cast("long")
    return (hours * 60 + part("MINUTE").cast("long")) * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def worded(column: str) -> Column:
    """A text, or null if it is empty or blank."""
    return F.when(F.col(column).rlike("[^\\x20\\x09-\\x0D]"), F.col(column))


def records(clients: DataFrame, trust: tuple[str, ...] = TRUST) -> DataFrame:
    """The fields, the cluster (``c`` and whether it is null, ``no_c``), trust and microseconds of each row."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, trust)), F.col("source")), F.lit(0)), F.lit(len(trust) + 1)).cast("long")
    balance = F.col("balance").cast("double")
    return clients.select(
        F.coalesce("master_id", "client_id", F.lit(0)).cast("long").alias("c"),
        F.coalesce("master_id", "client_id").isNull().alias("no_c"),
        F.col("client_id").cast("long").alias("client_id"),
        rank.alias("trust"),
        microseconds(clients, "updated_at").alias("at"),
        *[worded(x).alias(x) for x in ("name", "email", "city", "segment")],
        F.col("nation_id"),
        F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance).alias("balance"),
    )


def keys(stale_after: int = STALE_AFTER) -> dict[str, Column]:
    """The key of each field as a column over rows that have their cluster's ``latest``; null where the field is."""
    stale = F.coalesce(F.col("at") < F.col("latest") - stale_after, F.lit(True))
    recent = F.concat(descending(F.col("at")), one_byte(F.col("trust")), ascending(F.col("client_id")))
    trusted = F.concat(one_byte(stale), one_byte(F.col("trust")), recent)
    full = F.when(F.col("city").isNotNull(), 1).otherwise(0) + F.when(F.col("nation_id").isNotNull(), 1).otherwise(0)
    chars = F.substring(eight_bytes(F.lit(HIGHEST) - F.length("name").cast("long")), 9, 8)
    made = {
        "name": F.when(F.col("name").isNotNull(), F.concat(chars, trusted)),
        "email": F.when(F.col("email").isNotNull(), trusted),
        "segment": F.when(F.col("segment").isNotNull(), recent),
        "balance": F.when(F.col("balance").isNotNull(), recent),
        "address": F.concat(one_byte(2 - full), recent),
    }
    return {"stale": stale, "recent": F.unhex(recent), **{f"{k}_key": F.unhex(v) for k, v in made.items()}}


def golden_records(clients: DataFrame, trust: tuple[str, ...] = TRUST, stale_after: int = STALE_AFTER) -> DataFrame:
    """One row per cluster (master_id, or client_id where that is null): counts, surviving fields and the client_ids they come from.

    Columns: cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance_cents, name_from, email_from, segment_from,
    balance_from, address_from. Empty and blank texts count as null, balances that are no finite numbers too; a field that no row has is
    null. Rows without both ids are one cluster, whose id is null. Sources that ``trust`` does not name, null too, come after all others.
    Of rows that agree in all that decides (cluster, source, time, client_id) the least value of each field stays, and the least pair of
    city and nation, nulls first. An empty table gives an empty result; other columns are not read.
    """
    base = records(clients, trust)
    latest = base.groupBy("c", "no_c").agg(F.max("at").alias("latest"))
    told = with_group(base, latest, ["c", "no_c"], F.xxhash64("client_id", "at", "name", "email"))
    rows = cut(told.withColumns(keys(stale_after)).drop("at", "latest", "trust", "client_id"))
    least = [F.min(f"{k}_key").alias(f"{k}_key") for k in ("name", "email", "balance", "address")]
    by_segment = rows.groupBy("c", "no_c", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stale").cast("long")).alias("s"), F.min("segment_key").alias("segment_key"), *least)
    above = F.unhex(F.lit(ABOVE))
    chosen = F.min(F.concat("segment_key", F.coalesce("balance_key", above))).alias("chosen")  # the segment's key, and with it the best balance inside it
    won = by_segment.groupBy("c", "no_c").agg(F.sum("n").alias("n_records"), F.sum("s").alias("n_stale"), chosen, *least)
    inside = F.nullif(F.substring("chosen", RECENT_BYTES + 1, RECENT_BYTES), above)
    won = won.select("c", "no_c", "n_records", "n_stale", "name_key", "email_key", "address_key", F.substring("chosen", 1, RECENT_BYTES).alias("segment_key"), F.coalesce(inside, "balance_key").alias("balance_key"))
    fields = ["name", "email", "segment", "balance", "address"]
    names = F.array_distinct(F.filter(F.array(*[F.substring(f"{f}_key", -RECENT_BYTES, RECENT_BYTES) for f in fields]), lambda k: k.isNotNull()))
    asked = won.select("*", F.explode(names).alias("recent")).withColumnsRenamed({f"{f}_key": f"{f}_won" for f in fields})
    met = rows.select("c", "no_c", "recent", *[f"{f}_key" for f in fields], "name", "email", "segment", "balance", F.struct("city", "nation_id").alias("address"))
    met = met.join(asked, ["c", "no_c", "recent"])
    value = lambda f: F.min(F.when(F.col(f"{f}_key") == F.col(f"{f}_won"), F.col(f))).alias(f)
    same = [F.first(x).alias(x) for x in ["n_records", "n_stale", *[f"{f}_won" for f in fields]]]
    out = met.groupBy("c", "no_c").agg(*same, *map(value, fields))
    found = {f: named_by(F.col(f"{f}_won")) for f in fields}
    return out.select(
        F.when(~F.col("no_c"), F.col("c")).alias("cluster_id"),
        "n_records",
        "n_stale",
        "name",
        "email",
        "segment",
        F.col("address.city").alias("city"),
        F.col("address.nation_id").alias("nation_id"),
        F.floor(100 * F.col("balance") + 0.5).cast("long").alias("balance_cents"),
        *[found[f].alias(f"{f}_from") for f in fields[:-1]],
        F.when(F.coalesce("address.city", F.col("address.nation_id").cast("string")).isNotNull(), found["address"]).alias("address_from"),
    )


def op11_golden_records(spark, sf_dir: str) -> DataFrame:
    return golden_records(spark.read.parquet(f"{sf_dir}/clients.parquet"))


ORACLE_SQL = r"""
WITH r AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, balance,
        CASE source WHEN 'store' THEN 1 WHEN 'crm' THEN 2 WHEN 'partner' THEN 3 WHEN 'web' THEN 4 ELSE 5 END AS trust,
        CASE WHEN regexp_matches(name, '[^\x20\x09-\x0D]') THEN name END AS name, CASE WHEN regexp_matches(email, '[^\x20\x09-\x0D]') THEN email END AS email,
        CASE WHEN regexp_matches(city, '[^\x20\x09-\x0D]') THEN city END AS city, CASE WHEN regexp_matches(segment, '[^\x20\x09-\x0D]') THEN segment END AS segment FROM clients),
    s AS (SELECT *, coalesce(updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 240 HOUR, true) AS stale,
        first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, updated_at DESC NULLS LAST, trust, client_id) AS chosen,
        (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled FROM r),
    g AS (SELECT cluster_id, count(*) AS n_records, count(CASE WHEN stale THEN 1 END) AS n_stale,
        first(struct_pack(v := name, f := client_id) ORDER BY length(name) DESC, stale, trust, updated_at DESC NULLS LAST, client_id) FILTER (name IS NOT NULL) AS n,
        first(struct_pack(v := email, f := client_id) ORDER BY stale, trust, updated_at DESC NULLS LAST, client_id) FILTER (email IS NOT NULL) AS e,
        first(struct_pack(v := segment, f := client_id) ORDER BY updated_at DESC NULLS LAST, trust, client_id) FILTER (segment IS NOT NULL) AS s,
        first(struct_pack(v := balance, f := client_id) ORDER BY segment IS NOT DISTINCT FROM chosen AND chosen IS NOT NULL DESC, updated_at DESC NULLS LAST, trust, client_id) FILTER (balance IS NOT NULL) AS b,
        first(struct_pack(city := city, nation := nation_id, f := CASE WHEN filled > 0 THEN client_id END) ORDER BY filled DESC, updated_at DESC NULLS LAST, trust, client_id) AS a FROM s GROUP BY cluster_id)
SELECT cluster_id, n_records, n_stale, n.v AS name, e.v AS email, s.v AS segment, a.city AS city, a.nation AS nation_id, CAST(floor(100 * b.v + 0.5) AS BIGINT) AS balance_cents,
    n.f AS name_from, e.f AS email_from, s.f AS segment_from, b.f AS balance_from, a.f AS address_from FROM g
"""
