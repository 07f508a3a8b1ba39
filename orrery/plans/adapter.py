"""The star schema seen as a world of objects, events, participations, relations and edges.

The same rules are written once as DataFrames and once as the SQL parts of the
DuckDB twins, so that an operator can be compared on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import confidence, geo
from orrery.functions.timefn import month_index, to_ms

#: A closure ends where nothing new is reached. Chains of ids that are halved at each step end before this.
WHOLE_DEPTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_of(key: Column) -> Column:
    return (key.cast("long") * 7919 % 36000) / 100.0 - 180.0


def lat_of(key: Column) -> Column:
    return (key.cast("long") * 104729 % 17000) / 100.0 - 85.0


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, type, label, lon, lat, source, confidence, status, cx, cy."""

    def part(name, prefix, key, kind, label, source, conf, placed=True, status=None):
        df = table(spark, sf_dir, name)
        none = F.lit(None).cast("double")
        return df.select(
            F.concat(F.lit(prefix + ":"), F.col(key).cast("string")).alias("object_id"),
            F.lit(kind).alias("type"),
            F.col(label).alias("label"),
            (lon_of(F.col(key)) if placed else none).alias("lon"),
            (lat_of(F.col(key)) if placed else none).alias("lat"),
            source.alias("source"),
            conf.cast("double").alias("confidence"),
            (F.lit("current") if status is None else status).alias("status"),
        )

    balance = lambda c: F.round(F.least(F.greatest((F.col(c) + 1000) / 11000, F.lit(0.0)), F.lit(1.0)), 6)
    owed = lambda c: F.when(F.col(c) < 0, "retracted").otherwise("current")
    parts = [
        part("region", "region", "r_regionkey", "place.region", "r_name", F.lit("atlas"), F.lit(0.95), placed=False),
        part("nation", "nation", "n_nationkey", "place.nation", "n_name", F.lit("atlas"), F.lit(0.95)),
        part("customer", "customer", "c_custkey", "org.customer", "c_name", F.col("c_mktsegment"), balance("c_acctbal"), status=owed("c_acctbal")),
        part("supplier", "supplier", "s_suppkey", "org.supplier", "s_name", F.lit("registry"), balance("s_acctbal"), status=owed("s_acctbal")),
        part("part", "part", "p_partkey", "item.part", "p_name", F.col("p_brand"), F.col("p_size") / 50.0, placed=False),
    ]
    world = parts[0]
    for p in parts[1:]:
        world = world.unionByName(p)
    return world.withColumns({"cx": geo.cell_x(F.col("lon")), "cy": geo.cell_y(F.col("lat"))})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, type, t_ms, month, subject, value, severity, confidence, source, grp, status, lon, lat, cx, cy."""
    e, k = table(spark, sf_dir, "events"), F.col("user_id")
    df = e.select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("event_id").alias("n"),
        F.col("event_type").alias("type"),
        to_ms(F.col("ts")).alias("t_ms"),
        F.concat(F.lit("customer:"), k.cast("string")).alias("subject"),
        k.alias("user_id"),
        F.col("value"),
        confidence.severity(F.col("value"), 0.0, 200.0).alias("severity"),
        (F.col("event_id") * 37 % 100 / 100.0).alias("confidence"),
        F.concat(F.lit("feed"), (F.col("event_id") % 4).cast("string")).alias("source"),
        F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("grp"),
        F.when(F.col("event_id") % 50 == 0, "retracted").otherwise("current").alias("status"),
        lon_of(k).alias("lon"),
        lat_of(k).alias("lat"),
    )
    return df.withColumns({"month": month_index(F.col("t_ms")), "cx": geo.cell_x(F.col("lon")), "cy": geo.cell_y(F.col("lat"))})


def participations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, object_id, role: subjects of events and buyers of orders."""
    e = events(spark, sf_dir).select("event_id", F.col("subject").alias("object_id"), F.lit("subject").alias("role"))
    o = table(spark, sf_dir, "orders")
    return e.unionByName(o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("event_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("object_id"), F.lit("buyer").alias("role")))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation_id, type, nature, from_id, to_id, groups (independent), confidence."""

    def part(df, kind, nature, a, b, groups, conf):
        ids = [F.concat(F.lit(p + ":"), F.col(c).cast("string")) for p, c in (a, b)]
        return df.select(F.concat_ws("|", F.lit(kind), *ids).alias("relation_id"), F.lit(kind).alias("type"), F.lit(nature).alias("nature"), ids[0].alias("from_id"), ids[1].alias("to_id"), groups.cast("long").alias("groups"), conf.cast("double").alias("confidence"))

    one = F.lit(1)
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    supply = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("l_returnflag").alias("g"), F.max("l_discount").alias("d"))
    return (
        part(n, "located_in", "spatial", ("nation", "n_nationkey"), ("region", "n_regionkey"), one, F.lit(0.95))
        .unionByName(part(c, "located_in", "spatial", ("customer", "c_custkey"), ("nation", "c_nationkey"), one, F.lit(0.9)))
        .unionByName(part(s, "located_in", "spatial", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), one, F.lit(0.9)))
        .unionByName(part(supply, "supplies", "logical", ("supplier", "l_suppkey"), ("part", "l_partkey"), F.col("g"), 1 - F.col("d")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, kind, type, dst, ref: the navigation index over relations and participations."""
    r = relations(spark, sf_dir).select(F.col("from_id").alias("src"), F.lit("relation").alias("kind"), "type", F.col("to_id").alias("dst"), F.col("relation_id").alias("ref"))
    p = participations(spark, sf_dir).where("role = 'subject'")
    return r.unionByName(p.select(F.col("event_id").alias("src"), F.lit("participation").alias("kind"), F.col("role").alias("type"), F.col("object_id").alias("dst"), F.col("event_id").alias("ref")))


# ---- the same in DuckDB SQL ----


def lon_sql(k: str) -> str:
    return f"(({k})::BIGINT * 7919 % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE"


def lat_sql(k: str) -> str:
    return f"(({k})::BIGINT * 104729 % 17000)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE"


def cx_sql(lon: str, level: int = 8) -> str:
    n = 1 << level
    return f"least(greatest(trunc(({lon} + 180.0::DOUBLE) / 360.0::DOUBLE * {n})::INT, 0), {n - 1})"


def cy_sql(lat: str, level: int = 8) -> str:
    n = 1 << level
    return f"least(greatest(trunc(({lat} + 90.0::DOUBLE) / 180.0::DOUBLE * {n})::INT, 0), {n - 1})"


def km_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = geo.EARTH_KM) -> str:
    s, t = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin(radians({lon2} - ({lon1})) / 2)"
    return f"({2 * radius}::DOUBLE * asin(least(1.0::DOUBLE, sqrt({s} * {s} + cos(radians({lat1})) * cos(radians({lat2})) * {t} * {t}))))"


_BALANCE = "round(least(greatest(({0} + 1000) / 11000, 0.0::DOUBLE), 1.0::DOUBLE), 6)"
_OWED = "CASE WHEN {0} < 0 THEN 'retracted' ELSE 'current' END"
OBJECT_SQL = f"""object AS (SELECT *, {cx_sql("lon")} AS cx, {cy_sql("lat")} AS cy FROM (
    SELECT 'region:' || r_regionkey AS object_id, 'place.region' AS type, r_name AS label, NULL::DOUBLE AS lon, NULL::DOUBLE AS lat, 'atlas' AS source, 0.95::DOUBLE AS confidence, 'current' AS status FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'place.nation', n_name, {lon_sql("n_nationkey")}, {lat_sql("n_nationkey")}, 'atlas', 0.95::DOUBLE, 'current' FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'org.customer', c_name, {lon_sql("c_custkey")}, {lat_sql("c_custkey")}, c_mktsegment, {_BALANCE.format("c_acctbal")}, {_OWED.format("c_acctbal")} FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'org.supplier', s_name, {lon_sql("s_suppkey")}, {lat_sql("s_suppkey")}, 'registry', {_BALANCE.format("s_acctbal")}, {_OWED.format("s_acctbal")} FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, 'item.part', p_name, NULL, NULL, p_brand, p_size::DOUBLE / 50.0::DOUBLE, 'current' FROM part))"""
EVENT_SQL = f"""event AS (SELECT 'event:' || event_id AS event_id, event_id AS n, event_type AS type, epoch_us(ts) // 1000 AS t_ms, 'customer:' || user_id AS subject, user_id, value,
    least(greatest((value - 0.0::DOUBLE) / 200.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS severity, (event_id * 37 % 100)::DOUBLE / 100.0::DOUBLE AS confidence,
    'feed' || (event_id % 4) AS source, 'g' || (event_id % 3) AS grp, CASE WHEN event_id % 50 = 0 THEN 'retracted' ELSE 'current' END AS status,
    {lon_sql("user_id")} AS lon, {lat_sql("user_id")} AS lat, (year(ts) * 12 + month(ts) - 1)::BIGINT AS month, {cx_sql(lon_sql("user_id"))} AS cx, {cy_sql(lat_sql("user_id"))} AS cy FROM events)"""
PART_SQL = """participation AS (SELECT 'event:' || event_id AS event_id, 'customer:' || user_id AS object_id, 'subject' AS role FROM events
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'buyer' FROM orders)"""
RELATION_SQL = """relation AS (SELECT type || '|' || from_id || '|' || to_id AS relation_id, * FROM (
    SELECT 'located_in' AS type, 'spatial' AS nature, 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, 1::BIGINT AS groups, 0.95::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'located_in', 'spatial', 'customer:' || c_custkey, 'nation:' || c_nationkey, 1, 0.9::DOUBLE FROM customer
    UNION ALL SELECT 'located_in', 'spatial', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1, 0.9::DOUBLE FROM supplier
    UNION ALL SELECT 'supplies', 'logical', 'supplier:' || l_suppkey, 'part:' || l_partkey, count(DISTINCT l_returnflag), 1 - max(l_discount) FROM lineitem GROUP BY l_suppkey, l_partkey))"""
EDGE_SQL = """edge AS (SELECT from_id AS src, 'relation' AS kind, type, to_id AS dst, relation_id AS ref FROM relation
    UNION ALL SELECT event_id, 'participation', role, object_id, event_id FROM participation WHERE role = 'subject')"""


def world_sql(*names: str) -> str:
    """The WITH parts for the named tables of the world, in an order that works."""
    need = set(names)
    if "edge" in need:
        need |= {"relation", "participation"}
    parts = {"object": OBJECT_SQL, "event": EVENT_SQL, "participation": PART_SQL, "relation": RELATION_SQL, "edge": EDGE_SQL}
    return ",\n".join(v for k, v in parts.items() if k in need)
