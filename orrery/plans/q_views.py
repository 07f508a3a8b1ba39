"""Scopes, cube, map, timeline, facets, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import confidence, geo, timefn
from orrery.operators import cube as C
from orrery.operators import scope as S
from orrery.plans import adapter as A
from orrery.plans.catalog import query

T0, T1 = 1704412800000, 1705622400000  # 2024-01-05 .. 2024-01-19
VIEW = (-60.0, -30.0, 120.0, 60.0)
ACROSS = (150.0, -40.0, -150.0, 40.0)

EVENTS_SCOPE = S.Scope.of({"types": ["click", "purchase"], "time_window": [T0, T1], "min_confidence": 0.6, "status": ["current"], "sources": ["feed1", "feed2"], "ignored": 1})


@query("scope_rows", f"WITH {A.world_sql('event')} SELECT event_id, type, t_ms, confidence FROM event WHERE type IN ('click', 'purchase') AND t_ms BETWEEN {T0} AND {T1} AND confidence >= 0.6::DOUBLE AND status = 'current' AND source IN ('feed1', 'feed2')")
def scope_rows(spark, sf):
    return A.events(spark, sf).where(EVENTS_SCOPE.rows("event")).select("event_id", "type", "t_ms", "confidence")


@query("scope_as_of", f"WITH {A.world_sql('event')} SELECT type, count(*) AS n FROM event WHERE t_ms <= {T0} GROUP BY type")
def scope_as_of(spark, sf):
    return A.events(spark, sf).where(S.Scope.of({"as_of": T0}).rows("event", "t_ms")).groupBy("type").agg(F.count("*").alias("n"))


@query("live_rows", f"WITH {A.world_sql('object')} SELECT type, count(*) AS n FROM object WHERE status <> 'retracted' GROUP BY type")
def live_rows(spark, sf):
    return S.live(A.objects(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query("rule_where_triples", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW' AND o_orderpriority NOT IN ('1-URGENT')")
def rule_where_triples(spark, sf):
    w = S.where_triples([["o_totalprice", ">=", 100000.0], ["o_orderstatus", "in", ["F", "P"]], ["o_orderpriority", "!=", "5-LOW"], ["o_orderpriority", "not_in", ["1-URGENT"]]], F.col)
    return A.table(spark, sf, "orders").where(w).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _world_rows(spark, sf):
    o = A.objects(spark, sf).select(F.lit("object").alias("kind"), "type", "source", "confidence", "cx", "cy", F.lit(None).cast("long").alias("t_ms"))
    return o.unionByName(A.events(spark, sf).select(F.lit("event").alias("kind"), "type", "source", "confidence", "cx", "cy", "t_ms"))


def _cube(spark, sf):
    return C.build(_world_rows(spark, sf))


CUBE_SQL = f"""{A.world_sql("object", "event")},
wrow AS (SELECT 'object' AS kind, type, source, confidence, cx, cy, NULL::BIGINT AS t_ms FROM object UNION ALL SELECT 'event', type, source, confidence, cx, cy, t_ms FROM event),
wlev AS (SELECT *, CASE WHEN confidence >= 0.8::DOUBLE THEN 2 WHEN confidence >= 0.5::DOUBLE THEN 1 ELSE 0 END AS band, (cx IS NOT NULL)::INT AS geo,
    unnest(CASE WHEN cx IS NULL THEN [-1] ELSE [-1, 2, 4, 6, 8] END) AS level FROM wrow),
wper AS (SELECT *, unnest(CASE WHEN t_ms IS NULL THEN [0] ELSE [0, year(make_timestamp(t_ms * 1000)) * 100, year(make_timestamp(t_ms * 1000)) * 100 + month(make_timestamp(t_ms * 1000))] END)::INT AS period FROM wlev),
cube AS (SELECT level, period, CASE WHEN level < 0 THEN -1 ELSE cx >> (8 - level) END AS cx, CASE WHEN level < 0 THEN -1 ELSE cy >> (8 - level) END AS cy, kind, type, source, band, geo,
    count(*) AS n, max(coalesce(confidence, 0)) AS maxconf FROM wper GROUP BY ALL)"""


@query("cube_build", f"WITH {CUBE_SQL} SELECT * FROM cube")
def cube_build(spark, sf):
    return _cube(spark, sf)


@query("cube_delta", f"WITH {CUBE_SQL.replace('FROM event)', 'FROM event WHERE n % 4 <> 1)')} SELECT level, period, cx, cy, kind, type, source, band, geo, n FROM cube")
def cube_delta(spark, sf):
    """Every event is in the first cube, or added, or removed again."""
    rows = _world_rows(spark, sf).where("kind = 'object'")
    e = A.events(spark, sf).select(F.lit("event").alias("kind"), "type", "source", "confidence", "cx", "cy", "t_ms", "n")
    start = rows.unionByName(e.where("n % 4 <> 2").drop("n"))
    return C.apply_delta(C.build(start), e.where("n % 4 = 2").drop("n"), e.where("n % 4 = 1").drop("n")).drop("maxconf")


def _where(scope: S.Scope, level: int) -> str:
    t = [f"level = {level}", f"CASE WHEN kind = 'object' THEN period = 0 ELSE period IN ({', '.join(map(str, scope.period_codes()))}) END"]
    if scope.types is not None:
        t.append("type IN (" + ", ".join(f"'{x}'" for x in scope.types) + ")")
    if scope.min_confidence is not None:
        t.append(f"band >= {confidence.band_floor(scope.min_confidence)}")
    if scope.viewport is not None:
        t.append("(" + " OR ".join(f"cx BETWEEN {a} AND {b} AND cy BETWEEN {c} AND {d}" for a, b, c, d in geo.viewport_ranges(scope.viewport, level)) + ")")
    return " AND ".join(t)


MAPS = {
    "map_level2": S.Scope.of({"z": 0}),
    "map_level4": S.Scope.of({"z": 2, "viewport": list(VIEW), "min_confidence": 0.6}),
    "map_level6": S.Scope.of({"z": 4, "viewport": list(ACROSS)}),
    "map_level8": S.Scope.of({"z": 9, "time_window": [T0, T1], "types": ["org.customer", "click", "error"]}),
}
for _name, _scope in MAPS.items():
    query(_name, f"WITH {CUBE_SQL} SELECT cx, cy, kind, type, sum(n)::BIGINT AS n, max(maxconf) AS maxconf FROM cube WHERE {_where(_scope, _scope.level())} GROUP BY ALL")(lambda spark, sf, s=_scope: C.map_cells(_cube(spark, sf), s))


@query(
    "map_rollup",
    f"""WITH {CUBE_SQL}, c AS (SELECT cx, cy, type, sum(n) AS n, max(maxconf) AS maxconf FROM cube WHERE {_where(MAPS["map_level4"], 4)} GROUP BY ALL)
SELECT cx, cy, sum(n)::BIGINT AS n, min({{'m': -n, 'type': type}}).type AS dominant_type, count(*) AS n_types, max(maxconf) AS maxconf, cx * 360.0::DOUBLE / 16.0::DOUBLE - 180.0::DOUBLE AS min_lon, (cx + 1) * 360.0::DOUBLE / 16.0::DOUBLE - 180.0::DOUBLE AS max_lon,
    cy * 180.0::DOUBLE / 16.0::DOUBLE - 90.0::DOUBLE AS min_lat, (cy + 1) * 180.0::DOUBLE / 16.0::DOUBLE - 90.0::DOUBLE AS max_lat FROM c GROUP BY cx, cy ORDER BY n DESC, cx, cy LIMIT 40""",
)
def map_rollup(spark, sf):
    return C.rollup_cells(C.map_cells(_cube(spark, sf), MAPS["map_level4"]), 4, 40)


@query(
    "map_coarsened",
    f"""WITH {CUBE_SQL}, k AS (SELECT level, count(DISTINCT (cx, cy)) AS n FROM cube WHERE level IN (2, 4, 6, 8) AND (CASE WHEN kind = 'object' THEN period = 0 ELSE period = 0 END) GROUP BY level),
f AS (SELECT coalesce(max(level) FILTER (n <= 200), 2) AS level FROM k) SELECT c.level, cx, cy, sum(n)::BIGINT AS n FROM cube c JOIN f ON c.level = f.level WHERE period = 0 GROUP BY ALL""",
)
def map_coarsened(spark, sf):
    cube = _cube(spark, sf)
    s = S.Scope.of({"z": 9})
    level = C.fitting_level(cube, s, 200)
    return C.map_cells(cube, s, level).groupBy(F.lit(level).alias("level"), "cx", "cy").agg(F.sum("n").cast("long").alias("n"))


@query("map_counts_by_type", f"WITH {CUBE_SQL} SELECT kind, type, sum(n)::BIGINT AS n FROM cube WHERE {_where(MAPS['map_level4'], 4)} GROUP BY ALL")
def map_counts_by_type(spark, sf):
    return C.counts_by_type(C.map_cells(_cube(spark, sf), MAPS["map_level4"]))


@query("map_without_place", f"WITH {CUBE_SQL} SELECT coalesce(sum(n), 0)::BIGINT AS n FROM cube WHERE {_where(S.Scope.of({}), -1)} AND geo = 0")
def map_without_place(spark, sf):
    return C.without_place(_cube(spark, sf), S.Scope.of({}))


@query("map_local", f"WITH {A.world_sql('object')} SELECT {A.cx_sql('lon', 13)} AS x, {A.cy_sql('lat', 13)} AS y, type, count(*) AS n FROM object WHERE lon BETWEEN 0 AND 60 AND lat BETWEEN 0 AND 40 GROUP BY ALL")
def map_local(spark, sf):
    from orrery.operators.spatial import local_cells

    o = A.objects(spark, sf)
    return local_cells(o.where(S.in_viewport(F.col("lon"), F.col("lat"), (0.0, 0.0, 60.0, 40.0))), 11)


@query("map_exact_across", f"WITH {A.world_sql('object')} SELECT object_id, lon, lat FROM object WHERE (lon >= 150 OR lon <= -150) AND lat BETWEEN -40 AND 40")
def map_exact_across(spark, sf):
    o = A.objects(spark, sf)
    return o.where(S.in_viewport(F.col("lon"), F.col("lat"), ACROSS)).select("object_id", "lon", "lat")


@query("map_refs_snapped", f"WITH {A.world_sql('object')} SELECT object_id, cx >> 4 AS x, cy >> 4 AS y FROM object WHERE " + " OR ".join(f"(cx >> 4 BETWEEN {a} AND {b} AND cy >> 4 BETWEEN {c} AND {d})" for a, b, c, d in geo.viewport_ranges(VIEW, 4)))
def map_refs_snapped(spark, sf):
    o = A.objects(spark, sf)
    x, y = F.shiftright("cx", 4), F.shiftright("cy", 4)
    return o.where(S.in_ranges(x, y, geo.viewport_ranges(VIEW, 4))).select("object_id", x.alias("x"), y.alias("y"))


for _b in ("year", "month"):
    query(f"timeline_{_b}", f"WITH {CUBE_SQL} SELECT period, kind, type, sum(n)::BIGINT AS n FROM cube WHERE level = -1 AND kind <> 'object' AND period > 0 AND period % 100 {'=' if _b == 'year' else '>'} 0 AND band >= 1 GROUP BY ALL")(lambda spark, sf, b=_b: C.timeline(_cube(spark, sf), S.Scope.of({"min_confidence": 0.7}), b))
for _b, _ms in (("day", timefn.DAY), ("hour", timefn.HOUR)):
    query(f"timeline_{_b}", f"WITH {A.world_sql('event')} SELECT t_ms // {_ms} * {_ms} AS bucket_ms, type, count(*) AS n FROM event GROUP BY ALL")(lambda spark, sf, ms=_ms: C.fine_timeline(A.events(spark, sf), ms))


#: Partial years at both ends of a whole one, one source, and places across the antimeridian.
SCOPED = S.Scope.of({"z": 2, "viewport": list(ACROSS), "sources": ["feed1", "feed2"], "time_window": [1674000000000, 1739000000000], "min_confidence": 0.5})


def _scoped_sql(bucket: str) -> str:
    """The events themselves, counted by what the cube rounds to: months, cells and bands."""
    cells = " OR ".join(f"(cx >> 4 BETWEEN {a} AND {b} AND cy >> 4 BETWEEN {c} AND {d})" for a, b, c, d in geo.viewport_ranges(ACROSS, SCOPED.level()))
    first, last = (S.month_of(t) for t in SCOPED.time_window)
    code = "(month // 12 * 100)" if bucket == "year" else "(month // 12 * 100 + month % 12 + 1)"
    return f"WITH {A.world_sql('event')} SELECT {code}::INT AS period, 'event' AS kind, type, count(*) AS n FROM event WHERE ({cells}) AND source IN ('feed1', 'feed2') AND confidence >= 0.5 AND month BETWEEN {first} AND {last} GROUP BY ALL"


for _b in ("year", "month"):
    query(f"timeline_{_b}_scoped", _scoped_sql(_b))(lambda spark, sf, b=_b: C.timeline(_cube(spark, sf), SCOPED, b))


@query("timeline_order_months", "SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def timeline_order_months(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.groupBy(timefn.month_index(timefn.to_ms(F.col("o_orderdate"))).alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "facets",
    f"""WITH {CUBE_SQL}, r AS (SELECT kind, type, source, CASE band WHEN 2 THEN 'supporto forte' WHEN 1 THEN 'supporto medio' ELSE 'supporto debole' END AS band, CASE geo WHEN 1 THEN 'located' ELSE 'not located' END AS geometry, n FROM cube WHERE {_where(S.Scope.of({"min_confidence": 0.5}), -1)})
SELECT 'kind' AS dim, kind AS value, sum(n)::BIGINT AS n FROM r GROUP BY ALL UNION ALL SELECT 'type', type, sum(n)::BIGINT FROM r GROUP BY ALL UNION ALL SELECT 'source', source, sum(n)::BIGINT FROM r GROUP BY ALL
UNION ALL SELECT 'band', band, sum(n)::BIGINT FROM r GROUP BY ALL UNION ALL SELECT 'geometry', geometry, sum(n)::BIGINT FROM r GROUP BY ALL""",
)
def facets(spark, sf):
    return C.facets(_cube(spark, sf), S.Scope.of({"min_confidence": 0.5}))


@query("facets_relations", f"WITH {A.world_sql('relation')} SELECT type, nature, count(*) AS n FROM relation GROUP BY ALL")
def facets_relations(spark, sf):
    return A.relations(spark, sf).groupBy("type", "nature").agg(F.count("*").alias("n"))


@query("live_count", f"WITH {A.world_sql('event')} SELECT type, count(*) AS n FROM event WHERE confidence >= 0.5::DOUBLE AND t_ms BETWEEN {T0} AND {T1} GROUP BY type")
def live_count(spark, sf):
    return C.live_count(A.events(spark, sf), S.Scope.of({"min_confidence": 0.6, "time_window": [T0, T1]}), "event")


@query("live_count_equals_cube", f"WITH {A.world_sql('object', 'event')}, w AS (SELECT type, confidence FROM object UNION ALL SELECT type, confidence FROM event) SELECT type, count(*) AS in_cube, count(*) AS live FROM w WHERE confidence >= 0.5::DOUBLE GROUP BY type")
def live_count_equals_cube(spark, sf):
    cube = _cube(spark, sf).where("level = -1 AND period = 0 AND band >= 1").groupBy("type").agg(F.sum("n").alias("in_cube"))
    live = _world_rows(spark, sf).where(confidence.band(F.col("confidence")) >= 1).groupBy("type").agg(F.count("*").alias("live"))
    return cube.join(live, "type", "full_outer")


@query("entities_per_source", f"WITH {CUBE_SQL} SELECT source, kind, sum(n)::BIGINT AS n, max(maxconf) AS best FROM cube WHERE level = -1 AND period = 0 GROUP BY ALL")
def entities_per_source(spark, sf):
    return _cube(spark, sf).where("level = -1 AND period = 0").groupBy("source", "kind").agg(F.sum("n").cast("long").alias("n"), F.max("maxconf").alias("best"))


# ---- order, limit, pages ----


@query("page_keyset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 26")
def page_keyset(spark, sf):
    return S.page_after(A.table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 25)


@query("page_score_keyset", f"WITH {A.world_sql('event')} SELECT event_id, confidence FROM event WHERE confidence < 0.9::DOUBLE OR (confidence = 0.9::DOUBLE AND event_id > 'event:2') ORDER BY confidence DESC, event_id LIMIT 31")
def page_score_keyset(spark, sf):
    return S.page_after_score(A.events(spark, sf).select("event_id", "confidence"), "confidence", "event_id", (0.9, "event:2"), 30)


@query("page_offset", f"WITH {A.world_sql('event')} SELECT event_id, t_ms FROM event ORDER BY t_ms DESC, event_id LIMIT 20 OFFSET 40")
def page_offset(spark, sf):
    return S.page_offset(A.events(spark, sf).select("event_id", "t_ms"), [F.desc("t_ms"), F.asc("event_id")], 40, 20)


@query("top_k_latest", f"WITH {A.world_sql('event')} SELECT event_id, t_ms, type FROM event ORDER BY t_ms DESC, event_id LIMIT 50")
def top_k_latest(spark, sf):
    return A.events(spark, sf).select("event_id", "t_ms", "type").orderBy(F.desc("t_ms"), "event_id").limit(50)


@query("top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice, rank::INT AS rank, greatest(n - 2, 0)::BIGINT AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rank <= 2")
def top_per_group(spark, sf):
    o = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return C.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@query("capped_per_rule", f"WITH {A.world_sql('event')} SELECT type, event_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY severity DESC, event_id) AS r FROM event) WHERE r <= 2 ORDER BY severity DESC, event_id LIMIT 12")
def capped_per_rule(spark, sf):
    e = C.top_per_group(A.events(spark, sf).select("type", "event_id", "severity"), ["type"], [F.desc("severity"), F.asc("event_id")], 2)
    return e.select("type", "event_id", "severity").orderBy(F.desc("severity"), "event_id").limit(12)


@query("representative_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END ASC NULLS FIRST, c_custkey)::INT AS place FROM customer")
def representative_order(spark, sf):
    c = A.table(spark, sf, "customer")
    best, tie = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3)
    w = Window.partitionBy("c_nationkey").orderBy(best.desc_nulls_last(), tie.asc_nulls_first(), "c_custkey")
    return c.select("c_custkey", F.row_number().over(w).alias("place"))


@query("byte_budget", "SELECT doc_id, bytes_so_far::BIGINT AS bytes_so_far FROM (SELECT doc_id, sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS bytes_so_far FROM documents) WHERE bytes_so_far <= 20000")
def byte_budget(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return S.within_bytes(d, [F.asc("doc_id")], F.col("text"), 20000, [F.col("lang")]).select("doc_id", "bytes_so_far")


@query("page_bookkeeping", "SELECT count(*) AS total, least(count(*), 100) AS returned, count(*) > 100 AS truncated FROM orders WHERE o_orderstatus = 'P'")
def page_bookkeeping(spark, sf):
    n = F.count("*")
    return A.table(spark, sf, "orders").where("o_orderstatus = 'P'").agg(n.alias("total"), F.least(n, F.lit(100).cast("long")).alias("returned"), (n > 100).alias("truncated"))


@query(
    "timeline_items",
    f"WITH {A.world_sql('event')} SELECT kind, id, t_ms FROM (SELECT 'event' AS kind, event_id AS id, t_ms, confidence FROM event UNION ALL SELECT 'order', 'order:' || o_orderkey, epoch_us(o_orderdate) // 1000, 0.9::DOUBLE FROM orders) WHERE confidence >= 0.8::DOUBLE AND t_ms BETWEEN 883612800000 AND {T1} ORDER BY t_ms, id LIMIT 60",
)
def timeline_items(spark, sf):
    e = A.events(spark, sf).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "t_ms", "confidence")
    o = A.table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), timefn.to_ms(F.col("o_orderdate")).alias("t_ms"), F.lit(0.9).alias("confidence"))
    rows = e.unionByName(o).where((F.col("confidence") >= 0.8) & F.col("t_ms").between(883612800000, T1))
    return rows.orderBy("t_ms", "id").limit(60).select("kind", "id", "t_ms")


# ---- sets ----


@query("union_all_kinds", f"WITH {A.world_sql('object', 'event')} SELECT kind, type, count(*) AS n FROM (SELECT 'object' AS kind, type FROM object UNION ALL SELECT 'event', type FROM event) GROUP BY ALL")
def union_all_kinds(spark, sf):
    return _world_rows(spark, sf).groupBy("kind", "type").agg(F.count("*").alias("n"))


@query("union_distinct_ends", f"WITH {A.world_sql('relation')} SELECT from_id AS node FROM relation UNION SELECT to_id FROM relation")
def union_distinct_ends(spark, sf):
    r = A.relations(spark, sf)
    return r.select(F.col("from_id").alias("node")).union(r.select("to_id")).distinct()


@query("intersect_nations", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_nations(spark, sf):
    return A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(A.table(spark, sf, "supplier").select("s_nationkey"))


@query("except_all_customers", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_all_customers(spark, sf):
    return A.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).exceptAll(A.table(spark, sf, "customer").select("c_custkey"))


@query("dedupe_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_first(spark, sf):
    from orrery.operators.relational import dedupe

    return dedupe(A.table(spark, sf, "events"), ["user_id", "event_type"], F.asc("ts"), F.asc("event_id")).select("user_id", "event_type", "event_id")
