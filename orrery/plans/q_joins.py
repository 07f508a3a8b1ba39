"""Joins: spatial, temporal, graph and identity; evidence and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import confidence, timefn
from orrery.functions.text import norm_name
from orrery.operators import relational as R
from orrery.operators import spatial as SP
from orrery.operators import temporal as TM
from orrery.plans import adapter as A
from orrery.plans.catalog import query

KM = A.km_sql("c.lon", "c.lat", "s.lon", "s.lat")
W = A.world_sql


def _cust(spark, sf):
    o = A.objects(spark, sf).where("type = 'org.customer'")
    return o.select(F.col("object_id").alias("a_id"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), F.col("confidence").alias("a_conf"))


def _supp(spark, sf):
    o = A.objects(spark, sf).where("type = 'org.supplier'")
    return o.select(F.col("object_id").alias("b_id"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"), F.col("confidence").alias("b_conf"))


CS = f"{W('object')}, c AS (SELECT * FROM object WHERE type = 'org.customer'), s AS (SELECT * FROM object WHERE type = 'org.supplier')"


@query("distance_join", f"WITH {CS} SELECT c.object_id AS a_id, s.object_id AS b_id, round({KM}, 6) AS km FROM c, s WHERE {KM} <= 500")
def distance_join(spark, sf):
    return SP.distance_join(_cust(spark, sf), _supp(spark, sf), 500).select("a_id", "b_id", F.round("km", 6).alias("km"))


@query("distance_join_steps", f"WITH {CS} SELECT c.object_id AS a_id, s.object_id AS b_id, round({KM}, 6) AS km FROM c, s WHERE {KM} <= CASE WHEN c.confidence >= 0.9::DOUBLE THEN 800 WHEN c.confidence >= 0.5::DOUBLE THEN 400 WHEN c.confidence >= 0.2::DOUBLE THEN 150 END")
def distance_join_steps(spark, sf):
    steps = [(0.2, 150), (0.5, 400), (0.9, 800)]
    return SP.step_join(_cust(spark, sf), _supp(spark, sf), F.col("a_conf"), steps).select("a_id", "b_id", F.round("km", 6).alias("km"))


@query("time_join", "SELECT a.event_id AS a, b.event_id AS b, epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 AS dt FROM events a, events b WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 BETWEEN -600000 AND 3600000")
def time_join(spark, sf):
    e = A.events(spark, sf)
    a = e.where("type = 'signup'").select(F.col("n").alias("a"), F.col("t_ms").alias("a_t"))
    b = e.where("type = 'purchase'").select(F.col("n").alias("b"), F.col("t_ms").alias("b_t"))
    return TM.interval_join(a, b, timefn.parse_duration("-10m"), timefn.parse_duration("1h")).select("a", "b", "dt")


@query("time_join_same_user", "SELECT a.event_id AS a, b.event_id AS b, epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 AS dt FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 BETWEEN 0 AND 86400000")
def time_join_same_user(spark, sf):
    e = A.events(spark, sf)
    a = e.where("type = 'view'").select("user_id", F.col("n").alias("a"), F.col("t_ms").alias("a_t"))
    b = e.where("type = 'purchase'").select("user_id", F.col("n").alias("b"), F.col("t_ms").alias("b_t"))
    return TM.interval_join(a, b, 0, timefn.DAY, on=["user_id"]).select("a", "b", "dt")


@query("knn_within_radius", f"WITH {CS} SELECT a_id, b_id, round(km, 6) AS km, rank::INT AS rank, total FROM (SELECT c.object_id AS a_id, s.object_id AS b_id, {KM} AS km, row_number() OVER (PARTITION BY c.object_id ORDER BY {KM}, s.object_id) AS rank, count(*) OVER (PARTITION BY c.object_id) AS total FROM c, s WHERE {KM} <= 2000) WHERE rank <= 3")
def knn_within_radius(spark, sf):
    return SP.nearest(_cust(spark, sf), _supp(spark, sf), 2000, "a_id", "b_id", 3).select("a_id", "b_id", F.round("km", 6).alias("km"), "rank", "total")


@query("nearby_one", f"WITH {CS} SELECT s.object_id AS b_id, round({KM}, 6) AS km FROM c, s WHERE c.object_id = 'customer:7' AND {KM} <= 3000 ORDER BY {KM}, s.object_id LIMIT 10")
def nearby_one(spark, sf):
    one = _cust(spark, sf).where("a_id = 'customer:7'")
    return SP.distance_join(one, _supp(spark, sf), 3000).orderBy("km", "b_id").limit(10).select("b_id", F.round("km", 6).alias("km"))


# Areas: a box of ten degrees with a hole of four around each nation, away from the poles.
def _areas(spark, sf):
    n = A.objects(spark, sf).where("type = 'place.nation' AND abs(lat) < 75 AND abs(lon) < 170")

    def ring(half):
        pt = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
        return F.array(pt(-half, -half), pt(half, -half), pt(half, half), pt(-half, half), pt(-half, -half))

    return n.select(F.col("object_id").alias("area_id"), F.array(ring(5.0), ring(2.0)).alias("rings"))


N_SQL = f"{W('object')}, a AS (SELECT object_id AS area_id, lon, lat FROM object WHERE type = 'place.nation' AND abs(lat) < 75 AND abs(lon) < 170), p AS (SELECT * FROM object WHERE type IN ('org.customer', 'org.supplier'))"
INSIDE = "p.lon >= a.lon - {0} AND p.lon < a.lon + {0} AND p.lat >= a.lat - {0} AND p.lat < a.lat + {0}"


@query("pip_containment", f"WITH {N_SQL} SELECT p.object_id, a.area_id FROM p, a WHERE {INSIDE.format(5)} AND NOT ({INSIDE.format(2)})")
def pip_containment(spark, sf):
    p = A.objects(spark, sf).where("type IN ('org.customer', 'org.supplier')")
    return SP.contained(p, SP.ring_edges(_areas(spark, sf)), "object_id")


def _segment_km(ax, ay, bx, by):
    k = "cos(radians(p.lat))"
    ux, uy, vx, vy = f"(({ax}) - p.lon) * {k}", f"(({ay}) - p.lat)", f"(({bx}) - p.lon) * {k}", f"(({by}) - p.lat)"
    dx, dy = f"({vx} - {ux})", f"({vy} - {uy})"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, -({ux} * {dx} + {uy} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return A.km_sql("p.lon", "p.lat", f"(p.lon + ({ux} + {t} * {dx}) / {k})", f"(p.lat + ({uy} + {t} * {dy}))")


_SIDES = {h: [(-h, -h, h, -h), (h, -h, h, h), (h, h, -h, h), (-h, h, -h, -h)] for h in (5, 2)}
_BORDER = "least(" + ", ".join(_segment_km(f"a.lon + ({x1})", f"a.lat + ({y1})", f"a.lon + ({x2})", f"a.lat + ({y2})") for h in (5, 2) for x1, y1, x2, y2 in _SIDES[h]) + ")"
_NEAR = "abs(p.lat - a.lat) < 11 AND p.lon BETWEEN a.lon - 40 AND a.lon + 40"


@query("nearest_fallback", f"""WITH {N_SQL}, inside AS (SELECT p.object_id, a.area_id FROM p, a WHERE {INSIDE.format(5)} AND NOT ({INSIDE.format(2)})),
d AS (SELECT p.object_id, a.area_id, {_BORDER} AS km FROM p, a WHERE {_NEAR} AND p.object_id NOT IN (SELECT object_id FROM inside))
SELECT object_id, area_id, 'contained' AS method FROM inside UNION ALL SELECT object_id, min({{'km': round(km, 9), 'area_id': area_id}}).area_id, 'nearest' FROM d WHERE km <= 300 GROUP BY object_id""")
def nearest_fallback(spark, sf):
    p = A.objects(spark, sf).where("type IN ('org.customer', 'org.supplier')")
    return SP.enrich(p, SP.ring_edges(_areas(spark, sf)), "object_id", 300)


@query("relations_of_node", f"WITH {W('relation')}, e AS (SELECT type, nature, 'in' AS dir, from_id AS other FROM relation WHERE to_id = 'nation:3' UNION ALL SELECT type, nature, 'out', to_id FROM relation WHERE from_id = 'nation:3') SELECT type, nature, dir, other, rank::INT AS rank, total FROM (SELECT *, row_number() OVER (PARTITION BY type, nature, dir ORDER BY other) AS rank, count(*) OVER (PARTITION BY type, nature, dir) AS total FROM e) WHERE rank <= 50")
def relations_of_node(spark, sf):
    return R.relations_of(A.edges(spark, sf), A.relations(spark, sf), "nation:3")


@query("sources_left_join", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY n_name")
def sources_left_join(spark, sf):
    c = A.table(spark, sf, "customer").where("c_acctbal > 5000")
    return A.table(spark, sf, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


@query("unprocessed_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def unprocessed_anti_join(spark, sf):
    o = A.table(spark, sf, "orders").where("o_totalprice > 400000")
    return A.table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("member_semi_join", f"WITH {W('relation')}, direct AS (SELECT from_id AS id FROM relation WHERE to_id = 'region:1' AND type = 'located_in') SELECT from_id AS id FROM relation WHERE type = 'located_in' AND to_id IN (SELECT id FROM direct) UNION SELECT id FROM direct")
def member_semi_join(spark, sf):
    r = A.relations(spark, sf).where("type = 'located_in'")
    direct = r.where("to_id = 'region:1'").select(F.col("from_id").alias("id"))
    second = r.join(direct, F.col("to_id") == F.col("id"), "left_semi").select(F.col("from_id").alias("id"))
    return second.union(direct).distinct()


@query("shared_participants", "SELECT 'event:' || a.event_id AS event_id, 'event:' || b.event_id AS other_id, 1::BIGINT AS n_shared FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id WHERE a.event_id % 100 = 0 UNION ALL SELECT 'event:' || event_id, 'order:' || o_orderkey, 1 FROM events JOIN orders ON o_custkey = user_id WHERE event_id % 100 = 0")
def shared_participants(spark, sf):
    """The query set of searches: ids divisible by 100, against all rows."""
    seeds = A.events(spark, sf).where("n % 100 = 0").select("event_id")
    return R.shared_participants(A.participations(spark, sf), seeds)


@query("related_objects", f"""WITH {W('participation', 'relation')}, c AS (SELECT p.object_id AS id, 1 AS p, 'participation' AS reason FROM participation p WHERE event_id IN (SELECT event_id FROM participation WHERE object_id = 'supplier:3')
UNION ALL SELECT to_id, 2, 'relation_out' FROM relation WHERE from_id = 'supplier:3' UNION ALL SELECT from_id, 3, 'relation_in' FROM relation WHERE to_id = 'supplier:3')
SELECT id, min({{'p': p, 'reason': reason}}).reason AS reason FROM c WHERE id <> 'supplier:3' GROUP BY id""")
def related_objects(spark, sf):
    return R.related_objects(A.participations(spark, sf), A.relations(spark, sf), "supplier:3")


@query("related_events", f"""WITH {W('event', 'participation', 'relation')}, near AS (SELECT to_id AS o FROM relation WHERE from_id = 'nation:5' UNION SELECT from_id FROM relation WHERE to_id = 'nation:5'),
f AS (SELECT DISTINCT event_id FROM participation WHERE object_id IN (SELECT o FROM near)) SELECT e.event_id, type, t_ms, 'neighbour' AS reason FROM event e JOIN f USING (event_id) ORDER BY t_ms DESC, e.event_id LIMIT 25 OFFSET 5""")
def related_events(spark, sf):
    return R.related_events(A.participations(spark, sf), A.relations(spark, sf), A.events(spark, sf), "nation:5", 25, 5)


@query("evidence_noisy_or", f"WITH {W('event')}, b AS (SELECT subject, grp, max(confidence) AS v, count(*) AS k FROM event GROUP BY subject, grp) SELECT subject, round(1 - product(1 - v), 9) AS confidence, count(*) AS n_groups, sum(k)::BIGINT AS n FROM b GROUP BY subject")
def evidence_noisy_or(spark, sf):
    rows = R.noisy_or(A.events(spark, sf), "subject", "grp", "confidence")
    return rows.withColumn("confidence", F.round("confidence", 9))


@query("evidence_product", "SELECT o_orderkey, round(0.85::DOUBLE * CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 0.95::DOUBLE WHEN '3-MEDIUM' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END * CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END * 0.75::DOUBLE, 9) AS weight FROM orders")
def evidence_product(spark, sf):
    method = confidence.lookup(F.col("o_orderpriority"), {"1-URGENT": "measured", "2-HIGH": "asserted", "3-MEDIUM": "resolved_by_name", "4-NOT SPECIFIED": "proposed", "5-LOW": "proposed"})
    status = confidence.lookup(F.col("o_orderstatus"), {"F": "reviewed", "O": "preliminary", "P": "retracted"})
    o = A.table(spark, sf, "orders")
    return o.select("o_orderkey", F.round(confidence.evidence_weight(F.lit(0.85), method, status, F.lit(0.75)), 9).alias("weight"))


@query("independence", f"WITH {W('event')} SELECT subject, grp, max(confidence) AS best, count(*) AS n, count(DISTINCT source) AS n_sources FROM event GROUP BY subject, grp")
def independence(spark, sf):
    return R.independence(A.events(spark, sf), "subject", "grp", "source", "confidence")


def _identifiers(spark, sf):
    """Two schemes: brand codes (strong) and names, of parts."""
    p = A.table(spark, sf, "part")
    e = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    strong = p.select(F.lit("code").alias("scheme"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("value"), e.alias("entity_id"), F.lit(1).alias("strong"))
    return strong.unionByName(p.select(F.lit("name").alias("scheme"), F.col("p_name").alias("value"), e.alias("entity_id"), F.lit(0).alias("strong")))


ID_SQL = "ident AS (SELECT 'code' AS scheme, p_brand || '-' || p_size AS value, 'part:' || p_partkey AS entity_id, 1 AS strong FROM part UNION ALL SELECT 'name', p_name, 'part:' || p_partkey, 0 FROM part)"
MEN_SQL = "men AS (SELECT 'm' || p_partkey AS mention_id, 'code' AS scheme, p_brand || '-' || (p_size + p_partkey % 2) AS value FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'm' || p_partkey, 'name', p_name FROM part WHERE p_partkey % 3 <> 1)"


def _mentions(spark, sf):
    p = A.table(spark, sf, "part")
    m = F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("mention_id")
    code = p.where("p_partkey % 3 = 0").select(m, F.lit("code").alias("scheme"), F.concat_ws("-", "p_brand", (F.col("p_size") + F.col("p_partkey") % 2).cast("string")).alias("value"))
    return code.unionByName(p.where("p_partkey % 3 <> 1").select(m, F.lit("name").alias("scheme"), F.col("p_name").alias("value")))


@query("resolve_strong", f"WITH {ID_SQL}, {MEN_SQL} SELECT mention_id, min({{'p': CASE scheme WHEN 'code' THEN 0 ELSE 1 END, 'e': entity_id}}).e AS entity_id FROM men JOIN ident USING (scheme, value) GROUP BY mention_id")
def resolve_strong(spark, sf):
    return R.resolve_strong(_mentions(spark, sf), _identifiers(spark, sf), ["code", "name"])


@query("resolve_unique_name", "WITH u AS (SELECT p_brand || ' ' || p_size || ' ' || p_name AS name, p_partkey FROM part) SELECT 'm' || s_suppkey AS mention_id, min('part:' || u.p_partkey) AS entity_id FROM supplier JOIN part ON s_suppkey = part.p_partkey JOIN u ON u.name = p_brand || ' ' || p_size || ' ' || p_name GROUP BY 1 HAVING count(DISTINCT u.p_partkey) = 1")
def resolve_unique_name(spark, sf):
    p = A.table(spark, sf, "part")
    name = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"), "p_name")
    names = p.select(name.alias("name"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"))
    s = A.table(spark, sf, "supplier").select("s_suppkey")
    mentions = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("mention_id"), name.alias("name"))
    return R.resolve_name(mentions, names)


@query("name_collisions", "WITH n AS (SELECT p_type, p_name || ' ' || p_size AS name, 'part:' || p_partkey AS e FROM part), f AS (SELECT p_type, name, min(e) AS a FROM n GROUP BY ALL) SELECT a, e AS b, name FROM n JOIN f USING (p_type, name) WHERE e <> a")
def name_collisions(spark, sf):
    p = A.table(spark, sf, "part")
    names = p.select(F.col("p_type").alias("type"), norm_name(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("name"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"))
    return R.name_collisions(names)


@query("attribution", "SELECT 'event:' || event_id AS id, CASE WHEN event_id % 3 = 0 AND event_id % 5 < 3 AND event_id % 7 <> event_id % 4 THEN NULL WHEN event_id % 3 = 0 THEN event_id % 7 WHEN event_id % 5 < 3 THEN event_id % 4 END AS place, CASE WHEN event_id % 3 = 0 AND event_id % 5 < 3 AND event_id % 7 <> event_id % 4 THEN 'conflict' WHEN event_id % 3 = 0 THEN 'declared' WHEN event_id % 5 < 3 THEN 'contained' ELSE 'unresolved' END AS how FROM events")
def attribution(spark, sf):
    e = A.events(spark, sf).select(F.col("event_id").alias("id"), "n")
    return R.attribution(e.where("n % 3 = 0").select("id", (F.col("n") % 7).alias("place")), e.where("n % 5 < 3").select("id", (F.col("n") % 4).alias("place")), e)


@query("explore_ranking", f"WITH {W('object', 'relation')} SELECT b.object_id AS id, b.label AS label, count(DISTINCT a.type) AS n_types, count(*) AS n FROM relation r JOIN object a ON a.object_id = from_id JOIN object b ON b.object_id = to_id GROUP BY 1, 2 ORDER BY n_types DESC, n DESC, id LIMIT 20")
def explore_ranking(spark, sf):
    o = A.objects(spark, sf)
    a, b = o.select(F.col("object_id").alias("from_id"), F.col("type").alias("_t")), o.select(F.col("object_id").alias("to_id"), F.col("label").alias("label"))
    rows = A.relations(spark, sf).join(a, "from_id").join(b, "to_id")
    return rows.groupBy(F.col("to_id").alias("id"), "label").agg(F.countDistinct("_t").alias("n_types"), F.count("*").alias("n")).orderBy(F.desc("n_types"), F.desc("n"), "id").limit(20)


@query("mentions_first_links", "WITH m AS (SELECT o_custkey, o_orderpriority AS link, min(o_orderkey) AS seen FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seen) AS r FROM m) SELECT c_custkey, string_agg(link, '|' ORDER BY seen) AS links FROM customer JOIN r ON o_custkey = c_custkey WHERE r <= 3 GROUP BY c_custkey")
def mentions_first_links(spark, sf):
    from pyspark.sql import Window

    m = A.table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("link")).agg(F.min("o_orderkey").alias("seen"))
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("seen"))).where("r <= 3")
    m = m.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seen", "link"))), lambda x: x["link"]), "|").alias("links"))
    return A.table(spark, sf, "customer").join(m, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "links")


@query("as_of_join", f"WITH {W('event')} SELECT subject, type, event_id, t_ms FROM (SELECT *, row_number() OVER (PARTITION BY subject, type ORDER BY t_ms DESC, event_id DESC) AS r FROM event WHERE t_ms <= 1705000000000) WHERE r = 1")
def as_of_join(spark, sf):
    return TM.as_of(A.events(spark, sf), ["subject", "type"], "t_ms", 1705000000000, "event_id").select("subject", "type", "event_id", "t_ms")


@query("tariff_lookup", "WITH t AS (SELECT l_returnflag AS d0, l_linestatus AS d1, l_linenumber AS d2, max(l_tax) AS rate FROM lineitem GROUP BY ALL) SELECT l_suppkey, sum(floor(l_quantity * rate * 100 + 0.5::DOUBLE + 1e-9::DOUBLE))::BIGINT AS cents FROM lineitem JOIN t ON d0 = l_returnflag AND d1 = l_linestatus AND d2 = l_linenumber GROUP BY l_suppkey")
def tariff_lookup(spark, sf):
    li = A.table(spark, sf, "lineitem")
    key = ["l_returnflag", "l_linestatus", "l_linenumber"]
    rates = li.groupBy(*key).agg(F.max("l_tax").alias("rate"))
    cents = F.floor(F.col("l_quantity") * F.col("rate") * 100 + F.lit(0.5) + F.lit(1e-9))
    return li.join(rates, key).groupBy("l_suppkey").agg(F.sum(cents).cast("long").alias("cents"))


@query("edge_confidence", f"WITH {W('relation')} SELECT e.l_orderkey * 10 + e.l_linenumber AS edge, max(coalesce(CASE WHEN e.l_quantity > 40 THEN 0.99::DOUBLE END, r.confidence)) AS confidence FROM lineitem e LEFT JOIN relation r ON r.relation_id = 'supplies|supplier:' || l_suppkey || '|part:' || l_partkey GROUP BY 1")
def edge_confidence(spark, sf):
    li = A.table(spark, sf, "lineitem")
    ref = F.concat(F.lit("supplies|supplier:"), F.col("l_suppkey").cast("string"), F.lit("|part:"), F.col("l_partkey").cast("string"))
    rows = li.withColumn("ref", ref).join(A.relations(spark, sf).select(F.col("relation_id").alias("ref"), "confidence"), "ref", "left")
    own = F.when(F.col("l_quantity") > 40, 0.99)
    return rows.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge")).agg(F.max(F.coalesce(own, "confidence")).alias("confidence"))


@query("support_reference", f"WITH {W('event', 'object')} SELECT 'record' AS kind, event_id AS id, source AS via FROM event UNION ALL SELECT 'object', subject, label FROM event JOIN object ON object_id = subject")
def support_reference(spark, sf):
    e = A.events(spark, sf)
    rec = e.select(F.lit("record").alias("kind"), F.col("event_id").alias("id"), F.col("source").alias("via"))
    obj = e.join(A.objects(spark, sf).select("object_id", "label"), F.col("object_id") == F.col("subject"))
    return rec.unionByName(obj.select(F.lit("object").alias("kind"), F.col("subject").alias("id"), F.col("label").alias("via")))


@query("preferred_identifier", f"WITH {ID_SQL} SELECT entity_id, min({{'s': -strong, 'v': value}}).v AS value FROM ident WHERE scheme = 'name' GROUP BY entity_id")
def preferred_identifier(spark, sf):
    return R.preferred_identifier(_identifiers(spark, sf), "name")


@query("claim_conflicts", "SELECT user_id, event_type, count(DISTINCT props) AS n_values FROM events GROUP BY ALL HAVING count(DISTINCT props) > 1")
def claim_conflicts(spark, sf):
    return R.conflicts(A.table(spark, sf, "events"), ["user_id", "event_type"], "props")


@query("change_feed_since", f"WITH {W('event')} SELECT subject AS id, max(v)::BIGINT AS version, string_agg(DISTINCT type, ',' ORDER BY type) AS ops FROM (SELECT *, t_ms // 86400000 AS v FROM event) WHERE v > 19740 GROUP BY subject ORDER BY version, id LIMIT 100")
def change_feed_since(spark, sf):
    log = A.events(spark, sf).select(F.col("subject").alias("id"), F.floor(F.col("t_ms") / timefn.DAY).alias("version"), F.col("type").alias("op"))
    return R.changes_since(log, 19740, 100)


@query("term_covers_day", "SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') > '1998-06-15' THEN false WHEN o_orderstatus = 'F' THEN CASE WHEN strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') <= '1998-06-15' THEN false ELSE true END WHEN o_orderstatus = 'O' THEN true END AS covered FROM orders")
def term_covers_day(spark, sf):
    o = A.table(spark, sf, "orders")
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    end = F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add("o_orderdate", 90), "yyyy-MM-dd"))
    status = F.when(F.col("o_orderstatus") == "O", "current").otherwise("ended")
    return o.select("o_orderkey", timefn.covers(start, end, status, F.lit("1998-06-15")).alias("covered"))
