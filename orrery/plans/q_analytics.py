"""Windows, versions, sessions, tenures, zones, published tables, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import confidence, geo, ids, text, timefn
from orrery.operators import analytics as AN
from orrery.operators import cube as C
from orrery.operators import temporal as TM
from orrery.operators import world as WB
from orrery.plans import adapter as A
from orrery.plans.catalog import query

W = A.world_sql


@query("claims_scd2", f"WITH {W('event')}, l AS (SELECT subject, n, t_ms, source, lag(source) OVER w AS p, row_number() OVER w AS r FROM event WINDOW w AS (PARTITION BY subject ORDER BY t_ms, n)), c AS (SELECT * FROM l WHERE r = 1 OR source IS DISTINCT FROM p) SELECT subject, n, source, t_ms AS valid_from, lead(t_ms) OVER w AS valid_to, lead(n) OVER w AS superseded_by FROM c WINDOW w AS (PARTITION BY subject ORDER BY t_ms, n)")
def claims_scd2(spark, sf):
    e = A.events(spark, sf).select("subject", "n", "t_ms", "source")
    return TM.claims(e, ["subject"], "source", "t_ms", "n").withColumnRenamed("t_ms", "valid_from")


@query("latest_version", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, lpad((o_orderkey % 100)::VARCHAR, 20, '0') DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_version(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("version", (F.col("o_orderkey") % 100).cast("string"))
    return WB.latest_version(o, ["o_custkey"], "o_orderdate", "version", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("timeline_step", f"WITH {W('event')} SELECT 'next' AS side, * FROM (SELECT n, t_ms - 1705000000000 AS gap FROM event WHERE t_ms > 1705000000000 ORDER BY gap, n LIMIT 1) UNION ALL SELECT 'previous', * FROM (SELECT n, 1705000000000 - t_ms AS gap FROM event WHERE t_ms < 1705000000000 ORDER BY gap, n LIMIT 1)")
def timeline_step(spark, sf):
    e = A.events(spark, sf).select("n", "t_ms")
    side = lambda ahead, name: TM.step(e, 1705000000000, "n", ahead).select(F.lit(name).alias("side"), "n", "gap")
    return side(True, "next").unionByName(side(False, "previous"))


@query("sessions", f"WITH {W('event')}, o AS (SELECT subject, n, t_ms, CASE WHEN t_ms - lag(t_ms) OVER w > 21600000 THEN 1 ELSE 0 END AS opens FROM event WINDOW w AS (PARTITION BY subject ORDER BY t_ms, n)), s AS (SELECT *, sum(opens) OVER (PARTITION BY subject ORDER BY t_ms, n ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM o) SELECT subject, session, count(*) AS n, max(t_ms) - min(t_ms) AS span FROM s GROUP BY ALL")
def sessions(spark, sf):
    s = TM.sessions(A.events(spark, sf), ["subject"], "t_ms", timefn.parse_duration("6h"), "n")
    return s.groupBy("subject", "session").agg(F.count("*").alias("n"), (F.max("t_ms") - F.min("t_ms")).alias("span"))


@query("entity_timeline", f"""WITH {W('event')}, t AS (SELECT 'event' AS kind, event_id AS ref, t_ms FROM event WHERE subject = 'customer:5' UNION ALL SELECT 'order', 'order:' || o_orderkey, epoch_us(o_orderdate) // 1000 FROM orders WHERE o_custkey = 5
UNION ALL SELECT 'claim', event_id, t_ms FROM event WHERE subject = 'customer:5' AND severity >= 0.5::DOUBLE) SELECT kind, ref, t_ms, row_number() OVER (ORDER BY t_ms, ref, kind)::INT AS place FROM t WHERE t_ms >= 883612800000""")
def entity_timeline(spark, sf):
    e = A.events(spark, sf).where("subject = 'customer:5'")
    o = A.table(spark, sf, "orders").where("o_custkey = 5")
    part = lambda df, kind, ref, t: df.select(F.lit(kind).alias("kind"), ref.alias("ref"), t.alias("t_ms"))
    rows = part(e, "event", F.col("event_id"), F.col("t_ms")).unionByName(part(o, "order", F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), timefn.to_ms(F.col("o_orderdate")))).unionByName(part(e.where("severity >= 0.5"), "claim", F.col("event_id"), F.col("t_ms")))
    rows = rows.where("t_ms >= 883612800000")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("t_ms", "ref", "kind")))


@query("tenure_state", """WITH t AS (SELECT c_nationkey AS office, c_custkey AS person, CASE WHEN c_custkey % 11 > 0 THEN strftime(DATE '2000-01-01' + INTERVAL (c_custkey % 40) DAY, '%Y-%m-%d') END AS start, CASE WHEN c_custkey % 2 = 0 THEN '2020-01-01' END AS end_day, CASE WHEN c_custkey % 5 = 0 THEN 'preferred' ELSE 'normal' END AS rank, c_nationkey % 3 = 0 AS collegial FROM customer),
s AS (SELECT *, CASE WHEN end_day IS NOT NULL THEN 'ended' WHEN start IS NULL THEN 'undated' WHEN start = max(start) FILTER (end_day IS NULL) OVER (PARTITION BY office) THEN 'current' ELSE 'superseded' END AS st FROM t),
h AS (SELECT office, any_value(collegial) AS coll, count(DISTINCT person) FILTER (st = 'current') AS holders, bool_or(st = 'superseded' AND rank = 'preferred') AS pref FROM s GROUP BY office)
SELECT s.office, s.person, CASE WHEN st = 'current' AND NOT coll AND (holders > 1 OR pref) THEN 'conflict' ELSE st END AS state, CASE WHEN NOT coll AND (holders > 1 OR pref) THEN 'ambiguous' WHEN holders = 0 THEN 'none' WHEN coll THEN 'collegial' ELSE 'unique' END AS outcome FROM s JOIN h USING (office)""")
def tenure_state(spark, sf):
    c = A.table(spark, sf, "customer")
    start = F.when(F.col("c_custkey") % 11 > 0, F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") % 40).cast("int")), "yyyy-MM-dd"))
    terms = c.select(F.col("c_nationkey").alias("office"), F.col("c_custkey").alias("person"), start.alias("start"), F.when(F.col("c_custkey") % 2 == 0, "2020-01-01").alias("end_day"), F.when(F.col("c_custkey") % 5 == 0, "preferred").otherwise("normal").alias("rank"), (F.col("c_nationkey") % 3 == 0).alias("collegial"))
    return TM.tenures(terms).select("office", "person", "state", "outcome")


_SE = "CASE WHEN n > 0 THEN 100 * sqrt(least(greatest(value / 100, 0.0::DOUBLE), 1.0::DOUBLE) * (1 - least(greatest(value / 100, 0.0::DOUBLE), 1.0::DOUBLE)) / n) END"


@query("significance_change", f"""WITH p AS (SELECT event_type, epoch_us(ts) // 1000 // 86400000 AS day, floor(sum(value))::BIGINT % 9000 / 100.0::DOUBLE AS value, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, {_SE} AS se FROM p),
l AS (SELECT *, floor((value - lag(value) OVER w) * 10 + 0.5::DOUBLE) / 10 AS delta, floor(2 * sqrt(2.0::DOUBLE) * sqrt(lag(se) OVER w * lag(se) OVER w + se * se) * 10 + 0.5::DOUBLE) / 10 AS threshold FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, delta + 0.0::DOUBLE AS delta, CASE WHEN delta IS NULL OR threshold IS NULL THEN 'none' WHEN abs(delta) > threshold THEN CASE WHEN delta > 0 THEN 'up' ELSE 'down' END ELSE 'stable' END AS verdict, floor(1.96::DOUBLE * sqrt(2.0::DOUBLE) * se * 10 + 0.5::DOUBLE) / 10 AS margin FROM l""")
def significance_change(spark, sf):
    e = A.events(spark, sf).groupBy(F.col("type").alias("event_type"), F.floor(F.col("t_ms") / timefn.DAY).alias("day")).agg((F.floor(F.sum("value")).cast("long") % 9000 / 100.0).alias("value"), F.count("*").alias("n"))
    return TM.significance(e, ["event_type"], ["day"]).select("event_type", "day", (F.col("delta") + 0.0).alias("delta"), "verdict", "margin")


@query("official_change", "WITH p AS (SELECT o_orderstatus, year(o_orderdate) AS y, count(*)::DOUBLE AS value FROM orders GROUP BY ALL), l AS (SELECT *, floor((value - lag(value) OVER (PARTITION BY o_orderstatus ORDER BY y)) * 10000 + 0.5::DOUBLE) / 10000 AS delta FROM p) SELECT o_orderstatus, y, delta, CASE WHEN delta IS NULL THEN 'none' WHEN delta = 0 THEN 'stable' ELSE 'change' END AS verdict FROM l")
def official_change(spark, sf):
    p = A.table(spark, sf, "orders").groupBy("o_orderstatus", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").cast("double").alias("value"))
    return TM.official_change(p, ["o_orderstatus"], ["y"]).select("o_orderstatus", "y", "delta", "verdict")


@query("comparison_same_month", "WITH p AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, count(*) AS v FROM orders GROUP BY 1) SELECT a.m, a.v, b.v AS year_before FROM p a LEFT JOIN p b ON b.m = a.m - 12")
def comparison_same_month(spark, sf):
    p = A.table(spark, sf, "orders").groupBy(timefn.month_index(timefn.to_ms(F.col("o_orderdate"))).alias("m")).agg(F.count("*").alias("v"))
    return AN.against_year_before(p, "m", "v")


@query("series_assembly", "WITH t AS (SELECT event_type, user_id, epoch_us(ts) // 1000 AS t, event_id, value FROM events) SELECT event_type, user_id, count(*) AS n, string_agg(value::VARCHAR, ';' ORDER BY t, event_id) AS points FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY t DESC, event_id DESC) AS r FROM t) WHERE r <= 10 GROUP BY ALL")
def series_assembly(spark, sf):
    e = A.events(spark, sf).select(F.col("type").alias("event_type"), "user_id", "t_ms", "n", "value")
    return AN.series(e, ["event_type", "user_id"], "t_ms", "n", "value", 10)


@query("reality_perception_pairs", "WITH s AS (SELECT p_type AS topic, CASE p_partkey % 3 WHEN 0 THEN 'reality' WHEN 1 THEN 'perception' END AS side, p_partkey AS id FROM part) SELECT * FROM s WHERE side IS NOT NULL AND topic IN (SELECT topic FROM s WHERE side = 'reality') AND topic IN (SELECT topic FROM s WHERE side = 'perception')")
def reality_perception_pairs(spark, sf):
    p = A.table(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "official").when(F.col("p_partkey") % 3 == 1, "survey").otherwise("other")
    return AN.pairs_by_topic(p.select(F.col("p_type").alias("topic"), F.col("p_partkey").alias("id"), kind.alias("kind")))


_Z = """e AS (SELECT user_id % 20 AS state, props AS unit, event_id, ts, event_type, value, lon, lat FROM (SELECT *, ((user_id * 7919) % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS lon, ((user_id * 104729) % 17000)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS lat FROM events)
WHERE value >= 1 AND ts::DATE > (SELECT max(ts::DATE) FROM events) - 15)"""


@query("zone_rules", f"""WITH {_Z}, g AS (SELECT state, unit, count(*) AS n, sum(floor(value))::BIGINT AS deaths, count(*) FILTER (event_type = 'error' AND event_id % 5 <> state % 5) AS foreign_n, count(DISTINCT (floor((lon + 180) / 0.5::DOUBLE), floor((lat + 90) / 0.5::DOUBLE))) AS n_cells FROM e GROUP BY ALL),
r AS (SELECT *, CASE WHEN n >= 3 THEN 'R1' WHEN deaths >= 25 AND n >= 2 THEN 'R2' WHEN foreign_n > 0 THEN 'O1' END AS rule FROM g) SELECT state, unit, n, deaths, foreign_n, n_cells, rule, CASE WHEN rule IN ('R1', 'R2') THEN 'red' ELSE 'orange' END AS color FROM r WHERE rule IS NOT NULL""")
def zone_rules(spark, sf):
    e = A.table(spark, sf, "events")
    e = e.withColumns({"lon": A.lon_of(F.col("user_id")), "lat": A.lat_of(F.col("user_id")), "day": F.to_date("ts")}).where("value >= 1")
    last = A.table(spark, sf, "events").agg(F.max(F.to_date("ts")).alias("last"))
    e = e.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("last", 15))  # one row
    state = F.col("user_id") % 20
    rows = e.select(state.alias("state"), F.col("props").alias("unit"), F.floor("value").cast("long").alias("deaths"), ((F.col("event_type") == "error") & (F.col("event_id") % 5 != state % 5)).alias("foreign"), "lon", "lat")
    return AN.zones(rows)


@query("leaders_argmax", "SELECT c_nationkey, max({'v': c_acctbal, 'k': -c_custkey}).v AS best, -max({'v': c_acctbal, 'k': -c_custkey}).k AS leader FROM customer GROUP BY 1")
def leaders_argmax(spark, sf):
    return AN.leaders(A.table(spark, sf, "customer"), "c_nationkey", "c_acctbal", "c_custkey")


@query("subtype_counts", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def subtype_counts(spark, sf):
    return A.table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("availability_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY 1")
def availability_distinct(spark, sf):
    return A.table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props"))


@query("latest_release", "WITH m AS (SELECT o_orderpriority, max(o_orderdate) AS d FROM orders GROUP BY 1) SELECT o_orderpriority, epoch_us(d) // 1000 AS last_ms, count(DISTINCT o_custkey) AS elements FROM orders JOIN m USING (o_orderpriority) WHERE o_orderdate = d GROUP BY ALL")
def latest_release(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderpriority", timefn.to_ms(F.col("o_orderdate")).alias("last_ms"), "o_custkey")
    return AN.latest_release(o, "o_orderpriority", "last_ms", "o_custkey")


@query("highlights", f"WITH {W('event')}, m AS (SELECT max(t_ms) AS t FROM event) SELECT type, count(*) AS n, max(severity) AS most FROM event, m WHERE t_ms > t - 864000000 GROUP BY type")
def highlights(spark, sf):
    return AN.highlights(A.events(spark, sf), 10 * timefn.DAY)


@query("news_nation_groups", """WITH x AS (SELECT 'n' || (user_id % 12) AS nation, event_id, CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'unconfirmed' ELSE 'ambiguous' END AS geo, CASE event_id % 9 WHEN 0 THEN 'nation' WHEN 1 THEN 'region' ELSE 'city' END AS prec, (user_id * 7919 % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS lon FROM events)
SELECT nation, count(*) AS n, count(*) FILTER (geo = 'unconfirmed' AND prec = 'city') AS unconfirmed, count(*) FILTER (geo = 'ambiguous') AS ambiguous, count(*) FILTER (prec <> 'city') AS coarse, coalesce(arg_min(lon, event_id) FILTER (prec = 'nation'), round(avg(lon), 3)) AS lon FROM x WHERE geo <> 'confirmed' GROUP BY nation""")
def news_nation_groups(spark, sf):
    e = A.table(spark, sf, "events")
    n = F.col("event_id")
    rows = e.select(F.concat(F.lit("n"), (F.col("user_id") % 12).cast("string")).alias("nation"), n.alias("id"), F.when(n % 4 == 0, "confirmed").when(n % 4 == 1, "unconfirmed").otherwise("ambiguous").alias("geo"), F.when(n % 9 == 0, "nation").when(n % 9 == 1, "region").otherwise("city").alias("precision"), A.lon_of(F.col("user_id")).alias("lon"))
    return AN.nation_groups(rows)


@query("grid_dedupe_latest", f"WITH {W('event')} SELECT floor(lon / 5) AS gx, floor(lat / 5) AS gy, max({{'t': t_ms, 's': severity, 'n': n}}).n AS n FROM event WHERE confidence > 0.3::DOUBLE GROUP BY 1, 2")
def grid_dedupe_latest(spark, sf):
    e = A.events(spark, sf).where("confidence > 0.3")
    return AN.grid_dedupe(e, 5.0, ["t_ms", "severity", "n"]).select(F.col("gx").cast("double").alias("gx"), F.col("gy").cast("double").alias("gy"), "n")


@query("latest_per_platform", f"WITH {W('event')} SELECT subject, n, t_ms FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t_ms DESC, n) AS r FROM event WHERE status = 'current') WHERE r = 1")
def latest_per_platform(spark, sf):
    return TM.latest(A.events(spark, sf).where("status = 'current'"), ["subject"], F.desc("t_ms"), F.asc("n")).select("subject", "n", "t_ms")


@query("one_source_series", "WITH s AS (SELECT o_custkey, o_orderpriority AS source, max(year(o_orderdate)) AS last, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, max({'l': last, 'n': n, 's': source}).s AS source FROM s GROUP BY 1")
def one_source_series(spark, sf):
    o = A.table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year"))
    return AN.one_source(o, "o_custkey", "source", "year")


@query("mode_priority_dedupe", f"WITH {W('event')} SELECT subject, type, n FROM (SELECT *, row_number() OVER (PARTITION BY subject, type ORDER BY CASE source WHEN 'feed2' THEN 0 WHEN 'feed0' THEN 1 ELSE 2 END, t_ms, n) AS r FROM event) WHERE r = 1")
def mode_priority_dedupe(spark, sf):
    prio = F.when(F.col("source") == "feed2", 0).when(F.col("source") == "feed0", 1).otherwise(2)
    return TM.latest(A.events(spark, sf), ["subject", "type"], prio, F.asc("t_ms"), F.asc("n")).select("subject", "type", "n")


@query("indicator_assembly", "WITH p AS (SELECT c_nationkey, year(o_orderdate) AS period, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT c_nationkey, count(*) AS n, max(period) AS latest, round(min(v), 2) AS least, bool_or(v > 3 * m) AS anomaly FROM (SELECT *, avg(v) OVER (PARTITION BY c_nationkey) AS m FROM p) GROUP BY 1")
def indicator_assembly(spark, sf):
    rows = A.table(spark, sf, "orders").join(A.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    p = rows.groupBy("c_nationkey", F.year("o_orderdate").cast("long").alias("period")).agg(F.sum("o_totalprice").alias("v"))
    return AN.indicator(p, "c_nationkey", "period", "v")


@query("attributions", f"WITH {W('event')} SELECT DISTINCT source, grp FROM event WHERE subject = 'customer:9'")
def attributions(spark, sf):
    return A.events(spark, sf).where("subject = 'customer:9'").select("source", "grp").distinct()


@query("completeness_ratio", "SELECT p_partkey, ((p_size > 25)::INT + (p_retailprice > 1000)::INT + 1)::DOUBLE / 3 AS completeness FROM part")
def completeness_ratio(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select("p_partkey", confidence.completeness(F.when(F.col("p_size") > 25, F.col("p_size")), F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")), F.col("p_name")).alias("completeness"))


@query("percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentiles(spark, sf):
    e = A.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


# ---- published tables ----


@query("latest_payload", f"WITH {W('event')} SELECT grp, source, n FROM (SELECT *, row_number() OVER (PARTITION BY grp, source ORDER BY t_ms DESC, n DESC) AS r FROM event WHERE value > 5) WHERE r = 1")
def latest_payload(spark, sf):
    return TM.latest(A.events(spark, sf).where("value > 5"), ["grp", "source"], F.desc("t_ms"), F.desc("n")).select("grp", "source", "n")


@query("orbit_figures", "WITH m AS (SELECT p_partkey, 1 + p_size * 0.3::DOUBLE AS motion, (p_partkey % 70) / 100.0::DOUBLE AS ecc FROM part), a AS (SELECT *, pow(398600.4418::DOUBLE / pow(motion * 2 * pi() / 86400, 2), 1.0::DOUBLE / 3) AS a FROM m), h AS (SELECT *, a * (1 + ecc) - 6378.137::DOUBLE AS apogee, a * (1 - ecc) - 6378.137::DOUBLE AS perigee FROM a) SELECT p_partkey, round(apogee, 3) AS apogee, round(perigee, 3) AS perigee, round(1440 / motion, 6) AS period_min, CASE WHEN ecc >= 0.25 THEN 'HEO' WHEN apogee < 2000 THEN 'LEO' WHEN motion BETWEEN 0.99 AND 1.01 THEN 'GEO' ELSE 'MEO' END AS regime FROM h")
def orbit_figures(spark, sf):
    p = A.table(spark, sf, "part")
    return AN.orbits(p.select("p_partkey", (1 + F.col("p_size") * 0.3).alias("motion"), (F.col("p_partkey") % 70 / 100.0).alias("ecc")))


@query("name_families", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'bolt|nut') THEN 'fastener' WHEN regexp_matches(lower(p_name), '^red') THEN 'red' ELSE 'other' END AS family FROM part")
def name_families(spark, sf):
    return AN.families(A.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")), [("bolt|nut", "fastener"), ("^red", "red")]).drop("name")


@query("observed_and_predicted", f"WITH {W('event')}, u AS (SELECT t_ms // 10800000 AS slot, 'observed' AS kind, value, t_ms, n FROM event WHERE type = 'view' UNION ALL SELECT t_ms // 10800000, 'predicted', value, t_ms, n FROM event WHERE type = 'click') SELECT slot, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY slot, kind ORDER BY t_ms DESC, n) AS r FROM u) WHERE r = 1")
def observed_and_predicted(spark, sf):
    e = A.events(spark, sf).withColumn("slot", F.floor(F.col("t_ms") / 10800000))
    rows = e.where("type = 'view'").withColumn("kind", F.lit("observed")).unionByName(e.where("type = 'click'").withColumn("kind", F.lit("predicted")))
    return TM.latest(rows, ["slot", "kind"], F.desc("t_ms"), F.asc("n")).select("slot", "kind", "n")


@query("wide_to_long", "SELECT l_orderkey, name, max(value) AS value FROM (UNPIVOT (SELECT l_orderkey, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME name VALUE value) GROUP BY ALL")
def wide_to_long(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return AN.wide_to_long(li, ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"]).groupBy("l_orderkey", "name").agg(F.max("value").alias("value"))


@query("last_points_per_series", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def last_points_per_series(spark, sf):
    o = C.top_per_group(A.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return o.select("o_custkey", "o_orderkey")


@query("cube_cells_decoded", "SELECT p_partkey, p_partkey // 12 AS i, p_partkey % 12 // 4 AS j, p_partkey % 4 AS k, p_retailprice AS value FROM part")
def cube_cells_decoded(spark, sf):
    p = A.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    return AN.decode_cells(p, "p_partkey", {"i": 10**9, "j": 3, "k": 4})


# ---- scalar functions ----


@query("geo_scalars", f"WITH {W('object')} SELECT object_id, round({A.km_sql('lon', 'lat', '9.19::DOUBLE', '45.46::DOUBLE')}, 6) AS km, {A.cx_sql('lon', 5)} AS x5, {A.cy_sql('lat', 5)} AS y5, lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AS valid FROM object WHERE lon IS NOT NULL")
def geo_scalars(spark, sf):
    o = A.objects(spark, sf).where("lon IS NOT NULL")
    lon, lat = F.col("lon"), F.col("lat")
    return o.select("object_id", F.round(geo.haversine_km(lon, lat, F.lit(9.19), F.lit(45.46)), 6).alias("km"), geo.cell_x(lon, 5).alias("x5"), geo.cell_y(lat, 5).alias("y5"), geo.valid_lonlat(lon, lat).alias("valid"))


@query("circle_boxes", f"WITH {W('object')}, b AS (SELECT object_id, lon, lat, 700 / 111.32::DOUBLE AS d, 700 / (111.32::DOUBLE * greatest(cos(radians(greatest(abs(lat - 700 / 111.32::DOUBLE), abs(lat + 700 / 111.32::DOUBLE)))), 1e-9::DOUBLE)) AS w FROM object WHERE type = 'org.supplier') SELECT object_id, CASE WHEN lat - d <= -90 OR lat + d >= 90 OR w >= 180 THEN 1 WHEN lon - w < -180 OR lon + w > 180 THEN 2 ELSE 1 END AS n, round(CASE WHEN lat - d <= -90 OR lat + d >= 90 THEN -180 WHEN w >= 180 THEN -180 WHEN lon - w < -180 THEN lon - w + 360 ELSE lon - w END, 6) AS x0 FROM b")
def circle_boxes(spark, sf):
    o = A.objects(spark, sf).where("type = 'org.supplier'")
    boxes = geo.circle_boxes(F.col("lon"), F.col("lat"), 700)
    return o.select("object_id", F.size(boxes).alias("n"), F.round(F.element_at(boxes, 1)["x0"], 6).alias("x0"))


@query("bearings", f"WITH {W('object')}, b AS (SELECT object_id, (degrees(atan2(sin(radians(12.5 - lon)) * cos(radians(41.9)), cos(radians(lat)) * sin(radians(41.9)) - sin(radians(lat)) * cos(radians(41.9)) * cos(radians(12.5 - lon)))) + 360) % 360 AS c FROM object WHERE type = 'org.customer') SELECT object_id, round(c, 6) AS course, ['N', 'NE', 'E', 'SE', 'S', 'SO', 'O', 'NO'][(floor(c / 45.0 + 0.5)::INT % 8) + 1] AS compass FROM b")
def bearings(spark, sf):
    o = A.objects(spark, sf).where("type = 'org.customer'")
    c = geo.bearing(F.col("lon"), F.col("lat"), F.lit(12.5), F.lit(41.9))
    return o.select("object_id", F.round(c, 6).alias("course"), geo.compass(c).alias("compass"))


@query("human_delta", """WITH d AS (SELECT event_id, (event_id * 7919 - 20000000) * 61 AS ms FROM events), p AS (SELECT *, abs(ms) // 86400000 AS d, abs(ms) % 86400000 // 3600000 AS h, abs(ms) % 3600000 // 60000 AS m, abs(ms) % 60000 // 1000 AS s FROM d),
t AS (SELECT *, concat_ws(' ', CASE WHEN d > 0 THEN d || CASE WHEN d = 1 THEN ' giorno' ELSE ' giorni' END END, CASE WHEN h > 0 THEN h || ' h' END, CASE WHEN m > 0 AND d = 0 THEN m || ' min' END) AS x FROM p) SELECT event_id, CASE WHEN ms < 0 THEN '−' ELSE '' END || CASE WHEN x = '' THEN s || ' s' ELSE x END AS said FROM t""")
def human_delta(spark, sf):
    ms = (F.col("event_id") * 7919 - 20000000) * 61
    return A.table(spark, sf, "events").select("event_id", timefn.human_delta(ms).alias("said"))


@query("time_scalars", f"WITH {W('event')} SELECT n, month, t_ms // 900000 * 900000 AS slot, epoch_us(date_trunc('month', make_timestamp(t_ms * 1000))) // 1000 AS month_start, strftime(make_timestamp(t_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN t_ms % 1000 = 0 THEN '' ELSE '.' || lpad((t_ms % 1000)::VARCHAR, 3, '0') || '000' END || 'Z' AS iso FROM event")
def time_scalars(spark, sf):
    e = A.events(spark, sf)
    return e.select("n", "month", timefn.slot15(F.col("t_ms")).alias("slot"), timefn.month_start_ms(F.col("month")).alias("month_start"), timefn.to_iso(F.col("t_ms")).alias("iso"))


@query("period_dates", """WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-S' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END WHEN 2 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS code, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-01-01') WHEN 1 THEN CASE WHEN month(d) <= 6 THEN strftime(d, '%Y-01-01') ELSE strftime(d, '%Y-07-01') END WHEN 2 THEN strftime(d, '%Y-%m-01') ELSE code END AS first_day,
CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-12-31') WHEN 1 THEN CASE WHEN month(d) <= 6 THEN strftime(d, '%Y-06-30') ELSE strftime(d, '%Y-12-31') END WHEN 2 THEN strftime(last_day(d), '%Y-%m-%d') ELSE code END AS last_day FROM c""")
def period_dates(spark, sf):
    o = A.table(spark, sf, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    y = F.date_format(d, "yyyy")
    code = F.when(k == 0, y).when(k == 1, F.concat(y, F.when(F.month(d) <= 6, "-S1").otherwise("-S2"))).when(k == 2, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    o = o.select("o_orderkey", code.alias("code"))
    first, last = timefn.period_dates(F.col("code"))
    return o.select("o_orderkey", first.alias("first_day"), last.alias("last_day"))


_DET = "substr(sha256({0}), 1, 32)"


@query("det_ids", f"WITH h AS (SELECT c_custkey, {_DET.format('c_name || chr(31) || c_mktsegment || chr(31)')} AS h FROM customer), b AS (SELECT c_custkey, rpad(array_to_string(list_transform(string_split(h, ''), lambda c: to_base(strpos('0123456789abcdef', c) - 1, 2, 4)), ''), 130, '0') AS b FROM h) SELECT c_custkey, 'obj_' || array_to_string(list_transform(range(26), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', list_reduce(list_transform(range(5), lambda j: substr(b, (i * 5 + j + 1)::INT, 1)::INT), lambda x, y: x * 2 + y) + 1, 1)), '') AS id FROM b")
def det_ids(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", ids.det_id("obj", F.col("c_name"), F.col("c_mktsegment"), F.lit(None)).alias("id"))


@query("fnv_shards", "SELECT c_custkey, h, (h % 64)::INT AS shard FROM (SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(strlen(c_name)), lambda i: ascii(substr(c_name, (i + 1)::INT, 1))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS h FROM customer)")
def fnv_shards(spark, sf):
    c = A.table(spark, sf, "customer")
    return c.select("c_custkey", ids.fnv1a32(F.col("c_name")).alias("h"), ids.shard_of(F.col("c_name"), 64).alias("shard"))


@query("bands_and_text", "SELECT o_orderkey, CASE WHEN c >= 0.8 THEN 2 WHEN c >= 0.5 THEN 1 ELSE 0 END AS band, CASE WHEN c >= 0.8 THEN 'supporto forte' WHEN c >= 0.5 THEN 'supporto medio' ELSE 'supporto debole' END || ' (' || printf('%.2f', c) || '): ' || o_orderstatus AS said, replace(printf('%.1f', o_totalprice), '.', ',') AS price FROM (SELECT *, (o_orderkey % 97) / 96.0::DOUBLE AS c FROM orders)")
def bands_and_text(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("c", F.col("o_orderkey") % 97 / 96.0)
    return o.select("o_orderkey", confidence.band(F.col("c")).alias("band"), confidence.sentence(F.col("c"), F.array("o_orderstatus")).alias("said"), text.decimal_comma(F.col("o_totalprice"), 1).alias("price"))


@query("significant_digits", "SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0.0 ELSE round(c_acctbal * pow(10.0::DOUBLE, 3 - floor(log10(abs(c_acctbal))))) / pow(10.0::DOUBLE, 3 - floor(log10(abs(c_acctbal)))) END AS v FROM customer")
def significant_digits(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", text.significant(F.col("c_acctbal"), 4).alias("v"))


@query("json_props", "SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.missing') IS NULL AS absent FROM events")
def json_props(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("absent"))


@query("array_and_map_ops", "WITH a AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY 1) SELECT user_id, array_to_string(list_slice(l, 1, 8), ',') AS first8, len(list_distinct(l)) AS kinds, len(list_filter(l, lambda x: x = 'click')) AS clicks FROM a")
def array_and_map_ops(spark, sf):
    """Lists hold the first eight events of a user, maps its counts by type, however many it has."""
    e = A.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    first = C.top_per_group(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], 8).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    kinds = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    listed = F.array_join(F.transform("l", lambda x: x["event_type"]), ",")
    return first.join(kinds, "user_id").select("user_id", listed.alias("first8"), F.size("m").cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"))


@query("bitshift_cells", f"WITH {W('object')} SELECT object_id, cx >> 2 AS x6, cy >> 4 AS y4 FROM object WHERE cx IS NOT NULL")
def bitshift_cells(spark, sf):
    return A.objects(spark, sf).where("cx IS NOT NULL").select("object_id", F.shiftright("cx", 2).alias("x6"), F.shiftright("cy", 4).alias("y4"))


@query("version_keys", "SELECT p_partkey, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN lpad(v, 20, '0') ELSE v END AS k FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS v FROM part)")
def version_keys(spark, sf):
    p = A.table(spark, sf, "part")
    v = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return p.select("p_partkey", ids.version_key(v).alias("k"))


@query("url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/#?]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/#?]+(/[^#?]*)', 1) AS path FROM pages")
def url_parts(spark, sf):
    p = A.table(spark, sf, "pages")
    return p.select("page_id", F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/#?]+)", 1), F.lit("")).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/#?]+(/[^#?]*)", 1).alias("path"))


@query("fuzzy_names", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON substr(a.n_name, 1, 3) = substr(b.n_name, 1, 3) AND a.n_nationkey < b.n_nationkey WHERE levenshtein(a.n_name, b.n_name) <= 1")
def fuzzy_names(spark, sf):
    return AN.fuzzy_pairs(A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 3, 1)


@query("freshness", "SELECT o_custkey, CASE WHEN max(o_orderdate) < DATE '2001-07-01' THEN 'stale' ELSE 'ok' END AS health, CASE WHEN max(o_orderdate) < DATE '2001-07-01' THEN (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(max(o_orderdate))) // 86400000000 END AS days FROM orders GROUP BY 1")
def freshness(spark, sf):
    o = A.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(timefn.to_ms(F.col("o_orderdate"))).alias("last_ms"))
    return AN.freshness(o, 996624000000, 31 * timefn.DAY)


@query("recent_split", f"WITH {W('event')} SELECT count(*) FILTER (t_ms <= 1706000000000 + 3600000 AND 1706000000000 - t_ms <= 86400000) AS recent, count(*) FILTER (NOT (t_ms <= 1706000000000 + 3600000 AND 1706000000000 - t_ms <= 86400000)) AS old, max(t_ms) AS newest, min(t_ms) AS oldest FROM event")
def recent_split(spark, sf):
    return AN.recent_split(A.events(spark, sf), 1706000000000)
