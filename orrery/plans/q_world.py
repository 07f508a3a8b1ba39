"""Names, participations, versions, places, indicators, flows and status of a world."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import views as V
from orrery.operators import world as WB
from orrery.plans import adapter as A
from orrery.plans.catalog import query


@query("world_aliases", r"""WITH r AS (SELECT 'part:' || p_partkey AS entity_id, p_type AS type, p_name AS label, p_brand AS source, 'size:' || p_size AS ident FROM part),
n AS (SELECT entity_id, 0 AS o, label AS alias, type FROM r WHERE type LIKE 'PROMO%' UNION ALL SELECT entity_id, 1, source, type FROM r UNION ALL SELECT entity_id, 2, 'Size ' || substr(ident, 6), type FROM r WHERE substr(ident, 6)::INT % 2 = 0),
f AS (SELECT *, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS name FROM n),
b AS (SELECT entity_id, name, min({'o': o, 'alias': alias, 'type': type}) AS b FROM f WHERE name <> '' GROUP BY ALL)
SELECT entity_id, name, b.alias AS alias, b.type AS type, ['label', 'source', 'vocab'][b.o + 1] AS origin FROM b""")
def world_aliases(spark, sf):
    p = A.table(spark, sf, "part")
    ident = F.concat(F.lit("size:"), F.col("p_size").cast("string"))
    records = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_type").alias("type"), F.col("p_name").alias("label"), F.array("p_brand").alias("aliases"), F.array(ident).alias("identifiers"))
    vocabulary = p.where("p_size % 2 = 0").select(F.col("p_type").alias("type"), ident.alias("identifier"), F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("alias")).distinct()
    matched = [r[0] for r in p.select("p_type").distinct().collect() if r[0].startswith("PROMO")]  # a declared list of types
    return WB.aliases(records, matched, vocabulary)


def _evidence(spark, sf):
    e = A.events(spark, sf)
    return e.select("event_id", "type", F.col("subject").alias("object_id"), F.when(F.col("n") % 7 == 0, "witness").otherwise("subject").alias("role"), F.col("grp"), F.col("confidence").alias("weight"), "n")


_EV = "v AS (SELECT event_id, type, subject AS object_id, CASE WHEN n % 7 = 0 THEN 'witness' ELSE 'subject' END AS role, 'g' || (n % 3 + x) AS grp, confidence / (x + 1) AS weight, n FROM event, (VALUES (0), (1), (2)) t(x))"


def _thrice(spark, sf):
    """Each event is told by three pieces of evidence, of which groups overlap."""
    rows = _evidence(spark, sf).withColumn("x", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.withColumns({"grp": F.concat(F.lit("g"), (F.col("n") % 3 + F.col("x")).cast("string")), "weight": F.col("weight") / (F.col("x") + 1)})


@query("world_participations", f"WITH {A.world_sql('event')}, {_EV}, g AS (SELECT event_id, object_id, role, grp, max(weight) AS best, count(*) AS n FROM v GROUP BY ALL) SELECT event_id, object_id, role, round(1 - product(1 - best), 9) AS confidence, count(*) AS groups, sum(n)::BIGINT AS n_evidence FROM g GROUP BY ALL")
def world_participations(spark, sf):
    """In two batches: the state of the first and the evidence of the second give what all gives at once."""
    rows = _thrice(spark, sf)
    first = WB.participation_groups(rows.where("x = 0"))
    return WB.participations(WB.participation_groups(rows.where("x > 0"), first)).withColumn("confidence", F.round("confidence", 9))


@query("world_undeclared_roles", f"WITH {A.world_sql('event')}, {_EV} SELECT event_id, role, count(*) AS n FROM v WHERE role = 'witness' AND type NOT IN ('click', 'error') GROUP BY ALL")
def world_undeclared_roles(spark, sf):
    kinds = A.events(spark, sf).select("type").distinct()
    declared = kinds.select("type", F.lit("subject").alias("role")).unionByName(kinds.where("type IN ('click', 'error')").select("type", F.lit("witness").alias("role")))
    return WB.undeclared(_thrice(spark, sf), declared).groupBy("event_id", "role").agg(F.count("*").alias("n"))


@query("world_versions", "SELECT dense_rank() OVER (ORDER BY o_orderdate) AS version, 'order' AS kind, o_custkey AS id, o_orderstatus AS op FROM (SELECT DISTINCT o_orderdate, o_custkey, o_orderstatus FROM orders)")
def world_versions(spark, sf):
    """Each day's orders are one batch."""
    o = A.table(spark, sf, "orders")
    return WB.change_log(o.select(F.col("o_orderdate").alias("batch"), F.lit("order").alias("kind"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("op")))


@query("places_index", """WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN substr(n_name, 1, 1) || '. ' || substr(n_name, 3) ELSE n_name END AS label, n_name, n_regionkey FROM nation),
a AS (SELECT k, label AS alias FROM n UNION ALL SELECT k, n_name FROM n WHERE k % 2 = 0 UNION ALL SELECT k, 'Old ' || n_name FROM n)
SELECT n.k AS id, n.label, string_agg(DISTINCT alias, '|' ORDER BY alias) FILTER (alias <> label) AS aliases, CASE WHEN n.k % 6 = 0 AND n_regionkey < 4 THEN n_name END AS clear_name, n.k::DOUBLE AS rank, r_name AS context
FROM n JOIN a USING (k) JOIN region ON r_regionkey = n_regionkey WHERE n.k >= 3 GROUP BY ALL""")
def places_index(spark, sf):
    n = A.table(spark, sf, "nation").join(A.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    k = F.col("n_nationkey")
    label = F.when(k % 3 == 0, F.concat(F.substring("n_name", 1, 1), F.lit(". "), F.expr("substr(n_name, 3)"))).otherwise(F.col("n_name"))
    places = n.select(k.alias("id"), F.lit("place.nation").alias("type"), label.alias("label"), k.cast("double").alias("rank"), F.col("r_name").alias("context"), F.col("n_name").alias("sovereignty"), (F.col("n_regionkey") < 4).alias("sovereign"))
    names = places.select(F.col("id").alias("entity_id"), F.col("label").alias("alias")).unionByName(n.where(k % 2 == 0).select(k.alias("entity_id"), F.col("n_name").alias("alias"))).unionByName(n.select(k.alias("entity_id"), F.concat(F.lit("Old "), "n_name").alias("alias")))
    return V.places_index(places, names, 3).select("id", "label", F.array_join("aliases", "|").alias("aliases"), "clear_name", "rank", "context")


_FACTS = "f AS (SELECT 'nation:' || c_nationkey AS place, o_orderpriority AS indicator, year(o_orderdate)::INT AS period, round(sum(o_totalprice), 2) AS value, 'orders' AS source FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def _facts(spark, sf):
    o = A.table(spark, sf, "orders").join(A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return o.groupBy(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("place"), F.col("o_orderpriority").alias("indicator"), F.year("o_orderdate").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value")).withColumn("source", F.lit("orders"))


@query("place_indicators", f"WITH {_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY period DESC) AS r, lead(value) OVER (PARTITION BY indicator ORDER BY period DESC) AS before FROM f WHERE place = 'nation:3') SELECT indicator, period, value, before, round(value - before, 2) AS change, source FROM r WHERE r = 1")
def place_indicators(spark, sf):
    return V.indicators_of(_facts(spark, sf), "nation:3").withColumn("change", F.round("change", 2))


@query("indicator_catalog", f'WITH {_FACTS} SELECT indicator, count(DISTINCT place) AS places, min(period) AS "first", max(period) AS "last", count(*) AS n FROM f GROUP BY indicator')
def indicator_catalog(spark, sf):
    return V.indicator_catalog(_facts(spark, sf))


@query("place_flows", """WITH f AS (SELECT 'nation:' || s_nationkey AS origin, 'nation:' || c_nationkey AS target, l_returnflag AS indicator, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
d AS (SELECT 'out' AS dir, indicator, target AS partner, value FROM f WHERE origin = 'nation:7' UNION ALL SELECT 'in', indicator, origin, value FROM f WHERE target = 'nation:7')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir, indicator ORDER BY value DESC, partner)::INT AS rank FROM d) WHERE rank <= 4""")
def place_flows(spark, sf):
    rows = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = rows.join(A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    name = lambda c: F.concat(F.lit("nation:"), F.col(c).cast("string"))
    flows = rows.groupBy(name("s_nationkey").alias("origin"), name("c_nationkey").alias("target"), F.col("l_returnflag").alias("indicator")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return V.flows_of(flows, "nation:7", 4)


@query("world_status", f"WITH {A.world_sql('object', 'event', 'relation')} SELECT 'object' AS kind, type, count(*) AS n FROM object GROUP BY type UNION ALL SELECT 'event', type, count(*) FROM event GROUP BY type UNION ALL SELECT 'relation', type, count(*) FROM relation GROUP BY type")
def world_status(spark, sf):
    return V.status(object=A.objects(spark, sf), event=A.events(spark, sf), relation=A.relations(spark, sf))


@query("data_received", f"WITH {A.world_sql('event')} SELECT source, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM event GROUP BY source")
def data_received(spark, sf):
    return V.data_received(A.events(spark, sf))
