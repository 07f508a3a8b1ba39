"""References, details, news, highlights, chains, explanations, vocabularies and the façade."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.vocabulary import Registry, Vocabulary
from orrery.operators import explain as EX
from orrery.operators import rules as RU
from orrery.operators import views as V
from orrery.plans import adapter as A
from orrery.plans import q_rules as QR
from orrery.plans.catalog import query
from orrery.plans.engine import Engine

W = A.world_sql


def engine(spark, sf) -> Engine:
    return Engine({"object": A.objects(spark, sf), "event": A.events(spark, sf), "participation": A.participations(spark, sf), "relation": A.relations(spark, sf), "edge": A.edges(spark, sf)})


@query("entity_references", f"WITH {W('object', 'event', 'relation')} SELECT kind, type, count(*) AS n, min(id) AS first FROM (SELECT 'object' AS kind, object_id AS id, type FROM object UNION ALL SELECT 'event', event_id, type FROM event UNION ALL SELECT 'relation', relation_id, type FROM relation) GROUP BY ALL")
def entity_references(spark, sf):
    refs = V.references(A.objects(spark, sf), A.events(spark, sf), A.relations(spark, sf))
    return refs.groupBy("kind", "type").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("entity_details", f"WITH {W('object', 'edge')}, d AS (SELECT 'out:' || type || ':' || count(*) AS x FROM edge WHERE src = 'nation:2' GROUP BY type UNION ALL SELECT 'in:' || type || ':' || count(*) FROM edge WHERE dst = 'nation:2' GROUP BY type) SELECT object_id, label, (SELECT string_agg(x, ',' ORDER BY x) FROM d) AS degrees FROM object WHERE object_id = 'nation:2'")
def entity_details(spark, sf):
    return engine(spark, sf).query("entity", id="nation:2").select("object_id", "label", "degrees")


@query("type_points", f"WITH {W('object')}, o AS (SELECT * FROM object WHERE type = 'org.customer'), s AS (SELECT source, row_number() OVER (ORDER BY min(object_id)) - 1 AS source_no FROM o GROUP BY source) SELECT object_id, round(lon, 5) AS lon, round(lat, 5) AS lat, source_no FROM o JOIN s USING (source)")
def type_points(spark, sf):
    return V.type_points(A.objects(spark, sf), "org.customer")


def _news(spark, sf):
    e = A.table(spark, sf, "events")
    n = F.col("event_id")
    return e.select(n.alias("id"), F.concat(F.lit("n"), (F.col("user_id") % 12).cast("string")).alias("nation"), F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("city"), F.when(n % 3 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("categories"), F.when(n % 4 == 0, "confirmed").otherwise("ambiguous").alias("geo"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


@query("news_filter", "SELECT event_id AS id FROM events WHERE user_id % 12 = 3 AND event_id % 3 > 0 AND event_id % 4 > 0")
def news_filter(spark, sf):
    return V.news_filter(_news(spark, sf), nation="n3", category="other", certainty="uncertain").select("id")


@query("news_reports", """WITH RECURSIVE r AS (SELECT event_id AS id, props AS url, user_id % 30 AS place, event_type AS action, epoch_us(ts) // 3600000000 AS hour, event_id % 9 AS articles, epoch_us(ts) // 1000 AS t FROM events),
k AS (SELECT id, 'u' || url || '|' || place AS key FROM r UNION ALL SELECT id, 'a' || action || '|' || place || '|' || hour FROM r), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key) WHERE x.id <> y.id),
c AS (SELECT id AS node, id AS label FROM r UNION SELECT e.b, label FROM c JOIN e ON e.a = c.node WHERE label < e.b), g AS (SELECT node, min(label) AS grp FROM c GROUP BY node)
SELECT min({'a': -articles, 'id': id}).id AS id, count(*) AS n, sum(articles)::BIGINT AS articles, count(DISTINCT url) AS pages, min(t) AS first, max(t) AS last FROM r JOIN g ON node = id GROUP BY grp""")
def news_reports(spark, sf):
    e = A.events(spark, sf).join(A.table(spark, sf, "events").select(F.col("event_id").alias("n"), "props"), "n")
    rows = e.select(F.col("n").alias("id"), F.col("props").alias("url"), (F.col("user_id") % 30).cast("string").alias("place"), F.col("type").alias("action"), F.floor(F.col("t_ms") / 3600000).alias("hour"), (F.col("n") % 9).alias("articles"), F.col("t_ms").alias("t"))
    return V.news_reports(rows)


@query("highlight_states", f"WITH {W('object')}, c AS (SELECT object_id AS id, cx >> 4 AS x, cy >> 4 AS y, count(*) OVER (PARTITION BY cx >> 4, cy >> 4) AS n FROM object WHERE cx IS NOT NULL) SELECT o.object_id AS id, CASE WHEN o.cx IS NULL THEN 'not_applicable' WHEN n = 1 THEN 'single' ELSE 'in_cell' END AS state, x, y FROM object o LEFT JOIN c ON c.id = o.object_id WHERE o.type IN ('place.nation', 'place.region') UNION ALL SELECT 'nobody', 'outside_scope', NULL, NULL")
def highlight_states(spark, sf):
    o = A.objects(spark, sf).withColumnRenamed("object_id", "id")
    chosen = o.where("type IN ('place.nation', 'place.region')").select("id").unionByName(spark.createDataFrame([("nobody",)], "id string"))
    return V.highlighted_cells(o, chosen, 4)


@query("locate_entity", f"WITH {W('object', 'event', 'edge')} SELECT 'map' AS view, count(*) > 0 AS found FROM (SELECT lon FROM object WHERE object_id = 'nation:2' UNION ALL SELECT lon FROM event WHERE event_id = 'nation:2') WHERE lon IS NOT NULL UNION ALL SELECT 'timeline', count(*) > 0 FROM event WHERE event_id = 'nation:2' AND t_ms IS NOT NULL UNION ALL SELECT 'graph', count(*) > 0 FROM edge WHERE src = 'nation:2' OR dst = 'nation:2' UNION ALL SELECT 'search', count(*) > 0 FROM object WHERE object_id = 'nation:2' AND label IS NOT NULL")
def locate_entity(spark, sf):
    return engine(spark, sf).query("locate", id="nation:2")


@query("timeline_neighbours", f"WITH {W('event')}, f AS (SELECT * FROM event WHERE n = 4) SELECT e.event_id, 1 AS hops, e.t_ms - f.t_ms AS dt FROM event e, f WHERE e.subject = f.subject AND e.n <> f.n AND abs(e.t_ms - f.t_ms) <= 864000000")
def timeline_neighbours(spark, sf):
    return V.timeline_neighbours(A.events(spark, sf), A.participations(spark, sf), "event:4", 1, 864_000_000)


_EV = "ev AS (SELECT o_orderkey AS supports, o_orderkey // 3 AS support FROM orders WHERE o_orderkey > 2)"


def _evidence(spark, sf):
    o = A.table(spark, sf, "orders").where("o_orderkey > 2")
    return o.select(F.col("o_orderkey").alias("supports"), F.floor(F.col("o_orderkey") / 3).alias("support"))


@query("sources_of_closure", f"WITH RECURSIVE {_EV}, r AS (SELECT supports AS root, supports AS x, 0 AS d FROM ev UNION ALL SELECT root, support, d + 1 FROM r JOIN ev ON supports = x WHERE d < 64) SELECT DISTINCT root, o_orderpriority AS source FROM r JOIN orders ON o_orderkey = x")
def sources_of_closure(spark, sf):
    ev = _evidence(spark, sf)
    src = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"))
    return V.sources_of(ev, src, ev.select(F.col("supports").alias("node")), A.WHOLE_DEPTH)


@query("provenance_complete", f"WITH RECURSIVE {_EV}, r AS (SELECT supports AS root, supports AS x, 0 AS d FROM ev UNION ALL SELECT root, support, d + 1 FROM r JOIN ev ON supports = x WHERE d < 64) SELECT root, min(CASE WHEN x <= 1 THEN 1 ELSE 0 END) = 1 AS complete FROM r WHERE x NOT IN (SELECT supports FROM ev) GROUP BY root")
def provenance_complete(spark, sf):
    ev = _evidence(spark, sf)
    raws = spark.range(2).select("id")
    return V.complete_chains(ev, raws, ev.select(F.col("supports").alias("node")), A.WHOLE_DEPTH)


@query("evidence_in_and_out", f"WITH {_EV} SELECT support AS node, 'supports' AS side, supports AS id FROM ev UNION ALL SELECT supports, 'rests_on', support FROM ev")
def evidence_in_and_out(spark, sf):
    """Both sides of every record."""
    ev = _evidence(spark, sf)
    sides = F.array(*(F.struct(F.col(a).alias("node"), F.lit(side).alias("side"), F.col(b).alias("id")) for a, side, b in (("support", "supports", "supports"), ("supports", "rests_on", "support"))))
    return ev.select(F.explode(sides).alias("s")).select("s.*")


@query("line_chains", """WITH RECURSIVE l AS (SELECT DISTINCT o_orderkey AS id, o_orderkey AS src, CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey * 1000 ELSE o_orderkey + 1 END AS dst FROM orders),
p AS (SELECT id, src AS p FROM l UNION ALL SELECT id, dst FROM l), t AS (SELECT min(id) AS a, max(id) AS b FROM p GROUP BY p HAVING count(*) = 2), u AS (SELECT a, b FROM t WHERE a <> b UNION SELECT b, a FROM t WHERE a <> b),
c AS (SELECT id AS node, id AS label FROM l UNION SELECT u.b, label FROM c JOIN u ON u.a = c.node WHERE label < u.b), g AS (SELECT node, min(label) AS chain FROM c GROUP BY node) SELECT chain, count(*) AS n, sum(1.5::DOUBLE) AS km FROM g GROUP BY chain""")
def line_chains(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey").distinct()
    k = F.col("o_orderkey")
    return V.merge_lines(o.select(k.alias("id"), k.alias("src"), F.when(k % 10 == 9, k * 1000).otherwise(k + 1).alias("dst"), F.lit(1.5).alias("km")))


LINE = [(-150.0, -40.0), (-60.0, 0.0), (20.0, 10.0), (140.0, 60.0)]
_SEG = " UNION ALL ".join(f"SELECT {i} AS seg, {a[0]}::DOUBLE AS ax, {a[1]}::DOUBLE AS ay, {b[0]}::DOUBLE AS bx, {b[1]}::DOUBLE AS by" for i, (a, b) in enumerate(zip(LINE, LINE[1:], strict=False)))


@query("project_on_line")
def project_on_line(spark, sf):
    o = A.objects(spark, sf).where("type = 'org.supplier'").select(F.col("object_id").alias("id"), "lon", "lat")
    return V.project_on_line(o, LINE)


@query("explanations", f"""WITH {W('event')}, {QR.PAIRS}, x AS (SELECT *, dt // 3600000 AS h, dt % 3600000 // 60000 AS m, dt % 60000 // 1000 AS s FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_id) AS r FROM v WHERE score >= 0.3) WHERE r = 1)
SELECT b_id, 'Da ' || a_id || ', ' || CASE WHEN h = 0 AND m = 0 THEN s || ' s' ELSE concat_ws(' ', CASE WHEN h > 0 THEN h || ' h' END, CASE WHEN m > 0 THEN m || ' min' END) END || ' prima.' AS said FROM x""")
def explanations(spark, sf):
    rule = RU.load(QR.ASSOCIATION)
    found = RU.associations(rule, RU.Compiler(rule, QR.world(spark, sf)).bindings())
    return found.select(F.col("B_id").alias("b_id"), EX.render("Da {A.id}, {dt.A.B|delta} prima.", EX.from_bindings(found)).alias("said"))


@query("factors_recomputed", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE * (o_orderkey % 10) / 10 ELSE 1 - (1 - (o_orderkey % 10) / 10.0::DOUBLE) * (1 - 0.25::DOUBLE) END, 9) AS confidence FROM orders")
def factors_recomputed(spark, sf):
    k = F.col("o_orderkey")
    tenth = (k % 10 / 10.0).cast("string")
    packed = F.when(k % 2 == 0, F.concat(F.lit('{"p": [0.5, '), tenth, F.lit("]}"))).otherwise(F.concat(F.lit('{"g": {"a": '), tenth, F.lit(', "b": 0.25}, "n": 2}')))
    return A.table(spark, sf, "orders").select("o_orderkey", F.round(EX.recompute(packed), 9).alias("confidence"))


@query("candidates_truncated", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 4")
def candidates_truncated(spark, sf):
    return EX.truncated(A.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 4)


@query("licence_verdicts", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)public domain|cc0') THEN 'open' WHEN regexp_matches(text, '(?i)by-nc|non.?commercial') THEN 'restricted' WHEN regexp_matches(text, '(?i)cc.?by|attribution|open data') THEN 'attribution' WHEN regexp_matches(text, '(?i)all rights reserved|proprietary') THEN 'closed' ELSE 'unknown' END AS verdict FROM documents")
def licence_verdicts(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", EX.licence_verdict(F.col("text")).alias("verdict"))


VOCABULARY = """
[[object]]
id = "org.customer"
label = "Customer"
geometry = "point"
property = [ { name = "c_mktsegment", kind = "text", required = true, head = true }, { name = "c_acctbal", kind = "float", required = true, head = true, prefix = "saldo " } ]
severity = { property = "c_acctbal", min = 0, max = 5000 }
[[object]]
id = "place.nation"
[[relation]]
id = "located_in"
from = ["org.customer"]
to = ["place.nation"]
"""
REGISTRY = """
[[source]]
id = "AUTOMOBILE"
tier = "T1"
verdict = "approved"
group = "a"
checked = "2024-01-01"
[[source]]
id = "BUILDING"
tier = "T3"
verdict = "rejected"
checked = "2023-01-01"
"""


@query("vocabulary_columns", "SELECT c_custkey, least(greatest(CASE WHEN c_acctbal > 100 THEN c_acctbal END / 5000, 0), 1) AS severity, CASE WHEN c_acctbal > 100 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS completeness, CASE WHEN c_acctbal > 100 THEN 2 ELSE 1 END AS shown FROM customer")
def vocabulary_columns(spark, sf):
    v = Vocabulary.load(VOCABULARY)
    c = A.table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") > 100, F.col("c_acctbal")))
    kind = F.lit("org.customer")
    severity = F.when(F.col("c_acctbal").isNotNull(), v.severity(kind, F.col)).otherwise(F.least(F.greatest(F.lit(None).cast("double"), F.lit(0.0)), F.lit(1.0)))
    return c.select("c_custkey", severity.alias("severity"), v.completeness(kind, F.col).alias("completeness"), F.size(v.head("org.customer", F.col)).alias("shown"))


@query("registry_admissible", "SELECT c_mktsegment AS source, count(*) AS n FROM customer WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY 1")
def registry_admissible(spark, sf):
    r = Registry.load(REGISTRY).table(spark).where("admissible")
    c = A.table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "source")
    return c.join(F.broadcast(r), "source").groupBy("source").agg(F.count("*").alias("n"))


@query("engine_context", f"WITH {W('relation', 'participation')} SELECT section, count(*) AS n FROM (SELECT 'focus' AS section UNION ALL SELECT 'relations' FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY o) AS r FROM (SELECT 'in' AS dir, from_id AS o FROM relation WHERE to_id = 'nation:3' UNION ALL SELECT 'out', to_id FROM relation WHERE from_id = 'nation:3')) WHERE r <= 5 UNION ALL SELECT 'related_objects' FROM (SELECT from_id AS o FROM relation WHERE to_id = 'nation:3' UNION SELECT to_id FROM relation WHERE from_id = 'nation:3' LIMIT 5) UNION ALL SELECT 'related_events' FROM (SELECT DISTINCT event_id FROM participation WHERE role = 'subject' AND object_id IN (SELECT from_id FROM relation WHERE to_id = 'nation:3' UNION SELECT to_id FROM relation WHERE from_id = 'nation:3') LIMIT 5)) GROUP BY section")
def engine_context(spark, sf):
    c = engine(spark, sf).query("context", budget={"max_items": 5}, focus="nation:3")
    return c.where("section IN ('focus', 'relations', 'related_objects', 'related_events')").groupBy("section").agg(F.count("*").alias("n"))


@query("engine_context_sections", f"""WITH {W('object', 'event', 'participation')}, c AS (SELECT * FROM object WHERE object_id = 'customer:1'), e AS (SELECT * FROM event WHERE subject = 'customer:1'),
b AS (SELECT object_id, round({A.km_sql('c.lon', 'c.lat', 'o.lon', 'o.lat')}, 6) AS km FROM object o, (SELECT lon, lat FROM c) c WHERE o.object_id <> 'customer:1' AND o.status <> 'retracted')
SELECT 'focus' AS section, object_id AS ref FROM c UNION ALL SELECT 'sources', source FROM (SELECT source FROM c UNION SELECT source FROM e ORDER BY 1 LIMIT 5)
UNION ALL SELECT 'evidence', event_id FROM (SELECT event_id FROM participation WHERE object_id = 'customer:1' ORDER BY 1 LIMIT 5)
UNION ALL SELECT 'timeline', event_id FROM (SELECT event_id FROM e ORDER BY t_ms, event_id LIMIT 5)
UNION ALL SELECT 'geography', object_id FROM (SELECT object_id FROM b WHERE km <= 100 ORDER BY km, object_id LIMIT 5)
UNION ALL SELECT 'insights', i FROM (SELECT 'about ' || event_id AS i, confidence FROM e ORDER BY confidence DESC, i LIMIT 5)""")
def engine_context_sections(spark, sf):
    """The sections whose rows are few enough to be told one by one; engine_context counts the others."""
    e = A.events(spark, sf)
    about = F.concat(F.lit("about "), F.col("event_id")).alias("insight_id")
    more = {"evidence": A.participations(spark, sf).select(F.col("object_id").alias("supports"), F.col("event_id").alias("support")), "insight": e.select(about, F.lit("about").alias("rule_id"), "confidence"), "member": e.select(about, F.col("subject").alias("entity_id"))}
    c = Engine(engine(spark, sf).world | more).query("context", budget={"max_items": 5}, focus="customer:1")
    return c.where("section NOT IN ('relations', 'related_objects', 'related_events')").select("section", "ref")


@query("engine_map", f"WITH {W('object', 'event')} SELECT 200 >= count(*) AS fits, sum(n)::BIGINT AS n FROM (SELECT cx >> 4 AS x, cy >> 4 AS y, count(*) AS n FROM (SELECT cx, cy FROM object WHERE cx IS NOT NULL UNION ALL SELECT cx, cy FROM event) GROUP BY ALL)")
def engine_map(spark, sf):
    m = engine(spark, sf).query("map", scope={"z": 2}, budget={"max_items": 5000})
    return m.agg((F.count("*") <= 200).alias("fits"), F.sum("n").alias("n"))


@query("shared_insights", f"WITH {W('event')}, m AS (SELECT DISTINCT grp || t_ms // 3600000 AS i, subject AS e FROM event), a AS (SELECT i FROM m GROUP BY i HAVING count(*) BETWEEN 2 AND 5) SELECT x.e AS entity_id, y.e AS other_id, count(*) AS n FROM m x JOIN m y USING (i) JOIN a USING (i) WHERE x.e <> y.e AND x.e IN ('customer:1', 'customer:2') GROUP BY ALL")
def shared_insights(spark, sf):
    from orrery.operators.relational import shared_insights as shared

    e = A.events(spark, sf)
    m = e.select(F.concat("grp", F.floor(F.col("t_ms") / 3600000).cast("string")).alias("insight_id"), F.col("subject").alias("entity_id")).distinct()
    active = m.groupBy("insight_id").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 5").select("insight_id")
    return shared(m, active, spark.createDataFrame([("customer:1",), ("customer:2",)], "entity_id string"))


@query("factors_of_insights", "SELECT o_orderkey, round(0.9::DOUBLE * ((o_orderkey % 7) / 7.0::DOUBLE) * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0.5::DOUBLE * 0.25::DOUBLE END, 9) AS confidence FROM orders")
def factors_of_insights(spark, sf):
    k = F.col("o_orderkey")
    scored = F.when(k % 3 == 0, F.lit("{}")).otherwise(F.lit('{"b": 0.25, "a": 0.5}'))
    least = ((k % 7) / F.lit(7.0)).cast("string")
    factors = F.concat(F.lit('{"method": "insight", "relation_strength": 0.9, "members_min": '), least, F.lit(', "scored": '), scored, F.lit("}"))
    return A.table(spark, sf, "orders").select("o_orderkey", F.round(EX.recompute(factors), 9).alias("confidence"))


@query("names_in_force_of_equal_rows", "SELECT o_orderstatus AS status, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'lira' ELSE 'euro' END AS name FROM orders")
def names_in_force_of_equal_rows(spark, sf):
    """Facts without a key of their own: as many rows come back as went in."""
    from orrery.operators.relational import in_force

    names = spark.createDataFrame([("it", None, "1999-01-01", "lira"), ("it", "1999-01-01", None, "euro")], "k string, first string, last string, name string")
    names = names.select("k", F.coalesce(F.to_timestamp("first"), F.lit("0001-01-01").cast("timestamp")).alias("first"), F.to_timestamp("last").alias("last"), "name")
    facts = A.table(spark, sf, "orders").select(F.lit("it").alias("k"), F.col("o_orderstatus").alias("status"), F.date_trunc("year", F.col("o_orderdate").cast("timestamp")).alias("day"))
    return in_force(facts, names, "k", "day").select("status", "name")


@query("records_by_locator", """SELECT 'row' AS locator, o_orderkey, '{"key": "' || o_orderkey || '", "status": "' || o_orderstatus || '"}' AS extracted FROM orders
    UNION ALL SELECT 'line', o_orderkey, o_orderkey || ',' || o_orderstatus || ',x' FROM orders UNION ALL SELECT 'beyond', o_orderkey, NULL FROM orders""")
def records_by_locator(spark, sf):
    """Line 2 of a CSV with its header's names, line 1 counted from 0, and a row that is not there."""
    from orrery.sources import store

    o = A.table(spark, sf, "orders")
    files = o.select(F.col("o_orderkey").alias("sha256"), F.concat(F.lit("key,status,secret\r\n"), F.concat_ws(",", "o_orderkey", "o_orderstatus", F.lit("x"))).alias("text"))
    parts = [(n, store.extract(files, loc, allowed)) for n, loc, allowed in (("row", "row:2", ["key", "status"]), ("line", "line:1", None), ("beyond", "row:3", None))]
    rows = [p.select(F.lit(n).alias("locator"), F.col("sha256").alias("o_orderkey"), "extracted") for n, p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("currency_in_force", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'lira' ELSE 'euro' END AS name FROM orders")
def currency_in_force(spark, sf):
    from orrery.operators.relational import in_force

    o = A.table(spark, sf, "orders").select("o_orderkey", F.lit("IT").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    names = spark.createDataFrame([("IT", "1861-01-01", "1999-01-01", "lira"), ("IT", "1999-01-01", None, "euro")], "k string, first string, last string, name string")
    return in_force(o, names, "k", "day").select("o_orderkey", "name")


@query("horizon_caps", "SELECT p_partkey, round(degrees(acos(6371.0088::DOUBLE / (6371.0088::DOUBLE + 300 + p_size * 40) * cos(radians(10.0::DOUBLE)))) - 10, 6) AS half_angle FROM part")
def horizon_caps(spark, sf):
    from orrery.functions.geo import horizon_degrees

    p = A.table(spark, sf, "part")
    return p.select("p_partkey", F.round(horizon_degrees(300 + F.col("p_size") * 40, 10.0), 6).alias("half_angle"))


@query("rolling_last_days", "SELECT event_type, count(*) AS n FROM events WHERE ts::DATE > (SELECT max(ts::DATE) FROM events) - 7 GROUP BY 1")
def rolling_last_days(spark, sf):
    from orrery.operators.analytics import last_days

    e = A.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    return last_days(e, "day", 7).groupBy("event_type").agg(F.count("*").alias("n"))


@query("code_categories", "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#12') THEN 'twelve' WHEN starts_with(p_brand, 'Brand#1') THEN 'ones' ELSE 'other' END AS category FROM part")
def code_categories(spark, sf):
    from orrery.operators.analytics import categories

    return categories(A.table(spark, sf, "part"), "p_brand", {"Brand#1": "ones", "Brand#12": "twelve"}).select("p_partkey", "category")


@query("published_register", "SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 10")
def published_register(spark, sf):
    from orrery.operators.analytics import register

    return register(A.table(spark, sf, "part"), F.col("p_size") > 10, ["p_brand", "p_type"])
