"""Operators against brute force and against declared expectations."""

import collections
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import cube, graph, rules, scope, search, spatial, temporal, world
from orrery.plans import adapter


def km(a, b):
    p1, p2, dl = math.radians(a[1]), math.radians(b[1]), math.radians(b[0] - a[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [50, 900, 9000])
def test_distance_join_is_brute_force(spark, radius):
    rng = random.Random(radius)
    pts = [[(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(150)] for _ in range(2)]
    pts[0] += [(900, 180.0, 89.9), (901, -180.0, 0.0), (902, 0.0, -90.0)]
    pts[1] += [(900, -10.0, 89.95), (901, 179.9, 0.1), (902, 77.0, -89.9)]
    a, b = (spark.createDataFrame(p, f"{s}_id int, {s}_lon double, {s}_lat double") for p, s in zip(pts, "ab", strict=True))
    got = {(r["a_id"], r["b_id"]) for r in spatial.distance_join(a, b, radius).collect()}
    assert got == {(x[0], y[0]) for x, y in itertools.product(*pts) if km(x[1:], y[1:]) <= radius}


@pytest.mark.parametrize("radius", [120, 2000, 21000])
def test_nearest_is_brute_force(spark, radius):
    """Near the poles, where many places meet, and with ties that the id decides; no pairs are made to count them."""
    rng = random.Random(radius)
    pts = [[(i, rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(60, 90)) for i in range(120)] for _ in range(2)]
    pts[1] += [(900 + i, *p[1:]) for i, p in enumerate(pts[1][:20])]
    a, b = (spark.createDataFrame([*p, (-1, None, None)], f"{s}_id int, {s}_lon double, {s}_lat double") for p, s in zip(pts, "ab", strict=True))
    near = spatial.nearest(a, b, radius, "a_id", "b_id", 3)
    assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()
    got = {(r["a_id"], r["rank"]): (r["b_id"], r["total"]) for r in near.collect()}
    want = {}
    for x in pts[0]:
        first = sorted((d, y[0]) for y in pts[1] if (d := km(x[1:], y[1:])) <= radius)
        want |= {(x[0], i + 1): (y, len(first)) for i, (_, y) in enumerate(first[:3])}
    assert got == want


def test_steps_have_cells_of_their_own(spark):
    rng = random.Random(7)
    a, b = ([(i, rng.uniform(-180, 180), rng.uniform(-90, 90), rng.random()) for i in range(200)] for _ in range(2))
    x, y = spark.createDataFrame(a, "a_id int, a_lon double, a_lat double, v double"), spark.createDataFrame([p[:3] for p in b], "b_id int, b_lon double, b_lat double")
    got = {(r["a_id"], r["b_id"]) for r in spatial.step_join(x, y, F.col("v"), [(0.2, 500), (0.5, 1500), (0.8, 5000)]).collect()}
    radius = lambda v: 5000 if v >= 0.8 else 1500 if v >= 0.5 else 500 if v >= 0.2 else -1
    assert got == {(p[0], q[0]) for p, q in itertools.product(a, b) if km(p[1:3], q[1:3]) <= radius(p[3])}


def test_point_in_polygon_with_hole_and_nearest(spark):
    ring = lambda c: [{"lon": float(x), "lat": float(y)} for x, y in c]
    areas = spark.createDataFrame([("a", [ring([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), ring([(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)])])], "area_id string, rings array<array<struct<lon:double,lat:double>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 10.5, 5.0), (4, 30.0, 5.0), (5, None, None)], "id int, lon double, lat double")
    edges = spatial.ring_edges(areas)
    assert {r["id"] for r in spatial.contained(points, edges, "id").collect()} == {1}
    got = {r["id"]: r["method"] for r in spatial.enrich(points, edges, "id", 120).collect()}
    assert got == {1: "contained", 2: "nearest", 3: "nearest"}


@pytest.mark.parametrize("low, high", [(0, 10), (-7, 3), (5, 5), (-100, 100)])
def test_interval_join_is_brute_force(spark, low, high):
    rng = random.Random(high)
    ts = [[(i, rng.randint(-50, 50)) for i in range(40)] for _ in range(2)]
    a, b = (spark.createDataFrame(t, f"{s} int, {s}_t long") for t, s in zip(ts, "ab", strict=True))
    got = sorted((r["a"], r["b"]) for r in temporal.interval_join(a, b, low, high).collect())
    assert got == sorted((x[0], y[0]) for x, y in itertools.product(*ts) if low <= y[1] - x[1] <= high)


def test_scope_and_budget():
    with pytest.raises(ValueError):
        scope.Scope.of({"mode": "elsewhere"})
    for bad in ({"max_items": 0}, {"max_items": True}, {"max_items": 1.5}, {"lod": "all"}):
        with pytest.raises(ValueError):
            scope.Budget.of(bad)
    assert scope.Budget.of({"max_items": 10**9}).max_items == scope.MAX_ITEMS


def test_cube_adds_up(spark):
    rows = spark.createDataFrame([("object", "t", "s", 0.9, 200, 100, None), ("event", "e", "s", None, None, None, 1709210096789), ("event", "e", "s", 0.6, 0, 0, 1709210096789)], "kind string, type string, source string, confidence double, cx int, cy int, t_ms long")
    c = cube.build(rows)
    assert c.where("level = -1 AND period = 0").agg(F.sum("n")).first()[0] == 3
    assert c.where("level = 4 AND kind = 'object'").select("cx", "cy", "band").first() == (12, 6, 2)
    assert c.where("kind = 'event' AND geo = 0").count() == 3
    assert {r["period"] for r in c.where("kind = 'event'").collect()} == {0, 202400, 202402}
    again = cube.apply_delta(cube.build(rows.limit(0)), rows, rows.limit(0))
    assert sorted(again.drop("maxconf").collect()) == sorted(c.drop("maxconf").collect())


def test_components_paths_and_costs(spark):
    rng = random.Random(3)
    e = [(f"n{rng.randint(0, 60):02}", f"n{rng.randint(0, 60):02}", float(rng.randint(1, 9))) for _ in range(50)]
    df = spark.createDataFrame(e, "src string, dst string, w double")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in e:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["label"] for r in graph.components(df).collect()}
    assert got == {n: find(n) for n in list(parent)}
    start = e[0][0]
    cost, todo = {start: 0.0}, [start]
    while todo:
        n = todo.pop()
        for a, b, w in e:
            for x, y in ((a, b), (b, a)):
                if x == n and cost[n] + w < cost.get(y, math.inf):
                    cost[y] = cost[n] + w
                    todo.append(y)
    assert {r["node"]: r["cost"] for r in graph.cheapest(df, start, 100).collect()} == cost
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "x")], "src string, dst string")
    assert [r["node"] for r in graph.shortest_path(chain, "a", "e").orderBy("step").collect()] == list("abcde")
    assert graph.shortest_path(chain, "x", "e").count() == 0


def test_frequent_words_only_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "common" + (" rare" if i % 9 == 0 else ""), "", "", "") for i in range(40)], "id int, label string, aliases string, identifiers string, text string")
    index = search.Index.of(docs, "id", list(search.WEIGHTS))
    monkeypatch.setattr(search, "FREQUENT", 10)
    both, alone, every = (search.search(index, q, 50).collect() for q in ("common rare", "rare", "common"))
    assert [r["id"] for r in both] == [r["id"] for r in alone] == [0, 9, 18, 27, 36] and [r["score"] for r in both] == [r["score"] for r in alone]
    assert len(every) == 40 and {r["score"] for r in every} == {0.0}


def test_frequent_words_rank_where_all_shall(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "common " * (1 + i % 3) + ("rare" if i % 9 == 0 else ""), "", "", "") for i in range(40)], "id int, label string, aliases string, identifiers string, text string")
    index = search.Index.of(docs, "id", list(search.WEIGHTS))
    want = [tuple(r) for r in search.search(index, "common rare", 50, rank_all=True).collect()]
    monkeypatch.setattr(search, "FREQUENT", 3)
    assert [tuple(r) for r in search.search(index, "common rare", 50, rank_all=True).collect()] == want
    assert want != [tuple(r) for r in search.search(index, "common rare", 50).collect()]


def test_search_query_is_its_twin_beyond_the_frequent(spark, monkeypatch):
    """The words of the query are more frequent than the limit, as they are in large tables."""
    import duckdb

    from orrery.plans.queries import ORACLES, QUERIES

    sf, duck = "/root/testdata/sf0.01", duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{sf}/part.parquet')")
    monkeypatch.setattr(search, "FREQUENT", 20)
    got = [tuple(r) for r in QUERIES["search_prefix_bm25"](spark, sf).collect()]
    assert got == [tuple(r) for r in duck.sql(ORACLES["search_prefix_bm25"]).fetchall()] and len(got) == 30


def test_a_value_of_many_entities_makes_no_pairs(spark):
    """20,000 mentions and 20,000 entities of one value: the pairs of them would be 400 million rows."""
    from orrery.operators import relational

    m = spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("mention_id"), F.lit("code").alias("scheme"), F.lit("x").alias("value"))
    e = spark.range(20_000).select(F.lit("code").alias("scheme"), F.lit("x").alias("value"), F.concat(F.lit("e"), F.col("id") + 10_000).alias("entity_id"))
    out = relational.resolve_strong(m, e, ["code"])
    assert out.groupBy("entity_id").count().collect() == [("e10000", 20_000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")  # the entities are merged below the join


def test_large_frontiers_are_joined(spark, monkeypatch):
    rng = random.Random(1)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", "relation", "t", f"{a}-{b}") for a, b in pairs], "src string, dst string, kind string, type string, ref string")
    start = spark.createDataFrame([("n01",)], "node string")
    run = lambda: (sorted(graph.reach(edges, start, 4).collect()), sorted(map(tuple, graph.neighbourhood(edges, "n01", 3, 4).collect())), sorted(graph.reach(edges, start, 3, True).collect()))
    pushed = run()
    monkeypatch.setattr(graph, "PUSHED", 1)
    assert run() == pushed
    limited = graph.neighbourhood(edges, "n01", 3, 4, max_nodes=6).collect()
    assert len({r["other"] for r in limited} | {"n01"}) <= 6
    kept = spark.createDataFrame([(f"n{i:02}",) for i in range(0, 60, 2)], "node string")
    assert all(int(r["other"][1:]) % 2 == 0 or r["other"] == "n01" for r in graph.neighbourhood(edges, "n01", 2, 9, kept).collect())
    assert graph.by_node(edges).count() == len(pairs)


def test_search_ranks_labels_first(spark):
    docs = spark.createDataFrame([(1, "Élan vital", "", "", "nothing"), (2, "other", "", "", "an elan of sorts"), (3, "third", "", "", "more words here")], "id int, label string, aliases string, identifiers string, text string")
    index = search.Index.of(docs, "id", list(search.WEIGHTS))
    assert [r["id"] for r in search.search(index, "élan", 5).collect()] == []  # the query is matched as it stands
    assert [r["id"] for r in search.search(index, "ELAN", 5).collect()] == [1, 2]
    assert search.plan_prefixes({"a": 30000, "b": 5}) == (["b"], ["a"])


def test_claims_and_versions(spark):
    f = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", 3, None), ("k", 4, None), ("k", 5, "x")], "key string, at int, v string")
    got = [(r["at"], r["v"], r["valid_to"]) for r in temporal.claims(f, ["key"], "v", "at", "at").orderBy("at").collect()]
    assert got == [(1, "x", 3), (3, None, 5), (5, "x", None)]
    v = spark.createDataFrame([("e", 1, "9", 1), ("e", 1, "10", 2), ("e", 0, "99", 3)], "e string, at int, version string, id int")
    assert world.latest_version(v, ["e"], "at", "version", "id").first()["version"] == "10"


def test_validation_rejects_what_is_not_declared(spark):
    df = spark.createDataFrame([("r1", {"n": "5", "f": "1.5"}), ("r2", {"n": "x"}), ("r3", {"other": "1"})], "record_id string, props map<string,string>")
    good, bad = world.validate(df, {"n": "int", "f": "float"})
    assert [tuple(r) for r in good.collect()] == [("r1", 5, 1.5)]
    assert {(r["record_id"], r["reason"]) for r in bad.collect()} == {("r2", "not int"), ("r3", "undeclared")}


RULE = """
[rule]
id = "r"
output = "association"
anchor = "B"
unique = true
explain = "{0}"
[rule.group]
var = "A"
link = [ {{ op = "within_time", max = "72h" }}, {{ op = "within_distance", km = 150 }} ]
representative = [["severity", "desc"], ["score", "desc"]]
[[rule.var]]
name = "B"
kind = "event"
types = ["trigger"]
[[rule.var]]
name = "A"
kind = "event"
types = ["signal"]
[[rule.constraint]]
op = "within_time"
a = "A"
b = "B"
min = "-1h"
max = "7d"
score = true
[[rule.constraint]]
op = "within_distance"
a = "A"
b = "B"
km = 300
score = true
"""


def _world(spark, events):
    e = spark.createDataFrame(events, "id string, type string, lon double, lat double, t long, severity double")
    e = e.withColumns({"label": F.col("id"), "confidence": F.lit(0.95), "source": F.lit("s"), "status": F.lit("current")})
    none = spark.createDataFrame([], "event_id string, object_id string, role string")
    rel = spark.createDataFrame([], "relation_id string, type string, from_id string, to_id string, groups long, confidence double")
    return rules.World(e.limit(0), e, none, rel)


def test_grouped_candidates(spark):
    """The severest member stands for the group that has the best supported one; a severer one elsewhere does not."""
    day = 86_400_000
    w = _world(spark, [("t", "trigger", 10.0, 45.0, 10 * day, None), ("a1", "signal", 10.6, 45.3, 9 * day, 0.9), ("a2", "signal", 10.1, 45.1, 10 * day - 3_600_000, 0.4), ("z", "signal", 13.4, 45.0, 4 * day, 1.0), ("far", "signal", 40.0, 10.0, 9 * day, 1.0)])
    rule = rules.load(RULE.format("Un segnale vicino."))
    got = rules.grouped(rule, rules.Compiler(rule, w).bindings(), w).collect()
    assert [(r["anchor"], r["representative"], r["support_member"], r["members"], r["n_discarded"]) for r in got] == [("t", "a1", "a2", "a1,a2", 1)]


def test_linked_groups_are_brute_force():
    rng = np.random.default_rng(3)
    for span, far in ((5, 800.0), (None, 300.0), (3, None), (50, 20_000.0)):
        n = 120
        t, lon, lat = rng.integers(0, 100, n).astype(float), rng.uniform(-180, 180, n) / 3, rng.uniform(-90, 90, n)
        lon[:3], t[3:5], lon[10], lat[10] = np.nan, np.nan, lon[11], lat[11]
        got, want = rules.link_labels(t, lon, lat, span, far), list(range(n))
        for i, j in itertools.combinations(range(n), 2):
            if (span is None or abs(t[i] - t[j]) <= span) and (far is None or km((lon[i], lat[i]), (lon[j], lat[j])) <= far):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_bindings_of_an_anchor_are_not_dealt_anew(spark):
    """What follows by anchor shuffles no bindings, which are many times the events."""
    from orrery.operators import insights
    from orrery.plans import q_rules

    w = q_rules.world(spark, "/root/testdata/sf0.01")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for text, step in ((q_rules.ASSOCIATION, lambda r, b: insights.explained(r, b)), (q_rules.GROUPED, lambda r, b: rules.grouped(r, b, w))):
            rule = rules.load(text)
            df = step(rule, rules.Compiler(rule, w).bindings())
            assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2  # the two sides of the join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_of_two_variables_without_rows_of_pairs(spark):
    """Explained bindings, groups and members as by the joins, also of rows without a place, time or confidence, of equal scores and of an id that comes twice."""
    import random

    from orrery.operators import insights, pairs
    from orrery.plans import q_rules

    rng = random.Random(5)
    maybe = lambda x: None if rng.random() < 0.08 else x
    kinds = "id string, type string, label string, lon double, lat double, t long, confidence double, severity double, source string, status string"
    rows = [(f"event:{i if i % 40 else i - 1}", rng.choice(["click", "purchase"]) if i % 40 > 1 else "click", "x", maybe(rng.choice([0.0, 30.0, 170.0, -175.0]) + rng.random()), maybe(rng.choice([80.0, -20.0])), maybe(rng.randrange(0, 400) * 600_000), maybe(rng.choice([0.5, 0.75, 1.0])), maybe(rng.choice([0.1, 0.9])), "s", rng.choice(["current", "current", "retracted"])) for i in range(1, 700)]
    rows += [("event:a", "click", "x", 0.0, 0.0, 0, 1.0, 0.5, "s", "current"), ("event:b", "click", "x", 0.0, 0.0, 0, 1.0, 0.5, "s", "current"), ("event:z", "purchase", "x", 0.0, 0.0, 43_200_000, 1.0, 0.5, "s", "current")]
    events = spark.createDataFrame(rows, kinds)
    w = rules.World(events, events, None, None)
    table = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    base = q_rules.GROUPED
    after = base.replace('a = "A"\nb = "B"\nmin', 'a = "B"\nb = "A"\nmin')
    for text in (base, base.replace("unique = true", "unique = false"), base.replace("max_member", "representative"), after, base.replace("emit_threshold = 0.3", "emit_threshold = 0.0")):
        rule = rules.load(text)
        assert pairs.fits(rule)
        bindings = rules.Compiler(rule, w).bindings()
        groups = rules.grouped(rule, bindings, w)
        assert (found := table(pairs.solved(rule, w, "grouped"))) == table(groups) and found
        assert table(pairs.solved(rule, w, "members")) == table(insights.group_members(rule, groups))
        got = insights.with_reasons(rule, pairs.solved(rule, w, "explained"))
        assert table(got) == table(insights.explained(rule, bindings))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    assert not pairs.fits(rules.load(q_rules.CONTEXT))


@pytest.mark.parametrize("change", [("output = \"association\"", "output = \"cause\""), ("anchor = \"B\"", "anchor = \"Q\""), ("b = \"B\"", "b = \"Q\""), ("{0}", "il segnale ha causato altro"), ("\"severity\"", "\"beauty\"")])
def test_rules_that_cannot_be(change):
    with pytest.raises(rules.RuleError):
        rules.load(RULE.replace(*change).replace("{{", "{").replace("}}", "}").replace("{0}", "ok"))


def test_rule_order():
    make = lambda i, needs: rules.Rule(i, "1", "association", "A", [{"name": "A", "kind": "insight", "types": needs}], [])
    assert [r.id for r in rules.dependency_order([make("c", ["b"]), make("b", ["a"]), make("a", [])])] == ["a", "b", "c"]
    with pytest.raises(rules.RuleError):
        rules.dependency_order([make("a", ["b"]), make("b", ["a"])])


def test_adapter_has_no_lost_rows(spark):
    sf = "/root/testdata/sf0.001"
    assert adapter.events(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert adapter.objects(spark, sf).where("lon IS NULL").select("type").distinct().count() == 2


def test_timeline_of_partial_years_places_and_sources(spark):
    day = 86_400_000
    rows = [("event", "e", "s" + str(i % 2), 0.9, 100 + i % 3, 100, 1640995200000 + i * 9 * day) for i in range(130)]  # 2022-01-01 on
    df = spark.createDataFrame(rows, "kind string, type string, source string, confidence double, cx int, cy int, t_ms long")
    table = cube.build(df)
    window = (1646092800000, 1709251200000)  # 2022-03-01 .. 2024-03-01
    scoped = scope.Scope.of({"time_window": list(window), "sources": ["s1"]})
    code = lambda t: int(time.strftime("%Y%m", time.gmtime(t / 1000)))
    want = [r for r in rows if r[2] == "s1" and 202203 <= code(r[-1]) <= 202403]
    got = {r["period"]: r["n"] for r in cube.timeline(table, scoped, "year").collect()}
    assert got == {y * 100: sum(code(r[-1]) // 100 == y for r in want) for y in (2022, 2023, 2024)}
    months = {r["period"]: r["n"] for r in cube.timeline(table, scoped, "month").collect()}
    assert months == collections.Counter(code(r[-1]) for r in want)
    assert (cube.bucket_of(window), cube.bucket_of(window, "hour"), cube.bucket_of(window, "year"), cube.bucket_of((0, day))) == ("month", "month", "year", "hour")


def test_incremental_runs_give_what_a_full_run_gives(spark):
    """Only the anchors that changed entities may touch are computed again."""
    from orrery.plans import q_rules

    rule = rules.load(q_rules.ASSOCIATION)
    before = q_rules.world(spark, "/root/testdata/sf0.01")
    moved = F.col("id").substr(7, 20).cast("long") % 53 == 5
    after = rules.World(before.objects, before.events.withColumn("confidence", F.when(moved, 1 - F.col("confidence")).otherwise(F.col("confidence"))), before.participations, before.relations)
    changed = before.events.where(moved).select("id")
    run = lambda w, only=None: {(r["B_id"], r["A_id"], round(r["score"], 12)) for r in rules.associations(rule, rules.Compiler(rule, w).bindings(only)).collect()}
    old, full = run(before), run(after)
    again = rules.affected_anchors(rule, after, changed).unionByName(rules.affected_anchors(rule, before, changed)).distinct()
    touched = {r["id"] for r in again.collect()}
    assert old != full and {x for x in old if x[0] not in touched} | run(after, again) == full
    assert len(touched) < before.events.where("type = 'purchase'").count()
