"""Batches of streams, one by one: upserts, retraction of insights, bounds of candidates."""

from pyspark.sql import functions as F

from orrery.operators import rules as RU
from orrery.plans.q_insights import BOUNDED, world
from orrery.sources.shared import shared_dir
from orrery.streaming import streams as ST


def test_upsert_writes_touched_buckets_and_repeats(spark):
    path, schema = shared_dir(spark), "k long, at long, v string"
    write = ST.upsert(path, ["k"], "at", buckets=8)
    batch = lambda rows: spark.createDataFrame(rows, schema)
    assert ST.upserted(spark, path, schema).count() == 0
    write(batch([(k, 1, "a") for k in range(40)]), 0)
    write(batch([]), 1)
    write(batch([(3, 2, "b"), (3, 1, "late")]), 2)
    write(batch([(3, 2, "b"), (3, 1, "late")]), 2)
    rows = {r["k"]: r["v"] for r in ST.upserted(spark, path, schema).collect()}
    assert rows == {k: "b" if k == 3 else "a" for k in range(40)}
    assert sorted(set(ST._heads(spark, path).values())) == [0, 2]
    assert sum(v == 2 for v in ST._heads(spark, path).values()) == 1
    assert ST.upserted(spark, path, schema, below=2).where("v = 'b'").count() == 0


def test_insights_are_retired(spark):
    path = shared_dir(spark)
    anchors = lambda *a: spark.createDataFrame([(x,) for x in a], "anchor string")
    state = {"x": [("x1", "x", 0.5)], "y": [("y1", "y", 0.4)], "z": [("z1", "z", 0.9)]}

    def solve(asked):
        rows = [r for v in state.values() for r in v]
        return spark.createDataFrame(rows, "id string, anchor string, value double").join(asked, "anchor", "left_semi")

    write = ST.retracting(path, solve)
    write(anchors("x", "y", "z", None), 0)
    state |= {"x": [("x2", "x", 0.7), ("x3", "x", 0.2)], "y": []}
    write(anchors("x", "y"), 1)
    write(anchors("x", "y"), 1)
    told = {r["id"]: (r["status"], r["by_id"]) for r in ST.upserted(spark, path, ST.INSIGHTS).collect()}
    assert told == {"x1": ("superseded", "x2"), "x2": ("active", None), "x3": ("active", None), "y1": ("stale", None), "z1": ("active", None)}
    state["x"] = [("x1", "x", 0.8)]
    write(anchors("x"), 2)
    told = {r["id"]: r["status"] for r in ST.upserted(spark, path, ST.INSIGHTS).where("anchor = 'x'").collect()}
    assert told == {"x1": "active", "x2": "superseded", "x3": "superseded"}


def test_candidates_are_bounded_from_the_anchor_only(spark):
    sf = "/root/testdata/sf0.01"
    w, rule = world(spark, sf), RU.load(BOUNDED)
    kept = RU.Compiler(rule, w).bindings().groupBy("N_id").count()
    free = RU.Compiler(RU.load(BOUNDED.replace("max_candidates = 3\n", "")), w).bindings().groupBy("N_id").count()
    want = {r["N_id"]: min(3, r["count"]) for r in free.collect()}
    assert {r["N_id"]: r["count"] for r in kept.collect()} == want
    assert max(r["count"] for r in free.collect()) > 3
    changed = w.objects.where(F.col("type") == "org.supplier").select("id")
    assert RU.affected_anchors(rule, w, changed).count() == len(want)
