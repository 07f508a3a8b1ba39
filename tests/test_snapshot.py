"""Row sets in parts, packed polygons, labels, networks of lines, and channels of queries."""

import json
import random
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from orrery.plans.channels import Cancelled, Channel
from orrery.sources import feeds
from orrery.sources import snapshot as S


def test_polygons_round_trip(spark):
    r = random.Random(5)
    point = lambda: {"lon": r.randint(-18000, 18000) / 100, "lat": r.randint(-9000, 9000) / 100}
    for shape in [[], [[]], [[[]]], [[[point()], []], [[point() for _ in range(300)]]], [[[point() for _ in range(r.randint(0, 9))] for _ in range(r.randint(0, 3))] for _ in range(20)]]:
        assert S.unpack_polygons(S.pack_polygons(shape)) == shape
    with pytest.raises(ValueError, match="grid"):
        S.pack_polygons([[[{"lon": 0.123, "lat": 0.0}]]])
    rows = spark.createDataFrame([(1, [[[(1.25, -2.5)], [(0.0, 0.0), (0.01, 90.0)]]]), (2, None)], "k int, p array<array<array<struct<lon:double,lat:double>>>>")
    back = rows.select("k", "p", S.unpacked(S.packed("p")).alias("q")).collect()
    assert all(x["p"] == x["q"] for x in back)


def test_steps_are_small():
    line = [{"lon": x / 100, "lat": x / 100} for x in range(1000)]
    assert len(S.pack_polygons([[line]])) == 2004


def test_labels_are_ordered_and_need_a_place(spark):
    rows = [("B", 1.23456, 2.0, None, None), ("A", 1.0, 2.0, 3.0, 9), ("C", 0.0, 0.0, 1.5, 2), ("D", None, 1.0, 1.0, 1), ("", 1.0, 1.0, 1.0, 1), (None, 1.0, 1.0, 1.0, 1), ("E", 1.0, 1.0, 0.0, 0)]
    got = S.labels(spark.createDataFrame(rows, "name string, lon double, lat double, min_zoom double, rank int")).collect()
    assert [(g["name"], g["rank"], g["min_zoom"]) for g in got] == [("C", 2, 1.5), ("A", 9, 3.0), ("B", 9, 0.0), ("E", 9, 0.0)]
    assert got[2]["lon"] == 1.2346


def test_sea_routes(spark):
    two = struct.pack("<BII", 1, 5, 2) + struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 0) + struct.pack("<BII2d", 1, 2, 1, 5, 5)
    rows = feeds.sea_routes(spark.createDataFrame([("a", two), ("b", None)], "route string, wkb binary")).collect()
    assert [(r["id"], r["lon"], r["lat"]) for r in rows] == [("searoute:a:0", 0.0, 0.0)]
    assert abs(json.loads(rows[0]["props"])["km"] - 111.195) < 0.01


def test_mapped_ways_are_simplified(spark, tmp_path):
    line = [{"lat": 0.0, "lon": i / 100} for i in range(101)] + [{"lat": 1.0, "lon": 1.0}]
    answer = {"elements": [{"type": "way", "id": 7, "tags": {"name": "Cable"}, "geometry": line}, {"type": "node", "id": 8, "lat": 3.0, "lon": 4.0}, {"type": "way", "id": 9}]}
    (tmp_path / "a.json").write_text(json.dumps(answer))
    rows = {r["id"]: r for r in feeds.mapped_ways(spark, str(tmp_path / "a.json"), "infra.cable").collect()}
    assert set(rows) == {"way:7", "node:8"}
    assert rows["way:7"]["label"] == "Cable" and rows["node:8"]["label"] == "node 8" and (rows["node:8"]["lon"], rows["node:8"]["lat"]) == (4.0, 3.0)
    assert json.loads(rows["way:7"]["props"])["points"] == [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}]


def slow(spark):
    # Work that would last for minutes if nobody ended it.
    return lambda: spark.range(0, 10**12, 1, 4).select(F.sum(F.sqrt("id"))).collect()


def test_channel_ends_at_the_deadline_and_for_newer_queries(spark):
    c = Channel(spark)
    assert c.run(1, lambda: spark.range(5).count(), 60) == 5
    begun = time.time()
    with pytest.raises(Cancelled):
        c.run(2, slow(spark), 2)
    told = []

    def old():
        try:
            c.run(3, slow(spark))
        except Cancelled as e:
            told.append(e)

    t = threading.Thread(target=old)
    t.start()
    time.sleep(2)
    assert c.run(4, lambda: spark.range(7).count()) == 7
    t.join(60)
    assert len(told) == 1 and time.time() - begun < 60
    with pytest.raises(Cancelled):
        c.run(4, lambda: 1)
    with pytest.raises(ZeroDivisionError):
        c.run(5, lambda: 1 // 0)
