"""Readers, stores and streams on small payloads."""

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from orrery.sources import readers, store
from orrery.streaming import streams


def test_json_and_lines(spark, tmp_path):
    rec = {"kind": "object", "type": "t", "id": "1", "identifiers": [["s", "v"]], "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"p": "q"}}
    (tmp_path / "a.json").write_text(json.dumps({"records": [rec, rec | {"id": "2"}]}))
    (tmp_path / "b.jsonl").write_text(json.dumps(rec) + "\n")
    assert [r["id"] for r in readers.json_records(spark, str(tmp_path / "a.json")).collect()] == ["1", "2"]
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl")).first()["geometry"]["coordinates"] == [1.5, 2.5]


def test_geojson_csv_fixed_and_xml(spark, tmp_path):
    f = {"type": "Feature", "id": "x", "geometry": {"type": "Point", "coordinates": [7, 45]}, "properties": {"mag": 5.5}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f]}))
    (tmp_path / "one.json").write_text(json.dumps(f))
    for name in ("g.json", "one.json"):
        r = readers.geojson(spark, str(tmp_path / name), "mag double").first()
        assert (r["id"], r["lon"], r["mag"]) == ("x", 7.0, 5.5)
    (tmp_path / "t.tsv").write_text('a\tb\n1\t"x y"\n')
    assert readers.delimited(spark, str(tmp_path / "t.tsv"), sep="\t").first()["b"] == "x y"
    (tmp_path / "f.txt").write_text("#ST  LAT\nAB1  12.5\nCD2    MM\n")
    assert [tuple(r) for r in readers.fixed_width(spark, str(tmp_path / "f.txt"), [("st", 1, 4, "string"), ("lat", 5, 6, "double")]).collect()] == [("AB1", 12.5), ("CD2", None)]
    assert readers.columns_by_header(spark, str(tmp_path / "f.txt"), ["st", "lat"]).first()["lat"] == "12.5"
    (tmp_path / "x.xml").write_text('<all><row><a>1</a></row><row><a>2</a></row></all>')
    assert sorted(r["a"] for r in readers.xml_rows(spark, str(tmp_path / "x.xml"), "row", "a int").collect()) == [1, 2]


def test_json_stat_and_sparql(spark, tmp_path):
    cube = {"id": ["geo", "time"], "size": [2, 2], "value": {"0": 1.0, "3": 4.0}, "dimension": {"geo": {"category": {"index": {"IT": 0, "FR": 1}}}, "time": {"category": {"index": {"2020": 0, "2021": 1}}}}}
    (tmp_path / "s.json").write_text(json.dumps(cube))
    assert sorted(tuple(r) for r in readers.json_stat(spark, str(tmp_path / "s.json"), ["geo", "time"]).collect()) == [("FR", "2021", 4.0), ("IT", "2020", 1.0)]
    (tmp_path / "q.json").write_text(json.dumps({"results": {"bindings": [{"a": {"value": "1"}, "b": {"value": "2"}}]}}))
    assert tuple(readers.sparql(spark, str(tmp_path / "q.json"), ["a", "b"]).first()) == ("1", "2")


def test_zip_and_xlsx(spark, tmp_path):
    book = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>3.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    files = readers.binary_files(spark, str(tmp_path / "b.xlsx"))
    assert sorted((r["row"], r["col"], r["text"]) for r in readers.xlsx_cells(files).collect()) == [(0, 0, "name"), (1, 27, "3.5")]
    assert [r["member"] for r in readers.zip_members(files, "xl/worksheets/.*").collect()] == ["xl/worksheets/sheet1.xml"]


def test_shapes():
    outer, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    body = struct.pack("<i4dii2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in outer + hole)
    shp = b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body
    rings = readers.shp_polygons(shp)[0]
    assert [len(r) for r in rings] == [5, 5] and len(readers.polygons_with_holes(rings)) == 1
    head = struct.pack("<4xIHH20x", 2, 32 + 32 + 1, 6) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15 + b"\r"
    assert readers.dbf_records(head + b" abcde" + b"*gone ") == [{"NAME": "abcde"}, None]
    assert readers.polygons_with_holes(rings) == [[outer[::-1], hole[::-1]]]
    alone = [(9, 9), (10, 9), (10, 10), (9, 10), (9, 9)]
    assert readers.polygons_with_holes([alone, [(0, 0), (1, 1), (0, 0)], *rings]) == [[outer[::-1], hole[::-1]], [alone]]
    for code in (1002, 0x80000002, 2002, 0x40000002):
        assert readers.wkb_lines(struct.pack("<BII6d", 1, code, 2, 1, 2, 9, 3, 4, 9)) == [[(1, 2), (3, 4)]]
    assert readers.wkb_lines(struct.pack("<BIII8d", 1, 0xE0000002, 4326, 2, 1, 2, 9, 8, 3, 4, 9, 8)) == [[(1, 2), (3, 4)]]
    assert readers.wkb_lines(struct.pack("<BII", 1, 1005, 1) + struct.pack("<BII6d", 1, 1002, 2, 1, 2, 9, 3, 4, 9)) == [[(1, 2), (3, 4)]]
    line = struct.pack("<BII4d", 1, 2, 2, 1.0, 2.0, 3.0, 4.0)
    assert readers.wkb_lines(line) == [[(1.0, 2.0), (3.0, 4.0)]]
    assert readers.wkb_lines(struct.pack("<BII", 1, 5, 1) + line) == [[(1.0, 2.0), (3.0, 4.0)]]
    assert readers.simplify([(0, 0), (1, 0.001), (2, 0), (3, 5)], 0.01) == [(0, 0), (2, 0), (3, 5)]


def test_store(spark, tmp_path):
    import hashlib

    good, bad = b"payload", b"other"
    (tmp_path / hashlib.sha256(good).hexdigest()).write_bytes(good)
    (tmp_path / hashlib.sha256(b"?").hexdigest()).write_bytes(bad)
    raw = store.raw_payloads(spark, str(tmp_path))
    assert raw.count() == 2 and store.damaged(raw).count() == 1
    rows = spark.createDataFrame([("h", '{"a": [{"b": 7}]}\nsecond')], "sha256 string, text string")
    assert [store.extract(rows, f"line:{n}").first()["extracted"] for n in (1, 2)] == ["second", None]
    table = spark.createDataFrame([("h", 'a,b\n1,"x\ny"\n2,z\n')], "sha256 string, text string")
    assert [store.extract(table, f"row:{n}", ["b"]).first()["extracted"] for n in (1, 2, 3, 4)] == [None, '{"b": "x\\ny"}', '{"b": "z"}', None]
    packed = io.BytesIO()
    head = struct.pack("<4xIHH20x", 2, 32 + 32 + 1, 6) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15 + b"\r"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", '{"k": 1, "s": 2}\n{"k": 3}\n')
        z.writestr("a.dbf", head + b"*gone " + b" abcde")
    files = spark.createDataFrame([("h", packed.getvalue())], "sha256 string, content binary")
    got = [store.extract(files, x, ["k", "NAME"]).first()["extracted"] for x in ("zline:0", "zline:2", "shape:0", "shape:1")]
    assert got == ['{"k": 1}', None, None, '{"NAME": "abcde"}']
    big = spark.createDataFrame([("h", "é" * 200_000)], "sha256 string, text string")
    assert tuple(store.extract(big, "line:0").first()[1:]) == ("é" * (128 << 10), True)
    assert store.extract(spark.createDataFrame([("h", '{"a": [{"b": 7}]}')], "sha256 string, text string"), "$.a[0].b", ["a"]).first()["extracted"] == "7"
    store.write_shards(spark.range(50).select(F.col("id").cast("string").alias("k")), "k", 4, str(tmp_path / "shards"))
    assert spark.read.json(str(tmp_path / "shards")).count() == 50
    a = spark.range(10)
    assert store.logical_hash(a).first() == store.logical_hash(a.orderBy(F.desc("id"))).first()


def test_connector_and_data_source(spark, tmp_path):
    (tmp_path / "p1").write_bytes(b"1,a\n2,b\n")
    c = store.Connector("lines", "id int, name string", lambda s: ["p1"], lambda b, m: ((int(x.split(",")[0]), x.split(",")[1]) for x in b.decode().split()))
    store.register(c)
    assert sorted(tuple(r) for r in store.parse_payloads(readers.binary_files(spark, str(tmp_path / "p1")), c).collect()) == [(1, "a"), (2, "b")]
    assert c.next_state({}, ["p1"]) == {"done": ["p1"]}
    (tmp_path / "r.jsonl").write_text('{"kind": "event", "id": "9"}\n')
    spark.dataSource.register(store.RecordSource)
    assert spark.read.format("orrery_records").option("paths", str(tmp_path / "r.jsonl")).load().first()["id"] == "9"


def test_stream_keeps_the_latest_version(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 5, "q"), ("a", 2, "y")], "key string, version long, value string")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = streams.run_to_end(streams.latest_versions(s), "latest", "update", str(tmp_path / "state"))
    best = {r["key"]: r["v"] for r in seen.groupBy("key").agg(F.max("version").alias("v")).collect()}
    assert best == {"a": 3, "b": 5}


def test_stream_sessions_match_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "ev"))
    s = streams.sessions(streams.read_events(spark, str(tmp_path / "ev")), "6 hours", "40 days")
    done = streams.run_to_end(s, "sess", "complete", str(tmp_path / "st"))
    want = e.groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours"), "user_id").agg(F.count("*").alias("n"))
    assert sorted(r["n"] for r in done.collect()) == sorted(r["n"] for r in want.collect())
