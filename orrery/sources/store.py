"""Raw payload store, connectors, locators and sinks."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.functions.ids import shard_of

LOCATOR_BYTES = 256 << 10


def raw_payloads(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, length, content: payloads named by what they hold."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", "content")


def damaged(payloads: DataFrame) -> DataFrame:
    """Payloads whose file name is not the hash of their content."""
    name = F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1)
    return payloads.where(name != F.col("sha256")).select("path", "sha256")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The append-only list of fetched payloads."""
    return spark.read.schema("raw_id string, source_id string, resource string, sha256 string, fetched_ms long, status int").json(path)


def unprocessed(listed: DataFrame, done: DataFrame) -> DataFrame:
    """Payloads that no run has taken yet, in the order in which they are taken."""
    return listed.join(done.select("raw_id"), "raw_id", "left_anti").orderBy("source_id", "fetched_ms", "sha256")


def published(payloads: DataFrame, usable: Column) -> DataFrame:
    """The newest usable payload of each resource."""
    w = Window.partitionBy("resource").orderBy(F.desc("fetched_ms"), "sha256")
    return payloads.where(usable).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def extract(payloads: DataFrame, locator: str, allowed: list[str] | None = None) -> DataFrame:
    """sha256, extracted, truncated: the record that a locator names in payloads, as text; null where it names none.

    '$.a[0].b' is a JSON path and 'line:n' a line, from 0, of column text; 'row:n' is the row of a CSV
    text that ends on line n of the file, whose header is line 1, as a JSON object; 'zline:n' is a line
    of the first member of a ZIP, 'shape:n' the attributes of a shapefile's record
    n, from 0, in a ZIP: these two read column content. allowed restricts the fields of
    objects, and the first name of a path. Records are cut to 256 KiB.
    """
    kind, _, rest = locator.partition(":")
    if locator.startswith("$"):
        first = locator[2:].split(".")[0].split("[")[0]
        if allowed is not None and first and first not in allowed:
            raise ValueError(f"field {first!r} may not be read")
        value = F.get_json_object("text", locator)
    elif kind == "line" and rest.isdigit():
        value = F.get(F.split("text", r"\r\n|\n|\r"), F.lit(int(rest)))
    elif kind in ("row", "zline", "shape") and rest.isdigit():
        read, n = {"row": _csv_record, "zline": _zip_line, "shape": _shape_record}[kind], int(rest)
        value = F.pandas_udf(lambda s: s.map(lambda x: read(x, n), na_action="ignore"), "string")(F.col("text" if kind == "row" else "content"))
    else:
        raise ValueError(f"unknown locator: {locator!r}")
    if allowed is not None and (kind in ("row", "shape", "line", "zline") or locator == "$"):
        value = _only(value, allowed)
    long = F.octet_length(value) > LOCATOR_BYTES
    short = F.regexp_replace(F.make_valid_utf8(F.substring(value.cast("binary"), 1, LOCATOR_BYTES).cast("string")), "\ufffd$", "")
    return payloads.select("sha256", F.when(long, short).otherwise(value).alias("extracted"), F.coalesce(long, F.lit(False)).alias("truncated"))


def _csv_record(text: str, n: int) -> str | None:
    rows = list(csv.reader(io.StringIO(text)))
    return json.dumps(dict(zip(rows[0], rows[n - 1], strict=False)), ensure_ascii=False) if 2 <= n <= len(rows) else None


def _zip_line(content: bytes, n: int) -> str | None:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        lines = z.read(z.namelist()[0]).decode("utf-8").splitlines()
    return lines[n] if n < len(lines) else None


def _shape_record(content: bytes, n: int) -> str | None:
    from orrery.sources.readers import dbf_records

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        table = next((m for m in z.namelist() if m.lower().endswith(".dbf")), None)
        rows = dbf_records(z.read(table)) if table else []
    return json.dumps(rows[n], ensure_ascii=False) if n < len(rows) and rows[n] is not None else None


def _only(value: Column, allowed: list[str]) -> Column:
    """Of JSON objects the allowed fields; other texts as they are."""

    def keep(text: str) -> str:
        try:
            record = json.loads(text)
        except ValueError:
            return text
        return json.dumps({k: v for k, v in record.items() if k in allowed}, ensure_ascii=False) if isinstance(record, dict) else text

    return F.pandas_udf(lambda s: s.map(keep, na_action="ignore"), "string")(value)


def write_shards(rows: DataFrame, key: str, shards: int, path: str) -> None:
    """Rows dealt to shards by the FNV-1a hash of their key, one folder each."""
    rows.withColumn("shard", shard_of(F.col(key), shards)).repartition("shard").write.partitionBy("shard").mode("overwrite").json(path, compression="gzip")


def shard_manifest(rows: DataFrame, key: str, value: str, shards: int) -> DataFrame:
    """shard, n, bytes, digest: what each shard holds. The digest doesn't depend on the order of rows."""
    h = F.xxhash64(key, value)
    return rows.withColumn("shard", shard_of(F.col(key), shards)).groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.octet_length(value)).cast("long").alias("bytes"), F.bit_xor(h).alias("digest"))


def tile_shift(rows: DataFrame, small: int = 20_000) -> DataFrame:
    """type, shift: types with few located rows are cut at level 2, the others at level 5."""
    per = rows.where("cx IS NOT NULL").groupBy("type").agg(F.count("*").alias("n"))
    return per.select("type", F.when(F.col("n") <= small, 6).otherwise(3).alias("shift"))


def object_tiles(rows: DataFrame, small: int = 20_000) -> DataFrame:
    """type, x, y, n: the tiles of located objects."""
    sized = rows.where("cx IS NOT NULL").join(tile_shift(rows, small), "type")
    return sized.groupBy("type", F.expr("shiftright(cx, shift)").alias("x"), F.expr("shiftright(cy, shift)").alias("y")).agg(F.count("*").alias("n"))


def logical_hash(df: DataFrame) -> DataFrame:
    """n, a, b: a digest of a table that doesn't depend on the order of its rows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64(h, F.lit(7))).alias("b"))


def to_geojson(rows: DataFrame) -> DataFrame:
    """feature: each row with lon and lat as a GeoJSON feature."""
    props = [c for c in rows.columns if c not in ("lon", "lat")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))).alias("feature"))


# ---- connectors ----


@dataclass
class Connector:
    """A source: which resources to fetch next, and how a payload becomes records."""

    name: str
    schema: str
    plan: Callable[[dict], list[str]]
    parse: Callable[[bytes, dict], Iterator[tuple]]
    next_state: Callable[[dict, list[str]], dict] = lambda state, done: state | {"done": sorted({*state.get("done", []), *done})}


CONNECTORS: dict[str, Connector] = {}


def register(connector: Connector) -> None:
    CONNECTORS[connector.name] = connector


def parse_payloads(payloads: DataFrame, connector: Connector) -> DataFrame:
    """Records of raw payloads (path, content), parsed where the payloads are."""
    parse = connector.parse

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(parse(content, {"path": path}))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [f.name for f in payloads.sparkSession.createDataFrame([], connector.schema).schema.fields]
    return payloads.select("path", "content").mapInPandas(run, connector.schema)


class _Files(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class RecordSource(DataSource):
    """spark.read.format("orrery_records"): JSON-lines records, one partition for each named file."""

    @classmethod
    def name(cls) -> str:
        return "orrery_records"

    def schema(self) -> str:
        return "kind string, type string, id string, version string, label string"

    def reader(self, schema):
        return _RecordReader(self.options)


class _RecordReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self):
        return [_Files(p) for p in self.paths] or [_Files("")]

    def read(self, partition):
        import json

        if partition.path:
            with open(partition.path, encoding="utf-8") as f:
                for line in f:
                    if line.strip():
                        r = json.loads(line)
                        yield tuple(r.get(k) for k in ("kind", "type", "id", "version", "label"))
