"""Sharding by histogram sort, with DataFrame operations alone.

Rows are ordered by (key, id), where the key is a hash of the text, so that equal
texts are neighbours. The byte counts below candidate boundaries are exact: each
round counts the bytes in equal cells of the brackets that still hold a splitter,
and keeps the one cell of each in which the splitter lies. The counting rounds
read a narrow table of key, id and size, which is written once; only cells that
hold a splitter are counted again. When the splitters are known the rows are dealt
out once.

What reaches the driver in a round is bounded by 2^FIRST_BITS cells, or by
2^NEXT_BITS cells for each splitter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import free_name, materialise, release, table, text_bytes

KEY_BITS, FIRST_BITS, NEXT_BITS = 60, 12, 8
#: Each row counts its text and so many bytes for the frame around it.
FRAME_BYTES = 16
#: Parts of a shard in which slots are numbered at the same time.
PARTS = 64


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


def id_number(docs: DataFrame, id_col: str) -> Column:
    """A whole number below 2^62 for each id: whole numbers below 2^61 are their own, others get a hash; null is the least."""
    ident = F.col(id_col)
    hashed = F.shiftright(F.xxhash64(ident), 3)
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        hashed = F.when(ident.between(-(2**61), 2**61), ident.cast("long")).otherwise(hashed)
    return F.when(ident.isNull(), F.lit(-(2**62))).otherwise(hashed)


def _literal_case(points: list, holds, lo: int = 0) -> Column:
    """Number of points at or below the row, as a balanced tree of comparisons."""
    if not points:
        return F.lit(lo)
    m = len(points) // 2
    return F.when(holds(points[m]), _literal_case(points[m + 1 :], holds, lo + m + 1)).otherwise(_literal_case(points[:m], holds, lo))


def _refine(narrow: DataFrame, column: str, brackets: list[dict]) -> list[dict]:
    """Shrinks each bracket to the one value of column in which its target lies.

    A bracket has lo, hi (values lo <= v < hi), below (bytes before lo), target and
    the equality conditions where. Result: value, below (bytes before value), size
    (bytes at value). A target lies at the value where below <= target < below + size.
    """
    spark, done = narrow.sparkSession, {}
    live = {i: dict(b) for i, b in enumerate(brackets)}
    while live:
        rows = []
        for i, b in live.items():
            b["width"] = max(1, -(-(b["hi"] - b["lo"]) // (1 << NEXT_BITS)))
            rows.append((i, b["lo"], b["hi"], b["width"], b.get("key")))
        # Targets that share a bracket share its count.
        same: dict[tuple, int] = {}
        for r in rows:
            same.setdefault(r[1:], r[0])
        first = spark.createDataFrame([(v, *k) for k, v in same.items()], "b int, lo long, hi long, width long, wanted long")
        hit = (F.col(column) >= F.col("lo")) & (F.col(column) < F.col("hi"))
        if column != "key":
            hit = (F.col("key") == F.col("wanted")) & hit
        else:
            hit = (F.shiftright("key", KEY_BITS - FIRST_BITS) == F.shiftright("lo", KEY_BITS - FIRST_BITS)) & hit
        cell = F.expr(f"({column} - lo) div width").alias("cell")
        counted = (
            narrow.join(F.broadcast(first), hit)  # at most one row for each splitter
            .groupBy("b", cell)
            .agg(F.sum("size").alias("size"), F.min(column).alias("least"), F.max(column).alias("most"))
            .collect()
        )
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["b"], r["cell"])):
            by.setdefault(r["b"], []).append(r)
        for i in list(live):
            b = live[i]
            below = b["below"]
            for r in by[same[(b["lo"], b["hi"], b["width"], b.get("key"))]]:
                if below + r["size"] > b["target"]:
                    if r["least"] == r["most"]:
                        done[i] = b | {"value": r["least"], "below": below, "size": r["size"]}
                        del live[i]
                    else:
                        live[i] = b | {"lo": r["least"], "hi": r["most"] + 1, "below": below}
                    break
                below += r["size"]
    return [done[i] for i in range(len(brackets))]


def splitters(narrow: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """The shards - 1 boundaries (key, id): a row at or above a boundary lies beyond it.

    narrow has key, id, size. A boundary lies at an edge of the group of rows with
    one key if that is within tolerance x the mean shard of the wanted byte count, so
    that equal texts stay together; else between two ids in the group. Id None
    stands for the group's start.
    """
    shift = KEY_BITS - FIRST_BITS
    cells = narrow.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("size")).collect()
    cells = sorted((r["cell"], r["size"]) for r in cells)
    total = sum(s for _, s in cells)
    brackets, below, k = [], 0, 1
    for cell, size in cells:
        while k < shards and below + size > k * total // shards:
            brackets.append({"lo": cell << shift, "hi": (cell + 1) << shift, "below": below, "target": k * total // shards})
            k += 1
        below += size
    groups = _refine(narrow, "key", brackets)
    out: list = [None] * len(groups)
    inner = []
    for i, g in enumerate(groups):
        before, after = g["target"] - g["below"], g["below"] + g["size"] - g["target"]
        if min(before, after) <= tolerance * total / shards:
            out[i] = (g["value"], None) if before <= after else (g["value"] + 1, None)
        else:
            inner.append(i)
    if inner:
        need = {groups[i]["value"] for i in inner}
        keys = narrow.sparkSession.createDataFrame([(k,) for k in sorted(need)], "wanted long")
        ends = {r["key"]: (r["lo"], r["hi"]) for r in narrow.join(F.broadcast(keys), F.col("key") == F.col("wanted")).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
        found = _refine(narrow, "id", [{"lo": ends[groups[i]["value"]][0], "hi": ends[groups[i]["value"]][1] + 1, "below": groups[i]["below"], "target": groups[i]["target"], "key": groups[i]["value"]} for i in inner])
        for i, f in zip(inner, found, strict=True):
            before, after = f["target"] - f["below"], f["below"] + f["size"] - f["target"]
            out[i] = (f["key"], f["value"] if before <= after else f["value"] + 1)
    return sorted(out, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.02, id_col="doc_id", text_col="text") -> DataFrame:
    """docs with size, text_crc32, shard (0 .. shards-1) and slot (gapless from 0 in a shard).

    Shards hold nearly equal bytes: each boundary is off by at most the tolerance or
    half a row. Null text has size FRAME_BYTES and the CRC of no bytes; a null id
    counts as the least. Ids that are no whole numbers are told apart by a hash. Rows
    with one id and one text are never parted; rows that
    are equal in both get adjacent slots in any order. An empty table gives no rows.
    Columns of docs that carry the names of results are replaced by the results;
    others may have any name.
    """
    mark, results = free_name(docs), ["size", "text_crc32", "shard", "slot"]
    text, size, key, ident = F.col(text_col), F.col(mark + "size"), F.col(mark + "key"), F.col(mark + "id")
    keyed = docs.withColumns({mark + "size": text_bytes(text) + FRAME_BYTES, mark + "crc": F.crc32(F.coalesce(text, F.lit("")).cast("binary")), mark + "key": text_key(text), mark + "id": id_number(docs, id_col)})
    narrow = materialise(keyed.select(key.alias("key"), ident.alias("id"), size.alias("size")))
    cuts = splitters(narrow, shards, tolerance)

    def of(key: Column, ident: Column) -> Column:
        def holds(cut):
            k, i = cut
            return key >= k if i is None else (key > k) | ((key == k) & (ident >= i))

        return _literal_case(cuts, holds).cast("int")

    def part(key: Column, ident: Column) -> Column:
        return (F.conv(F.substring(F.md5(F.concat_ws("|", ident, key)), 1, 4), 16, 10).cast("int") % PARTS).cast("int")

    counts = narrow.select(of(F.col("key"), F.col("id")).alias("shard"), part(F.col("key"), F.col("id")).alias("part")).groupBy("shard", "part").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(counts.select(F.col("shard").alias(mark + "s"), F.col("part").alias(mark + "p"), start.alias(mark + "start")))  # shards x PARTS rows at most
    release(narrow)
    out = keyed.withColumns({mark + "shard": of(key, ident), mark + "part": part(key, ident)})
    place = F.row_number().over(Window.partitionBy(mark + "shard", mark + "part").orderBy(key, ident)) - 1
    out = out.withColumn(mark + "n", place)
    out = out.join(F.broadcast(starts), (F.col(mark + "shard") == F.col(mark + "s")) & (F.col(mark + "part") == F.col(mark + "p")))
    made = [size.alias("size"), F.col(mark + "crc").alias("text_crc32"), F.col(mark + "shard").alias("shard"), (F.col(mark + "start") + F.col(mark + "n")).cast("long").alias("slot")]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], *made)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots. The folder must not exist; an empty table writes no shard."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir):
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes in DuckDB, which has no such function: by nibbles, low one first."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    at = f"{table}::BIGINT[]"
    hexes = f"list_prepend(4294967295::BIGINT, list_transform(range(strlen({text}) * 2), lambda i: (strpos('0123456789ABCDEF', substr(hex(encode({text})), (i // 2 * 2 + 2 - i % 2)::INT, 1)) - 1)::BIGINT))"
    return f"xor(list_reduce({hexes}, lambda c, n: xor(c >> 4, ({at})[(xor(c, n) & 15) + 1])), 4294967295::BIGINT)"


def sharding_sql(docs: str = "documents") -> str:
    """WITH parts that end in shard_rows: the rows of docs with size, shard and slot."""
    return f"""
sh_base AS (SELECT *, coalesce(strlen(text), 0)::BIGINT + 16 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k,
    coalesce(doc_id, -4611686018427387904)::BIGINT AS id FROM {docs}),
sh_id AS (SELECT k, id, sum(size)::BIGINT AS s FROM sh_base GROUP BY k, id),
sh_cum AS (SELECT k, id, s, (sum(s) OVER (ORDER BY k, id) - s)::BIGINT AS below, (sum(s) OVER ())::BIGINT AS total FROM sh_id),
sh_key AS (SELECT k, min(below)::BIGINT AS below, sum(s)::BIGINT AS s, any_value(total) AS total FROM sh_cum GROUP BY k),
sh_want AS (SELECT i, i * total // 40 AS target, total FROM range(1, 40) t(i), (SELECT any_value(total) AS total FROM sh_key)),
sh_at AS (SELECT w.i, w.target, w.total, g.k, w.target - g.below AS before, g.below + g.s - w.target AS after
    FROM sh_want w JOIN sh_key g ON g.below <= w.target AND w.target < g.below + g.s),
sh_cut AS (
    SELECT CASE WHEN before <= after THEN k ELSE k + 1 END AS k, -9223372036854775807::BIGINT AS id FROM sh_at WHERE least(before, after) <= 0.02::DOUBLE * total / 40
    UNION ALL
    SELECT a.k, CASE WHEN a.target - c.below <= c.below + c.s - a.target THEN c.id ELSE c.id + 1 END FROM sh_at a
    JOIN sh_cum c ON c.k = a.k AND c.below <= a.target AND a.target < c.below + c.s WHERE least(a.before, a.after) > 0.02::DOUBLE * a.total / 40),
sh_cuts AS (SELECT list({{'k': k, 'id': id}}) AS cuts FROM sh_cut),
sh_dealt AS (SELECT b.*, coalesce(len(list_filter(cuts, lambda c: c.k < b.k OR (c.k = b.k AND c.id <= b.id))), 0)::INT AS shard FROM sh_base b, sh_cuts),
shard_rows AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(id::VARCHAR || '|' || k::VARCHAR), 1, 4))::INT % 64, k, id) - 1)::BIGINT AS slot FROM sh_dealt)"""


OP7_SQL = f"""WITH {sharding_sql()} SELECT doc_id, size, {crc32_sql("coalesce(text, '')")}::BIGINT AS text_crc32, 'bytes' AS law, shard, slot, NULL::INT AS grown_shard FROM shard_rows"""
