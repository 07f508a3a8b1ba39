"""Structured Streaming: windows, deduplication, interval joins, feeds.

Every stream is read with a declared schema, and state is bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.operators.rules import lifecycle
from orrery.sources.shared import _path, materialise, release

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events of Parquet files under a path, with their time as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("at", F.col("ts").cast("timestamp")).drop("ts")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """bucket, event_type, n, total."""
    w = events.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("bucket"), "event_type", "n", "total")


def hopping(events: DataFrame, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("at", late).groupBy(F.window("at", size, slide), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("bucket"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once; a repeat is known as long as the watermark has not passed it."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def interval_join(a: DataFrame, b: DataFrame, low: str, high: str, late: str = "1 hour") -> DataFrame:
    """Pairs of one user with low <= b - a <= high. a has a_id, user_id, a_at; b has b_id, b_user, b_at."""
    x, y = a.withWatermark("a_at", late), b.withWatermark("b_at", late)
    on = f"user_id = b_user AND b_at >= a_at + INTERVAL {low} AND b_at <= a_at + INTERVAL {high}"
    return x.join(y, F.expr(on))


def latest_versions(records: DataFrame) -> DataFrame:
    """key, version, value: the highest version of each key so far, late ones included. State is one row for each key."""

    def keep(key, batches, state: GroupState):
        best = state.get if state.exists else None
        for b in batches:
            top = b.sort_values("version").iloc[-1]
            if best is None or top["version"] > best[0]:
                best = (int(top["version"]), str(top["value"]))
        state.update(best)
        yield pd.DataFrame({"key": [key[0]], "version": [best[0]], "value": [best[1]]})

    return records.groupBy("key").applyInPandasWithState(keep, "key string, version long, value string", "version long, value string", "update", GroupStateTimeout.NoTimeout)


def _heads(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The version that each bucket of an upserted table had before a batch, or has by now."""
    pattern, files = _path(spark, f"{path}/head/v*/_SUCCESS")
    done = [int(f.getPath().getParent().getName()[1:]) for f in files.globStatus(pattern) or ()]
    done = [n for n in done if below is None or n < below]
    if not done:
        return {}
    rows = spark.read.schema("bucket int, version long").parquet(f"{path}/head/v{max(done)}").collect()  # a row for each bucket
    return {r["bucket"]: r["version"] for r in rows}


def upserted(spark: SparkSession, path: str, schema, below: int | None = None, heads: dict[int, int] | None = None) -> DataFrame:
    """The rows that upsert() keeps under a path: by now, or as they were before a batch."""
    heads = _heads(spark, path, below) if heads is None else heads
    if not heads:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/v{v}/_bucket={b}" for b, v in sorted(heads.items())])


def upsert(path: str, key: list[str], order: str, by: list[str] | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that keeps the row of each key that is greatest in order.

    Rows lie in buckets by the hash of the key, or of columns of it (by). A batch
    writes the buckets that it touches under its number, and a head that names
    each bucket's version, so that its cost follows its own keys, and a batch that
    runs again gives the same table. A bucket that a head names and that is gone
    is an error.
    """
    from pyspark.sql import Window

    def write(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        heads = _heads(spark, path, number)
        rows = batch.withColumn("_bucket", F.pmod(F.hash(*(by or key)), F.lit(buckets))).persist()
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most one row for each bucket
        if touched:
            old = {b: heads[b] for b in touched if b in heads}
            whole = rows
            if old:
                before = upserted(spark, path, schema, heads=old)
                whole = rows.unionByName(before.withColumn("_bucket", F.pmod(F.hash(*(by or key)), F.lit(buckets))))
            w = Window.partitionBy("_bucket", *key).orderBy(F.desc(order))
            best = whole.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
            best.write.partitionBy("_bucket").mode("overwrite").parquet(f"{path}/data/v{number}")
            heads |= dict.fromkeys(touched, number)
            spark.createDataFrame(list(heads.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/head/v{number}")
        rows.unpersist()

    return write


#: Rows of a table of insights with their state; changed_in is the batch of the last change.
INSIGHTS = "id string, anchor string, value double, status string, by_id string, changed_in long"


def retracting(path: str, solve: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of insights that retires those that a change took the ground from.

    A batch names anchors that changed; solve(anchors) gives their insights (id,
    anchor, value) as of now. What is new becomes active; an active insight that
    is not found again becomes superseded, by the best new one of its anchor, or
    stale. Only the anchors of the batch are computed, and only their buckets written.
    """
    keep = upsert(path, ["anchor", "id"], "changed_in", by=["anchor"])

    def write(batch: DataFrame, number: int) -> None:
        anchors = batch.select("anchor").where("anchor IS NOT NULL").distinct()
        was = upserted(batch.sparkSession, path, INSIGHTS, below=number).where("status = 'active'").join(anchors, "anchor", "left_semi")
        now = materialise(solve(anchors).select("id", "anchor", "value"))
        changes = lifecycle(was.select("id", "anchor", "value"), now).where("change <> 'kept'")
        rows = now.unionByName(was.select("id", "anchor", "value").join(now, "id", "left_anti"))
        status = F.when(F.col("change") == "new", "active").otherwise(F.col("change"))
        keep(rows.join(changes, "id").select("id", "anchor", "value", status.alias("status"), "by_id", F.lit(number).cast("long").alias("changed_in")), number)
        release(now)

    return write


def resolved_late(assertions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Assertions with the target of their key, as soon as both are there, whichever comes first.

    Those without a target wait in the state store, row by row, which a key with
    many assertions does not strain; a target counts once.
    """
    return assertions.join(targets.dropDuplicates([key]), key)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a stream gives for the data there is, as a table in memory: for tests and small feeds."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that an append stream gives for the data there is, as Parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
