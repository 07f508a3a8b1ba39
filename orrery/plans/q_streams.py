"""Streams run to their end, beside the batch form as the twin; and sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.plans import adapter as A
from orrery.plans.catalog import query
from orrery.sources import store
from orrery.sources.shared import shared_dir
from orrery.streaming import streams as ST

W = A.world_sql


def _stream(spark, sf):
    """The events as a stream over a copy in several files, in the shared folder."""
    path = shared_dir(spark)
    rows = spark.read.schema(ST.EVENTS).parquet(f"{sf}/events.parquet")
    rows.repartitionByRange(4, "ts").write.parquet(path)
    return ST.read_events(spark, path)


def _ended(spark, stream, mode):
    """Runs a stream and returns its last state as a table."""
    path = shared_dir(spark)
    if mode == "append":
        return ST.run_to_table(stream, f"{path}/out", f"{path}/state")
    rows = {}

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/b{number}")
        rows["last"] = number

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/b{rows['last']}")


@query("stream_tumbling", f"WITH {W('event')} SELECT t_ms // 3600000 * 3600000 AS bucket_ms, type AS event_type, count(*) AS n FROM event GROUP BY ALL")
def stream_tumbling(spark, sf):
    done = _ended(spark, ST.tumbling(_stream(spark, sf), "1 hour", "40 days"), "complete")
    return done.select(F.unix_millis("bucket").alias("bucket_ms"), "event_type", "n")


@query("stream_hopping", f"WITH {W('event')} SELECT b AS bucket_ms, type AS event_type, count(*) AS n FROM (SELECT type, unnest([t_ms // 21600000 * 21600000, t_ms // 21600000 * 21600000 - 21600000]) AS b FROM event) GROUP BY ALL")
def stream_hopping(spark, sf):
    done = _ended(spark, ST.hopping(_stream(spark, sf), "12 hours", "6 hours", "40 days"), "complete")
    return done.select(F.unix_millis("bucket").alias("bucket_ms"), "event_type", "n")


@query("stream_dedupe", "SELECT event_id % 3000 AS k, count(*) AS n FROM (SELECT DISTINCT event_id FROM events) GROUP BY 1")
def stream_dedupe(spark, sf):
    s = _stream(spark, sf)
    doubled = s.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    done = _ended(spark, ST.deduplicated(doubled, "event_id", "40 days"), "append")
    return done.groupBy((F.col("event_id") % 3000).alias("k")).agg(F.count("*").alias("n"))


@query("stream_interval_join", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def stream_interval_join(spark, sf):
    s, t = _stream(spark, sf), _stream(spark, sf)
    a = s.where("event_type = 'signup'").select(F.col("event_id").alias("a_id"), "user_id", F.col("at").alias("a_at"))
    b = t.where("event_type = 'purchase'").select(F.col("event_id").alias("b_id"), F.col("user_id").alias("b_user"), F.col("at").alias("b_at"))
    done = _ended(spark, ST.interval_join(a, b, "0 HOURS", "6 HOURS", "40 days"), "append")
    return done.select("a_id", "b_id")


@query("stream_upsert_latest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert_latest(spark, sf):
    path = shared_dir(spark)
    s = _stream(spark, sf).select("user_id", "event_id", "value")
    q = s.writeStream.foreachBatch(ST.upsert(path, ["user_id"], "event_id")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return ST.upserted(spark, path, s.schema)


@query("stream_insight_retraction", "SELECT user_id::VARCHAR AS anchor, max({'v': value, 'id': event_id}).id::VARCHAR AS id FROM events WHERE value IS NOT NULL GROUP BY user_id")
def stream_insight_retraction(spark, sf):
    """An insight of each user: the greatest event so far; those that greater ones took the place of are retired."""
    path = shared_dir(spark)
    s = _stream(spark, sf).where("value IS NOT NULL").select(F.col("user_id").cast("string").alias("anchor"), F.col("event_id").cast("string").alias("id"), "value", "event_id")
    seen = ST.upsert(f"{path}/seen", ["anchor", "id"], "event_id", by=["anchor"])

    def each(batch, number):
        seen(batch, number)

        def solve(anchors):
            rows = ST.upserted(spark, f"{path}/seen", s.schema, below=number + 1).join(anchors, "anchor", "left_semi")
            return rows.groupBy("anchor").agg(F.max(F.struct("value", "event_id", "id")).alias("m")).select("m.id", "anchor", "m.value")

        ST.retracting(f"{path}/insights", solve)(batch, number)

    s.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return ST.upserted(spark, f"{path}/insights", ST.INSIGHTS).where("status = 'active'").select("anchor", "id")


@query("stream_late_resolution", "SELECT event_id AS a_id, user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def stream_late_resolution(spark, sf):
    """Purchases wait for the first signup of their user, which may come in a later file."""
    a = _stream(spark, sf).where("event_type = 'purchase'").select(F.col("event_id").alias("a_id"), "user_id")
    b = _stream(spark, sf).where("event_type = 'signup'").select("user_id")
    return _ended(spark, ST.resolved_late(a, b, "user_id"), "append").select("a_id", "user_id")


@query("sink_shard_manifest", "SELECT shard, count(*) AS n, sum(strlen(c_mktsegment))::BIGINT AS bytes FROM (SELECT *, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(strlen(c_name)), lambda i: ascii(substr(c_name, (i + 1)::INT, 1))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % 16)::INT AS shard FROM customer) GROUP BY shard")
def sink_shard_manifest(spark, sf):
    return store.shard_manifest(A.table(spark, sf, "customer"), "c_name", "c_mktsegment", 16).drop("digest")


@query("sink_object_tiles", f"WITH {W('object')}, k AS (SELECT type, CASE WHEN count(*) <= 500 THEN 6 ELSE 3 END AS s FROM object WHERE cx IS NOT NULL GROUP BY type) SELECT type, cx >> s AS x, cy >> s AS y, count(*) AS n FROM object JOIN k USING (type) WHERE cx IS NOT NULL GROUP BY ALL")
def sink_object_tiles(spark, sf):
    return store.object_tiles(A.objects(spark, sf), 500)


@query("source_extract_locator", "SELECT event_id, props->>'$.k' AS extracted FROM events")
def source_extract_locator(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("sha256"), F.col("props").alias("text"))
    return store.extract(e, "$.k", ["k"]).select(F.col("sha256").cast("long").alias("event_id"), "extracted")


@query("source_unprocessed", "SELECT event_id AS raw_id FROM events WHERE event_id % 4 > 0")
def source_unprocessed(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("event_id").alias("raw_id"), F.col("event_type").alias("source_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("fetched_ms"), F.col("props").alias("sha256"))
    return store.unprocessed(e, e.where("raw_id % 4 = 0")).select("raw_id")


@query("source_html_cells", r"""WITH r AS (SELECT page_id, unnest(l) AS t, unnest(range(len(l)))::INT AS row FROM (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '<(/?)(ul|div)', '<\1tr', 'g'), '<(/?)(li|p)\b', '<\1td', 'g'), '(?is)<tr[^>]*>(.*?)</tr>', 1) AS l FROM pages)),
c AS (SELECT page_id, row, unnest(l) AS t, unnest(range(len(l)))::INT AS cell FROM (SELECT page_id, row, regexp_extract_all(t, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1) AS l FROM r))
SELECT page_id, row, cell, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM c""")
def source_html_cells(spark, sf):
    from orrery.sources.readers import html_cells

    # The pages at hand hold no tables, so their lists and blocks stand for rows, and items and paragraphs for cells.
    html = F.regexp_replace(F.regexp_replace("html", "<(/?)(ul|div)", "<$1tr"), r"<(/?)(li|p)\b", "<$1td")
    return html_cells(A.table(spark, sf, "pages").select("page_id", html.alias("html")), "html").select("page_id", "row", "cell", "text")


@query("sink_logical_hash")
def sink_logical_hash(spark, sf):
    return store.logical_hash(A.table(spark, sf, "customer"))


@query("sink_geojson")
def sink_geojson(spark, sf):
    return store.to_geojson(A.objects(spark, sf).where("lon IS NOT NULL").select("object_id", "label", "lon", "lat"))
