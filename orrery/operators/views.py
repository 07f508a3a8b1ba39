"""Projections of entities for readers: references, details, points, highlights, reports, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import graph, relational


def references(objects: DataFrame, events: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, id, type, label of every entity; a relation's label is its type."""
    pick = lambda df, kind, ident, label: df.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), "type", F.col(label).alias("label"))
    return pick(objects, "object", "object_id", "label").unionByName(pick(events, "event", "event_id", "type")).unionByName(pick(relations, "relation", "relation_id", "type"))


def details(objects: DataFrame, edges: DataFrame, ident: str) -> DataFrame:
    """One entity with its number of edges by direction and type."""
    own = relational.both_ways(edges).where(F.col("node") == ident).groupBy("node", "dir", "type").agg(F.count("*").alias("n"))
    degrees = own.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "dir", "type", F.col("n").cast("string")))), ",").alias("degrees"))
    return objects.where(F.col("object_id") == ident).join(degrees, F.col("object_id") == F.col("node"), "left").drop("node")


def type_points(objects: DataFrame, kind: str) -> DataFrame:
    """object_id, lon, lat (five digits), source_no: sources numbered by their first object."""
    own = objects.where((F.col("type") == kind) & F.col("lon").isNotNull())
    first = own.groupBy("source").agg(F.min("object_id").alias("_f"))
    numbers = first.withColumn("source_no", (F.row_number().over(Window.orderBy("_f")) - 1).cast("long")).drop("_f")
    return own.join(F.broadcast(numbers), "source").select("object_id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "source_no")


def news_filter(items: DataFrame, nation: str | None = None, city: str | None = None, category: str | None = None, certainty: str | None = None) -> DataFrame:
    """Items with nation, city, categories (array), geo; category 'other' has none; newest first."""
    if nation:
        items = items.where(F.col("nation") == nation)
    if city:
        items = items.where(F.col("city") == city)
    if category:
        items = items.where(F.size("categories") == 0 if category == "other" else F.array_contains("categories", category))
    if certainty:
        items = items.where((F.col("geo") == "confirmed") if certainty == "confirmed" else (F.col("geo") != "confirmed"))
    return items.orderBy(F.desc_nulls_last("t"), "id")


def news_reports(rows: DataFrame) -> DataFrame:
    """One report of each component of rows that share a page and place, or an action, place and hour.

    rows has id, url, place, action, hour, articles, tone, t. The representative has
    most articles, then the least id.
    """
    keys = F.array(F.concat_ws("|", F.lit("u"), "url", "place"), F.concat_ws("|", F.lit("a"), "action", "place", F.col("hour").cast("string")))
    keyed = rows.select(F.col("id").cast("string").alias("id"), F.explode(keys).alias("key"))
    labels = graph.components(keyed.select(F.concat(F.lit("row:"), "id").alias("src"), F.col("key").alias("dst")))
    joined = rows.join(labels, F.concat(F.lit("row:"), F.col("id").cast("string")) == F.col("node"))
    best = F.min(F.struct((-F.col("articles")).alias("a"), "id"))["id"]
    return joined.groupBy("label").agg(best.alias("id"), F.count("*").alias("n"), F.sum("articles").alias("articles"), F.countDistinct("url").alias("pages"), F.min("t").alias("first"), F.max("t").alias("last")).drop("label")


def highlighted_cells(points: DataFrame, chosen: DataFrame, shift: int) -> DataFrame:
    """id, state, x, y: in which cell a chosen entity appears, and whether alone; or why it does not.

    points has id, type, cx, cy; chosen has id.
    """
    cells = points.where("cx IS NOT NULL").withColumns({"x": F.shiftright("cx", shift), "y": F.shiftright("cy", shift)})
    n = F.count("*").over(Window.partitionBy("x", "y"))
    own = cells.withColumn("_n", n).select(F.col("id"), "x", "y", "_n")
    everyone = points.select("id", F.col("cx").isNotNull().alias("_placed"))
    rows = chosen.join(everyone, "id", "left").join(own, "id", "left")
    state = F.when(F.col("_placed").isNull(), "outside_scope").when(~F.col("_placed"), "not_applicable").when(F.col("_n") == 1, "single").otherwise("in_cell")
    return rows.select("id", state.alias("state"), "x", "y")


def locate(ident: str, objects: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """view, found: where an entity can be seen."""
    o, e = objects.where(F.col("object_id") == ident), events.where(F.col("event_id") == ident)
    count = lambda df, view: df.agg((F.count("*") > 0).alias("found")).select(F.lit(view).alias("view"), "found")
    placed = o.where("lon IS NOT NULL").select(F.lit(1).alias("x")).unionByName(e.where("lon IS NOT NULL").select(F.lit(1).alias("x")))
    return count(placed, "map").unionByName(count(e.where("t_ms IS NOT NULL"), "timeline")).unionByName(count(edges.where((F.col("src") == ident) | (F.col("dst") == ident)), "graph")).unionByName(count(o.where("label IS NOT NULL"), "search"))


def timeline_neighbours(events: DataFrame, participations: DataFrame, focus: str, hops: int, window_ms: int) -> DataFrame:
    """event_id, hops, dt: events reached over shared participants, within a window of time around the focus."""
    e = participations.select(F.col("event_id").alias("src"), F.col("object_id").alias("dst"))
    seeds = events.sparkSession.createDataFrame([(focus,)], "node string")
    near = graph.reach(e, seeds, 2 * hops)
    at = events.where(F.col("event_id") == focus).select(F.col("t_ms").alias("_t"))
    rows = near.join(events.select("event_id", "t_ms"), F.col("node") == F.col("event_id")).where(F.col("event_id") != focus).crossJoin(F.broadcast(at))
    rows = rows.where(F.col("t_ms").isNotNull() & (F.abs(F.col("t_ms") - F.col("_t")) <= window_ms))
    return rows.select("event_id", (F.col("hops") / 2).cast("int").alias("hops"), (F.col("t_ms") - F.col("_t")).alias("dt"))


def sources_of(evidence: DataFrame, sources: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """root, source: every source in the closure of the roots' evidence."""
    reached = graph.closure(evidence, roots, depth)
    return reached.join(sources, F.col("support") == F.col("id")).select("root", "source").distinct()


def complete_chains(evidence: DataFrame, raws: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """root, complete: whether all that a root rests on ends in raw records (id)."""
    reached = graph.closure(evidence, roots, depth)
    ends = reached.join(evidence.select(F.col("supports").alias("support")).distinct(), "support", "left_anti")
    told = ends.join(raws.select(F.col("id").alias("support"), F.lit(True).alias("_raw")).distinct(), "support", "left")
    return told.groupBy("root").agg(F.min(F.coalesce("_raw", F.lit(False))).alias("complete"))


def merge_lines(lines: DataFrame) -> DataFrame:
    """chain, n, km: lines (id, src, dst, km) joined where exactly two of them meet.

    Ends with two lines become links between lines, and the components of those links are the chains.
    """
    ends = lines.select("id", F.col("src").alias("p")).unionByName(lines.select("id", F.col("dst").alias("p")))
    two = ends.groupBy("p").agg(F.count("*").alias("n"), F.min("id").alias("src"), F.max("id").alias("dst")).where("n = 2 AND src <> dst")
    labels = graph.components(two.select("src", "dst"))
    rows = lines.join(labels, F.col("id") == F.col("node"), "left").withColumn("chain", F.coalesce("label", "id"))
    return rows.groupBy("chain").agg(F.count("*").alias("n"), F.sum("km").alias("km"))


def project_on_line(points: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """points (id, lon, lat) with the nearest segment of a line, its distance, and the length of the line before it."""
    from orrery.functions import geo

    spark = points.sparkSession
    segments = [(i, *a, *b) for i, (a, b) in enumerate(zip(line, line[1:], strict=False))]
    s = spark.createDataFrame(segments, "seg int, ax double, ay double, bx double, by double")
    c = F.col
    s = s.withColumn("len", geo.haversine_km(c("ax"), c("ay"), c("bx"), c("by"))).withColumn("before", F.coalesce(F.sum("len").over(Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = points.crossJoin(F.broadcast(s)).withColumn("km", geo.point_segment_km(c("lon"), c("lat"), c("ax"), c("ay"), c("bx"), c("by")))  # the segments of one line
    best = rows.groupBy("id").agg(F.min(F.struct("km", "seg", "before")).alias("m"))
    return best.select("id", "m.seg", "m.km", "m.before")


def places_index(places: DataFrame, names: DataFrame, least_rank: float | None = None) -> DataFrame:
    """id, type, label, aliases, clear_name, rank, context: the places that a search reads first.

    places has id, type, label, rank, context, sovereignty, sovereign; names has entity_id and alias. Places
    below the least rank, or without one, are left to the full search. A label that
    abbreviates gets the sovereign state's name as its clear one, if that is one of its names.
    """
    rows = places if least_rank is None else places.where(F.col("rank") >= least_rank)
    own = names.groupBy(F.col("entity_id").alias("_e")).agg(F.sort_array(F.collect_set("alias")).alias("_names"))
    rows = rows.join(own, F.col("id") == F.col("_e"), "left")
    others = F.array_remove(F.coalesce("_names", F.array().cast("array<string>")), F.col("label"))
    clear = F.when(F.col("label").contains(".") & F.col("sovereign") & F.array_contains(others, F.col("sovereignty")), F.col("sovereignty"))
    return rows.select("id", "type", "label", others.alias("aliases"), clear.alias("clear_name"), "rank", "context")


def indicators_of(facts: DataFrame, place: str) -> DataFrame:
    """indicator, period, value, before, change, source: the latest fact of each indicator of a place, and the one before."""
    w = Window.partitionBy("indicator").orderBy(F.desc("period"), "source")
    rows = facts.where(F.col("place") == place)
    rows = rows.withColumns({"_r": F.row_number().over(w), "before": F.lead("value").over(w)}).where("_r = 1")
    return rows.select("indicator", "period", "value", "before", (F.col("value") - F.col("before")).alias("change"), "source")


def indicator_catalog(facts: DataFrame) -> DataFrame:
    """indicator, places, first, last, n: what there is of each indicator."""
    return facts.groupBy("indicator").agg(F.countDistinct("place").alias("places"), F.min("period").alias("first"), F.max("period").alias("last"), F.count("*").alias("n"))


def flows_of(flows: DataFrame, place: str, k: int) -> DataFrame:
    """dir, indicator, partner, value, rank: the largest flows out of a place and into it, k of each indicator."""
    out = flows.where(F.col("origin") == place).select(F.lit("out").alias("dir"), "indicator", F.col("target").alias("partner"), "value")
    back = flows.where(F.col("target") == place).select(F.lit("in").alias("dir"), "indicator", F.col("origin").alias("partner"), "value")
    w = Window.partitionBy("dir", "indicator").orderBy(F.desc("value"), "partner")
    return out.unionByName(back).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def status(**kinds: DataFrame) -> DataFrame:
    """kind, type, n of all rows of the given tables, by one aggregation of each."""
    parts = [df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "type", "n") for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_received(events: DataFrame) -> DataFrame:
    """source, n, first_ms, last_ms: what has come from each source, and when."""
    return events.groupBy("source").agg(F.count("*").alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))
