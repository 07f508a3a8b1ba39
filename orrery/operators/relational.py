"""Joins over participations, relations, evidence and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """node, dir (out, in), kind, type, other, ref: every edge seen from both ends."""
    out = edges.select(F.col("src").alias("node"), F.lit("out").alias("dir"), "kind", "type", F.col("dst").alias("other"), "ref")
    back = edges.select(F.col("dst").alias("node"), F.lit("in").alias("dir"), "kind", "type", F.col("src").alias("other"), "ref")
    return out.unionByName(back)


def relations_of(edges: DataFrame, relations: DataFrame, node: str, k: int = 50) -> DataFrame:
    """Relations of a node by (type, nature, dir), the first k of each group and the group's size."""
    own = both_ways(edges.where("kind = 'relation'")).where(F.col("node") == node)
    rows = own.select("dir", "other", "ref").join(relations, F.col("ref") == F.col("relation_id"))
    w = Window.partitionBy("type", "nature", "dir")
    rows = rows.withColumns({"rank": F.row_number().over(w.orderBy("other")), "total": F.count("*").over(w)})
    return rows.where(F.col("rank") <= k).select("type", "nature", "dir", "other", "rank", "total")


def shared_participants(participations: DataFrame, seeds: DataFrame) -> DataFrame:
    """event_id, other_id, n_shared: events that have a participant in common with the seed events."""
    mine = participations.join(seeds, "event_id", "left_semi").select(F.col("event_id"), "object_id").distinct()
    theirs = participations.select(F.col("event_id").alias("other_id"), "object_id").distinct()
    return mine.join(theirs, "object_id").where("event_id <> other_id").groupBy("event_id", "other_id").agg(F.count("*").alias("n_shared"))


def first_reason(candidates: list[tuple[str, DataFrame]], key: str = "id") -> DataFrame:
    """id, reason: every id once, with the first reason that names it."""
    parts = [df.select(F.col(key).alias("id"), F.lit(reason).alias("reason"), F.lit(i).alias("_p")) for i, (reason, df) in enumerate(candidates)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("id").agg(F.min(F.struct("_p", "reason"))["reason"].alias("reason"))


def related_objects(participations: DataFrame, relations: DataFrame, node: str) -> DataFrame:
    """Objects that meet the node in an event, or that a relation leads to or from; the first reason wins."""
    events = participations.where(F.col("object_id") == node).select("event_id").distinct()
    together = participations.join(events, "event_id", "left_semi").select(F.col("object_id").alias("id"))
    out = relations.where(F.col("from_id") == node).select(F.col("to_id").alias("id"))
    back = relations.where(F.col("to_id") == node).select(F.col("from_id").alias("id"))
    return first_reason([("participation", together), ("relation_out", out), ("relation_in", back)]).where(F.col("id") != node)


def related_events(participations: DataFrame, relations: DataFrame, events: DataFrame, node: str, n: int, offset: int = 0) -> DataFrame:
    """Events of the node, then of its neighbours, the latest first."""
    own = participations.where(F.col("object_id") == node).select(F.col("event_id").alias("id"))
    near = relations.where(F.col("from_id") == node).select(F.col("to_id").alias("o")).unionByName(relations.where(F.col("to_id") == node).select(F.col("from_id").alias("o"))).distinct()
    theirs = participations.join(near, F.col("object_id") == F.col("o"), "left_semi").select(F.col("event_id").alias("id"))
    found = first_reason([("participation", own), ("neighbour", theirs)])
    rows = events.join(found, F.col("event_id") == F.col("id")).select("event_id", "type", "t_ms", "reason")
    return rows.orderBy(F.desc("t_ms"), "event_id").offset(offset).limit(n)


def noisy_or(evidence: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """key, confidence, n_groups, n: the best value of each independent group, combined.

    Two aggregations with partial sums; the product runs over the groups in order.
    """
    best = evidence.groupBy(key, group).agg(F.max(value).alias("v"), F.count("*").alias("k"))
    rows = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(group, "v"))).alias("g"), F.sum("k").alias("n"))
    rest = F.aggregate("g", F.lit(1.0), lambda acc, x: acc * (1 - x["v"]))
    return rows.select(key, (1 - rest).alias("confidence"), F.size("g").cast("long").alias("n_groups"), "n")


def independence(evidence: DataFrame, key: str, group: str, source: str, value: str) -> DataFrame:
    """key, group, best, n, n_sources: what each independent group adds."""
    return evidence.groupBy(key, group).agg(F.max(value).alias("best"), F.count("*").alias("n"), F.countDistinct(source).alias("n_sources"))


def resolve_strong(mentions: DataFrame, identifiers: DataFrame, schemes: list[str]) -> DataFrame:
    """mention_id, entity_id: by the first declared scheme that knows the value, then the least entity.

    Of the entities that have a value in common only the least meets its mentions, so that no pair of them is made.
    """
    order = F.lit(None).cast("int")
    for i, s in enumerate(schemes):
        order = F.when(F.col("scheme") == s, i).otherwise(order)
    least = identifiers.groupBy("scheme", "value").agg(F.min("entity_id").alias("entity_id"))
    hits = mentions.join(least, ["scheme", "value"]).withColumn("_p", order).where("_p IS NOT NULL")
    return hits.groupBy("mention_id").agg(F.min(F.struct("_p", "entity_id"))["entity_id"].alias("entity_id"))


def resolve_name(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mention_id, entity_id where the normalised name belongs to one entity alone."""
    hits = mentions.join(names, "name").groupBy("mention_id").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_most"))
    return hits.where(F.col("entity_id") == F.col("_most")).drop("_most")


def name_collisions(names: DataFrame, type_col: str = "type") -> DataFrame:
    """a, b, name: pairs of the same type and name, proposed for a merge that nobody makes.

    Each entity is paired with the first holder of its name, so that a name of n
    entities makes n - 1 proposals.
    """
    first = names.groupBy(type_col, "name").agg(F.min("entity_id").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return names.join(first, [type_col, "name"]).where("entity_id <> a").select("a", F.col("entity_id").alias("b"), "name")


def attribution(declared: DataFrame, spatial: DataFrame, everyone: DataFrame) -> DataFrame:
    """id, place, how: a declared place, one by position, nothing where they disagree."""
    d, s = declared.select("id", F.col("place").alias("_d")), spatial.select("id", F.col("place").alias("_s"))
    rows = everyone.select("id").join(d, "id", "left").join(s, "id", "left")
    how = F.when(F.col("_d").isNotNull() & F.col("_s").isNotNull() & (F.col("_d") != F.col("_s")), "conflict").when(F.col("_d").isNotNull(), "declared").when(F.col("_s").isNotNull(), "contained").otherwise("unresolved")
    return rows.select("id", F.when(how != "conflict", F.coalesce("_d", "_s")).alias("place"), how.alias("how"))


def preferred_identifier(identifiers: DataFrame, scheme: str) -> DataFrame:
    """entity_id, value: the strong one first, then the least."""
    own = identifiers.where(F.col("scheme") == scheme)
    return own.groupBy("entity_id").agg(F.min(F.struct((-F.col("strong")).alias("s"), "value"))["value"].alias("value"))


def conflicts(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    return facts.groupBy(*key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def dedupe(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def changes_since(log: DataFrame, version: int, n: int) -> DataFrame:
    """id, version, ops: what changed after a version, the least changed first."""
    rows = log.where(F.col("version") > version).groupBy("id").agg(F.max("version").alias("version"), F.array_join(F.array_sort(F.collect_set("op")), ",").alias("ops"))
    return rows.orderBy("version", "id").limit(n)


def shared_insights(members: DataFrame, active: DataFrame, seeds: DataFrame) -> DataFrame:
    """entity_id, other_id, n: entities that stand in an active insight together with a seed."""
    live = members.join(active, "insight_id", "left_semi").select("insight_id", "entity_id").distinct()
    mine = live.join(seeds, "entity_id", "left_semi")
    others = live.select("insight_id", F.col("entity_id").alias("other_id"))
    return mine.join(others, "insight_id").where("entity_id <> other_id").groupBy("entity_id", "other_id").agg(F.count("*").alias("n"))


def in_force(facts: DataFrame, names: DataFrame, key: str, day: str) -> DataFrame:
    """facts with the name whose [first, last) holds the day; names has key, first, last (null: open), name.

    The names of a key are few and travel as one list, so that facts stay row by row,
    equal ones too.
    """
    spans = names.groupBy(key).agg(F.collect_list(F.struct("first", "last", "name")).alias("_names"))
    holds = lambda n: (F.col(day) >= n["first"]) & (n["last"].isNull() | (F.col(day) < n["last"]))
    rows = facts.join(spans, key, "left")
    return rows.withColumn("name", F.array_max(F.transform(F.filter("_names", holds), lambda n: n["name"]))).drop("_names")
