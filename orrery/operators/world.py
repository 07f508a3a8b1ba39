"""World building: records become entities, claims, evidence, relations and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import confidence, ids
from orrery.functions.text import norm_name
from orrery.operators.temporal import claims as _claims


def new_records(incoming: DataFrame, known: DataFrame, key: str = "record_id") -> DataFrame:
    """Records seen for the first time, each once."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def latest_version(records: DataFrame, key: list[str], at: str, version: str, tie: str) -> DataFrame:
    """The row of each entity with the latest time, then the highest version."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(ids.version_key(F.col(version))), tie)
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def validate(records: DataFrame, declared: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the declared properties coerced, reasons of rejected ones: record_id, property, reason).

    records has record_id and props (map of string to string). Kinds are text, float,
    int and bool; an undeclared property or one that can't be read is rejected.
    """
    names = list(declared)
    spark_type = {"text": "string", "float": "double", "int": "long", "bool": "boolean"}
    given = records.select("record_id", F.explode("props").alias("property", "value"))
    unknown = given.where(~F.col("property").isin(*names)).select("record_id", "property", F.lit("undeclared").alias("reason"))
    bad = unknown
    for n, kind in declared.items():
        part = given.where((F.col("property") == n) & F.col("value").isNotNull() & F.expr(f"try_cast(value AS {spark_type[kind]})").isNull())
        bad = bad.unionByName(part.select("record_id", "property", F.lit(f"not {kind}").alias("reason")))
    good = records.join(bad.select("record_id").distinct(), "record_id", "left_anti")
    typed = [F.expr(f"try_cast(props['{n}'] AS {spark_type[k]})").alias(n) for n, k in declared.items()]
    return good.select("record_id", *typed), bad


def claims(facts: DataFrame, key: list[str], value: str, at: str, ident: str) -> DataFrame:
    return _claims(facts, key, value, at, ident)


def strong_holders(identifiers: DataFrame) -> DataFrame:
    """identifiers with holds: the first entity keeps a strong identifier, the others don't."""
    w = Window.partitionBy("scheme", "value").orderBy("recorded", "entity_id")
    first = F.row_number().over(w) == 1
    return identifiers.withColumn("holds", F.when(F.col("strong") == 1, first).otherwise(F.lit(True)))


def add_relations(assertions: DataFrame) -> DataFrame:
    """relation_id, type, from_id, to_id, groups, n, confidence, derivation: asserted and computed relations merged.

    assertions has type, from_id, to_id, grp, weight, method.
    """
    key = ["type", "from_id", "to_id"]
    best = assertions.groupBy(*key, "grp").agg(F.max("weight").alias("w"), F.count("*").alias("k"), F.max(F.when(F.col("method") == "asserted", 1).otherwise(0)).alias("a"), F.max(F.when(F.col("method") == "computed", 1).otherwise(0)).alias("c"))
    rows = best.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("grp", "w"))).alias("g"), F.sum("k").alias("n"), F.max("a").alias("a"), F.max("c").alias("c"))
    rest = F.aggregate("g", F.lit(1.0), lambda acc, x: acc * (1 - x["w"]))
    derivation = F.when((F.col("a") == 1) & (F.col("c") == 1), "both").when(F.col("a") == 1, "asserted").otherwise("computed")
    return rows.select(ids.det_id("rel", F.col("type"), F.col("from_id"), F.col("to_id")).alias("relation_id"), *key, F.size("g").cast("long").alias("groups"), "n", (1 - rest).alias("confidence"), derivation.alias("derivation"))


def resolve_assertions(assertions: DataFrame, identifiers: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assertions with target_id and method, those that stay pending).

    assertions has assertion_id, scheme, value, name. A target is an identifier's
    only entity, or else a name's only entity.
    """
    def only(df, key):
        u = df.groupBy(*key).agg(F.min("entity_id").alias("e"), F.max("entity_id").alias("_m"))
        return u.where(F.col("e") == F.col("_m")).drop("_m")

    by_id = only(identifiers, ["scheme", "value"]).withColumnRenamed("e", "_by_id")
    by_name = only(names, ["name"]).withColumnRenamed("e", "_by_name")
    rows = assertions.join(by_id, ["scheme", "value"], "left").join(by_name, "name", "left")
    rows = rows.withColumn("target_id", F.coalesce("_by_id", "_by_name")).withColumn("method", F.when(F.col("_by_id").isNotNull(), "asserted").when(F.col("_by_name").isNotNull(), "resolved_by_name")).drop("_by_id", "_by_name")
    return rows.where("target_id IS NOT NULL"), rows.where("target_id IS NULL").drop("target_id", "method")


def endpoint_violations(relations: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Relations whose end types the type system does not allow (allowed: type, from_type, to_type)."""
    e = entities.select(F.col("object_id"), F.col("type").alias("_t"))
    a = e.select(F.col("object_id").alias("from_id"), F.col("_t").alias("from_type"))
    b = e.select(F.col("object_id").alias("to_id"), F.col("_t").alias("to_type"))
    return relations.join(a, "from_id").join(b, "to_id").join(allowed, ["type", "from_type", "to_type"], "left_anti")


def provenance(rows: DataFrame, *key: str) -> DataFrame:
    """prov_id and the key: one row for each distinct origin."""
    return rows.select(*key).distinct().select(ids.det_id("prov", *[F.col(k) for k in key]).alias("prov_id"), *key)


def retract(entities: DataFrame, retracted: DataFrame, merged: DataFrame) -> DataFrame:
    """entities with status and merged_into set from lists of ids (id; id, into)."""
    r, m = retracted.select(F.col("id").alias("_r")).distinct(), merged.select(F.col("id").alias("_m"), "into").dropDuplicates(["_m"])
    df = entities.drop("merged_into").join(r, F.col("entity_id") == F.col("_r"), "left").join(m, F.col("entity_id") == F.col("_m"), "left")
    return df.withColumn("status", F.when(F.col("_r").isNotNull(), "retracted").otherwise(F.col("status"))).withColumnRenamed("into", "merged_into").drop("_r", "_m")


def stale_images(cameras: DataFrame, day_ms: int = 86_400_000) -> DataFrame:
    """cameras (list_id, camera_id, image_ms, refresh_ms, status) with snapshots too far behind their list's freshest as stale."""
    newest = F.max("image_ms").over(Window.partitionBy("list_id"))
    limit = F.greatest(F.lit(day_ms), 6 * F.coalesce("refresh_ms", F.lit(0)))
    old = (F.col("status") == "current_snapshot") & (newest - F.col("image_ms") > limit)
    return cameras.withColumn("status", F.when(F.coalesce(old, F.lit(False)), "stale").otherwise(F.col("status")))


def maintain_edges(edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """edges with new ones, each once; only those of insights can go."""
    key = ["src", "kind", "type", "dst", "ref"]
    gone = removed.where("kind = 'insight_member'").select(*key)
    return edges.unionByName(added).dropDuplicates(key).join(gone, key, "left_anti")


def evidence_weights(evidence: DataFrame) -> Column:
    """Weight of evidence rows with reliability, method, status, completeness."""
    return confidence.evidence_weight(F.col("reliability"), F.col("method"), F.col("status"), F.col("completeness"))


#: Where a name comes from, the most telling first.
ORIGINS = ("label", "source", "vocab")


def aliases(records: DataFrame, matched: list[str], vocabulary: DataFrame) -> DataFrame:
    """entity_id, name (normal form), alias, type, origin: each name of an entity once, from the first origin that gives it.

    records has entity_id, type, label, aliases and identifiers ('scheme:value') as arrays; the
    label counts for the types in matched. vocabulary has type, identifier, alias.
    """
    own = records.select("entity_id", "type", F.explode(F.concat(F.when(F.col("type").isin(*matched), F.array(F.struct(F.col("label").alias("alias"), F.lit(0).alias("o")))).otherwise(F.array().cast("array<struct<alias:string,o:int>>")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("alias"), F.lit(1).alias("o"))))).alias("n"))
    named = records.select("entity_id", "type", F.explode("identifiers").alias("identifier")).join(vocabulary, ["type", "identifier"])
    rows = own.select("entity_id", "type", "n.alias", "n.o").unionByName(named.select("entity_id", "type", "alias", F.lit(2).alias("o")))
    rows = rows.withColumn("name", norm_name(F.col("alias"))).where(F.col("name") != "")
    best = rows.groupBy("entity_id", "name").agg(F.min(F.struct("o", "alias", "type")).alias("b"))
    return best.select("entity_id", "name", "b.alias", "b.type", F.element_at(F.array(*map(F.lit, ORIGINS)), F.col("b.o") + 1).alias("origin"))


def undeclared(evidence: DataFrame, declared: DataFrame) -> DataFrame:
    """The evidence of participations whose role the event's type (declared: type, role) does not know."""
    return evidence.join(declared, ["type", "role"], "left_anti")


def participation_groups(evidence: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """event_id, object_id, role, grp, best, n: the state of participations, from evidence and from an earlier state.

    Best values and counts merge in any order, so that batches one after the other give
    what all evidence at once gives.
    """
    key = ["event_id", "object_id", "role", "grp"]
    rows = evidence.select(*key, F.col("weight").alias("best"), F.lit(1).cast("long").alias("n"))
    rows = rows if known is None else rows.unionByName(known)
    return rows.groupBy(*key).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def participations(groups: DataFrame) -> DataFrame:
    """event_id, object_id, role, confidence, groups, n_evidence: independent groups support a participation together."""
    per = groups.groupBy("event_id", "object_id", "role").agg(F.sort_array(F.collect_list(F.struct("grp", "best"))).alias("g"), F.sum("n").alias("n_evidence"))
    rest = F.aggregate("g", F.lit(1.0), lambda a, x: a * (1 - x["best"]))
    return per.select("event_id", "object_id", "role", F.round(1 - rest, 12).alias("confidence"), F.size("g").cast("long").alias("groups"), "n_evidence")


def change_log(changes: DataFrame) -> DataFrame:
    """version, kind, id, op: each batch of changes (batch, kind, id, op) is one version of the world, from 1, in order."""
    from orrery.operators.graph import numbered

    versions = numbered(changes.select("batch").distinct(), "batch").select("batch", (F.col("no") + 1).alias("version"))
    return changes.select("batch", "kind", "id", "op").distinct().join(versions, "batch").select("version", "kind", "id", "op")
