"""Insights as rows: members with their roles, extent in space and time, reads and explanations.

A rule's results become two tables: insights, one row each, and members (insight_id,
role, kind, entity_id and what is known of the entity). Everything that reads insights
joins these two by id; members of one insight are few, and never gathered across insights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geo, ids, timefn
from orrery.operators.rules import Rule, dealt

MEMBER = ("role", "kind", "entity_id", "label", "confidence", "t", "lon", "lat")


def _member(role: Column, kind: Column, ident: Column, source: dict[str, Column]) -> Column:
    kinds = {"label": "string", "confidence": "double", "t": "long", "lon": "double", "lat": "double"}
    known = {c: source.get(c, F.lit(None)).cast(k) for c, k in kinds.items()}
    return F.struct(role.alias("role"), kind.alias("kind"), ident.alias("entity_id"), *[v.alias(c) for c, v in known.items()])


def members_of(rule: Rule, found: DataFrame) -> Column:
    """The members of each binding as an array: a variable under its name, a relation that a constraint rests on as rel:<constraint>."""
    own = []
    for v in rule.variables:
        n = v["name"]
        own.append(_member(F.lit(n), F.lit(v.get("kind", "object")), F.col(f"{n}_id"), {c: F.col(f"{n}_{c}") for c in ("label", "confidence", "t", "lon", "lat") if f"{n}_{c}" in found.columns}))
    for c in sorted(x for x in found.columns if x.startswith("relid:")):
        key = c.removeprefix("relid:")
        own.append(_member(F.lit(f"rel:{key}"), F.lit("relation"), F.col(f"`{c}`"), {"confidence": F.col(f"`rel:{key}`")}))
    return F.filter(F.array(*own), lambda m: m["entity_id"].isNotNull())


def insight_id(rule: Rule, members: Column) -> Column:
    """The name of an insight: by its rule, the rule's version, and role=entity of its members in order."""
    named = F.array_sort(F.transform(members, lambda m: F.concat_ws("=", m["role"], m["entity_id"])))
    return ids.det_id("ins", F.lit(rule.id), F.lit(rule.version), F.array_join(named, ids.SEPARATOR))


def extent(members: Column, anchor: str) -> dict[str, Column]:
    """Bounds of the members' places, the anchor's place (or the first that has one), its cell, first and last time, month."""
    placed = F.filter(members, lambda m: m["lon"].isNotNull() & m["lat"].isNotNull())
    base = F.coalesce(F.get(F.filter(placed, lambda m: m["role"] == anchor), F.lit(0)), F.get(placed, F.lit(0)))
    of = lambda name: F.transform(placed, lambda m: m[name])
    times = F.transform(members, lambda m: m["t"])
    first = F.array_min(times)
    return {
        "min_lon": F.array_min(of("lon")),
        "max_lon": F.array_max(of("lon")),
        "min_lat": F.array_min(of("lat")),
        "max_lat": F.array_max(of("lat")),
        "lon": base["lon"],
        "lat": base["lat"],
        "cx": geo.cell_x(base["lon"]),
        "cy": geo.cell_y(base["lat"]),
        "t_start": first,
        "t_end": F.array_max(times),
        "month": timefn.month_index(first),
    }


def insights_of(rule: Rule, found: DataFrame) -> DataFrame:
    """A row for each binding of a rule: insight_id, rule_id, kind, anchor, confidence, members, and its extent."""
    rows = found.withColumn("_members", members_of(rule, found))
    where = extent(F.col("_members"), rule.anchor)
    return rows.select(insight_id(rule, F.col("_members")).alias("insight_id"), F.lit(rule.id).alias("rule_id"), F.lit(rule.output).alias("kind"), F.col(f"{rule.anchor}_id").alias("anchor"), F.col("score").alias("confidence"), F.col("_members").alias("members"), *[c.alias(n) for n, c in where.items()])


def member_rows(insights: DataFrame) -> DataFrame:
    """insight_id and a row for each member."""
    return insights.select("insight_id", F.explode("members").alias("m")).select("insight_id", *[F.col(f"m.{c}").alias(c) for c in MEMBER])


def collected_members(rule: Rule, bindings: DataFrame) -> DataFrame:
    """anchor, role, entity_id, km of a context: the anchor, the nearest collected as <var>#000 .., and all counted in the order of their ids."""
    a, v, limit = f"{rule.anchor}_id", rule.collect["var"], int(rule.collect.get("limit", 20))
    kms = [c for c in bindings.columns if c.startswith("km:") and v in c.split(":")[-1].split("-")]
    km = F.coalesce(*[F.col(f"`{c}`") for c in kms]) if kms else F.lit(None).cast("double")
    near = bindings.where(F.col(f"{v}_id").isNotNull()).groupBy(F.col(a).alias("anchor"), F.col(f"{v}_id").alias("entity_id")).agg(F.min(km).alias("km"))
    role = lambda name: F.format_string(name + "#%03d", F.col("_i") - 1)
    cols = ["anchor", "role", "entity_id", "km"]
    at = Window.partitionBy("anchor")
    out = near.withColumn("_i", F.row_number().over(at.orderBy(F.coalesce("km", F.lit(0.0)), "entity_id"))).where(F.col("_i") <= limit).withColumn("role", role(v)).select(cols)
    own = near.select("anchor").distinct().select("anchor", F.lit(rule.anchor).alias("role"), F.col("anchor").alias("entity_id"), F.lit(None).cast("double").alias("km"))
    out = own.unionByName(out)
    for extra in rule.collect.get("count", []):
        rows = bindings.where(F.col(f"{extra}_id").isNotNull() & F.col(f"{v}_id").isNotNull()).select(F.col(a).alias("anchor"), F.col(f"{extra}_id").alias("entity_id"), F.lit(None).cast("double").alias("km")).distinct()
        out = out.unionByName(rows.withColumn("_i", F.row_number().over(at.orderBy("entity_id"))).withColumn("role", role(extra)).select(cols))
    return out


def group_members(rule: Rule, groups: DataFrame) -> DataFrame:
    """anchor, role, entity_id of grouped results: the representative under its variable, the others as <var>~group#000 .. in the order of their ids."""
    v = rule.group["var"]
    rest = F.filter(F.split("members", ","), lambda m: m != F.col("representative"))
    others = groups.select("anchor", F.posexplode(rest).alias("i", "entity_id")).select("anchor", F.format_string(v + "~group#%03d", "i").alias("role"), "entity_id")
    first = groups.select("anchor", F.lit(v).alias("role"), F.col("representative").alias("entity_id"))
    own = groups.select("anchor", F.lit(rule.anchor).alias("role"), F.col("anchor").alias("entity_id")).distinct()
    return own.unionByName(first).unionByName(others)


def holding(members: DataFrame, entity: str) -> DataFrame:
    """insight_id of insights that hold an entity, or hold an insight that does."""
    direct = members.where(F.col("entity_id") == entity).select("insight_id").distinct()
    above = members.join(direct.select(F.col("insight_id").alias("entity_id")), "entity_id", "left_semi").select("insight_id")
    return direct.unionByName(above).distinct()


def listed(insights: DataFrame, members: DataFrame, n: int, cursor: tuple[float, str] | None = None, rule_id: str | None = None, member: str | None = None, least: float | None = None, window: tuple[int, int] | None = None, viewport: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The next n insights by confidence, then id, after a cursor (confidence, id), that fulfil all that is asked."""
    rows = insights
    if rule_id is not None:
        rows = rows.where(F.col("rule_id") == rule_id)
    if least is not None:
        rows = rows.where(F.col("confidence") >= least)
    if window is not None:
        rows = rows.where(F.col("t_start").between(*window))
    if viewport is not None:
        west, south, east, north = viewport
        rows = rows.where((F.col("min_lon") <= east) & (F.col("max_lon") >= west) & (F.col("min_lat") <= north) & (F.col("max_lat") >= south))
    if member is not None:
        rows = rows.join(holding(members, member), "insight_id", "left_semi")
    if cursor is not None:
        score, last = cursor
        rows = rows.where((F.col("confidence") < score) | ((F.col("confidence") == score) & (F.col("insight_id") > last)))
    return rows.orderBy(F.desc("confidence"), "insight_id").limit(n)


def components_of(insight: DataFrame, members: DataFrame) -> DataFrame:
    """insight_id, component_id, role, entity_id: the members of the insights that an insight (column insight_id) is made of."""
    own = members.join(insight.select("insight_id"), "insight_id", "left_semi").where("kind = 'insight'").select("insight_id", F.col("entity_id").alias("component_id"))
    inner = members.select(F.col("insight_id").alias("component_id"), "role", "entity_id")
    return own.join(inner, "component_id").select("insight_id", "component_id", "role", "entity_id")


def summaries(members: DataFrame, entities: DataFrame) -> DataFrame:
    """insight_id, a, b (labels of the first two members that are no collected ones), nearest, km, n: what a reader sees first.

    members has insight_id, role, entity_id, km; entities has id and label. Collected
    members bear # in their role; the nearest of them comes first, n is their number.
    """
    named = members.join(entities.select(F.col("id").alias("entity_id"), "label"), "entity_id", "left")
    own, place = ~F.col("role").contains("#"), F.struct("role", "entity_id", "label")
    near = F.struct(F.col("km").isNull().alias("far"), "km", "entity_id", "label")
    per = named.groupBy("insight_id").agg(F.sort_array(F.collect_list(F.when(own, place))).alias("own"), F.min(F.when(~own, near)).alias("near"), F.count(F.when(~own, 1)).alias("n"))
    return per.select("insight_id", F.get("own", F.lit(0))["label"].alias("a"), F.get("own", F.lit(1))["label"].alias("b"), F.col("near.label").alias("nearest"), F.col("near.km").alias("km"), "n")


def explained(rule: Rule, bindings: DataFrame) -> DataFrame:
    """anchor, candidate members, score, reason of every complete binding: why it was kept or not, and what its factors give again."""
    names = [v["name"] for v in rule.variables if v["name"] != rule.anchor]
    who = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(f"{n}_id")) for n in sorted(names)])
    confs = F.array_min(F.array(*[F.col(f"{v['name']}_confidence") for v in rule.variables], *[F.col(f"`{c}`") for c in bindings.columns if c.startswith("rel:")]))
    scored = sorted(c for c in bindings.columns if c.startswith("factor:"))
    again = F.lit(rule.strength) * F.coalesce(F.round(confs, 12), F.lit(0.0))
    for c in scored:
        again = again * F.round(F.col(f"`{c}`"), 12)
    # What the window sorts is narrow, and stays where the bindings were dealt out.
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(dealt(rule, bindings))]
    rows = bindings.select(*keys, F.col(f"{rule.anchor}_id").alias("anchor"), who.alias("candidate"), "score", (F.abs(again - F.col("score")) <= 1e-9).alias("recomputed"))
    at = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    rows = rows.withColumn("rank", F.row_number().over(at.orderBy(F.desc("score"), "candidate")))
    return with_reasons(rule, rows)


def with_reasons(rule: Rule, rows: DataFrame) -> DataFrame:
    """anchor, candidate, score, rank, reason, recomputed of ranked candidates."""
    most = 1 if rule.unique else rule.max_results
    reason = F.when(F.col("score") < rule.threshold, "below the threshold").when(F.col("rank") > most, "another one is better supported" if rule.unique else "beyond the number of results").otherwise("kept")
    return rows.select("anchor", "candidate", "score", "rank", reason.alias("reason"), "recomputed")
