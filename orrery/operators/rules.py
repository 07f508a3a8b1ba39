"""Declarative rules compiled to joins.

A rule names variables over a world and constraints between them. The compiler
starts at the anchor and joins one variable after another through a constraint that
generates its candidates: equi-joins for participations, relations and shared
members, bucketed joins for time and distance. The other constraints filter or give
factors of the score. Outputs are tables: associations, contexts, hypotheses.
"""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import confidence
from orrery.functions.geo import EARTH_KM
from orrery.functions.timefn import parse_duration
from orrery.operators.explain import truncated
from orrery.operators.graph import components
from orrery.operators.scope import where_triples
from orrery.operators.spatial import distance_join, step_radius
from orrery.operators.temporal import interval_join

# Outputs and operations of rules, and wording that no explanation may use.
OUTPUTS = ("association", "context", "composite", "relation_hypothesis")
LINK_OPS = ("within_time", "within_distance", "shares_participant", "related")
GENERATING = ("concerns", "related", "shares_participant", "same_member", "within_time", "within_distance")
FORBIDDEN = ("ha causato", "hanno causato", "causato da", "causata da", "provocato", "provocata", "a causa di", "dovuto a", "dovuta a", "because", "caused", "probabilità", "probability", "probabile")
ORDER_KEYS = ("severity", "score", "time", "confidence")
#: Where the joins deal bindings out by a bucket that depends on the anchor alone, its column.
DEALT = "dealt:time"
#: The anchors of a bucket are grouped in so many calls.
SLICES = 8
#: Members of a growing group that are tested at a time, at least; with few candidates left, more, up to so many tests.
FRONT, BLOCK = 8, 1 << 15
#: Columns that a variable brings along, each with the variable's name before it.
CARRIED = ("id", "type", "label", "lon", "lat", "t", "confidence", "severity", "source")


class RuleError(ValueError):
    pass


@dataclass
class Rule:
    id: str
    version: str
    output: str
    anchor: str
    variables: list[dict]
    constraints: list[dict]
    strength: float = 0.8
    threshold: float = 0.3
    unique: bool = False
    max_results: int = 50
    max_candidates: int | None = None  # none named: no bound
    explain: str = ""
    group: dict | None = None
    collect: dict | None = None
    hypothesis: dict | None = None
    var: dict = field(default_factory=dict)


def load(text: str) -> Rule:
    """A rule from its TOML text; what it can't mean is an error."""
    data = tomllib.loads(text)
    r = data.get("rule") or {}
    variables = r.pop("var", [])
    constraints = r.pop("constraint", [])
    rule = Rule(r.get("id", ""), str(r.get("version", "1")), r.get("output", ""), r.get("anchor", ""), variables, constraints, float(r.get("strength", 0.8)), float(r.get("emit_threshold", 0.3)), bool(r.get("unique", False)), int(r.get("max_results", 50)), int(r["max_candidates"]) if "max_candidates" in r else None, r.get("explain", ""), r.get("group"), r.get("collect"), r.get("hypothesis"))
    rule.var = {v["name"]: v for v in variables}
    if not rule.id:
        raise RuleError("a rule needs an id")
    if rule.output not in OUTPUTS:
        raise RuleError(f"{rule.id}: unknown output {rule.output!r}")
    if rule.anchor not in rule.var:
        raise RuleError(f"{rule.id}: the anchor {rule.anchor!r} is no variable")
    for c in constraints:
        for end in ("a", "b"):
            if end in c and c[end] not in rule.var:
                raise RuleError(f"{rule.id}: constraint on unknown variable {c[end]!r}")
    if rule.group:
        if rule.group.get("var") not in rule.var:
            raise RuleError(f"{rule.id}: the group's variable is unknown")
        for link in rule.group.get("link", []):
            if link["op"] not in LINK_OPS:
                raise RuleError(f"{rule.id}: unknown link {link['op']!r}")
        for key, _ in rule.group.get("representative", []):
            if key not in ORDER_KEYS:
                raise RuleError(f"{rule.id}: unknown order {key!r}")
    bad = [w for w in FORBIDDEN if w in rule.explain.lower()]
    if bad:
        raise RuleError(f"{rule.id}: the explanation says {bad[0]!r}")
    return rule


def dependency_order(rules: list[Rule]) -> list[Rule]:
    """Rules over insights after the rules that make those; a cycle is an error."""
    makers = {r.id: r for r in rules}
    needs = {r.id: {t for v in r.variables if v.get("kind") == "insight" for t in v.get("types", []) if t in makers} for r in rules}
    out, done = [], set()
    while len(done) < len(rules):
        ready = sorted(i for i in makers if i not in done and needs[i] <= done)
        if not ready:
            raise RuleError("rules depend on each other in a circle")
        out += [makers[i] for i in ready]
        done |= set(ready)
    return out


@dataclass
class World:
    """Tables a rule runs over. Entities have id, type, label, lon, lat, t, confidence, severity, source, status."""

    objects: DataFrame
    events: DataFrame
    participations: DataFrame  # event_id, object_id, role
    relations: DataFrame  # relation_id, type, from_id, to_id, groups, confidence
    insights: DataFrame | None = None
    members: DataFrame | None = None  # insight_id, role, entity_id


class Compiler:
    def __init__(self, rule: Rule, world: World):
        self.rule, self.world = rule, world

    def scan(self, name: str) -> DataFrame:
        """The candidates of a variable, with its columns named after it."""
        v = self.rule.var[name]
        df = {"object": self.world.objects, "event": self.world.events, "insight": self.world.insights}[v.get("kind", "object")]
        if v.get("types"):
            df = df.where(F.col("type").isin(*v["types"]))
        if "status" in df.columns:
            gone = v.get("status_not", ["retracted"])
            df = df.where(F.coalesce(~F.col("status").isin(*gone), F.lit(True)))
        df = df.where(where_triples(v.get("where", []), F.col))
        have = set(df.columns)
        return df.select(*[(F.col(c) if c in have else F.lit(None).cast("double")).alias(f"{name}_{c}") for c in CARRIED])

    def _links(self, c: dict) -> DataFrame | None:
        """Pairs a, b (ids) of a constraint that holds between known rows; None for time and distance."""
        op, w = c["op"], self.world
        if op == "concerns":
            p = w.participations.where(F.col("role").isin(*c["roles"])) if c.get("roles") else w.participations
            return p.select(F.col("event_id").alias("_a"), F.col("object_id").alias("_b")).distinct()
        if op == "related":
            r = w.relations.where(F.col("type") == c["type"])
            if c.get("min_independent_groups"):
                r = r.where(F.col("groups") >= int(c["min_independent_groups"]))
            return r.groupBy(F.col("from_id").alias("_a"), F.col("to_id").alias("_b")).agg(F.max("confidence").alias("_rel"), F.min_by("relation_id", F.struct(-F.col("confidence"), "relation_id")).alias("_relid"))
        if op == "shares_participant":
            roles = lambda k: w.participations.where(F.col("role").isin(*c[k])) if c.get(k) else w.participations
            a = roles("roles_a").select(F.col("event_id").alias("_a"), "object_id").distinct()
            b = roles("roles_b").select(F.col("event_id").alias("_b"), "object_id").distinct()
            return a.join(b, "object_id").select("_a", "_b").distinct()
        if op == "same_member":
            a = w.members.where(F.col("role") == c["var_a"]).select(F.col("insight_id").alias("_a"), "entity_id")
            b = w.members.where(F.col("role") == c["var_b"]).select(F.col("insight_id").alias("_b"), "entity_id")
            return a.join(b, "entity_id").select("_a", "_b").distinct()
        return None

    def _key(self, c: dict) -> str:
        return f"{c['op']}:{c['a']}-{c['b']}"

    def _join(self, left: DataFrame, c: dict, new: str, keep_all: bool) -> DataFrame:
        """left with candidates of a new variable by a generating constraint; the constraint's measure as a column."""
        a, b = c["a"], c["b"]
        other = b if new == a else a
        right = self.scan(new)
        links = self._links(c)
        key = self._key(c)
        if links is not None:
            mine, theirs = ("_a", "_b") if other == a else ("_b", "_a")
            links = links.withColumnsRenamed({"_rel": f"rel:{key}", "_relid": f"relid:{key}"})
            found = right.join(links, F.col(f"{new}_id") == F.col(theirs)).drop(theirs)
            return left.join(found, F.col(f"{other}_id") == F.col(mine), "left" if keep_all else "inner").drop(mine)
        if c["op"] == "within_time":
            low, high = parse_duration(c.get("min", 0)), parse_duration(c["max"])
            first, second = (left, right) if other == a else (right, left)
            # A bucket of the anchor's time holds all that comes of the anchor: what follows by anchor needs no new deal.
            kept = DEALT if other == b == self.rule.anchor and DEALT not in left.columns else None
            pairs = interval_join(first.withColumn("_ta", F.col(f"{a}_t")), second.withColumn("_tb", F.col(f"{b}_t")), low, high, a_t="_ta", b_t="_tb", bucket=kept)
            pairs = pairs.drop("_ta", "_tb").withColumnRenamed("dt", f"dt:{key}")
        else:
            km, radius = self._radius(c)
            place = lambda df, v, side: df.withColumns({f"{side}_lon": F.col(f"{v}_lon"), f"{side}_lat": F.col(f"{v}_lat")})
            pairs = distance_join(place(left, other, "a"), place(right, new, "b"), km, radius=radius).drop("a_lon", "a_lat", "b_lon", "b_lat").withColumnRenamed("km", f"km:{key}")
        if not keep_all:
            return pairs
        missing = left.join(pairs.select(*[F.col(x).alias(f"_{x}") for x in self._ids(left)]).distinct(), [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in self._ids(left)], "left_anti")
        return pairs.unionByName(missing, allowMissingColumns=True)

    def _ids(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c.endswith("_id") and c[:-3] in self.rule.var]

    def _radius(self, c: dict) -> tuple[float, Column | None]:
        if "km_steps" in c:
            steps = [(float(t), float(k)) for t, k in c["km_steps"]]
            return max(k for _, k in steps), step_radius(F.col(f"{c['km_of'].split('.')[0]}_{c['km_of'].split('.')[1]}"), steps)
        return float(c["km"]), None

    def _test(self, df: DataFrame, c: dict) -> tuple[DataFrame, Column, Column]:
        """df with the measure of a constraint between bound variables; whether it holds, and its factor."""
        a, b, key, op = c["a"], c["b"], self._key(c), c["op"]
        if op in ("ordered", "different"):
            return df, (F.col(f"{a}_id") < F.col(f"{b}_id")) if op == "ordered" else (F.col(f"{a}_id") != F.col(f"{b}_id")), F.lit(1.0)
        if op == "within_time":
            low, high = parse_duration(c.get("min", 0)), parse_duration(c["max"])
            if f"dt:{key}" not in df.columns:
                df = df.withColumn(f"dt:{key}", F.col(f"{b}_t") - F.col(f"{a}_t"))
            dt = F.col(f"`dt:{key}`")
            return df, dt.between(low, high), confidence.time_factor(dt, high)
        if op == "within_distance":
            from orrery.functions.geo import haversine_km

            km, radius = self._radius(c)
            if f"km:{key}" not in df.columns:
                df = df.withColumn(f"km:{key}", haversine_km(F.col(f"{a}_lon"), F.col(f"{a}_lat"), F.col(f"{b}_lon"), F.col(f"{b}_lat")))
            d, limit = F.col(f"`km:{key}`"), F.lit(km) if radius is None else radius
            return df, d <= limit, confidence.distance_factor(d, limit)
        if f"rel:{key}" in df.columns:
            return df, F.col(f"`rel:{key}`").isNotNull(), F.lit(1.0)
        mark = f"ok:{key}"
        if mark not in df.columns:
            links = self._links(c)
            extra = [F.col("_rel").alias(f"rel:{key}"), F.col("_relid").alias(f"relid:{key}")] if "_rel" in links.columns else []
            links = links.select(F.col("_a").alias("__a"), F.col("_b").alias("__b"), F.lit(True).alias(mark), *extra)
            df = df.join(links, (F.col(f"{a}_id") == F.col("__a")) & (F.col(f"{b}_id") == F.col("__b")), "left").drop("__a", "__b")
        return df, F.coalesce(F.col(f"`{mark}`"), F.lit(False)), F.lit(1.0)

    def bindings(self, only: DataFrame | None = None, start: str | None = None) -> DataFrame:
        """All complete bindings with columns <var>_<carried>, factor:<constraint> and score.

        The joins begin at a variable, the anchor if none is named; only: ids (column id)
        to which that variable is held, for an incremental run, whose cost then
        follows those ids and not the world.

        A rule with max_candidates keeps, of the candidates that a variable has for one
        binding, the first by id, and ten times as many results of an anchor; only where
        the joins begin at the anchor, so that no change goes unseen.
        """
        rule, start = self.rule, start or self.rule.anchor
        bounded = rule.max_candidates is not None and start == rule.anchor
        df = self.scan(start)
        if only is not None:
            df = df.join(only.select(F.col("id").alias("_i")), F.col(f"{start}_id") == F.col("_i"), "left_semi")
        bound, tested, factors = [start], set(), {}

        def test_all(df: DataFrame) -> DataFrame:
            for i, c in enumerate(rule.constraints):
                if i in tested or not {c["a"], c["b"]} <= set(bound):
                    continue
                tested.add(i)
                df, holds, factor = self._test(df, c)
                absent = F.col(f"{c['a']}_id").isNull() | F.col(f"{c['b']}_id").isNull()
                lenient = any(rule.var[c[e]].get("optional") for e in ("a", "b"))
                if c.get("optional"):
                    penalty = F.lit(float(c.get("penalty", 1.0)))
                    df = df.withColumn(f"factor:{self._key(c)}", F.when(~absent & F.coalesce(holds, F.lit(False)), factor).otherwise(penalty))
                    factors[self._key(c)] = True
                else:
                    passes = F.coalesce(holds, F.lit(False))
                    df = df.where((absent | passes) if lenient else passes)
                    if c.get("score"):
                        df = df.withColumn(f"factor:{self._key(c)}", F.when(absent, F.lit(1.0)).otherwise(factor))
                        factors[self._key(c)] = True
            return df

        left = [v["name"] for v in rule.variables if v["name"] != start]
        while left:
            choices = [(GENERATING.index(c["op"]), left.index(n), n, c) for n in left for c in rule.constraints if c["op"] in GENERATING and not (c.get("optional") and not rule.var[n].get("optional")) and n in (c["a"], c["b"]) and (c["b"] if n == c["a"] else c["a"]) in bound]
            required = [x for x in choices if not rule.var[x[2]].get("optional")] or choices
            if not required:
                raise RuleError(f"{rule.id}: {left[0]!r} has no constraint that finds it")
            _, _, name, c = min(required, key=lambda x: x[:2])
            df = self._join(df, c, name, bool(rule.var[name].get("optional")))
            if bounded:
                df = truncated(df, [f"{v}_id" for v in bound], f"{name}_id", rule.max_candidates)
            bound.append(name)
            left.remove(name)
            df = test_all(df)
        df = test_all(df)
        if bounded and len(bound) > 1:
            order = [F.col(f"{v}_id").asc_nulls_first() for v in bound[1:]]
            df = df.withColumn("_r", F.row_number().over(Window.partitionBy(f"{start}_id").orderBy(*order))).where(F.col("_r") <= 10 * rule.max_candidates).drop("_r")
        confs = [F.col(f"{v}_confidence") for v in bound] + [F.col(f"`{c}`") for c in df.columns if c.startswith("rel:")]
        least = F.round(F.array_min(F.array(*confs)), 12)
        score = F.lit(rule.strength) * F.coalesce(least, F.lit(0.0))
        for key in sorted(factors):
            score = score * F.round(F.col(f"`factor:{key}`"), 12)
        return df.withColumn("score", score)


def members_key(rule: Rule) -> Column:
    """A text that orders bindings with equal scores."""
    names = sorted(v["name"] for v in rule.variables)
    return F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(f"{n}_id")) for n in names])


def associations(rule: Rule, bindings: DataFrame) -> DataFrame:
    """The bindings that reach the threshold: the best of each anchor if unique, else the first max_results."""
    keep = bindings.where(F.col("score") >= rule.threshold).withColumn("_key", members_key(rule))
    w = Window.partitionBy(f"{rule.anchor}_id").orderBy(F.desc("score"), "_key")
    return keep.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (1 if rule.unique else rule.max_results)).drop("_key")


def contexts(rule: Rule, bindings: DataFrame) -> DataFrame:
    """anchor, n, nearest_id, nearest_km, score, members and n_<var> for each counted variable.

    The nearest limit distinct members count; the score is that of the nearest alone.
    """
    a, v = f"{rule.anchor}_id", rule.collect["var"]
    limit = int(rule.collect.get("limit", 20))
    kms = [c for c in bindings.columns if c.startswith("km:") and v in c.split(":")[-1].split("-")]
    km = F.coalesce(*[F.col(f"`{c}`") for c in kms], F.lit(0.0)) if kms else F.lit(0.0)
    rows = bindings.where(F.col(f"{v}_id").isNotNull()).withColumn("_km", km)
    # The score takes the anchor and the member alone, not the counted variables.
    least = F.round(F.least(f"{rule.anchor}_confidence", f"{v}_confidence"), 12)
    score = F.lit(rule.strength) * least
    for c in sorted(x for x in rows.columns if x.startswith("factor:")):
        score = score * F.round(F.col(f"`{c}`"), 12)
    per = rows.groupBy(F.col(a).alias("anchor"), F.col(f"{v}_id").alias("m")).agg(F.min(F.struct(F.col("_km").alias("km"), (-score).alias("s"))).alias("best"))
    w = Window.partitionBy("anchor").orderBy("best.km", "m")
    near = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    out = near.groupBy("anchor").agg(F.count("*").alias("n"), F.min(F.struct("rank", "m", "best")).alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "m"))), lambda x: x["m"]), ",").alias("members"))
    out = out.select("anchor", "n", F.col("first.m").alias("nearest_id"), F.col("first.best.km").alias("nearest_km"), (-F.col("first.best.s")).alias("score"), "members").where(F.col("score") >= rule.threshold)
    for extra in rule.collect.get("count", []):
        counted = bindings.groupBy(F.col(a).alias("anchor")).agg(F.countDistinct(f"{extra}_id").alias(f"n_{extra}"))
        out = out.join(counted, "anchor", "left")
    return out


def hypotheses(rule: Rule, bindings: DataFrame) -> DataFrame:
    """src, kind, type, dst, score: one edge for each pair that the rule proposes."""
    h = rule.hypothesis
    rows = associations(rule, bindings)
    return rows.groupBy(F.col(f"{h['from']}_id").alias("src"), F.col(f"{h['to']}_id").alias("dst")).agg(F.max("score").alias("score")).select("src", F.lit("hypothesis").alias("kind"), F.lit(h["type"]).alias("type"), "dst", "score")


def grouped(rule: Rule, bindings: DataFrame, world: World) -> DataFrame:
    """anchor, representative, support_member, support, n_members, members, n_discarded: candidates in linked groups.

    Each candidate counts with its best binding. Candidates of an anchor that fulfil
    all link criteria belong together, and so do chains of them. A group's support is
    its best member's score (or its representative's), and its representative comes
    first in the declared order.
    """
    g, v = rule.group, rule.group["var"]
    if {x["op"] for x in g.get("link", [])} <= {"within_time", "within_distance"}:
        return _grouped_by_anchor(rule, bindings, g.get("link", []))
    a = f"{rule.anchor}_id"
    cols = {"anchor": F.col(a), "id": F.col(f"{v}_id"), "lon": F.col(f"{v}_lon"), "lat": F.col(f"{v}_lat"), "t": F.col(f"{v}_t"), "severity": F.col(f"{v}_severity"), "confidence": F.col(f"{v}_confidence"), "score": F.col("score")}
    cands = bindings.where(F.col(f"{v}_id").isNotNull()).select(*[c.alias(n) for n, c in cols.items()])
    cands = cands.groupBy("anchor", "id").agg(*[F.max_by(c, "score").alias(c) for c in ("lon", "lat", "t", "severity", "confidence")], F.max("score").alias("score"))
    from orrery.sources.shared import materialise

    cands = materialise(cands)
    links = g.get("link", [])
    time = next((x for x in links if x["op"] == "within_time"), None)
    x, y = (cands.select("anchor", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "lon", "lat", "t")]) for s in ("x", "y"))
    if time:
        span = parse_duration(time["max"])
        pairs = interval_join(x, y, -span, span, on=["anchor"], a_t="x_t", b_t="y_t").drop("dt")
    else:
        pairs = x.join(y, "anchor")
    pairs = pairs.where("x_id < y_id")
    for link in links:
        if link["op"] == "within_distance":
            from orrery.functions.geo import haversine_km

            pairs = pairs.where(haversine_km(F.col("x_lon"), F.col("x_lat"), F.col("y_lon"), F.col("y_lat")) <= float(link["km"]))
        elif link["op"] in ("shares_participant", "related"):
            both = Compiler(rule, world)._links({"op": link["op"], "roles_a": link.get("roles"), "roles_b": link.get("roles"), "type": link.get("type")}).select("_a", "_b")
            if link["op"] == "related":
                both = both.unionByName(both.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct()
            pairs = pairs.join(both, (F.col("x_id") == F.col("_a")) & (F.col("y_id") == F.col("_b")), "left_semi")
    name = lambda c: F.xxhash64("anchor", c)
    labels = components(pairs.select(name("x_id").alias("src"), name("y_id").alias("dst")))
    rows = cands.withColumn("_node", name("id")).join(labels.withColumnRenamed("node", "_node"), "_node", "left").withColumn("grp", F.coalesce("label", "_node"))
    order = []
    for key, way in g.get("representative", [["severity", "desc"], ["score", "desc"]]):
        c = F.coalesce(F.col({"time": "t"}.get(key, key)).cast("double"), F.lit(float("-inf")))
        order.append(-c if way == "desc" else c)
    first = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "id", "score")
    per = rows.groupBy("anchor", "grp").agg(F.min(first).alias("rep"), F.max(F.struct("score", "id")).alias("sup"), F.count("*").alias("n_members"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members"))
    support = F.col("sup.score") if g.get("support", "max_member") == "max_member" else F.col("rep.score")
    per = per.withColumn("support", support)
    w = Window.partitionBy("anchor")
    by = w.orderBy(F.desc("support"), "rep")
    per = per.withColumns({"_r": F.row_number().over(by), "_ok": F.sum(F.when(F.col("support") >= rule.threshold, 1).otherwise(0)).over(w), "_all": F.count("*").over(w)})
    kept = per.where((F.col("support") >= rule.threshold) & ((F.col("_r") == 1) if rule.unique else F.lit(True)))
    gone = F.col("_all") - (F.least(F.col("_ok"), F.lit(1)) if rule.unique else F.col("_ok"))
    return kept.select("anchor", F.col("rep.id").alias("representative"), F.col("sup.id").alias("support_member"), "support", "n_members", "members", gone.cast("long").alias("n_discarded"))


def dealt(rule: Rule, bindings: DataFrame) -> list[str]:
    """Columns that hold all bindings of an anchor together: itself, after the bucket by which they are dealt out already."""
    return [c for c in (DEALT,) if c in bindings.columns] + [f"{rule.anchor}_id"]


def link_labels(t: np.ndarray, lon: np.ndarray, lat: np.ndarray, span: int | None, km: float | None, p: np.ndarray | None = None) -> np.ndarray:
    """A number for each candidate, the same for those that chains of links join. A place or time that is missing (NaN) links with nothing.

    Groups grow from a candidate on; each step tests only what no group holds yet, in
    blocks, so that memory follows the candidates and not their pairs. The newest of a
    group come first: they lie farthest out and reach most. p: the places as unit vectors.
    """
    x, y = np.radians(lon), np.radians(lat)
    if p is None:
        p = np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)
    edge = None if km is None else math.cos(min(max(km, 0.0) / EARTH_KM, math.pi))

    def near(f: np.ndarray, r: np.ndarray) -> np.ndarray:
        ok = np.ones((len(f), len(r)), bool) if span is None else np.abs(t[f][:, None] - t[r]) <= span
        if km is not None:
            dot = p[f] @ p[r].T
            dubious = np.abs(dot - edge) < 1e-12
            inside = dot >= edge
            if dubious.any():  # at the very edge, and for tiny distances, the exact formula decides
                i0, j0 = np.nonzero(dubious)
                i, j = f[i0], r[j0]
                h = np.sin((y[j] - y[i]) / 2) ** 2 + np.cos(y[i]) * np.cos(y[j]) * np.sin((x[j] - x[i]) / 2) ** 2
                inside[i0, j0] = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h))) <= km
            ok &= inside
        return ok.any(axis=0)

    label, rest, group = np.full(len(t), -1), np.arange(len(t)), 0
    while len(rest):
        front, rest = rest[:1], rest[1:]
        label[front] = group
        while len(front) and len(rest):
            n = max(FRONT, BLOCK // len(rest))
            hit = near(front[-n:], rest)
            label[rest[hit]] = group
            front, rest = np.concatenate((front[:-n], rest[hit])), rest[~hit]
        group += 1
    return label


def _grouped_by_anchor(rule: Rule, bindings: DataFrame, links: list[dict]) -> DataFrame:
    """grouped() for links of time and distance: all of an anchor's candidates come to one call, without their pairs ever being rows."""
    g, v = rule.group, rule.group["var"]
    keys = [F.col(f"`{c}`") for c in dealt(rule, bindings)]
    if len(keys) > 1:  # many anchors a call, still without a new deal
        keys[-1] = F.pmod(F.xxhash64(keys[-1]), F.lit(SLICES))
    spans, kms = [parse_duration(x["max"]) for x in links if x["op"] == "within_time"], [float(x["km"]) for x in links if x["op"] == "within_distance"]
    span, km = min(spans, default=None), min(kms, default=None)
    order = g.get("representative", [["severity", "desc"], ["score", "desc"]])
    by_sup, unique, threshold = g.get("support", "max_member") == "max_member", rule.unique, rule.threshold
    cols = {"anchor": F.col(f"{rule.anchor}_id"), "id": F.col(f"{v}_id"), **{c: F.col(f"{v}_{c}").cast("double") for c in ("lon", "lat", "t", "severity", "confidence")}, "score": F.col("score")}
    rows = bindings.where(F.col(f"{v}_id").isNotNull()).select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], *[c.alias(n) for n, c in cols.items()])
    out = ["anchor", "representative", "support_member", "support", "n_members", "members", "n_discarded"]

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        anchor, ident = df["anchor"].to_numpy(object), df["id"].to_numpy(object)
        nums = {c: df[c].to_numpy(float) for c in ("t", "lon", "lat", "severity", "confidence", "score")}
        at = np.lexsort((-nums["score"], pd.factorize(ident, sort=True)[0], pd.factorize(anchor)[0]))
        again = (anchor[at][1:] == anchor[at][:-1]) & (ident[at][1:] == ident[at][:-1])
        at = at[np.concatenate(([True], ~again))]  # the best binding of each candidate; ids ascend in each anchor
        anchor, ident, nums = anchor[at], ident[at], {c: x[at] for c, x in nums.items()}
        rows = []
        for one in np.split(np.arange(len(at)), np.flatnonzero(anchor[1:] != anchor[:-1]) + 1):
            x = {c: y[one] for c, y in nums.items()}
            grp = link_labels(x["t"], x["lon"], x["lat"], span, km)
            signed = [(-1.0 if way == "desc" else 1.0) * np.nan_to_num(x[{"time": "t"}.get(k, k)], nan=-np.inf, posinf=np.inf, neginf=-np.inf) for k, way in order]
            place = np.argsort(np.lexsort((*reversed(signed), np.zeros(len(one)))))
            by, score, groups = np.argsort(grp, kind="stable"), x["score"], []
            for m in np.split(by, np.flatnonzero(np.diff(grp[by])) + 1):
                first, best = m[np.argmin(place[m])], m[::-1][np.argmax(score[m[::-1]])]
                groups.append((-(score[best] if by_sup else score[first]), tuple(s[first] for s in signed), ident[one[first]], score[first], best, m))
            groups.sort(key=lambda y: y[:4])
            ok = [y for y in groups if -y[0] >= threshold]
            gone = len(groups) - (min(len(ok), 1) if unique else len(ok))
            for y in ok[:1] if unique else ok:
                rows.append((anchor[one[0]], y[2], ident[one[y[4]]], float(-y[0]), len(y[5]), ",".join(ident[one[y[5]]]), gone))
        return pd.DataFrame(rows, columns=out)

    kinds = {**dict.fromkeys(out, "string"), "support": "double", "n_members": "long", "n_discarded": "long"}
    return rows.groupBy(*[f"_k{i}" for i in range(len(keys))]).applyInPandas(solve, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def lifecycle(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change of insights (id, anchor, value): new, kept, superseded (by the best new one of the anchor) or stale."""
    best = new.groupBy("anchor").agg(F.max(F.struct("value", "id"))["id"].alias("by_id"))
    o, n = old.select("id", F.col("anchor").alias("o_anchor")), new.select("id", F.col("anchor").alias("n_anchor"))
    rows = o.join(n, "id", "full_outer").join(best, F.col("o_anchor") == F.col("anchor"), "left")
    change = F.when(F.col("o_anchor").isNull(), "new").when(F.col("n_anchor").isNotNull(), "kept").when(F.col("by_id").isNotNull(), "superseded").otherwise("stale")
    return rows.select("id", change.alias("change"), F.when(change == "superseded", F.col("by_id")).alias("by_id"))


def affected_anchors(rule: Rule, world: World, changed: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """id of anchors to compute again when entities changed: themselves, those bound to a changed one, those of insights that hold one.

    Bindings are solved from the changed entities on, variable by variable.
    """
    c = Compiler(rule, world)
    found = c.scan(rule.anchor).select(F.col(f"{rule.anchor}_id").alias("id")).join(changed.select("id"), "id", "left_semi")
    for v in rule.variables:
        if v["name"] != rule.anchor:
            found = found.unionByName(c.bindings(changed, v["name"]).select(F.col(f"{rule.anchor}_id").alias("id")))
    if members is not None:
        held = members.join(changed.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        found = found.unionByName(members.join(held.select("insight_id").distinct(), "insight_id", "left_semi").where(F.col("role") == rule.anchor).select(F.col("entity_id").alias("id")))
    return found.where("id IS NOT NULL").distinct()


def run_in_full(n_changed: int, n_anchors: int) -> bool:
    """Whether so many changes make a run over all anchors the cheaper one."""
    return n_changed > 0.2 * n_anchors
