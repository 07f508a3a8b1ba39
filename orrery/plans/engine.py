"""The façade: named operations over a world, each composing operators and clamped by a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import cube, graph, insights, relational, views
from orrery.operators.scope import Budget, Scope, page_after
from orrery.operators.spatial import distance_join


class Engine:
    """Operations over tables object, event, participation, relation and edge; evidence, insight and member where there are any."""

    def __init__(self, world: dict[str, DataFrame]):
        self.world = world
        self._cube: DataFrame | None = None

    @property
    def cube(self) -> DataFrame:
        """The cube, built once and written to the shared folder."""
        if self._cube is None:
            from orrery.sources.shared import materialise

            o = self.world["object"].select(F.lit("object").alias("kind"), "type", "source", "confidence", "cx", "cy", F.lit(None).cast("long").alias("t_ms"))
            e = self.world["event"].select(F.lit("event").alias("kind"), "type", "source", "confidence", "cx", "cy", "t_ms")
            self._cube = materialise(cube.build(o.unionByName(e)))
        return self._cube

    def query(self, operation: str, scope: dict | None = None, budget: dict | None = None, **given) -> DataFrame:
        run = getattr(self, f"op_{operation}", None)
        if run is None:
            raise ValueError(f"unknown operation: {operation!r}")
        return run(Scope.of(scope), Budget.of(budget), **given)

    def operations(self) -> list[str]:
        return sorted(n[3:] for n in dir(self) if n.startswith("op_"))

    def op_map(self, scope, budget):
        level = cube.fitting_level(self.cube, scope, budget.max_items)
        cells = cube.map_cells(self.cube, scope, level)
        return cube.counts_by_type(cells) if budget.lod == "counts" else cube.rollup_cells(cells, level, budget.max_items)

    def op_timeline(self, scope, budget, bucket="month"):
        window = scope.time_window
        if window is None and bucket == "auto":
            window = tuple(self.world["event"].agg(F.min("t_ms"), F.max("t_ms")).first())
            if window[0] is None:
                bucket = "month"
        if window and window[0] is not None:
            bucket = cube.bucket_of(window, bucket)
        if bucket in ("year", "month"):
            return cube.timeline(self.cube, scope, bucket).orderBy("period", "type").limit(budget.max_items)
        return cube.fine_timeline(self.world["event"].where(scope.rows("event")), {"day": 86_400_000, "hour": 3_600_000}[bucket]).orderBy("bucket_ms", "type").limit(budget.max_items)

    def op_facets(self, scope, budget):
        return cube.facets(self.cube, scope)

    def op_list(self, scope, budget, kind="object", cursor=None):
        key = f"{kind}_id"
        return page_after(self.world[kind].where(scope.rows(kind)), key, cursor, budget.max_items)

    def op_entity(self, scope, budget, id=None):
        return views.details(self.world["object"], self.world["edge"], id)

    def op_neighbourhood(self, scope, budget, focus=None, depth=1):
        types = None
        if scope.types is not None:
            named = [self.world[k].where(F.col("type").isin(*scope.types)).select(F.col(f"{k}_id").alias("node")) for k in ("object", "event")]
            types = named[0].unionByName(named[1])
        return graph.neighbourhood(self.world["edge"], focus, max(1, min(depth, 3)), max(3, budget.max_nodes // 20), types, budget.max_nodes).limit(budget.max_edges)

    def op_path(self, scope, budget, a=None, b=None):
        return graph.shortest_path(self.world["edge"], a, b)

    def op_relations(self, scope, budget, id=None):
        return relational.relations_of(self.world["edge"], self.world["relation"], id)

    def op_related_events(self, scope, budget, id=None, offset=0):
        return relational.related_events(self.world["participation"], self.world["relation"], self.world["event"], id, budget.max_items, offset)

    def op_related_objects(self, scope, budget, id=None):
        return relational.related_objects(self.world["participation"], self.world["relation"], id).orderBy("id").limit(budget.max_items)

    def op_nearby(self, scope, budget, id=None, km=100.0):
        o = self.world["object"]
        one = o.where(F.col("object_id") == id).select(F.col("object_id").alias("a_id"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))
        rest = o.where(scope.rows("object") & (F.col("object_id") != id)).select(F.col("object_id").alias("b_id"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
        return distance_join(one, rest, km).orderBy("km", "b_id").limit(budget.max_items).select("b_id", "km")

    def op_locate(self, scope, budget, id=None):
        return views.locate(id, self.world["object"], self.world["event"], self.world["edge"])

    def op_timeline_of(self, scope, budget, id=None):
        """Events that concern an entity, the first of them, and an event's own."""
        mine = self.world["participation"].where((F.col("object_id") == id) | (F.col("event_id") == id)).select("event_id").distinct()
        rows = self.world["event"].join(mine, "event_id", "left_semi").where("t_ms IS NOT NULL")
        return rows.select("event_id", "type", "t_ms").orderBy("t_ms", "event_id").limit(budget.max_items)

    def op_evidence(self, scope, budget, id=None):
        """What an entity rests on directly."""
        rows = self._optional("evidence", "supports string, support string").where(F.col("supports") == id)
        return rows.select("support").distinct().orderBy("support").limit(budget.max_items)

    def op_sources(self, scope, budget, id=None):
        """Sources of an entity and of all that it rests on."""
        root = self.world["object"].sparkSession.createDataFrame([(id,)], "node string")
        named = [self.world[k].select(F.col(f"{k}_id").alias("id"), "source") for k in ("object", "event")]
        found = views.sources_of(self._optional("evidence", "supports string, support string"), named[0].unionByName(named[1]), root)
        return found.select("source").distinct().orderBy("source").limit(budget.max_items)

    def op_insights(self, scope, budget, id=None):
        """Insights that hold an entity, the best supported first."""
        rows = self._optional("insight", "insight_id string, rule_id string, confidence double")
        return insights.listed(rows, self._optional("member", "insight_id string, entity_id string"), budget.max_items, member=id)

    def _optional(self, name: str, schema: str) -> DataFrame:
        """A table that a world may lack."""
        return self.world[name] if name in self.world else self.world["object"].sparkSession.createDataFrame([], schema)

    def op_context(self, scope, budget, focus=None):
        """section, ref, detail: nine sections of what surrounds one entity, each within min(max_items, 25)."""
        n = min(budget.max_items, 25)
        small = Budget(max_items=n)
        row = lambda df, section, ref, detail: df.select(F.lit(section).alias("section"), F.col(ref).cast("string").alias("ref"), F.col(detail).cast("string").alias("detail"))
        parts = [
            row(self.op_entity(scope, small, focus), "focus", "object_id", "label"),
            row(self.op_sources(scope, small, focus), "sources", "source", "source"),
            row(self.op_evidence(scope, small, focus), "evidence", "support", "support"),
            row(self.op_relations(scope, small, focus).where(F.col("rank") <= n), "relations", "other", "type"),
            row(self.op_related_objects(scope, small, focus), "related_objects", "id", "reason"),
            row(self.op_related_events(scope, small, focus), "related_events", "event_id", "type"),
            row(self.op_timeline_of(scope, small, focus), "timeline", "event_id", "t_ms"),
            row(self.op_nearby(scope, Budget(max_items=min(n, 10)), focus, 100.0), "geography", "b_id", "km"),
            row(self.op_insights(scope, small, focus), "insights", "insight_id", "confidence"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def op_trail(self, scope, budget, trail=()):
        out = None
        for i, focus in enumerate(trail):
            part = self.op_context(scope, budget, focus).withColumn("step", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out


def halve_to_fit(lists: dict[str, list], room: int, size) -> tuple[dict[str, list], bool]:
    """Halves the largest list again and again until the whole fits; whether anything went."""
    cut = False
    while size(lists) > room and any(lists.values()):
        name = max(lists, key=lambda k: size({k: lists[k]}))
        lists = lists | {name: lists[name][: len(lists[name]) // 2]}
        cut = True
    return lists, cut
