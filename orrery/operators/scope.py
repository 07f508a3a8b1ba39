"""Scopes (what a query is about) and budgets (how much it may return)."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import confidence, geo, timefn

MODES = ("world", "focus", "trail")
MAX_ITEMS, MAX_NODES, MAX_EDGES, MAX_BYTES = 5000, 2000, 4000, 10_000_000
LOCAL_ZOOM = 10


@dataclass(frozen=True)
class Scope:
    """What a query covers. Unknown keys are ignored; mode, focus and text choose nothing by themselves."""

    mode: str = "world"
    focus: str | None = None
    types: tuple[str, ...] | None = None
    natures: tuple[str, ...] | None = None
    time_window: tuple[int, int] | None = None
    as_of: int | None = None
    viewport: tuple[float, float, float, float] | None = None
    z: float | None = None
    min_confidence: float | None = None
    sources: tuple[str, ...] | None = None
    status: tuple[str, ...] | None = None
    text: str | None = None

    @classmethod
    def of(cls, given: dict | None) -> Scope:
        known = {f.name for f in fields(cls)}
        lists = lambda v: tuple(v) if isinstance(v, list) else v
        scope = cls(**{k: lists(v) for k, v in (given or {}).items() if k in known})
        if scope.mode not in MODES:
            raise ValueError(f"unknown mode: {scope.mode!r}")
        return scope

    def rows(self, kind: str, recorded: str | None = None) -> Column:
        """The predicate on rows of objects, events or insights; confidence is compared exactly here."""
        tests = []
        if self.types is not None:
            tests.append(F.col("type").isin(*self.types))
        if self.min_confidence is not None:
            tests.append(F.coalesce("confidence", F.lit(0.0)) >= self.min_confidence)
        if self.sources is not None and kind != "insight":
            tests.append(F.col("source").isin(*self.sources))
        if self.time_window is not None and kind in ("event", "insight"):
            tests.append(F.coalesce(F.col("t_ms").between(*self.time_window), F.lit(False)))
        if self.as_of is not None and recorded:
            tests.append(F.col(recorded) <= self.as_of)
        if self.status is not None:
            tests.append(F.col("status").isin(*self.status))
        return _all(tests)

    def cube_rows(self, level: int) -> Column:
        """The predicate on the cube: confidence by bands, time by whole months, space by cells."""
        tests = [F.col("level") == level]
        tests.append(F.when(F.col("kind") == "object", F.col("period") == 0).otherwise(F.col("period").isin(*self.period_codes())))
        return self.cube_where(*tests, level=level)

    def cube_where(self, *tests: Column, level: int | None = None) -> Column:
        """The tests, and the scope's own of types, sources, confidence and place; cells are those of the level, or else of its own."""
        tests = list(tests)
        if self.types is not None:
            tests.append(F.col("type").isin(*self.types))
        if self.sources is not None:
            tests.append(F.col("source").isin(*self.sources))
        if self.min_confidence is not None:
            tests.append(F.col("band") >= confidence.band_floor(self.min_confidence))
        if self.viewport is not None:
            tests.append(in_ranges(F.col("cx"), F.col("cy"), geo.viewport_ranges(self.viewport, self.level() if level is None else level)))
        return _all(tests)

    def period_codes(self) -> list[int]:
        if self.time_window is None:
            return [0]
        first, last = (month_of(t) for t in self.time_window)
        return timefn.month_codes(first, last)

    def level(self) -> int:
        return geo.level_of_zoom(self.z)

    def with_(self, **changes) -> Scope:
        return replace(self, **changes)


def month_of(ms: int) -> int:
    from datetime import datetime, timezone

    at = datetime.fromtimestamp(ms / 1000, tz=timezone.utc)
    return at.year * 12 + at.month - 1


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def in_ranges(cx: Column, cy: Column, ranges) -> Column:
    return reduce(lambda a, b: a | b, [cx.between(x0, x1) & cy.between(y0, y1) for x0, x1, y0, y1 in ranges])


def in_viewport(lon: Column, lat: Column, viewport) -> Column:
    """Exact containment of a point, across the antimeridian too."""
    west, south, east, north = viewport
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return F.coalesce(across & lat.between(south, north), F.lit(False))


@dataclass(frozen=True)
class Budget:
    """Limits of an answer, clamped to the greatest allowed."""

    max_items: int = 500
    max_nodes: int = 500
    max_edges: int = 1000
    max_bytes: int = 1_000_000
    lod: str = "refs"

    @classmethod
    def of(cls, given: dict | None) -> Budget:
        most = {"max_items": MAX_ITEMS, "max_nodes": MAX_NODES, "max_edges": MAX_EDGES, "max_bytes": MAX_BYTES}
        kept = {}
        for k, v in (given or {}).items():
            if k in most:
                if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                    raise ValueError(f"{k} must be a positive integer")
                kept[k] = min(v, most[k])
            elif k == "lod":
                if v not in ("counts", "cells", "refs", "details"):
                    raise ValueError(f"unknown lod: {v!r}")
                kept[k] = v
        return cls(**kept)


def page_after(df: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The page of n + 1 rows beyond a key; the last tells whether there are more."""
    rest = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    return rest.orderBy(key).limit(n + 1)


def page_after_score(df: DataFrame, score: str, key: str, cursor: tuple | None, n: int) -> DataFrame:
    """The page beyond (score descending, key ascending)."""
    if cursor is not None:
        s, k = cursor
        df = df.where((F.col(score) < F.lit(s)) | ((F.col(score) == F.lit(s)) & (F.col(key) > F.lit(k))))
    return df.orderBy(F.desc(score), F.asc(key)).limit(n + 1)


def page_offset(df: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


OPERATIONS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


def where_triples(triples: list, prop) -> Column:
    """Conditions [name, op, value] on properties; prop(name) is the property's column. A missing property fails."""
    tests = []
    for name, op, value in triples:
        c = prop(name)
        if op in OPERATIONS:
            tests.append(F.coalesce(OPERATIONS[op](c, F.lit(value)), F.lit(False)))
        elif op in ("in", "not_in"):
            inside = c.isin(*value)
            tests.append(F.coalesce(inside if op == "in" else ~inside, F.lit(False)))
        else:
            raise ValueError(f"unknown operation: {op!r}")
    return _all(tests)


def live(df: DataFrame) -> DataFrame:
    """Rows that are neither retracted nor merged into another."""
    kept = df.where(F.coalesce(F.col("status") != "retracted", F.lit(True)))
    return kept.where(F.col("merged_into").isNull()) if "merged_into" in df.columns else kept


def within_bytes(df: DataFrame, order: list[Column], text: Column, room: int, by: list[Column] | None = None) -> DataFrame:
    """The first rows whose serialised lengths together fit, within each group of by."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("bytes_so_far", F.sum(F.octet_length(text)).over(w).cast("long")).where(F.col("bytes_so_far") <= room)
