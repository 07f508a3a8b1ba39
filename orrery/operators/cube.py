"""The aggregate cube and the projections that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import confidence, geo, timefn
from orrery.operators.scope import Scope, month_of

LEVELS = (-1, 2, 4, 6, 8)
KEYS = ("level", "period", "cx", "cy", "kind", "type", "source", "band", "geo")


def build(rows: DataFrame) -> DataFrame:
    """The cube of rows with kind, type, source, confidence, cx, cy (null without a place) and t_ms (null for objects).

    Each row counts at five levels and in the periods ever, year and month; rows
    without a place count at level -1 alone. One shuffle with partial sums.
    """
    placed = F.col("cx").isNotNull()
    levels = F.when(placed, F.array(*[F.lit(x) for x in LEVELS])).otherwise(F.array(F.lit(-1)))
    out = rows.select("kind", "type", "source", "cx", "cy", "confidence", confidence.band(F.col("confidence")).alias("band"), placed.cast("int").alias("geo"), F.explode(levels).alias("level"), timefn.periods(F.col("t_ms")).alias("_periods"))
    out = out.withColumn("period", F.explode("_periods"))
    shrink = lambda c: F.when(F.col("level") < 0, F.lit(-1)).otherwise(F.expr(f"shiftright({c}, 8 - level)"))
    out = out.withColumns({"cx": shrink("cx"), "cy": shrink("cy")})
    return out.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("maxconf"))


def apply_delta(cube: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The cube after rows came and went; cells without rows go, the greatest confidence never falls."""
    parts = cube.unionByName(build(added)).unionByName(build(removed).withColumns({"n": -F.col("n"), "maxconf": F.lit(0.0)}))
    return parts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.max("maxconf").alias("maxconf")).where("n > 0")


def map_cells(cube: DataFrame, scope: Scope, level: int | None = None) -> DataFrame:
    """cx, cy, kind, type, n, maxconf of the cells in scope."""
    rows = cube.where(scope.cube_rows(scope.level() if level is None else level))
    return rows.groupBy("cx", "cy", "kind", "type").agg(F.sum("n").cast("long").alias("n"), F.max("maxconf").alias("maxconf"))


def fitting_level(cube: DataFrame, scope: Scope, max_items: int) -> int:
    """The finest level, at most the scope's, whose cells fit; 2 if none does. One job counts all levels."""
    top = scope.level()
    levels = [x for x in LEVELS if 2 <= x <= top]
    counts = {}
    rows = None
    for x in levels:
        part = cube.where(scope.cube_rows(x)).select(F.lit(x).alias("l"), "cx", "cy")
        rows = part if rows is None else rows.unionByName(part)
    for r in rows.groupBy("l").agg(F.countDistinct("cx", "cy").alias("n")).collect():  # a row for each level
        counts[r["l"]] = r["n"]
    return next((x for x in reversed(levels) if counts.get(x, 0) <= max_items), 2)


def rollup_cells(cells: DataFrame, level: int, max_items: int | None = None) -> DataFrame:
    """A row for each cell: n, dominant type (most rows, then name), n_types, maxconf, bounds; the densest only, if asked."""
    per = cells.groupBy("cx", "cy", "type").agg(F.sum("n").alias("n"), F.max("maxconf").alias("maxconf"))
    out = per.groupBy("cx", "cy").agg(F.sum("n").cast("long").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "type"))["type"].alias("dominant_type"), F.count("*").alias("n_types"), F.max("maxconf").alias("maxconf"))
    w, e, s, n = geo.cell_bounds(level, F.col("cx"), F.col("cy"))
    out = out.withColumns({"min_lon": w, "max_lon": e, "min_lat": s, "max_lat": n})
    return out if max_items is None else out.orderBy(F.desc("n"), "cx", "cy").limit(max_items)


def counts_by_type(cells: DataFrame) -> DataFrame:
    return cells.groupBy("kind", "type").agg(F.sum("n").cast("long").alias("n"))


def without_place(cube: DataFrame, scope: Scope) -> DataFrame:
    """n: rows in scope that no map shows."""
    rows = cube.where(scope.with_(viewport=None).cube_rows(-1)).where("geo = 0")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def timeline(cube: DataFrame, scope: Scope, bucket: str) -> DataFrame:
    """period, kind, type, n by years or months from the cube, for all of the scope.

    Within a time window years count by their whole-year cells where the window holds them
    and else by their months; places count by the cells of the scope's level.
    """
    code = F.col("period")
    tests = [F.col("kind") != "object", code > 0, F.col("level") == (-1 if scope.viewport is None else scope.level())]
    if scope.time_window is None:
        tests.append(code % 100 == 0 if bucket == "year" else code % 100 > 0)
    else:
        first, last = (month_of(t) for t in scope.time_window)
        tests.append(code.isin(*(timefn.month_codes(first, last) if bucket == "year" else [m // 12 * 100 + m % 12 + 1 for m in range(first, last + 1)])))
    rows = cube.where(scope.cube_where(*tests))
    return rows.groupBy((F.floor(code / 100) * 100 if bucket == "year" else code).cast("int").alias("period"), "kind", "type").agg(F.sum("n").cast("long").alias("n"))


def fine_timeline(events: DataFrame, step_ms: int) -> DataFrame:
    """bucket_ms, type, n by days or hours from the events themselves."""
    return events.where("t_ms IS NOT NULL").groupBy(timefn.bucket(F.col("t_ms"), step_ms).alias("bucket_ms"), "type").agg(F.count("*").alias("n"))


#: Milliseconds in a bucket, mean ones for months and years, and the most buckets of an answer.
BUCKET_MS = {"hour": 3600e3, "day": 86400e3, "month": 30.44 * 86400e3, "year": 365.25 * 86400e3}
MAX_BUCKETS = 400


def bucket_of(window: tuple[int, int], wanted: str = "auto") -> str:
    """The bucket of a time window: by its length, or as wanted, if that makes no more than MAX_BUCKETS; else the finest that does."""
    span, day = window[1] - window[0], 86_400_000
    if wanted == "auto":
        return next((b for b, days in (("year", 3 * 365), ("month", 90), ("day", 3)) if span > days * day), "hour")
    if span / BUCKET_MS[wanted] <= MAX_BUCKETS:
        return wanted
    return next((b for b in BUCKET_MS if span / BUCKET_MS[b] <= MAX_BUCKETS), "year")


def facets(cube: DataFrame, scope: Scope) -> DataFrame:
    """dim, value, n over kind, type, source, band and geometry, as one grouping-sets aggregation."""
    rows = cube.where(scope.with_(viewport=None).cube_rows(-1))
    label = F.element_at(F.array(*[F.lit(confidence.BAND_LABEL[b]) for b in (0, 1, 2)]), F.col("band") + 1)
    rows = rows.select("kind", "type", "source", label.alias("band"), F.when(F.col("geo") == 1, "located").otherwise("not located").alias("geometry"), "n")
    sets = rows.groupingSets([["kind"], ["type"], ["source"], ["band"], ["geometry"]], "kind", "type", "source", "band", "geometry").agg(F.sum("n").cast("long").alias("n"), F.grouping_id().alias("_g"))
    names = {0b01111: "kind", 0b10111: "type", 0b11011: "source", 0b11101: "band", 0b11110: "geometry"}
    dim = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for code, name in names.items():
        dim, value = F.when(F.col("_g") == code, name).otherwise(dim), F.when(F.col("_g") == code, F.col(name)).otherwise(value)
    return sets.select(dim.alias("dim"), value.alias("value"), "n")


def live_count(rows: DataFrame, scope: Scope, kind: str) -> DataFrame:
    """type, n counted on the rows themselves, with the cube's coarser confidence."""
    coarse = rows.where(scope.with_(min_confidence=None).rows(kind))
    if scope.min_confidence is not None:
        coarse = coarse.where(confidence.band(F.col("confidence")) >= confidence.band_floor(scope.min_confidence))
    return coarse.groupBy("type").agg(F.count("*").alias("n"))


def hubs(edges: DataFrame, least: int) -> DataFrame:
    """node, n_out, n_in, n of nodes with so many edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("n")).where(F.col("n") >= least)


def top_per_group(df: DataFrame, group: list, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank and the number that remains."""
    w = Window.partitionBy(*group)
    df = df.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return df.where(F.col("rank") <= k).withColumn("remaining", F.greatest(F.col("_n") - k, F.lit(0)).cast("long")).drop("_n")
