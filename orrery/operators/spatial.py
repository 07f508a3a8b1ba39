"""Joins in space. Every one is an equi-join on cells or bands with an exact filter after it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geo

_KM_PER_DEGREE = 111.0  # less than the true value, so that bands are wide enough
#: A cell is a chord over so many long.
CELLS = 2
#: Slack of squared chords, far beyond the error of doubles and far below what an exact test would notice to cost.
_SLACK = 1e-12


def _chord(km: float) -> float:
    """The straight line, in radii, between points that are so far apart on the sphere."""
    return 2 * math.sin(min(max(km, 0.0) / geo.EARTH_KM, math.pi) / 2)


def _in_space(df: DataFrame, side: str) -> DataFrame:
    """df's rows that have a place, with its point on the unit sphere as _<side>x, _<side>y, _<side>z."""
    lon, lat = F.radians(F.col(f"{side}_lon")), F.radians(F.col(f"{side}_lat"))
    rows = df.where(F.col(f"{side}_lon").isNotNull() & F.col(f"{side}_lat").isNotNull())
    return rows.withColumns({f"_{side}x": F.cos(lat) * F.cos(lon), f"_{side}y": F.cos(lat) * F.sin(lon), f"_{side}z": F.sin(lat)})


def _in_cells(a: DataFrame, b: DataFrame, km: float) -> tuple[DataFrame, DataFrame]:
    """a and b with their points and the cells _cx, _cy, _cz of space: a row of a in its own, one of b in all that hold points within km of it."""
    chord = _chord(km)
    width = max(chord / CELLS, 1e-4) * (1 + 1e-6)
    axes = ("x", "y", "z")
    left = _in_space(a, "a").withColumns({f"_c{k}": F.floor((F.col(f"_a{k}") + 1) / width).cast("int") for k in axes})
    right, away = _in_space(b, "b"), F.lit(0.0)
    for k in axes:
        at = F.col(f"_b{k}") + 1
        right = right.withColumn(f"_c{k}", F.explode(F.array(*[F.floor(at / width).cast("int") + i for i in range(-CELLS, CELLS + 1)])))
        gap = F.greatest(F.col(f"_c{k}") * width - at, at - (F.col(f"_c{k}") + 1) * width, F.lit(0.0))
        away = away + gap * gap
        right = right.where(away <= chord * chord + _SLACK)
    # Cells that the sphere does not pass through hold no point.
    least = sum((F.pow(F.greatest(F.col(f"_c{k}") * width - 1, 1 - (F.col(f"_c{k}") + 1) * width, F.lit(0.0)), 2) for k in axes), F.lit(0.0))
    most = sum((F.pow(F.greatest(F.abs(F.col(f"_c{k}") * width - 1), F.abs((F.col(f"_c{k}") + 1) * width - 1)), 2) for k in axes), F.lit(0.0))
    return left, right.where((least <= 1 + 1e-9) & (most >= 1 - 1e-9))


def distance_join(a: DataFrame, b: DataFrame, km: float, radius: Column | None = None, on: Column | None = None) -> DataFrame:
    """Pairs within km of each other, with column km.

    a has a_lon, a_lat and b has b_lon, b_lat; other names must differ. Places are points
    in space, cut into cubes of half the radius, which are alike all over the sphere: poles
    and the antimeridian need no case of their own. b is copied to the cubes that its circle
    reaches, and a is not copied. Straight distances, which cost little, leave few pairs to the
    exact one. radius: a smaller radius of each pair; a null one matches nothing.
    """
    left, right = _in_cells(a, b, km)
    chord = F.lit(0.0)
    for k in ("x", "y", "z"):
        chord = chord + (F.col(f"_a{k}") - F.col(f"_b{k}")) * (F.col(f"_a{k}") - F.col(f"_b{k}"))
    pairs = left.join(right, ["_cx", "_cy", "_cz"]).where(chord <= _chord(km) ** 2 + _SLACK)
    pairs = pairs.withColumn("km", geo.haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")))
    pairs = pairs.where(F.col("km") <= F.lit(float(km)))
    if radius is not None:
        pairs = pairs.where(F.col("km") <= radius)
    if on is not None:
        pairs = pairs.where(on)
    return pairs.drop(*[f"_{s}{k}" for s in "abc" for k in "xyz"])


def step_join(a: DataFrame, b: DataFrame, value: Column, steps: list[tuple[float, float]]) -> DataFrame:
    """Pairs within the radius that a value of a's row asks for by its step, with column km: each radius is joined on cells of its own."""
    radius, parts = step_radius(value, steps), None
    for km in sorted({float(k) for _, k in steps}):
        part = distance_join(a.where(radius == km), b, km)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def step_radius(value: Column, steps: list[tuple[float, float]]) -> Column:
    """The radius of the last threshold at or below the value; null below the first or without a value."""
    out = F.lit(None).cast("double")
    for threshold, km in steps:
        out = F.when(value >= threshold, F.lit(float(km))).otherwise(out)
    return out


def ring_edges(areas: DataFrame) -> DataFrame:
    """area_id, ax, ay, bx, by of areas with rings: array of arrays of structs (lon, lat), closed."""
    ring = areas.select("area_id", F.explode("rings").alias("r"))
    at = F.explode(F.sequence(F.lit(1), F.size("r") - 1)).alias("i")
    e = ring.select("area_id", "r", at).select("area_id", F.get("r", F.col("i") - 1).alias("a"), F.get("r", F.col("i")).alias("b"))
    e = e.select("area_id", F.col("a.lon").alias("ax"), F.col("a.lat").alias("ay"), F.col("b.lon").alias("bx"), F.col("b.lat").alias("by"))
    return e.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))


def contained(points: DataFrame, edges: DataFrame, key: str, band_degrees: float = 1.0) -> DataFrame:
    """Pairs (key, area_id) of points inside areas: an odd number of edges to the east.

    points has key, lon, lat; edges as from ring_edges. An edge is copied to the bands
    of latitude that it crosses; points meet the edges of their band alone, and the
    crossings are counted with partial sums. Holes count as edges like any others.
    """
    banded = edges.where("ay <> by").withColumn("_band", F.explode(F.sequence(F.floor(F.least("ay", "by") / band_degrees), F.floor(F.greatest("ay", "by") / band_degrees))))
    p = points.where("lon IS NOT NULL AND lat IS NOT NULL").select(key, "lon", "lat").withColumn("_band", F.floor(F.col("lat") / band_degrees))
    c = lambda n: F.col(n)
    hits = p.join(banded, "_band").where(geo.crosses(c("lon"), c("lat"), c("ax"), c("ay"), c("bx"), c("by")))
    return hits.groupBy(key, "area_id").agg(F.count("*").alias("_n")).where("_n % 2 = 1").select(key, "area_id")


def border_distance(points: DataFrame, edges: DataFrame, key: str, km: float, band_degrees: float = 1.0) -> DataFrame:
    """key, area_id, km: points to the nearest border of areas no farther than km (outside points)."""
    reach = km / _KM_PER_DEGREE
    banded = edges.withColumn("_band", F.explode(F.sequence(F.floor((F.least("ay", "by") - reach) / band_degrees), F.floor((F.greatest("ay", "by") + reach) / band_degrees))))
    p = points.where("lon IS NOT NULL AND lat IS NOT NULL").select(key, "lon", "lat").withColumn("_band", F.floor(F.col("lat") / band_degrees))
    c = lambda n: F.col(n)
    d = geo.point_segment_km(c("lon"), c("lat"), c("ax"), c("ay"), c("bx"), c("by"))
    return p.join(banded, "_band").withColumn("km", d).where(c("km") <= km).groupBy(key, "area_id").agg(F.min("km").alias("km"))


def enrich(points: DataFrame, edges: DataFrame, key: str, km: float) -> DataFrame:
    """key, area_id, method: areas around a point; else the one nearest area within km, by (distance, id)."""
    inside = contained(points, edges, key).withColumn("method", F.lit("contained"))
    outside = points.join(inside.select(key).distinct(), key, "left_anti")
    near = border_distance(outside, edges, key, km).groupBy(key).agg(F.min(F.struct("km", "area_id")).alias("m")).select(key, F.col("m.area_id").alias("area_id"), F.lit("nearest").alias("method"))
    return inside.unionByName(near)


def nearest(a: DataFrame, b: DataFrame, km: float, a_id: str, b_id: str, k: int = 1) -> DataFrame:
    """a_id, b_id, km, rank, total: the k nearest partners within km, by (distance, id), and the number of all.

    The pairs, which may be very many, are counted where a cell's points meet, by their
    dot products. Only the first k of a row, with all that come so close to them that
    rounding might change the order, and those at the very edge go on to the exact distance.
    """
    left, right = _in_cells(a, b, km)
    edge, slack = 1 - _chord(km) ** 2 / 2, _SLACK
    cell, at = ["_cx", "_cy", "_cz"], lambda s: [f"_{s}{x}" for x in "xyz"]
    schema = left.select(a_id, "a_lon", "a_lat").schema
    for f in right.select(b_id, "b_lon", "b_lat").schema:
        schema = schema.add(f)
    schema = schema.add("sure", "boolean").add("n", "long")

    def meet(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = ([d[c].to_numpy(object) for c in names] for d, names in ((here, [a_id, "a_lon", "a_lat"]), (there, [b_id, "b_lon", "b_lat"])))
        out = [[np.empty(0, object)] for _ in schema]
        if len(here) and len(there):
            p, q = here[at("a")].to_numpy(), there[at("b")].to_numpy().T
            step = max(1, (1 << 21) // len(there))
            for i in range(0, len(here), step):
                dot = p[i : i + step] @ q
                sure = dot > edge + slack
                least = min(k, len(there))
                want = np.maximum(np.partition(dot, -least, axis=1)[:, -least] - slack, edge - slack)
                x, y = np.nonzero((dot >= want[:, None]) | (~sure & (dot >= edge - slack)))
                for have, new in zip(out, [*[c[i + x] for c in mine], *[c[y] for c in theirs], sure[x, y], sure.sum(axis=1)[x]], strict=True):
                    have.append(new.astype(object))
        return pd.DataFrame({f.name: pd.Series(np.concatenate(c), dtype=object) for f, c in zip(schema, out, strict=True)})

    left, right = left.select(a_id, "a_lon", "a_lat", *at("a"), *cell), right.select(b_id, "b_lon", "b_lat", *at("b"), *cell)
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, schema)
    found = found.withColumn("km", geo.haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))).where(F.col("sure") | (F.col("km") <= km))
    w = Window.partitionBy(a_id)
    total = F.max("n").over(w) + F.count(F.when(~F.col("sure"), 1)).over(w)
    ranked = found.withColumns({"rank": F.row_number().over(w.orderBy("km", b_id)), "total": total})
    return ranked.where(F.col("rank") <= k).select(a_id, b_id, "km", "rank", "total")


def local_cells(points: DataFrame, z: int) -> DataFrame:
    """x, y, type, n: points on a grid of their own at level min(20, z + 2)."""
    level = min(20, z + 2)
    cells = points.select("type", geo.cell_x(F.col("lon"), level).alias("x"), geo.cell_y(F.col("lat"), level).alias("y"))
    return cells.groupBy("x", "y", "type").agg(F.count("*").alias("n"))
