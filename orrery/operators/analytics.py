"""Analytic tables: series, zones, leaders, freshness, published-table transforms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

HOUR = 3_600_000
#: The Earth's gravitational parameter (km^3/s^2) and equatorial radius (km).
MU, EQUATOR_KM = 398600.4418, 6378.137


def against_year_before(points: DataFrame, month: str, value: str) -> DataFrame:
    """month, value and year_before of monthly points."""
    before = points.select((F.col(month) + 12).alias(month), F.col(value).alias("year_before"))
    return points.join(before, month, "left")


def series(points: DataFrame, key: list[str], at: str, tie: str, value: str, n: int) -> DataFrame:
    """key, n, points: the last n values of each series in order of time."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    last = points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    rows = last.groupBy(*key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(at, tie, value))).alias("_p"))
    return rows.select(*key, "n", F.array_join(F.transform("_p", lambda x: x[value].cast("string")), ";").alias("points"))


def pairs_by_topic(listed: DataFrame) -> DataFrame:
    """topic, side, id: official series (reality) and surveys (perception) of the topics that have both.

    A row for each series, so that a topic of any size is no list; topics are found by partial sums.
    """
    side = F.when(F.col("kind") == "official", "reality").when(F.col("kind") == "survey", "perception")
    rows = listed.select("topic", side.alias("side"), "id").where("side IS NOT NULL")
    both = rows.groupBy("topic").agg(F.min("side").alias("_a"), F.max("side").alias("_b")).where("_a < _b")
    return rows.join(both, "topic", "left_semi")


def zones(rows: DataFrame) -> DataFrame:
    """Units with three events (R1), or 25 deaths in two (R2), or one by a foreign actor (O1).

    rows has state, unit, deaths, foreign, lon, lat; n_cells counts half-degree cells.
    """
    cell = F.struct(F.floor((F.col("lon") + 180) / 0.5), F.floor((F.col("lat") + 90) / 0.5))
    per = rows.groupBy("state", "unit").agg(F.count("*").alias("n"), F.sum("deaths").alias("deaths"), F.sum(F.col("foreign").cast("long")).alias("foreign_n"), F.countDistinct(cell).alias("n_cells"))
    rule = F.when(F.col("n") >= 3, "R1").when((F.col("deaths") >= 25) & (F.col("n") >= 2), "R2").when(F.col("foreign_n") > 0, "O1")
    return per.withColumn("rule", rule).where("rule IS NOT NULL").withColumn("color", F.when(F.col("rule").isin("R1", "R2"), "red").otherwise("orange"))


def leaders(rows: DataFrame, group: str, value: str, ident: str) -> DataFrame:
    """group, best, leader: the greatest value and the least id that has it."""
    best = rows.groupBy(group).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(ident)).alias("k"))).alias("m"))
    return best.select(group, F.col("m.v").alias("best"), (-F.col("m.k")).alias("leader"))


def latest_release(rows: DataFrame, source: str, at: str, element: str) -> DataFrame:
    """source, at, elements: each source's last moment and the elements that it has then. One aggregation by (source, moment) first."""
    per = rows.groupBy(source, at).agg(F.countDistinct(element).alias("elements"))
    return per.groupBy(source).agg(F.max(F.struct(at, "elements")).alias("m")).select(source, f"m.{at}", "m.elements")


def highlights(events: DataFrame, window_ms: int) -> DataFrame:
    """type, n, most (severity) over the last stretch before the newest event."""
    newest = events.agg(F.max("t_ms").alias("_t"))
    return events.crossJoin(F.broadcast(newest)).where(F.col("t_ms") > F.col("_t") - window_ms).groupBy("type").agg(F.count("*").alias("n"), F.max("severity").alias("most"))


def nation_groups(reports: DataFrame) -> DataFrame:
    """Reports without a confirmed place, by nation: counts by certainty, and a centre.

    The centre is that of the first report about the nation as a whole, else the mean.
    """
    r = reports.where("geo <> 'confirmed'")
    count = lambda c: F.count(F.when(c, 1))
    whole = F.min_by(F.col("lon"), F.when(F.col("precision") == "nation", F.col("id")))
    some = count(F.col("precision") == "nation") > 0
    return r.groupBy("nation").agg(F.count("*").alias("n"), count((F.col("geo") == "unconfirmed") & (F.col("precision") == "city")).alias("unconfirmed"), count(F.col("geo") == "ambiguous").alias("ambiguous"), count(F.col("precision") != "city").alias("coarse"), F.when(some, whole).otherwise(F.round(F.avg("lon"), 3)).alias("lon"))


def grid_dedupe(rows: DataFrame, degrees: float, order: list[str]) -> DataFrame:
    """gx, gy and the columns of order: one row for each cell, the greatest in the order."""
    best = rows.groupBy(F.floor(F.col("lon") / degrees).alias("gx"), F.floor(F.col("lat") / degrees).alias("gy")).agg(F.max(F.struct(*order)).alias("m"))
    return best.select("gx", "gy", "m.*")


def one_source(points: DataFrame, key: str, source: str, year: str) -> DataFrame:
    """key, source: the source with the latest year, then most points; series are never spliced."""
    per = points.groupBy(key, source).agg(F.max(year).alias("y"), F.count("*").alias("n"))
    return per.groupBy(key).agg(F.max(F.struct("y", "n", source)).alias("m")).select(key, f"m.{source}")


def indicator(points: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """key, n, latest, least, anomaly (a value of three times the mean)."""
    mean = F.avg(value).over(Window.partitionBy(key))
    return points.withColumn("_m", mean).groupBy(key).agg(F.count("*").alias("n"), F.max(period).alias("latest"), F.round(F.min(value), 2).alias("least"), F.max(F.col(value) > 3 * F.col("_m")).alias("anomaly"))


def orbits(elements: DataFrame) -> DataFrame:
    """apogee, perigee, period and regime from mean motion (revolutions a day) and eccentricity."""
    a = F.pow(F.lit(MU) / F.pow(F.col("motion") * 2 * math.pi / 86400, 2.0), F.lit(1.0) / 3)
    apogee, perigee = a * (1 + F.col("ecc")) - EQUATOR_KM, a * (1 - F.col("ecc")) - EQUATOR_KM
    regime = F.when(F.col("ecc") >= 0.25, "HEO").when(apogee < 2000, "LEO").when(F.col("motion").between(0.99, 1.01), "GEO").otherwise("MEO")
    keep = [c for c in elements.columns if c not in ("motion", "ecc")]
    return elements.select(*keep, F.round(apogee, 3).alias("apogee"), F.round(perigee, 3).alias("perigee"), F.round(1440 / F.col("motion"), 6).alias("period_min"), regime.alias("regime"))


def families(rows: DataFrame, patterns: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """rows with family: the first pattern that a name matches."""
    family = F.lit(other)
    for pattern, name in reversed(patterns):
        family = F.when(F.lower("name").rlike(pattern), name).otherwise(family)
    return rows.withColumn("family", family)


def wide_to_long(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    return rows.unpivot(key, columns, "name", "value")


def decode_cells(rows: DataFrame, index: str, sizes: dict[str, int]) -> DataFrame:
    """rows with a column for each dimension of a linear cell index; the last dimension runs fastest."""
    stride, out = 1, {}
    for name in reversed(list(sizes)):
        out[name] = (F.floor(F.col(index) / stride) % sizes[name]).cast("long")
        stride *= sizes[name]
    return rows.withColumns(dict(reversed(out.items())))


def fuzzy_pairs(names: DataFrame, head: int, most: int) -> DataFrame:
    """a, b, d: names with the same beginning and few differing letters. The beginning is the join's key."""
    n = names.withColumn("_h", F.substring("name", 1, head))
    a, b = n.select("_h", F.col("id").alias("_a"), F.col("name").alias("a")), n.select("_h", F.col("id").alias("_b"), F.col("name").alias("b"))
    rows = a.join(b, "_h").where("_a < _b").withColumn("d", F.levenshtein("a", "b").cast("long"))
    return rows.where(F.col("d") <= most).select("a", "b", "d")


def freshness(sources: DataFrame, now_ms: int, most_ms: int) -> DataFrame:
    """health (stale after most_ms) and days since the last success of stale ones."""
    old = now_ms - F.col("last_ms") > most_ms
    return sources.withColumns({"health": F.when(old, "stale").otherwise("ok"), "days": F.when(old, F.floor((now_ms - F.col("last_ms")) / (24 * HOUR)))}).drop("last_ms")


def recent_split(events: DataFrame, now_ms: int, hours: int = 24) -> DataFrame:
    """recent, old, newest, oldest: acquired within the last hours, or up to one hour ahead of the clock, or not."""
    fresh = F.coalesce((F.col("t_ms") <= now_ms + HOUR) & (now_ms - F.col("t_ms") <= hours * HOUR), F.lit(False))
    return events.agg(F.count(F.when(fresh, 1)).alias("recent"), F.count(F.when(~fresh, 1)).alias("old"), F.max("t_ms").alias("newest"), F.min("t_ms").alias("oldest"))


def last_days(rows: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last days before the newest one in the data, that one included."""
    newest = rows.agg(F.max(day).alias("_last"))
    return rows.crossJoin(F.broadcast(newest)).where(F.col(day) > F.date_sub("_last", days)).drop("_last")  # one row


def categories(rows: DataFrame, code: str, table: dict[str, str], other: str = "other") -> DataFrame:
    """rows with category: that of the longest beginning of the code in a fixed table."""
    out = F.lit(other)
    for start in sorted(table, key=len):
        out = F.when(F.col(code).startswith(start), table[start]).otherwise(out)
    return rows.withColumn("category", out)


def register(rows: DataFrame, keep, columns: list[str]) -> DataFrame:
    """A published register: the rows that stay, each once."""
    return rows.where(keep).select(*columns).distinct()
