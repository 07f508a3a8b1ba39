"""Joins and versions in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of an interval join without other columns are so many times narrower than the interval.
PIECES = 8


def interval_join(a: DataFrame, b: DataFrame, low: int, high: int, on: list[str] | None = None, a_t: str = "a_t", b_t: str = "b_t", bucket: str | None = None) -> DataFrame:
    """Pairs with low <= b_t - a_t <= high, both ends included, with column dt.

    Time is cut into buckets: a row of b lies in one, a row of a is copied to those that
    its partners can lie in. on: columns that must be equal too. bucket: a name under which
    the bucket stays, by which the pairs are dealt out; it depends on b_t alone.
    """
    width = max((high - low) // (1 if on else PIECES), 1)
    first, last = F.floor((F.col(a_t) + low) / width), F.floor((F.col(a_t) + high) / width)
    left = a.where(F.col(a_t).isNotNull()).withColumn("_bucket", F.explode(F.sequence(first, last)))
    right = b.where(F.col(b_t).isNotNull()).withColumn("_bucket", F.floor(F.col(b_t) / width))
    if bucket:  # pairs are many more than rows, by whose bytes few tasks would be made
        n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, "_bucket"), right.repartition(n, "_bucket")
    pairs = left.join(right, [*(on or []), "_bucket"]).withColumn("dt", F.col(b_t) - F.col(a_t))
    pairs = pairs.where(F.col("dt").between(low, high))
    return pairs.withColumnRenamed("_bucket", bucket) if bucket else pairs.drop("_bucket")


def as_of(facts: DataFrame, key: list[str], at: str, moment, *tie: str) -> DataFrame:
    """The latest row of each key no later than the moment."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), *[F.desc(t) for t in tie])
    return facts.where(F.col(at) <= moment).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest(facts: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that is total."""
    return facts.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def claims(facts: DataFrame, key: list[str], value: str, at: str, ident: str) -> DataFrame:
    """Versions of a value: a row that repeats the current value says nothing, any other supersedes it.

    Adds valid_to (null for the current version) and superseded_by.
    """
    w = Window.partitionBy(*key).orderBy(at, ident)
    changes = facts.withColumn("_same", F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)).where("NOT _same").drop("_same")
    return changes.withColumns({"valid_to": F.lead(at).over(w), "superseded_by": F.lead(ident).over(w)})


def step(events: DataFrame, t: int, ident: str, forward: bool) -> DataFrame:
    """The next or previous event in time around a moment, by (distance, id)."""
    side = F.col("t_ms") > t if forward else F.col("t_ms") < t
    return events.where(side).withColumn("gap", F.abs(F.col("t_ms") - t)).orderBy("gap", ident).limit(1)


def sessions(events: DataFrame, key: list[str], at: str, gap: int, ident: str) -> DataFrame:
    """Adds session (0, 1, ...): a new one begins after a pause longer than gap."""
    w = Window.partitionBy(*key).orderBy(at, ident)
    opens = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return events.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_opens")


def _rounded(c: Column, digits: int) -> Column:
    """Rounded half up, towards the greater number."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def significance(points: DataFrame, key: list[str], order: list[str], deff: float = 2.0) -> DataFrame:
    """Adds delta, threshold and verdict of each point against the one before it in its series.

    points has value (percent) and n (answers); a change counts beyond
    2 sqrt(deff) standard errors of the difference.
    """
    share = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    se = F.when(F.coalesce("n", F.lit(0)) > 0, 100 * F.sqrt(share * (1 - share) / F.col("n")))
    w = Window.partitionBy(*key).orderBy(*order)
    df = points.withColumn("se", se).withColumns({"_v": F.lag("value").over(w), "_se": F.lag("se").over(w)})
    delta = _rounded(F.col("value") - F.col("_v"), 1)
    threshold = _rounded(F.lit(2 * deff**0.5) * F.sqrt(F.col("_se") * F.col("_se") + F.col("se") * F.col("se")), 1)
    verdict = F.when(delta.isNull() | threshold.isNull(), "none").when(F.abs(delta) > threshold, F.when(delta > 0, "up").otherwise("down")).otherwise("stable")
    return df.withColumns({"delta": delta, "threshold": threshold, "verdict": verdict, "margin": _rounded(1.96 * deff**0.5 * F.col("se"), 1)}).drop("_v", "_se")


def official_change(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds delta and verdict (change, stable, none) of series without sampling error."""
    delta = _rounded(F.col("value") - F.lag("value").over(Window.partitionBy(*key).orderBy(*order)), 4)
    return points.withColumn("delta", delta).withColumn("verdict", F.when(delta.isNull(), "none").when(delta == 0, "stable").otherwise("change"))


def tenures(terms: DataFrame, office: str = "office") -> DataFrame:
    """Adds state of each term and outcome of its office.

    terms has office, person, start, end_day, rank, collegial. Terms without an end are
    open: undated without a start, current at the latest start, else superseded. Several
    current holders, or a preferred superseded one, are a conflict unless collegial.
    """
    w = Window.partitionBy(office)
    is_open = F.col("end_day").isNull()
    latest_start = F.max(F.when(is_open, F.col("start"))).over(w)
    state = F.when(~is_open, "ended").when(F.col("start").isNull(), "undated").when(F.col("start") == latest_start, "current").otherwise("superseded")
    df = terms.withColumn("state", state)
    current = F.col("state") == "current"
    holders = F.size(F.collect_set(F.when(current, F.col("person"))).over(w))
    preferred = F.max(F.when((F.col("state") == "superseded") & (F.col("rank") == "preferred"), 1).otherwise(0)).over(w)
    clash = ~F.col("collegial") & ((holders > 1) | (preferred == 1))
    outcome = F.when(clash, "ambiguous").when(holders == 0, "none").when(F.col("collegial"), "collegial").otherwise("unique")
    df = df.withColumns({"outcome": outcome, "_clash": clash})
    return df.withColumn("state", F.when(current & F.col("_clash"), "conflict").otherwise(F.col("state"))).drop("_clash")
