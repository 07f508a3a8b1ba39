"""Degrees of support in [0, 1] and their decomposition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of methods, statuses and tiers of sources; names of the bands.
METHOD = {"measured": 1.0, "asserted": 0.95, "computed": 0.95, "resolved_by_name": 0.85, "proposed": 0.5}
STATUS = {"reviewed": 1.0, "updated": 1.0, "preliminary": 0.9, "retracted": 0.0}
BAND_LABEL = {2: "supporto forte", 1: "supporto medio", 0: "supporto debole"}


def band(c: Column) -> Column:
    return F.when(c >= 0.8, 2).when(c >= 0.5, 1).otherwise(0)


def band_floor(c: float) -> int:
    """The band that a least confidence asks for: coarser than the confidence itself."""
    return 2 if c >= 0.8 else 1 if c >= 0.5 else 0


def band_label(c: Column) -> Column:
    return F.when(c >= 0.8, BAND_LABEL[2]).when(c >= 0.5, BAND_LABEL[1]).otherwise(BAND_LABEL[0])


def lookup(key: Column, table: dict) -> Column:
    """The value of key in a fixed table; null where it has none."""
    return reduce(lambda acc, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(acc), table.items(), F.lit(None))


def evidence_weight(reliability: Column, method: Column, status: Column, completeness: Column) -> Column:
    """Product of the four factors of a piece of evidence, in this order."""
    return F.round(reliability, 6) * lookup(method, METHOD) * lookup(status, STATUS) * F.round(completeness, 6)


def noisy_or(values: Column) -> Column:
    """1 - product(1 - v) over an array of each group's best value."""
    return 1 - F.aggregate(values, F.lit(1.0), lambda acc, v: acc * (1 - v))


def severity(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def completeness(*required: Column) -> Column:
    """Share of the required properties that are present; 1 without any."""
    if not required:
        return F.lit(1.0)
    return sum((F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in required), F.lit(0.0)) / len(required)


def distance_factor(km: Column, limit) -> Column:
    return 1 - km / limit


def time_factor(dt: Column, limit: int) -> Column:
    """1 for no or negative delay, 0 at the limit; 1 if the limit isn't positive."""
    return F.lit(1.0) if limit <= 0 else 1 - F.greatest(dt, F.lit(0)) / F.lit(float(limit))


def insight_score(strength: float, members: list[Column], factors: dict[str, Column]) -> Column:
    """strength x least member confidence x the factors in the order of their names."""
    least = F.round(F.least(*members) if len(members) > 1 else members[0], 12)
    return reduce(lambda acc, k: acc * F.round(factors[k], 12), sorted(factors), F.lit(strength) * least)


def sentence(value: Column, parts: Column) -> Column:
    head = F.concat(band_label(value), F.lit(" ("), F.call_function("format_number", value, F.lit("0.00")), F.lit(")"))
    return F.when(F.size(parts) > 0, F.concat(head, F.lit(": "), F.array_join(parts, "; "))).otherwise(head)
