"""Explanations: templates filled from bindings, factors recomputed, licence verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import decimal_comma
from orrery.functions.timefn import from_ms, human_delta

_PLACE = re.compile(r"\{([^{}|]+)(?:\|(\w+))?\}")


def _shown(value: Column, form: str | None) -> Column:
    if form is None:
        return value.cast("string")
    if form.startswith("num"):
        return decimal_comma(value.cast("double"), int(form[3:] or 0))
    if form == "delta":
        return human_delta(value.cast("long"))
    if form == "date":
        return F.date_format(from_ms(value.cast("long")), "dd/MM/yyyy")
    if form == "join":
        return F.array_join(value, ", ")
    raise ValueError(f"unknown form: {form!r}")


def render(template: str, lookup) -> Column:
    """A template as an expression. Places look like {A.label}, {dist.A.B|num1}, {dt.A.B|delta}; lookup gives a place's column."""
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(_shown(lookup(m[1]), m[2]), F.lit("?"))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def from_bindings(bindings: DataFrame):
    """A lookup for render() over the columns of a rule's bindings."""

    def lookup(name: str) -> Column:
        head, *rest = name.split(".")
        if head in ("dist", "dt"):
            kind = {"dist": "km:", "dt": "dt:"}[head]
            for c in bindings.columns:
                if c.startswith(kind) and set(c.split(":")[-1].split("-")) == set(rest):
                    return F.col(f"`{c}`")
            raise ValueError(f"nothing is known for {name!r}")
        field = {"time": "t", "prop": rest[-1]}.get(rest[0], rest[0])
        return F.col(f"{head}_{field}")

    return lookup


def recompute(factors: Column) -> Column:
    """The confidence that factors stand for; null if they are of no known kind.

    Packed ones are {"p": [...]}, a product, and {"g": {...}}, independent groups; spelled out they
    have a method: "product" of factors, "independent_groups" with groups, or "insight", the rule's
    strength x the least member's confidence x what was scored, by name.
    """
    at = lambda path, kind: F.from_json(F.get_json_object(factors, path), kind)
    by_name = lambda path: F.transform(F.array_sort(F.map_entries(at(path, "map<string,double>"))), lambda e: e["value"])
    times = lambda values, start=F.lit(1.0): F.aggregate(values, start, lambda a, x: a * x)
    groups = lambda path: 1 - F.aggregate(by_name(path), F.lit(1.0), lambda a, x: a * (1 - x))
    number = lambda path: F.get_json_object(factors, path).cast("double")
    method = F.get_json_object(factors, "$.method")
    scored = F.coalesce(by_name("$.scored"), F.array().cast("array<double>"))
    return (
        F.when(F.get_json_object(factors, "$.p").isNotNull(), times(at("$.p", "array<double>")))
        .when(F.get_json_object(factors, "$.g").isNotNull(), groups("$.g"))
        .when(method == "product", times(by_name("$.factors")))
        .when(method == "independent_groups", groups("$.groups"))
        .when(method == "insight", times(scored, number("$.relation_strength") * number("$.members_min")))
    )


def truncated(bindings: DataFrame, bound: list[str], candidate: str, most: int) -> DataFrame:
    """The first candidates of each binding in the order of their ids."""
    w = Window.partitionBy(*bound).orderBy(candidate)
    return bindings.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= most).drop("_r")


#: Patterns of licence texts and the verdict of each, the first that fits.
LICENCES = (("(?i)public domain|cc0", "open"), ("(?i)by-nc|non.?commercial", "restricted"), ("(?i)cc.?by|attribution|open data", "attribution"), ("(?i)all rights reserved|proprietary", "closed"))


def licence_verdict(text: Column) -> Column:
    out = F.lit("unknown")
    for pattern, verdict in reversed(LICENCES):
        out = F.when(text.rlike(pattern), verdict).otherwise(out)
    return out
