"""Declared types and sources: loaded from TOML on the driver, used as small tables."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import confidence

# Reliability of the tiers of sources, kinds of properties and geometries.
TIERS = {"T1": 0.95, "T2": 0.85, "T3": 0.75, "T4": 0.60, "T5": 0.45, "T6": 0.35}
PROPERTY_KINDS = ("text", "float", "int", "bool", "list")
GEOMETRIES = ("none", "point", "line", "area", "any")


class VocabularyError(ValueError):
    pass


@dataclass
class Vocabulary:
    types: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, *texts: str) -> Vocabulary:
        """Types of kind object, event and relation from TOML texts; a name that comes twice or a wrong kind is an error."""
        types: dict[str, dict] = {}
        for text in texts:
            data = tomllib.loads(text)
            for kind in ("object", "event", "relation"):
                for t in data.get(kind, []):
                    if t["id"] in types:
                        raise VocabularyError(f"type {t['id']!r} is declared twice")
                    for p in t.get("property", []):
                        if p.get("kind") not in PROPERTY_KINDS:
                            raise VocabularyError(f"{t['id']}.{p.get('name')}: unknown kind {p.get('kind')!r}")
                    if t.get("geometry", "none") not in GEOMETRIES:
                        raise VocabularyError(f"{t['id']}: unknown geometry {t['geometry']!r}")
                    types[t["id"]] = t | {"entity": kind}
        for t in types.values():
            for end in ("from", "to"):
                for other in t.get(end, []):
                    if other != "*" and other not in types:
                        raise VocabularyError(f"{t['id']}: unknown type {other!r}")
        return cls(types)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t["entity"], t.get("label", i), t.get("geometry", "none")) for i, t in sorted(self.types.items())]
        return spark.createDataFrame(rows, "type string, entity string, label string, geometry string")

    def allowed_ends(self, spark: SparkSession) -> DataFrame:
        """type, from_type, to_type of every relation; a star stands for all types."""
        every = [i for i, t in self.types.items() if t["entity"] != "relation"]
        wide = lambda names: every if "*" in names else names
        rows = [(i, a, b) for i, t in sorted(self.types.items()) if t["entity"] == "relation" for a in wide(t.get("from", ["*"])) for b in wide(t.get("to", ["*"]))]
        return spark.createDataFrame(rows, "type string, from_type string, to_type string")

    def severity(self, type_col: Column, prop) -> Column:
        """Severity by the declared property and range of each type; null without one."""
        out = F.lit(None).cast("double")
        for i, t in self.types.items():
            s = t.get("severity")
            if s:
                out = F.when(type_col == i, confidence.severity(prop(s["property"]), float(s["min"]), float(s["max"]))).otherwise(out)
        return out

    def completeness(self, type_col: Column, prop) -> Column:
        out = F.lit(1.0)
        for i, t in self.types.items():
            need = [p["name"] for p in t.get("property", []) if p.get("required")]
            if need:
                out = F.when(type_col == i, confidence.completeness(*[prop(n) for n in need])).otherwise(out)
        return out

    def head(self, kind: str, prop) -> Column:
        """The properties that a type shows first, as texts, without those that are missing."""
        shown = [p for p in self.types[kind].get("property", []) if p.get("head")]
        texts = [F.concat(F.lit(p.get("prefix", "")), prop(p["name"]).cast("string"), F.lit(p.get("suffix", ""))) for p in shown]
        return F.filter(F.array(*texts), lambda x: x.isNotNull()) if texts else F.array().cast("array<string>")


@dataclass
class Registry:
    sources: list[dict]

    @classmethod
    def load(cls, text: str) -> Registry:
        sources = tomllib.loads(text).get("source", [])
        for s in sources:
            if s.get("tier") not in TIERS:
                raise VocabularyError(f"{s.get('id')}: unknown tier {s.get('tier')!r}")
            if s.get("verdict") not in ("approved", "rejected", "pending"):
                raise VocabularyError(f"{s.get('id')}: unknown verdict {s.get('verdict')!r}")
        return cls(sources)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s["id"], s["tier"], TIERS[s["tier"]], s.get("group", s["id"]), s.get("licence"), s["verdict"] == "approved", s.get("checked")) for s in self.sources]
        return spark.createDataFrame(rows, "source string, tier string, reliability double, grp string, licence string, admissible boolean, checked string")

    def old_reviews(self, spark: SparkSession, today: str, days: int = 180) -> DataFrame:
        """Sources whose review is older than so many days."""
        return self.table(spark).where(F.datediff(F.lit(today).cast("date"), F.col("checked").cast("date")) > days).select("source", "checked")
