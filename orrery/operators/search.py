"""Text search: an inverted index over weighted fields, prefix matching and BM25."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import index_tokens, query_tokens
from orrery.sources.shared import materialise

# Field weights, BM25 constants, the floor of a term's weight, the limits of frequency estimates.
WEIGHTS = {"label": 10.0, "aliases": 4.0, "identifiers": 6.0, "text": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FREQUENT, DF_CAP = 20_000, 20_001


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """term, key, field, tf. Fields are folded and cut into words and numbers."""
    parts = None
    for f in fields:
        p = docs.select(key, F.lit(f).alias("field"), F.explode(index_tokens(F.coalesce(F.col(f), F.lit("")))).alias("term"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("term", key, "field").agg(F.count("*").alias("tf"))


def lengths(index: DataFrame, key: str) -> DataFrame:
    """key, len: tokens of each document, all fields together."""
    return index.groupBy(key).agg(F.sum("tf").alias("len"))


@dataclass(frozen=True)
class Index:
    """Postings sorted by term, so that a prefix reads few row groups; the length of each document; their number and mean."""

    postings: DataFrame
    key: str
    lengths: DataFrame
    n_docs: int
    mean: float

    @classmethod
    def of(cls, docs: DataFrame, key: str, fields: list[str]) -> Index:
        """Written once, to the shared folder, and searched often."""
        made = materialise(postings(docs, key, fields).repartitionByRange("term").sortWithinPartitions("term"))
        lens = materialise(lengths(made, key))
        n, total = lens.agg(F.count("*"), F.sum("len")).first()
        return cls(made, key, lens, n, (total or 0) / n if n else 0.0)


def document_frequency(index: DataFrame, key: str, prefixes: list[str]) -> DataFrame:
    """prefix, df: documents with a term that begins so, counted up to the cap."""
    rows = None
    for p in prefixes:
        part = index.where(F.col("term").startswith(p)).agg(F.least(F.countDistinct(key), F.lit(DF_CAP)).alias("df")).select(F.lit(p).alias("prefix"), "df")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def search(index: Index, text: str, n: int, rank_all: bool = False) -> DataFrame:
    """key, score of the documents that hold every word of the text as the beginning of a term, best first.

    The postings are read once, for the prefixes alone. Words that more than FREQUENT
    documents hold only filter; where all are such, all documents score 0. With rank_all
    every word counts in the score, however many documents hold it.
    """
    key, prefixes = index.key, list(dict.fromkeys(t.lower() for t in re.findall("[0-9A-Za-zÀ-ÿ]+", text)[:8]))
    if not prefixes:
        return index.postings.select(key, F.lit(0.0).alias("score")).limit(0)
    weight = F.lit(1.0)
    for f, w in WEIGHTS.items():
        weight = F.when(F.col("field") == f, w).otherwise(weight)
    begins = [F.col("term").startswith(p) for p in prefixes]
    rows = index.postings.where(reduce(lambda a, b: a | b, begins))
    # One column for each word: a document's row holds them all, and no row is copied.
    sums = [F.sum(F.when(b, F.col("tf") * weight)).alias(f"tf{i}") for i, b in enumerate(begins)]
    hits = materialise(rows.groupBy(key).agg(*sums))
    found = hits.agg(*[F.count(f"tf{i}") for i in range(len(prefixes))]).first()
    every = hits.where(reduce(lambda a, b: a & b, [F.col(f"tf{i}").isNotNull() for i in range(len(prefixes))])).join(index.lengths, key)
    gain = F.lit(0.0)
    for i, n_found in enumerate(found):
        if rank_all or n_found <= FREQUENT:
            tf = F.col(f"tf{i}")
            gain = gain + idf(F.lit(float(index.n_docs)), F.lit(float(n_found))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(index.mean)))
    return every.select(key, F.round(gain, 4).alias("score")).orderBy(F.desc("score"), key).limit(n)


def plan_prefixes(frequencies: dict[str, int]) -> tuple[list[str], list[str]]:
    """Words to search by, and too frequent ones that only filter; if all are frequent they search without a rank."""
    rare = [p for p, n in frequencies.items() if n <= FREQUENT]
    return (rare, [p for p in frequencies if p not in rare]) if rare else (list(frequencies), [])


def match_places(places: DataFrame, text: str, n: int = 5) -> DataFrame:
    """id, label, score of places whose name or alias begins with the text; ties by rank, then length, then name.

    places has id, label, aliases (array), rank (null for places of the first order).
    """
    import unicodedata

    from orrery.functions.text import match_score, place_name

    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    wanted = re.sub("[^a-z0-9]+", " ", plain).strip()
    own = match_score(place_name(F.col("label")), wanted)
    others = F.array_min(F.transform("aliases", lambda a: match_score(place_name(a), wanted) + 0.5))
    rows = places.withColumn("score", F.least(own, others)).where("score IS NOT NULL")
    return rows.orderBy("score", F.desc_nulls_first("rank"), F.length("label"), "label", "id").limit(n).select("id", "label", "score")


__all__ = ["Index", "document_frequency", "idf", "lengths", "match_places", "plan_prefixes", "postings", "query_tokens", "search"]
