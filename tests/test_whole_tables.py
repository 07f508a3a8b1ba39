"""Queries over whole texts against brute force, beside their DuckDB twins."""

import os
import re
import unicodedata

import duckdb
import pytest

from orrery.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def ordered(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def test_norm_name_of_whole_texts(spark, duck):
    def brute(text):
        if text is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
        return re.sub("^the (?=.)", "", re.sub(r"[\W_]+", " ", plain).strip(" "))

    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = ordered(tuple(r) for r in QUERIES["norm_name"](spark, SF).collect())
    assert got == ordered((d, brute(t)) for d, t in docs)
    assert sum((t or "").lower().startswith("the ") for _, t in docs) > 0


def test_norm_name_drops_the_leading_the(spark, tmp_path):
    texts = ["The  Élan of\n" + "très long " * 30, "the", "THE-end", "then"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(tuple(r) for r in QUERIES["norm_name"](spark, str(tmp_path)).collect())
    assert got == {0: "elan of " + " ".join(["tres long"] * 30), 1: "the", 2: "end", 3: "then"}
