"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import drop_shuffles, materialise, release, shared_dir

__all__ = ["WORD", "draw32", "drop_shuffles", "free_name", "materialise", "n_words", "release", "shared_dir", "table", "text_bytes"]

#: Words are maximal runs of code points that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame) -> str:
    """A name, of underscores, that no column of df begins with."""
    return "_" * (1 + max(map(len, df.columns), default=0))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def draw32(key: Column, seed: str) -> Column:
    """A uniform number in 0 .. 2^32-1 that depends on the key and seed alone."""
    salted = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(salted), 1, 8), 16, 10).cast("long")
