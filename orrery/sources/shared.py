"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go with the query that made them, not when the driver happens to collect its garbage.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir.

    Where that is unset, a session on one machine, as in tests, gets a folder of its
    own; on a cluster that is an error, as executors would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/orrery-{uuid.uuid4().hex}"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


@contextlib.contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, by: str | None = None, parts: int = 0, swept: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and lost executors don't matter.

    The table goes when it is released, or else with the session. What was shuffled for it goes as
    soon as it is written. by: a column of up to so many parts, which lie in folders of their own and
    can be released one by one; tasks write them side by side, without sorting. swept: the caller has
    drop_shuffles() do it instead.
    """
    spark, name = df.sparkSession, shared_dir(df.sparkSession)
    conf = {FILES_GO: str(not swept).lower()} | ({"spark.sql.maxConcurrentOutputFileWriters": str(parts + 1)} if by else {})
    with _set(spark, conf):
        (df.write.partitionBy(by) if by else df.write).parquet(name)
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(name)
    out.written_to = name
    return out


def release(*tables: DataFrame, part: str = "") -> None:
    """Deletes tables that materialise() wrote and no later result reads. part: only the folder <column>=<value> of each."""
    for t in tables:
        path, files = _path(t.sparkSession, f"{t.written_to}/{part}" if part else t.written_to)
        files.delete(path, True)


def drop_shuffles(df: DataFrame) -> None:
    """Has the executors delete the shuffle files of earlier jobs, which they else keep until the driver happens to collect its garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
