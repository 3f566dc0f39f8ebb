"""Intermediate tables in the shared checkpoint folder.

Every stage that would otherwise be recomputed, or whose lineage should end, is written as Parquet
below ``spark.checkpoint.dir``; a lost executor then costs one task, not the whole chain.  The folder
is read from the session.  Only where it is unset (tests, notebooks) one is made: a temporary folder
under a local master, else a folder below the SQL warehouse, which a cluster shares as well.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}


def root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix="roadlens-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_roadlens"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def bounded(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows than Spark's default, as rows here are whole texts; a set value stays.

    Spark itself ends a batch at 64 MB (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def path(spark: SparkSession, tag: str) -> str:
    """A fresh path for a table; ``drop`` or the end of the process removes it."""
    out = f"{root(spark)}/roadlens-{tag}-{uuid.uuid4().hex}"
    _live[out] = spark
    return out


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write df and return a DataFrame that reads what was written (``df.scratch_path`` names it)."""
    spark = df.sparkSession
    out = path(spark, tag)
    df.write.parquet(out)
    back = spark.read.schema(df.schema).parquet(out)
    back.scratch_path = out
    return back


@contextlib.contextmanager
def scope():
    """Tables made inside are deleted at its end, but for those that ``keep`` was called with."""
    before, kept = set(_live), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch_path)
        return df

    try:
        yield keep
    finally:
        for where in set(_live) - before - kept:
            _delete(_live[where], where)


def drop(*frames: DataFrame) -> None:
    """Delete tables of ``table`` that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, where: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(where)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _live.pop(where, None)


@atexit.register
def _sweep() -> None:
    for where, spark in list(_live.items()):
        if spark.sparkContext._jsc is None:
            continue
        try:
            _delete(spark, where)
        except Exception:  # noqa: BLE001 - the JVM may be gone already at exit
            return
