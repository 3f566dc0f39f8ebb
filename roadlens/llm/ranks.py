"""Gapless ranks within keys that may be very large, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, key: str, order: list[str], rank: str = "rank", least: int = 2000, parts: int = 50_000) -> DataFrame:
    """Add ``rank`` (0.. within each value of the non-null int column ``key``; ``order`` makes rows unique).

    df must be a stored table: it is read three times.  A key with n rows is dealt into about
    n / max(least, total / parts) salts, so no task holds a whole hot key; the salts' offsets are a
    table of at most (distinct keys + parts + 1) rows, which is what gets broadcast.  Keys must come
    from a set of bounded size (lengths, shards).
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    each = max(least, -(-total // parts))
    salts = sizes.select(key, F.ceil(F.col("_n") / each).cast("int").alias("_salts"))
    salted = df.join(F.broadcast(salts), key).withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts")).cast("int")).drop("_salts")
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_within", within).join(F.broadcast(offsets), [key, "_salt"]).withColumn(rank, F.col("_before") + F.col("_within")).drop("_salt", "_within", "_before")
