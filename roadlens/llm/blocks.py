"""Groups of any size met in pairs of blocks, so that no task holds a hot group.

A group of n rows above a limit is cut into blocks by a hash of the node; each row goes to the cells of
its block with every block, and a cell is a unit of work of its own.  Which groups are large is a stored
table that is joined by the group's key (broadcast only where the planner finds it small), never a list
on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

WIDE = 1 << 24


def dealt(entries: DataFrame, group: list[str], limit: int) -> DataFrame:
    """entries (group columns, node, ...) with cell and block; rows of large groups once for each block.

    Small groups are cell 0.  A group over the limit has blocks of about limit / 4 rows, but at most
    eight of them, until these would be over 2 * limit rows each: as rows are repeated once a block, much
    larger groups have blocks of that size.
    """
    n = F.col("_n")
    blocks = F.greatest(F.least(F.lit(8), F.ceil(n * 4 / limit)), F.ceil(n / (2 * limit))).cast("int")
    large = scratch.table(entries.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(n > limit).select(*group, blocks.alias("_blocks")), "large")
    if large.isEmpty():
        scratch.drop(large)
        return entries.withColumns({"cell": F.lit(0).cast("long"), "block": F.lit(0)})
    count = F.col("_blocks")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    each = F.explode(F.when(count.isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), count - 1)))
    rows = entries.join(large, group, "left").withColumn("block", F.coalesce(own, F.lit(0))).withColumn("_other", each)
    cell = 1 + F.least("block", "_other").cast("long") * WIDE + F.greatest("block", "_other")
    return rows.withColumn("cell", F.when(F.col("_other") < 0, F.lit(0).cast("long")).otherwise(cell)).drop("_other", "_blocks")


def crosses(cell: int) -> bool:
    """Whether a cell is of two different blocks, whose own pairs are met elsewhere."""
    return cell > 0 and (cell - 1) // WIDE != (cell - 1) % WIDE
