"""Balanced shards of indivisible groups by Karmarkar-Karp differencing (law ``bytes``).

Rows with equal texts form a group that stays together.  Each task reduces its groups, dealt by text
hash, to one partial partition: the two partial partitions of largest spread are combined, one's
heaviest parts with the other's lightest, until one is left.  What differs between tasks is then a
vector of ``shards`` sums each, and the driver combines those vectors by the same rule; it holds
``tasks * shards`` numbers, never groups.

Defined cases: a null text has 0 bytes (size 8) and is a group of its own, an empty text equals other
empty texts; repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks, scratch
from . import textvec as tv

SHARDS = 24


def difference(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the shard of each size, and the shards' sums.

    Sizes are single items, or rows of a matrix (partial partitions); then the result is, per row, a
    permutation: entry j is the final shard of that row's part j.
    """
    single = sizes.ndim == 1
    rows = len(sizes)
    if rows == 0:
        return (np.zeros(0, np.int64) if single else np.zeros((0, shards), np.int64)), np.zeros(shards, np.int64)
    if single:
        spread, parts = sizes, None
    else:
        spread, parts = sizes.max(1) - sizes.min(1), np.sort(sizes, 1)
    # a node's parts ascend; `left[node]` and `right[node]` are its children, the right one reversed
    sums: dict[int, np.ndarray] = {}
    how: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(spread)]
    heapq.heapify(heap)

    def of(i: int) -> np.ndarray:
        if i in sums:
            return sums.pop(i)
        if single:
            x = np.zeros(shards, np.int64)
            x[-1] = sizes[i]
            return x
        return parts[i]

    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heap[0]
        x = of(i) + of(j)[::-1]
        order = np.argsort(x, kind="stable")
        node = rows + len(how)
        how.append((i, j, order))
        x = x[order]
        sums[node] = x
        heapq.heapreplace(heap, (int(x[0] - x[-1]), node))
    last = heap[0][1]
    total = of(last)
    # downwards: the shard of each (sorted) part of a node
    place: dict[int, np.ndarray] = {last: np.arange(shards)}
    for k in range(len(how) - 1, -1, -1):
        i, j, order = how[k]
        mine = place.pop(rows + k)
        back = np.empty(shards, np.int64)
        back[order] = mine
        place[i], place[j] = back, back[::-1]
    if single:
        return np.array([place[i][-1] for i in range(rows)], np.int64), total
    out = np.empty((rows, shards), np.int64)
    for i in range(rows):
        out[i, np.argsort(sizes[i], kind="stable")] = place[i]
    return out, total


def _local(shards: int):
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        where, sums = difference(t.column("bytes").to_numpy(), shards)
        first = t.column("group").chunk(0)[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [t.column("group").chunk(0), pa.array(where, pa.int32()), pa.array([first] * t.num_rows, pa.string()), pa.array([sums.tolist()] + [None] * (t.num_rows - 1), pa.list_(pa.int64()))],
            names=["group", "part", "task", "sums"],
        )

    return run


def by_bytes(docs: DataFrame, shards: int = SHARDS, groups_per_task: int = 100_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("copy"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.concat(F.lit("null "), F.monotonically_increasing_id())).otherwise(F.md5(text.cast("binary"))).alias("group"),
    )
    rows = scratch.table(rows, "sizes")
    spark = rows.sparkSession
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    n = groups.count()
    tasks = max(1, -(-n // groups_per_task))
    # a stored table: the permutation of a task must be applied to the parts it was computed from
    local = scratch.table(groups.repartition(tasks, F.xxhash64("group")).sortWithinPartitions("group").mapInArrow(tv.tidy(_local(shards)), "group string, part int, task string, sums array<long>"), "parts")
    found = local.where("sums is not null").select("task", "sums").orderBy("task").collect()  # one row a task
    final, _ = difference(np.array([r["sums"] for r in found], np.int64).reshape(-1, shards), shards)
    names = spark.createDataFrame([(r["task"], [int(x) for x in p]) for r, p in zip(found, final, strict=True)], "task string, finals array<int>")
    placed = local.join(F.broadcast(names), "task").select("group", F.element_at("finals", F.col("part") + 1).alias("shard"))
    dealt = scratch.table(rows.join(placed, "group").drop("group"), "dealt")
    scratch.drop(rows, local)
    out = ranks.ranked(dealt, "shard", ["doc_id", "copy"], rank="slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
