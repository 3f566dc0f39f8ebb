"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised; on the sphere a cosine of at least 0.93 is a distance of at most 0.374.  A
table's bucket is the tuple of K quantised random (Gaussian) projections floor((a.x + b) / w), within
a label and dimension.  K, w and the number of tables are planned from the largest label's size so
that a pair at the threshold shares a bucket with probability ``recall`` and closer ones more surely.
In a bucket all pairs are compared by exact double-precision cosine.

Nothing is emitted by pair: a pair counts in the first table in which it shares a bucket (the task
recomputes both keys), a bucket sends on each vector's number of links and one edge to its least
linked one.  Equal vectors of a label collapse first and count by their number.  Buckets over
``BUCKET`` vectors are cut into blocks that meet pairwise in tasks of their own (``blocks``); none is capped.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without a label, link with nothing; vectors of different lengths do not link; repeated rows are
vectors of their own; a null vec_id takes no part and keeps a null component; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, scratch
from . import textvec as tv
from .components import components

COSINE = 0.93
BUCKET = 512


def collide(d: float, w: float) -> float:
    """P(two points at distance d share a cell of width w on a Gaussian projection)."""
    r = w / d
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = 0.98) -> dict:
    """K, w and tables for n vectors of a label."""
    d = math.sqrt(2 - 2 * cosine)
    best = None
    for w in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        p, far = collide(d, w), collide(math.sqrt(2 - 2 * 0.2), w)
        for k in range(1, 33):
            tables = math.ceil(math.log(1 - recall) / math.log(1 - p**k))
            if tables > 400:
                break
            cost = tables * (1 + n * far**k * 0.002)
            if best is None or cost < best["cost"]:
                best = {"k": k, "width": w, "tables": tables, "cost": cost}
    return best


class Hash:
    def __init__(self, plan_: dict, seed: int = 11):
        self.k, self.width, self.tables, self.seed = plan_["k"], plan_["width"], plan_["tables"], seed
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Bucket keys, rows by tables, of normalised vectors."""
        dim = x.shape[1]
        if dim not in self.made:
            rng = np.random.Generator(np.random.PCG64([self.seed, dim]))
            self.made[dim] = rng.standard_normal((dim, self.tables * self.k)), rng.uniform(0, self.width, self.tables * self.k)
        a, b = self.made[dim]
        # a fixed order of additions: a row's cells must not depend on the rows beside it
        cells = np.floor((np.einsum("ij,jk->ik", x, a, optimize=False) + b) / self.width).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(x), self.tables, self.k)
        out = np.zeros((len(x), self.tables), np.uint64)
        for j in range(self.k):
            out = tv.mix(out + cells[:, :, j] * tv.COMBINE[j])
        return out.view(np.int64)


def normalised(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


ENTRY = "label int, dim int, tab int, bucket long, node long, m long, v array<double>"


def _deal(hash_of):
    """(label, dim, node, m, v) to bucket entries, one dimension at a time."""

    def run(batches):
        for batch in batches:
            label, dim, node, m = (batch.column(i).to_numpy() for i in range(4))
            for d in np.unique(dim):
                for part in np.array_split(np.flatnonzero(dim == d), max(1, int((dim == d).sum()) // 2000)):
                    raw = batch.column(4).take(pa.array(part))
                    x = normalised(raw.flatten().to_numpy().reshape(len(part), int(d)))
                    keys = hash_of.value.keys(x)
                    n = len(part)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * int(d), pa.int32()), pa.array(x.ravel()))
                    for t in range(keys.shape[1]):
                        yield pa.RecordBatch.from_arrays([*map(pa.array, (label[part], np.full(n, d, np.int32), np.full(n, t, np.int32), keys[:, t].copy(), node[part], m[part])), flat], names=["label", "dim", "tab", "bucket", "node", "m", "v"])

    return run


def _links(hash_of, cosine: float):
    """Sorted bucket entries to (node, links, other): links counted here, and an edge to a linked node."""

    def run(batches):
        held = None

        def work(tab, cell, block, node, m, x):
            n = len(node)
            if n < 2:
                return None
            keys = hash_of.value.keys(x)
            cross = blocks.crosses(cell)
            count, root = np.zeros(n, np.int64), np.arange(n)
            hits = []
            for lo in range(0, n, 1024):
                hi = min(n, lo + 1024)
                ok = np.einsum("ij,kj->ik", x[lo:hi], x, optimize=True) >= cosine
                ok &= np.arange(lo, hi)[:, None] < np.arange(n)[None, :]
                ok &= ~(cross & (block[lo:hi, None] == block[None, :]))
                i, j = np.nonzero(ok)
                i += lo
                if len(i):
                    new = ~(keys[i, :tab] == keys[j, :tab]).any(1) if tab else np.ones(len(i), bool)
                    np.add.at(count, i[new], m[j[new]])
                    np.add.at(count, j[new], m[i[new]])
                    hits.append((i, j))
            if not hits:
                return None
            i, j = (np.concatenate(h) for h in zip(*hits, strict=True))
            while True:  # components of the bucket
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[root]
                if (root == before).all():
                    break
            some = np.zeros(n, bool)
            some[i] = some[j] = True
            return node[some], count[some], node[root[some]]

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("label", "dim", "tab", "bucket", "cell")], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(cut):
                yield from _groups(held.slice(0, cut[-1]), key[: cut[-1]], np.append(0, cut), work)
                held = held.slice(cut[-1]).combine_chunks()
        if held is not None and held.num_rows:
            key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("label", "dim", "tab", "bucket", "cell")], 1)
            yield from _groups(held, key, np.array([0, len(key)]), work)

    return run


def _groups(t, key, bounds, work):
    block, node, m = (t.column(c).to_numpy() for c in ("block", "node", "m"))
    flat = t.column("v").combine_chunks()
    flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
    at = np.append(0, np.cumsum(key[:, 1]))
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo > 1:
            got = work(int(key[lo, 2]), int(key[lo, 4]), block[lo:hi], node[lo:hi], m[lo:hi], flat[at[lo] : at[hi]].reshape(hi - lo, -1))
            if got:
                out.append(got)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["node", "links", "other"])


def link(vectors: DataFrame, cosine: float = COSINE, recall: float = 0.98, bucket: int = BUCKET) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform("v", F.abs))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v"))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & (largest > 0), F.lit(False))
    key = F.when(valid, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json("v")), 256))
    rows = scratch.table(rows.select("vec_id", "label", "v", key.alias("key")), "vectors")
    good = rows.where("key is not null")
    nodes = scratch.table(good.groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("m"), F.first("label").alias("label"), F.first("v").alias("v")), "nodes")
    most = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    hash_of = spark.sparkContext.broadcast(Hash(plan(max(2, most), cosine, recall)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = nodes.select("label", F.size("v").alias("dim"), "node", "m", "v").repartition(parts)
    group = ["label", "dim", "tab", "bucket"]
    entries = blocks.dealt(deal.mapInArrow(tv.tidy(_deal(hash_of)), ENTRY), group, bucket).select(*group, "cell", "block", "node", "m", "v")
    found = entries.repartition(parts, *group, "cell").sortWithinPartitions(*group, "cell").mapInArrow(tv.tidy(_links(hash_of, cosine)), "node long, links long, other long")
    found = scratch.table(found, "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("key", "node", "m").join(counts, "node", "left").join(roots, "node", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    own = good.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    rest = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
