"""Near-duplicate classes by SimHash and the May-Ozerov nearest-neighbour recursion.

A text is the set of its 5-word shingles (words of ASCII letters and digits and non-ASCII characters,
A-Z as a-z; a text of 1 to 4 words is one shingle).  Its fingerprint has 128 SimHash bits.  Two texts
link if the shingle sets' Jaccard similarity is at least 0.8; classes are the linked components.

A second fingerprint of 128 bits is asked of each found pair at once, in both passes.  The
thresholds of both let similar pairs pass; texts of at most ``FEW`` shingles, whose bits agree less at
the same similarity, are also searched among themselves by a plan of their own.

Search (May and Ozerov, EUROCRYPT 2015): the coordinates are split at random into strips; a list is
filtered to the fingerprints whose weight on a strip, relative to a random centre, is small; each
filtered list is filtered again on the next strip, and the lists that are left are compared by brute
force.  Number of strips, weight, centres and repetitions are planned from the number of distinct
texts, so that the lists stay small and a pair of similarity 0.8 is found with probability ``recall``
(closer pairs more surely).

Equal texts collapse first and are never paired.  Pass one keeps, of all a fingerprint's lists, only its
nearest other one and its nearest of lesser id; those pairs are checked on the shingle sets, and linked.
Pass two takes the texts that have any near fingerprint and emits the pairs whose classes still
differ, so a large class is not expanded into its pairs.  Of these the pairs that cannot be similar end
where their lists are compared, without their texts: by the triangle inequality over a pivot of each large
near group (``pivots``), and by the sizes and odd sketches of the shingle sets (``sketches``), which bound their
difference from below.  Lists over ``LIST`` are cut into blocks which meet pairwise in tasks of their own.

Defined cases: null texts are classes of their own; texts without words are linked only to equal
texts; repeated rows share class and ``kept``; a null doc_id keeps a null class; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, scratch
from . import textvec as tv
from .components import components

BITS = 128
SHINGLE = 5
SIMILARITY = 0.8
NEAR = 36  # bits in which fingerprints of texts of similarity 0.8 differ at most (19.4 +- 4.1 expected: 99.99 %)
FEW = 25  # shingles up to which texts are searched a second time, as ties of few bits flip more
FEW_FLIP = 0.1875  # how often a bit differs between 4 shingles and those with a fifth, the worst case of similarity 0.8
FEW_NEAR = 40  # NEAR of that search (24 +- 4.4: 99.98 %)
SURE = 76  # bits over 256 (48 +- 6.2 in the worst case: over 99.999 %), asked of a pair before its texts are fetched
LIST = 2048
ODD = 2048  # bits of an odd sketch; sets that differ in some 1000 shingles and more are told apart by it less and less
LANES = tv.U64(0x0101010101010101)


def shingles(h: np.ndarray) -> np.ndarray:
    """Shingle hashes of one text's word hashes."""
    return tv.ngrams(h, min(SHINGLE, len(h))) if len(h) else np.zeros(0, np.uint64)


def _sets(s: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the rows of a slice: (row, hash)."""
    ws, we, off = s.words(tv.ALNUM)
    h = s.span_hash(ws, we)
    n = np.diff(off)
    grams = tv.ngrams(h, SHINGLE)
    at = tv.ragged(off[:-1], np.maximum(n - SHINGLE + 1, 0))
    row, own = np.repeat(np.arange(s.rows), np.maximum(n - SHINGLE + 1, 0)), grams[at] if len(at) else np.zeros(0, np.uint64)
    short = [(r, shingles(h[off[r] : off[r + 1]])[0]) for r in np.flatnonzero((n > 0) & (n < SHINGLE))]
    if short:
        row, own = np.append(row, [x[0] for x in short]), np.append(own, np.array([x[1] for x in short], np.uint64))
    key = np.unique((row.astype(np.uint64) << tv.U64(44)) | (own >> tv.U64(20)))
    return (key >> tv.U64(44)).astype(np.int64), key & tv.U64((1 << 44) - 1)


def _bit_counts(h: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often each of 256 hash bits is set in each run of h (starts ``at``, lengths ``count``).

    Bits are added eight to a word, in the bytes of 64-bit lanes, over at most 255 hashes; those sums are
    added up as bytes.
    """
    pieces = -(-count // 255)
    run = np.repeat(np.arange(len(at)), pieces)
    begin = at[run] + 255 * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lanes = np.empty((len(begin), 32), np.uint64)
    for i in range(4):
        word = tv.mix(h * tv.COMBINE[11 + i])
        for k in range(8):
            lanes[:, 8 * i + k] = np.add.reduceat((word >> tv.U64(k)) & LANES, begin)
    return np.add.reduceat(lanes.view(np.uint8), np.cumsum(pieces) - pieces, axis=0, dtype=np.int32)


def _fingerprints(batches):
    for batch in batches:
        f = np.zeros((batch.num_rows, 4), np.int64)
        some = np.zeros(batch.num_rows, bool)
        few = np.zeros(batch.num_rows, bool)
        for s in tv.slices(batch.column(2), 1 << 19):
            row, h = _sets(s)
            if not len(row):
                continue
            at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            count = np.diff(np.append(at, len(row)))
            ones = _bit_counts(h, at, count)
            f[s.first + row[at]] = np.packbits(2 * ones > count[:, None], axis=1).view(np.int64)
            some[s.first + row[at]] = True
            few[s.first + row[at]] = count <= FEW
        off = ~some
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(f[:, i].copy(), mask=off) for i in range(4)), pa.array(few)], names=["doc_id", "key", "f0", "f1", "f2", "f3", "few"])


def _tail(m: int, w: int, p: float) -> tuple[float, float]:
    """P(weight <= w) of m fair bits, and the same for a neighbour with bits flipped at rate p, given it."""
    fair = [math.comb(m, i) / 2.0**m for i in range(m + 1)]
    q = sum(fair[: w + 1])
    both = 0.0
    for x in range(w + 1):
        off = [math.comb(x, i) * p**i * (1 - p) ** (x - i) for i in range(x + 1)]
        on = [math.comb(m - x, i) * p**i * (1 - p) ** (m - x - i) for i in range(m - x + 1)]
        upto = np.cumsum(on)
        both += fair[x] * sum(off[i] * upto[min(m - x, w - x + i)] for i in range(x + 1) if w - x + i >= 0)
    return q, both / q if q else 0.0


def plan(n: int, recall: float = 0.98, similarity: float = SIMILARITY, least_flip: float = 0.0) -> dict:
    """Strips, weight, centres a strip and repetitions for n fingerprints."""
    cosine = 2 * similarity / (1 + similarity)
    p = max(least_flip, math.acos(cosine) / math.pi)
    best = None
    for t in (2, 3, 4):
        m = BITS // t
        for w in range(max(1, m // 5), m // 2):
            q, stay = _tail(m, w, p)
            if q < 1 / 4096 or stay <= 0:
                continue
            for g in (1.0, 1.5, 2.0):
                centres = math.ceil(g / q)
                found = 1.0
                for _ in range(t):
                    found = 1 - math.exp(-centres * q * stay * found)
                times = max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))
                rows = times * (centres * q) ** t
                cost = n * (rows * 4e-6 + rows * n * q**t / 2 * 5e-9 + times * centres * sum((centres * q) ** i for i in range(t)) * 5e-9)
                if best is None or cost < best["cost"]:
                    best = {"strips": t, "size": m, "weight": w, "centres": centres, "times": times, "rows": rows, "list": n * q**t, "cost": cost}
    return best


class Filters:
    """The random strips and centres of a plan, the same in every task."""

    def __init__(self, plan_: dict, seed: int = 97):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.weight = plan_["weight"]
        self.levels = []
        for _ in range(plan_["times"]):
            order = rng.permutation(BITS)
            strips = []
            for k in range(plan_["strips"]):
                bits = np.zeros(BITS, np.uint8)
                bits[order[k * plan_["size"] : (k + 1) * plan_["size"]]] = 1
                strips.append((np.packbits(bits).view(np.uint64), rng.integers(0, 2**64, (plan_["centres"], 2), dtype=np.uint64)))
            self.levels.append(strips)

    def lists(self, f: np.ndarray):
        """(row, list) of fingerprints f (n, 2) as uint64, a repetition at a time."""
        for r, strips in enumerate(self.levels):
            row, key = np.arange(len(f)), np.full(len(f), r, np.int64)
            for mask, centres in strips:
                x = f[row]
                rows, keys = [], []
                for lo in range(0, len(row), 20_000):
                    part = x[lo : lo + 20_000]
                    for c in range(0, len(centres), 64):
                        z = centres[c : c + 64]
                        w = np.bitwise_count((part[:, None, 0] ^ z[None, :, 0]) & mask[0]) + np.bitwise_count((part[:, None, 1] ^ z[None, :, 1]) & mask[1])
                        i, j = np.nonzero(w <= self.weight)
                        rows.append(row[lo + i])
                        keys.append(key[lo + i] * len(centres) + c + j)
                row, key = (np.concatenate(rows), np.concatenate(keys)) if rows else (row[:0], key[:0])
            yield row, key


ONE = {"node": "long", "f0": "long", "f1": "long", "f2": "long", "f3": "long"}  # an entry's columns in pass one
TWO = ONE | {"root": "long", "pivot": "long", "far": "double", "size": "long", "odd": "binary"}  # and in pass two


def _deal(filters_of, names: list[str]):
    """Nodes with these columns to entries of lists."""

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            f = np.stack([cols["f0"].to_numpy(), cols["f1"].to_numpy()], 1).view(np.uint64)
            for row, key in filters_of.value.lists(f):
                yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(pa.array(row)) for c in cols.values())], names=["list", *names])

    return run


def _array(c: pa.Array) -> np.ndarray:
    """A column of entries; sketches as rows of words."""
    if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
        return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), ODD // 64)
    return c.to_numpy()


def _alike(x: dict, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows i and j may be similar: exact bounds, which no similar pair exceeds.

    Of sets A and B of Jaccard similarity J or more, (1 - J) / (1 + J) * (|A| + |B|) elements at most are in one
    only; the sizes differ by no more than that, and the odd sketches in no more bits.
    """
    size, odd, least = x["size"], x["odd"], similarity - 1e-9
    most = (1 - least) / (1 + least) * (size[i] + size[j]) + 1e-6
    ok = np.abs(size[i] - size[j]) <= most
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), 8192):
        k = at[lo : lo + 8192]
        ok[k] = np.bitwise_count(odd[i[k]] ^ odd[j[k]]).sum(1, dtype=np.int64) <= most[k]
    return ok


def _compare(x: dict, cross: bool, all_pairs: bool, near: int, similarity: float):
    """(node, other, bits) of one list (or pair of blocks) with fingerprints at most ``near`` bits apart, and ``SURE`` of 256.

    All pairs of different roots, node < other; or of each node its nearest other one and its nearest
    among those of lesser id, by which a group of near copies hangs together at once.  As 1 - Jaccard is
    a metric, two texts whose distances to a common pivot differ by over 1 - similarity are no pair; nor are
    those that are not ``_alike``, where x has sketches.
    """
    node, n = x["node"], len(x["node"])
    f = [x[f"f{k}"].view(np.uint64) for k in range(4)]
    out = []
    if all_pairs and (x["root"] == x["root"][0]).all():
        return out
    step = max(1, min(256, (1 << 18) // n))
    for lo in range(0, n, step):
        d = np.bitwise_count(f[0][lo : lo + step, None] ^ f[0])
        d += np.bitwise_count(f[1][lo : lo + step, None] ^ f[1])
        d = d.ravel()
        at = np.flatnonzero(d <= near)  # few, so all else is asked of these only
        i, j = np.divmod(at, n)
        i += lo
        ok = node[i] < node[j] if all_pairs else node[i] != node[j]
        if cross:
            ok &= x["block"][i] != x["block"][j]
        if all_pairs:
            ok &= x["root"][i] != x["root"][j]
            ok &= (x["pivot"][i] != x["pivot"][j]) | (np.abs(x["far"][i] - x["far"][j]) <= 1 - similarity + 1e-6)
        i, j, bits = i[ok], j[ok], d[at[ok]].astype(np.int64)
        # pairs near in 128 bits by chance are in the order of the square of the corpus: they end here
        ok = bits + sum(np.bitwise_count(f[k][i] ^ f[k][j]).astype(np.int64) for k in (2, 3)) <= SURE
        i, j, bits = i[ok], j[ok], bits[ok]
        if all_pairs:
            ok = _alike(x, i, j, similarity) if "odd" in x else slice(None)
            out.append(np.stack([node[i[ok]], node[j[ok]], bits[ok]], 1))
            continue
        for part in (slice(None), node[j] < node[i]):
            own, key = i[part], bits[part] << 32 | j[part]
            if len(own):
                begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                best = np.minimum.reduceat(key, begin)
                out.append(np.stack([node[own[begin]], node[best & 0xFFFFFFFF], best >> 32], 1))
    return out


def _nearest(x: np.ndarray) -> np.ndarray:
    """Of rows (node, other, bits) each node's nearest other one and nearest of lesser id."""
    keep = []
    for part in (x, x[x[:, 1] < x[:, 0]]):
        part = part[np.lexsort((part[:, 1], part[:, 2], part[:, 0]))]
        keep.append(part[np.append(True, part[1:, 0] != part[:-1, 0])] if len(part) else part)
    return np.unique(np.concatenate(keep), axis=0)


def _search(all_pairs: bool, near: int, similarity: float):
    """Entries sorted by (list, cell) to what ``_compare`` finds, without repetitions."""

    def run(batches):
        held: dict = {}
        found: list = []

        def work(x):
            if len(x["node"]) > 1:
                found.extend(_compare(x, blocks.crosses(int(x["cell"][0])), all_pairs, near, similarity))

        def gather():
            x = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            found[:] = [np.unique(x, axis=0) if all_pairs else _nearest(x)]
            return found[0]

        def batch_of(x):
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32))], names=["node", "other", "bits"])

        limit = 200_000
        for batch in batches:
            cols = dict(zip(batch.schema.names, map(_array, batch.columns), strict=True))
            if not batch.num_rows:
                continue
            if held:
                cols = {c: np.concatenate([held[c], v]) for c, v in cols.items()}
            lists, cells = cols["list"], cols["cell"]
            cut = np.append(np.flatnonzero((lists[1:] != lists[:-1]) | (cells[1:] != cells[:-1])) + 1, len(lists))
            at = 0
            for to in cut[:-1]:
                work({c: v[at:to] for c, v in cols.items()})
                at = to
            held = {c: v[at:] for c, v in cols.items()}
            if sum(map(len, found)) > limit:
                left = len(gather())
                if all_pairs or left > 4_000_000:
                    yield batch_of(found.pop())
                else:
                    limit = max(200_000, 2 * left)
        if held:
            work(held)
        yield batch_of(gather())

    return run


def _zip(batches):
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([z.compress(t.encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["node", "z"])


def _shingled(z: zstandard.ZstdDecompressor, raw: bytes) -> np.ndarray:
    """Distinct shingles of a text of ``_zip``."""
    t = z.decompress(raw)
    s = tv.Slice(0, np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    ws, we, _ = s.words(tv.ALNUM)
    return np.unique(shingles(s.span_hash(ws, we)))


def _sketched(batches):
    """(node, z) to (node, number of distinct shingles, their odd sketch)."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        sets = [_shingled(z, raw.as_py()) for raw in batch.column(1)]
        odd = [np.packbits((np.bincount((tv.mix(h) % tv.U64(ODD)).astype(np.int64), minlength=ODD) & 1).astype(bool)).tobytes() for h in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(odd, pa.binary())], names=["node", "size", "odd"])


def sketches(texts: DataFrame) -> DataFrame:
    """(node, size, odd) of texts (node, z): a bit of ``odd`` is the parity of the number of shingles that fall on it.

    Two sketches differ in at most as many bits as there are shingles in one set only (Mitzenmacher, Pagh and
    Pham, WWW 2014).  Versions of one document have a row each.
    """
    return texts.mapInArrow(tv.tidy(_sketched), "node long, size long, odd binary").distinct()


def _similar(batches):
    """(a, b, za, zb) to (a, b, Jaccard similarity of the texts)."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            memo: dict[int, np.ndarray] = {}

            def shingled(node, raw, memo=memo):
                if node not in memo:
                    memo[node] = _shingled(z, raw)
                return memo[node]

            out = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                p, q = shingled(int(x), part.column(2)[i].as_py()), shingled(int(y), part.column(3)[i].as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / max(1, len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], names=["a", "b", "j"])


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the Jaccard similarity j of their texts (node, z)."""
    left = texts.select(F.col("node").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(tv.tidy(_similar), "a long, b long, j double")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs (a, b) whose texts (node, z) are at least so similar."""
    return similarities(pairs, texts).where((F.col("j") > 0) & (F.col("j") >= similarity - 1e-9)).select("a", "b")


def pivots(near: DataFrame, good: DataFrame, texts: DataFrame, least: int = 64) -> DataFrame:
    """(node, pivot, far): a text common to a node's whole near group, and 1 - similarity to it.

    A near group is what hangs together by near pairs (a, b), similar or not; its pivot is the text with
    most links.  Groups of fewer than ``least`` texts have none: their pairs are few.
    """
    group = scratch.table(components(near), "groups")
    both = good.union(good.select("b", "a")).toDF("node", "_x")
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("node", F.struct(F.coalesce("n", F.lit(0)), -F.col("node")))
    hub = group.join(degree, "node", "left").groupBy("root").agg(best.alias("pivot"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    hub = scratch.table(hub.select("root", "pivot", F.ceil(F.col("size") / least).cast("int").alias("salts")), "hubs")
    # the pivot's text goes once for each ``least`` texts, so that no task holds a group
    centre = hub.join(texts, F.col("pivot") == F.col("node")).select("pivot", F.col("z").alias("zb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    mine = group.join(hub, "root").where("node <> pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    pairs = mine.join(texts.select("node", F.col("z").alias("za")), "node").join(centre, ["pivot", "salt"])
    far = pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b"), "za", "zb").mapInArrow(tv.tidy(_similar), "a long, b long, j double")
    return far.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("j")).alias("far")).union(hub.select("pivot", "pivot", F.lit(0.0)))


def _candidates(nodes: DataFrame, filters_of, limit: int, all_pairs: bool, near: int = NEAR, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct candidate pairs (a, b) among nodes (columns ``TWO`` or ``ONE``); at most two of each node unless ``all_pairs``."""
    spark = nodes.sparkSession
    kinds = TWO if all_pairs else ONE
    schema = ", ".join(f"{c} {k}" for c, k in ({"list": "long"} | kinds).items())
    entries = blocks.dealt(nodes.select(*kinds).mapInArrow(tv.tidy(_deal(filters_of, list(kinds))), schema), ["list"], limit).select("list", "cell", "block", *kinds)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = entries.repartition(parts, "list", "cell").sortWithinPartitions("list", "cell").mapInArrow(tv.tidy(_search(all_pairs, near, similarity)), "node long, other long, bits int")
    if not all_pairs:
        nearest = F.struct("bits", "other")
        found = found.groupBy("node").agg(F.min(nearest).alias("x"), F.min(F.when(F.col("other") < F.col("node"), nearest)).alias("y"))
        found = found.select("node", F.explode(F.array("x.other", "y.other")).alias("other")).where("other is not null")
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def links(reps: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, recall: float = 0.98, limit: int = LIST) -> DataFrame:
    """(node, root) of the linked ones of reps (node, f0 to f3, few); texts has each node's text."""
    spark = reps.sparkSession
    n = reps.count()
    filters_of = spark.sparkContext.broadcast(Filters(plan(max(2, n), recall, similarity)))
    n_few = reps.where("few").count()
    few_of = spark.sparkContext.broadcast(Filters(plan(max(2, n_few), recall, similarity, FEW_FLIP)))

    def search(nodes: DataFrame, all_pairs: bool) -> DataFrame:
        found = _candidates(nodes, filters_of, limit, all_pairs, NEAR, similarity)
        if not n_few:
            return found
        return found.union(_candidates(nodes.where("few"), few_of, limit, all_pairs, FEW_NEAR, similarity)).distinct()

    deal = reps.select(*ONE, "few").repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 2000))))
    first = scratch.table(search(deal, False), "near")
    active = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    packed = texts.where("text is not null").mapInArrow(tv.tidy(_zip), "node long, z binary")
    # by sort and merge at every size: what is right for a large corpus is what small ones test
    own = scratch.table(packed.join(active.hint("merge"), "node"), "texts")
    good = scratch.table(verified(first, own, similarity), "links")
    roots = components(good)
    pivot = scratch.table(pivots(first, good, own), "pivots")
    again = active.join(reps, "node").join(roots, "node", "left").join(pivot, "node", "left").join(sketches(own), "node")
    again = again.select("node", "f0", "f1", "f2", "f3", F.coalesce("root", "node").alias("root"), F.coalesce("pivot", -1 - F.col("node")).alias("pivot"), F.coalesce("far", F.lit(0.0)).alias("far"), "size", "odd", "few")
    again = scratch.table(again, "active")
    # the pairs of pass one that failed are known; what is left has different roots
    rest = search(again, True).join(first, ["a", "b"], "left_anti")
    more = scratch.table(verified(rest, own, similarity), "links")
    return components(good.union(more))


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = 0.98, limit: int = LIST) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of the class) and kept (doc_id = class_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select("doc_id", F.when(F.col("text").isNull(), F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    prints = scratch.table(keyed.mapInArrow(tv.tidy(_fingerprints), "doc_id long, key string, f0 long, f1 long, f2 long, f3 long, few boolean"), "prints")
    equal = scratch.table(prints.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), *(F.min(f"f{i}").alias(f"f{i}") for i in range(4)), F.min("few").alias("few")), "equal")
    roots = links(equal.where("f0 is not null").select("node", "f0", "f1", "f2", "f3", "few"), docs.select(F.col("doc_id").alias("node"), "text").where("node is not null"), similarity, recall, limit)
    named = equal.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("class_id"))
    out = prints.where("doc_id is not null").select("doc_id", "key").join(named, "key").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    return out.union(prints.where("doc_id is null").select("doc_id", F.lit(None).cast("long"), F.lit(False)))
