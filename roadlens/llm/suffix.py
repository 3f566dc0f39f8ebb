"""Exact removal of repeated byte strings (suffix-array deduplication at corpus scale).

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier: in a document of smaller
id, or earlier in the same one.  Sorting all suffixes of a corpus is neither affordable nor needed;
the work is cut in a way that loses nothing:

1. Every LENGTH-byte window is assigned to its least GRAM-byte hash (the leftmost of equals), which
   depends on the window's bytes alone, so equal windows meet at equal hashes.  Consecutive windows
   with one such anchor form a run; a run's context is its windows' bytes.
2. Runs meet by anchor hash in one shuffle of small rows.  All but the first run of equal contexts
   are repeated whole.  A first one can only share windows with runs of the same hash whose contexts
   differ, and only then are its bytes fetched.  Two contexts with a common window also agree on the
   anchor and (LENGTH - GRAM) / 2 bytes to its left, or as many to its right; contexts without such a
   partner are dropped.  A run carries 32 bits of hash for either side, so that runs which only share a
   GRAM by chance, more of them the larger the corpus is, end where they meet.
3. Those contexts, routed by hash, are cut into shards; the shards' Burrows-Wheeler transforms are
   merged by interleave refinement (module bwt), and the intervals of equal LENGTH-byte prefixes are
   the repeated windows; all but an interval's earliest member are marked.
4. Marked runs are united by document and taken out of its bytes.

Skew: a task marks later copies of a context itself and sends on only the first, so a context is
sent once a task at most.  A hash with more than GROUP different contexts (the edge of a passage that
many documents hold) leaves step 3: its windows are hashed singly, combined in each task first, and
dealt by window.  A sample of the documents decides only which hashes are dealt by context as well
from the start; results do not depend on it.  Texts travel compressed.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; rows of equal doc_id are
versions of one document, their positions compared by start; a null doc_id takes no part and keeps
its bytes; extra columns are kept by ``strip`` and ignored by ``dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, scratch
from . import textvec as tv

LENGTH = 100
GRAM = 24
GROUP = 5000  # contexts of one hash resolved together
BUCKET = 1 << 20  # bytes of contexts merged together
SHARDS = 4
PIECE = 1 << 18  # bytes hashed at once
SAMPLE = 20_000  # documents, about, whose hashes are counted to find hot ones

MARK, EDGE, HOT = 0, 1, 2
LOW = 0xFFFF  # a run's column n: its windows, and above them the anchor's place in its context


def runs_of(s: tv.Slice, length: int, gram: int):
    """Runs of a slice: (row, start in the row, windows and anchor's place, anchor hash, context hash)."""
    n, span = len(s.buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    sums = s.sums(tv.CODES)
    inv = tv.powers(n + 1)[1]
    grams = tv.mix((sums[gram:] - sums[:-gram]) * inv[: n - gram + 1])
    bits = np.uint64(max(22, n.bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = tv.sliding_min(key, span)
    edge = np.zeros(n + 1, np.int32)
    size = np.diff(s.off)
    long_ = np.flatnonzero(size >= length)
    np.add.at(edge, s.off[long_], 1)
    np.add.at(edge, s.off[long_ + 1] - length + 1, -1)
    valid = np.cumsum(edge)[: len(least)] > 0
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(change)
    begin, count = at[:-1], np.diff(at)
    ok = valid[begin]
    begin, count = begin[ok], count[ok]
    anchor = (least[begin] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(s.off, begin, "right") - 1
    context = tv.mix(s.span_hash(begin, begin + count + length - 1) + (anchor - begin).astype(np.uint64) * tv.COMBINE[5])
    return row, begin - s.off[row], count | (anchor - begin) << 16, grams[anchor].view(np.int64), context.view(np.int64)


def sides(s: tv.Slice, start: np.ndarray, n: np.ndarray, gram: int, length: int) -> np.ndarray:
    """Of runs (start in the slice, column n) 32 bits of hash of the anchor and half of what surrounds it,
    to the left in the upper half, to the right in the lower one; 0 where the context does not reach so far."""
    half, place = (length - gram) // 2, n >> 16
    at = start + place
    out = np.zeros(len(start), np.uint64)
    for shift, i, lo, hi in ((32, np.flatnonzero(place >= half), at - half, at + gram), (0, np.flatnonzero(place - (n & LOW) + 1 < half), at, at + gram + half)):
        if len(i):
            key = tv.mix(s.span_hash(lo[i], hi[i])) >> np.uint64(32)
            out[i] |= np.maximum(key, np.uint64(1)) << np.uint64(shift)
    return out.view(np.int64)


def agreeing(h: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether a run shares one of its ``sides`` with another one of its hash."""
    keep = np.zeros(len(h), bool)
    for one in (side.view(np.uint64) >> np.uint64(32), side.view(np.uint64) & np.uint64(0xFFFFFFFF)):
        i = np.flatnonzero(one)
        if len(i):
            _, of, count = np.unique(tv.mix(h[i].view(np.uint64) ^ tv.mix(one[i])), return_inverse=True, return_counts=True)
            keep[i] |= count[of] > 1
    return keep


def _first(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (keys, doc, start), and whether each has the least position of its keys."""
    order = np.lexsort((start, doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    # an equal position (versions of one document) is no earlier one
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    d, p = doc[order], start[order]
    same = (d == d[at][group]) & (p == p[at][group]) if len(order) else new
    return order, same


RUN = "h long, c long, doc_id long, start int, n int, kind int"
SIDED = RUN + ", side long"


def _batch(h, c, doc, start, n, kind):
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(kind.astype(np.int32))], names=["h", "c", "doc_id", "start", "n", "kind"])


def _anchors(length: int, gram: int, hot_of):
    def run(batches):
        hot = hot_of.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            parts = []
            for s in tv.slices(batch.column(1), PIECE):
                row, start, n, h, c = runs_of(s, length, gram)
                parts.append((h, c, ids[s.first + row], start, n, sides(s, s.off[row] + start, n, gram, length)))
            if not parts:
                continue
            h, c, doc, start, n, side = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first = _first((h, c), doc, start)
            kind = np.where(first, EDGE, MARK)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, h[order]), len(hot) - 1)
                kind[first & (hot[at] == h[order])] = HOT
            yield _batch(h[order], c[order], doc[order], start[order], n[order], kind).append_column("side", pa.array(np.where(kind == EDGE, side[order], 0)))

    return run


def _meet(group: int):
    """Rows sorted by (h, c, doc_id, start): marks later runs of equal contexts, keeps the edges.

    Of the edges only those stay that agree with another one of their hash on a side.
    """

    def run(batches):
        wait: list = []  # edges, until all of their hash are there
        size = 0
        for made in met(batches):
            edge = made[5] == EDGE
            yield _batch(*(x[~edge] for x in made[:6]))
            wait.append([x[edge] for x in made])
            size += len(wait[-1][0])
            if size > 200_000:
                all_ = [np.concatenate(x) for x in zip(*wait, strict=True)]
                open_ = all_[0] == all_[0].max()  # rows come by hash, so only the last one may go on
                yield settled([x[~open_] for x in all_])
                wait, size = [[x[open_] for x in all_]], int(open_.sum())
        if size:
            yield settled([np.concatenate(x) for x in zip(*wait, strict=True)])

    def settled(edges):
        keep = agreeing(edges[0], edges[6])
        return _batch(*(x[keep] for x in edges[:6]))

    def met(batches):
        last_h = last_c = last_doc = last_start = None  # of the group of equal contexts
        held = None  # the only context of its hash so far
        seen: list = []  # contexts of the current hash, while they may still be resolved together
        size = 0
        for batch in batches:
            h, c, doc, start, n, kind, side = (x.to_numpy() for x in batch.columns)
            m = len(h)
            if not m:
                continue
            out: list = []
            take = lambda i, k: out.append((h[i], c[i], doc[i], start[i], n[i], np.full(len(i), k, np.int32), side[i]))  # noqa: E731, B023
            take(np.flatnonzero(kind == MARK), MARK)
            live = np.flatnonzero(kind != MARK)
            if len(live):
                hl, cl, dl, sl = h[live], c[live], doc[live], start[live]
                new = np.ones(len(live), bool)
                new[1:] = (hl[1:] != hl[:-1]) | (cl[1:] != cl[:-1])
                if last_h is not None:
                    new[0] = hl[0] != last_h or cl[0] != last_c
                at = np.flatnonzero(new)
                group_of = np.cumsum(new) - 1
                d0, s0 = (dl[at][group_of], sl[at][group_of]) if len(at) else (dl, sl)
                if not new[0]:
                    d0, s0 = np.where(group_of < 0, last_doc, d0), np.where(group_of < 0, last_start, s0)
                take(live[(dl != d0) | (sl != s0)], MARK)
                last_h, last_c, last_doc, last_start = hl[-1], cl[-1], d0[-1], s0[-1]
                firsts = live[new]
                take(firsts[kind[firsts] == HOT], HOT)
                firsts = firsts[kind[firsts] == EDGE]
                if len(firsts):
                    hf = h[firsts]
                    same_before = np.append(held is not None and hf[0] == held[0][0], hf[1:] == hf[:-1])
                    same_after = np.append(hf[1:] == hf[:-1], False)
                    if held is not None:
                        if same_before[0]:
                            if size == 1:
                                out.append((*held[:5], np.full(1, EDGE, np.int32), held[5]))
                        else:
                            size, seen = 0, []
                    # sizes of hashes within this batch decide about large ones
                    begin = np.flatnonzero(~same_before)
                    lead = int(begin[0]) if len(begin) else len(firsts)
                    if lead:  # goes on with the held hash
                        before, size = size, size + lead
                        piece = firsts[:lead]
                        if size <= group:
                            take(piece, EDGE)
                            seen.append(tuple(x[piece] for x in (h, c, doc, start, n, side)))
                        else:
                            if before <= group:
                                out += [(*x[:5], np.full(len(x[0]), HOT, np.int32), x[5]) for x in seen]
                                seen = []
                            take(piece, HOT)
                    rest = firsts[lead:]
                    if len(rest):
                        multi = (same_before | same_after)[lead:]
                        bounds = np.append(begin - lead, len(rest))
                        sizes = np.diff(bounds)
                        large = np.repeat(sizes > group, sizes)
                        tail = bounds[-2]
                        take(rest[multi & ~large], EDGE)
                        take(rest[large], HOT)
                        size = int(sizes[-1])
                        end = rest[tail:]
                        seen = [] if size > group else [tuple(x[end] for x in (h, c, doc, start, n, side))]
                    f = firsts[-1:]
                    held = tuple(x[f] for x in (h, c, doc, start, n, side))
            yield [np.concatenate(x) for x in zip(*out, strict=True)]

    return run


def _zip(keep: int):
    """Compress the last column; the others pass."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(keep)
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                packed = [None if t is None else z.compress(t.encode()) for t in texts.slice(lo, 2000).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(packed, pa.binary())], names=[*batch.schema.names[:keep], "z"])

    return run


def _unzip(z, raw) -> bytes:
    return b"" if raw is None else z.decompress(raw)


def _ragged_bytes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[tv.ragged(start, size)])])


def _contexts(length: int):
    """(doc_id, z, edges) to the edges' bytes, or for hot hashes to single windows."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [_unzip(z, raw) for raw in part.column(1).to_pylist()]
                buf = np.frombuffer(b"".join(texts), np.uint8)
                off = np.zeros(len(texts) + 1, np.int64)
                np.cumsum([len(t) for t in texts], out=off[1:])
                edges = part.column(2)
                flat = edges.flatten()
                h, start, n, kind = (flat.field(c).to_numpy() for c in ("h", "start", "n", "kind"))
                of = np.repeat(np.arange(len(texts)), np.asarray(edges.value_lengths()))
                doc = part.column(0).to_numpy()[of]
                room = np.diff(off)[of] - length + 1 - start  # of versions of a document one may be shorter
                windows = np.clip(n & LOW, 0, np.maximum(room, 0))
                i = np.flatnonzero((kind == EDGE) & (windows == n & LOW))
                yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(np.zeros(len(i), np.int64)), pa.array(doc[i]), pa.array(start[i]), pa.array(n[i]), pa.array(kind[i]), _ragged_bytes(buf, off[of[i]] + start[i], windows[i].astype(np.int64) + length - 1)], names=["h", "c", "doc_id", "start", "n", "kind", "bytes"])
                i = np.flatnonzero(kind == HOT)
                if len(i):
                    s = tv.Slice(0, buf, off)
                    s.sums(tv.CODES)
                    w = windows[i].astype(np.int64)
                    at = tv.ragged(off[of[i]] + start[i], w)
                    hash_, owner = s.span_hash(at, at + length).view(np.int64), np.repeat(i, w)
                    keys = (h[owner], hash_)
                    order, first = _first(keys, doc[owner], at - off[of[owner]])
                    out = owner[order]
                    yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(hash_[order]), pa.array(doc[out]), pa.array((at[order] - off[of[out]]).astype(np.int32)), pa.array(np.ones(len(out), np.int32)), pa.array(np.where(first, HOT, MARK).astype(np.int32)), pa.nulls(len(out), pa.binary())], names=["h", "c", "doc_id", "start", "n", "kind", "bytes"])

    return run


def partners(h: np.ndarray, n: np.ndarray, buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Whether a context has a window whose hash another one of its hash has too.

    Asked first is whether they agree on half of what surrounds the anchor, which is two hashes a context.
    """
    half = (length - gram) // 2
    place = n >> 16
    s = tv.Slice(0, buf, off)
    s.sums(tv.CODES)
    at = off[:-1] + place
    keep = np.zeros(len(h), bool)
    for i, lo, hi in ((np.flatnonzero(place >= half), at - half, at + gram), (np.flatnonzero(place - (n & LOW) + 1 < half), at, at + gram + half)):
        if len(i):
            key = tv.mix(s.span_hash(lo[i], hi[i]) ^ tv.mix(h[i].view(np.uint64)))
            _, of, count = np.unique(key, return_inverse=True, return_counts=True)
            keep[i] |= count[of] > 1
    i = np.flatnonzero(keep)
    windows = n[i].astype(np.int64) & LOW
    at, owner = tv.ragged(off[i], windows), np.repeat(i, windows)
    keep[:] = False
    if len(at):
        key = tv.mix(s.span_hash(at, at + length) ^ tv.mix(h[owner].view(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        keep[owner[order[1:][same]]] = True
        keep[owner[order[:-1][same]]] = True
    return keep


def whole(h: np.ndarray, off: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Cuts rows sorted by hash, with offsets of their bytes, into parts of about ``size`` bytes; a hash stays whole."""
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    lead = begin[np.flatnonzero(np.append(True, np.diff(off[begin] // size) > 0))]
    return list(zip(lead.tolist(), [*lead[1:].tolist(), len(h)], strict=True))


def resolve(doc: np.ndarray, start: np.ndarray, n: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (doc, start) of the windows of some contexts that are also at an earlier position."""
    if len(pieces) < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(p) for p in pieces])
    total = int(size.sum())
    shard_of = np.minimum((np.cumsum(size) - size) * SHARDS // max(1, total), SHARDS - 1)
    texts = [np.frombuffer(b"".join(pieces[i] for i in np.flatnonzero(shard_of == k)), np.uint8) for k in np.unique(shard_of)]
    shard, at, block = bwt.merge(texts, length)
    again = block[1:] == block[:-1]
    some = np.flatnonzero(np.append(False, again) | np.append(again, False))  # a string that is there once is not repeated
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    place, block = first[shard[some]] + at[some], block[some]
    off = np.cumsum(size) - size  # shards are consecutive pieces, so places are those in all pieces
    of = np.searchsorted(off, place, "right") - 1
    inside = place - off[of]
    real = inside < n[of]
    d, p, block = doc[of[real]], start[of[real]] + inside[real], block[real]
    order, same = _first((block,), d, p)
    late = order[~same]
    return d[late], p[late]


def _resolve(length: int, gram: int):
    """Contexts sorted by hash to the repeated windows among them."""

    def work(t: pa.Table):
        h, doc, start, n = (t.column(c).to_numpy() for c in ("h", "doc_id", "start", "n"))
        raw = t.column("bytes").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        buf = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        keep = np.concatenate([lo + np.flatnonzero(partners(h[lo:hi], n[lo:hi], buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length, gram)) for lo, hi in whole(h, off, PIECE)])
        new = np.append(True, h[keep][1:] != h[keep][:-1]) if len(keep) else np.zeros(0, bool)
        size = np.diff(off)[keep]
        part = (np.cumsum(size) - size) // BUCKET  # merged together; a hash stays whole
        part = part[np.maximum.accumulate(np.where(new, np.arange(len(keep)), 0))] if len(keep) else part
        for mine in np.split(keep, np.flatnonzero(np.diff(part)) + 1) if len(keep) else ():
            d, p = resolve(doc[mine], start[mine].astype(np.int64), (n[mine] & LOW).astype(np.int64), [buf[off[i] : off[i + 1]].tobytes() for i in mine], length)
            if len(d):
                one = np.zeros(len(d), np.int64)
                yield _batch(one, one, d, p, one + 1, one)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            last = int(np.searchsorted(h, h[-1]))  # the last hash may go on
            if last == 0 and held and held[-1].column(0)[-1].as_py() == h[0]:
                held.append(batch)
                size += batch.nbytes
                continue
            held.append(batch.slice(0, last))
            size += batch.nbytes
            if size >= 4 * BUCKET:
                full = [b for b in held if b.num_rows]
                if full:
                    yield from work(pa.Table.from_batches(full))
                held, size = [], 0
            held.append(batch.slice(last))
        if full := [b for b in held if b.num_rows]:
            yield from work(pa.Table.from_batches(full))

    return run


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Runs of repeated windows: (doc_id, start, n), stored; docs needs (doc_id long, text)."""
    if length % 2 or length > LOW or gram >= length:
        raise ValueError("length must be even, under 65536 and over gram")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and octet_length(text) >= %d" % length)
    total = docs.select("doc_id").count()
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, total))))
    none = spark.sparkContext.broadcast(np.zeros(0, np.int64))
    often = max(20, SAMPLE // 500)
    # at most (anchors of the sample) / often hashes
    hot = few.mapInArrow(tv.tidy(_anchors(length, gram, none)), SIDED).groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= often).select("h").toArrow().column(0).to_numpy()
    hot_of = spark.sparkContext.broadcast(np.sort(hot))
    runs = docs.mapInArrow(tv.tidy(_anchors(length, gram, hot_of)), SIDED)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = F.when(F.col("kind") == EDGE, F.xxhash64("h")).otherwise(F.xxhash64("h", "c", F.when(F.col("kind") == MARK, F.col("doc_id")).otherwise(F.lit(0))))
    met = scratch.table(runs.repartition(parts, deal).sortWithinPartitions("h", "c", "doc_id", "start").mapInArrow(tv.tidy(_meet(group)), RUN), "runs")
    edges = met.where(F.col("kind") != MARK).groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n", "kind")).alias("edges"))
    packed = docs.mapInArrow(tv.tidy(_zip(1)), "doc_id long, z binary")
    found = scratch.table(edges.join(packed, "doc_id").select("doc_id", "z", "edges").mapInArrow(tv.tidy(_contexts(length)), RUN + ", bytes binary"), "contexts")
    cold = found.where(F.col("kind") == EDGE).repartition(parts, "h").sortWithinPartitions("h").mapInArrow(tv.tidy(_resolve(length, gram)), RUN)
    single = found.where(F.col("kind") == HOT).select("h", "c", "doc_id", "start", "n", "kind", F.lit(0).cast("long").alias("side")).repartition(parts, "h", "c").sortWithinPartitions("h", "c", "doc_id", "start").mapInArrow(tv.tidy(_meet(group)), RUN).where(F.col("kind") == MARK)
    at_once = found.where(F.col("kind") == MARK).select("h", "c", "doc_id", "start", "n", "kind")
    out = met.where(F.col("kind") == MARK).union(at_once).union(cold).union(single).select("doc_id", "start", F.expr(f"n & {LOW}").alias("n"))
    out = scratch.table(out, "marks")
    scratch.drop(met, found)
    return out


def _kept(keep: list[str], length: int, text: bool):
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                cols: list[list] = [[], [], [], [], []]
                for raw, spans in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1), strict=True):
                    whole = _unzip(z, raw)
                    gone = np.zeros(len(whole) + 1, np.int32)
                    if spans.is_valid:
                        s = spans.values
                        a, n = s.field(0).to_numpy(), s.field(1).to_numpy()
                        np.add.at(gone, np.minimum(a, len(whole)), 1)
                        np.add.at(gone, np.minimum(a + n + length - 1, len(whole)), -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    left = np.frombuffer(whole, np.uint8)[~gone].tobytes() if gone.any() else whole
                    spans_n = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
                    row = (len(whole), int(gone.sum()), spans_n, hashlib.sha256(left).hexdigest(), None if raw is None else left.decode("utf-8", "ignore"))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "_kept"]
                if not text:
                    made, names = made[:4], names[:4]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *names])

    return run


def strip(docs: DataFrame, keep: list[str], text: bool = True, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Columns ``keep`` of docs with n_bytes, n_removed, n_spans, kept_sha256 and the left text ``_kept``.

    Half characters at the edge of a removed span go from ``_kept`` (the digest is of the bytes).
    """
    spans = marks(docs, length, gram, group).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    docs = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("_id"), "text")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    packed = docs.mapInArrow(tv.tidy(_zip(len(keep) + 1)), f"{own}, z binary")
    names = [f"_{i}" for i in range(len(keep))]
    own = ", ".join(f"`_{i}` {docs.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(keep)))
    made = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", _kept string" if text else "")
    out = packed.join(spans, "_id", "left").select(*names, "z", "_spans").mapInArrow(tv.tidy(_kept(names, length, text)), f"{own}, {made}")
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), *out.columns[len(keep) :])


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return strip(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], False, length, gram, group)
