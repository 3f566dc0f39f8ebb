"""Best-fit packing of documents into token sequences, by large-item matching.

Only lengths decide a packing, and there are at most ``capacity`` of them.  So the packing is planned
on the histogram of piece lengths: large items (over a third of the capacity) are matched greedily,
at most two to a sequence, longest first with the longest partner that fits; smaller items, longest
first, go to the sequence class with the smallest sufficient gap, else open new sequences.  A plan is
a list of classes (which lengths in which places, how many sequences), a few thousand entries
whatever the corpus.  Pieces then find their place by their rank among pieces of equal length, which
is computed with salted windows; nothing else is shuffled and no text is.

Defined cases: null or empty text is one piece that holds only the closing id; repeated rows are
separate documents (told apart by ``copy``); documents over the capacity are cut into full pieces and
a rest.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks, scratch, tokens
from . import textvec as tv

CAPACITY = 2048
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def _pieces(file: str, capacity: int, end: int, keep: bool):
    def run(batches):
        enc = tokens.encoder(file)
        for batch in batches:
            doc, copy = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in tv.slices(batch.column(2)):
                ids, sizes = enc.encode([s.text(r) for r in range(s.rows)])
                cols: list[list] = [[], [], [], [], [], [], []]
                at = 0
                for r, n in enumerate(sizes.tolist()):
                    own = np.append(ids[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    for k, lo in enumerate(range(0, n + 1, capacity)):
                        part = own[lo : lo + capacity]
                        row = (doc[s.first + r], copy[s.first + r], k, lo, len(part), zlib.crc32(part), part if keep else None)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[: 6 + keep], types, strict=False)], names=names[: 6 + keep])

    return run


def pieces(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, copy, piece, start, length, ids_crc32 and perhaps ids.

    ``copy`` tells repeated rows apart; it is unique but arbitrary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), "text")
    return rows.mapInArrow(tv.tidy(_pieces(file or tokens.vocabulary(), capacity, end, keep_ids)), PIECES + (", ids array<int>" if keep_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequence classes for a histogram of lengths: (lengths in order of place, number of sequences)."""
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 1 <= s <= capacity for s in left):
        raise ValueError("a length is out of range")
    large = sorted(s for s in left if 3 * s > capacity)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(items: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(items)
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((items, n))

    while large:
        a = large[-1]
        i = bisect_left(large, min(a, capacity - a) + 1) - 1
        if i < 0 or (large[i] == a and left[a] < 2):
            i -= i >= 0 and large[i] == a
        if i < 0:
            put((a,), left.pop(a))
            large.pop()
            continue
        b = large[i]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        put((a, b), n)
        for x in (a, b):
            left[x] -= n
        for x in {a, b}:
            if not left[x]:
                del left[x]
                large.remove(x)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                fit = capacity // s
                if n >= fit:
                    put((s,) * fit, n // fit)
                    n %= fit
                else:
                    put((s,) * n, 1)
                    n = 0
                continue
            gap = gaps[i]
            items, have = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            take = min(n, have)
            if have > take:
                put(items, have - take)
            put((*items, s), take)
            n -= take
    return [x for gap in gaps for x in open_[gap]]


def slots(classes: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, by rank: columns first rank, first sequence, offset in the sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for items, n in classes:
        offset = 0
        for s in items:
            out.setdefault(s, []).append((used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + n
            offset += s
        sequence += n
    return {s: np.array(x, np.int64) for s, x in out.items()}


def _place(slots_of):
    def run(batches):
        table = slots_of.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                t = table[int(length[part[0]])]
                i = np.searchsorted(t[:, 0], rank[part], "right") - 1
                sequence[part] = t[i, 1] + rank[part] - t[i, 0]
                offset[part] = t[i, 2]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, copy, piece, start, length, ids_crc32, (ids), sequence_id, offset."""
    cut = scratch.table(pieces(docs, file, capacity, end, keep_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = cut.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    out = ranks.ranked(cut, "length", ["doc_id", "copy", "piece"])
    names = [*cut.columns, "rank"]
    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return out.select(*names).mapInArrow(tv.tidy(_place(table)), schema)
