"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words; 5-word hashes are winnowed (the least of each six
consecutive ones stays), so any span of ten shared words keeps at least one common fingerprint.
Fingerprints of the documents are joined with those of the items, and each hit is extended to the
whole ten-word windows around it, compared word by word.

Scale: documents are read once and never shuffled.  Only the hashes of the items' fingerprints and
windows are broadcast, 16 bytes a window, in blocks of at most ``block_windows`` windows; each block is
a look-up in the same scan's next step, not another scan.  What a scan finds is a small stored table: a
text's places whose window hash some item has, with the words.  Those are joined with the table of
windows by hash and words, once per distinct text.

Defined cases: null or wordless text has no words and no hits; an item of fewer than ten words (but
not none) is one window of its length; repeated rows each get their own result; equal windows of
several items count for each item.  Extra columns are ignored by ``decontaminate`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textvec as tv

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1


def _normal(buf: np.ndarray, ws: np.ndarray, we: np.ndarray, lo: int, hi: int) -> bytes:
    return b" ".join(tv.LOWER[buf[a:b]].tobytes() for a, b in zip(ws[lo:hi], we[lo:hi], strict=True))


def _selected(grams: np.ndarray) -> np.ndarray:
    """Positions that are the least of some SPAN consecutive hashes."""
    least = tv.sliding_min(grams, SPAN)
    keep = np.zeros(len(grams), bool)
    for j in range(SPAN):
        keep[j : j + len(least)] |= least == grams[j : j + len(least)]
    return np.flatnonzero(keep)


def _item_windows(batches):
    """Arrow batches of (item_id, text) to one row per window: length, hash, words, its fingerprints."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = []
        for s in tv.slices(batch.column(1)):
            ws, we, off = s.words(tv.ALNUM)
            h = s.span_hash(ws, we)
            for r in range(s.rows):
                lo, hi = int(off[r]), int(off[r + 1])
                n = min(WINDOW, hi - lo)
                if n == 0 or ids[s.first + r] is None:
                    continue
                whole = tv.ngrams(h[lo:hi], n)
                prints = tv.ngrams(h[lo:hi], GRAM) if n == WINDOW else np.zeros(0, np.uint64)
                for i, w in enumerate(whole):
                    least = [int(prints[i : i + SPAN].min().astype(np.int64))] if n == WINDOW else []
                    rows.append((ids[s.first + r], n, int(w.astype(np.int64)), _normal(s.buf, ws, we, lo + i, lo + i + n), least))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())))],
            names=["item_id", "n", "window", "words", "prints"],
        )


class Index:
    """Sorted hashes of some windows, by length, and of their fingerprints."""

    def __init__(self, n: np.ndarray, window: np.ndarray, prints: np.ndarray):
        self.hashes = {int(k): np.unique(window[n == k]) for k in np.unique(n)}
        self.prints = np.unique(prints)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


PLACE = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("window", pa.int64()), ("words", pa.binary())])
OUT = "n_words long, places array<struct<at:int,n:int,window:bigint,words:binary>>"


def places(s: tv.Slice, index: Index) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Of each row of a slice: number of words, and the places whose window hash some item has."""
    ws, we, off = s.words(tv.ALNUM)
    h = s.span_hash(ws, we)
    last = np.repeat(off[1:], np.diff(off))  # the end of each word's row
    out: list[list[dict]] = [[] for _ in range(s.rows)]
    for n, known in index.hashes.items():
        if n == WINDOW:
            grams = tv.ngrams(h, GRAM)
            if len(grams) < SPAN:
                continue
            own = _selected(grams)
            own = own[_member(grams[own].astype(np.int64), index.prints)]
            at = np.unique((own[:, None] - np.arange(SPAN)[None, :]).ravel())
            at = at[(at >= 0) & (at + n <= len(h))]
        else:
            at = np.arange(max(0, len(h) - n + 1))
        at = at[at + n <= last[at]]
        if not len(at):
            continue
        whole = np.zeros(len(at), np.uint64)
        for j in range(n):
            whole += h[at + j] * tv.COMBINE[j]
        whole = tv.mix(whole).astype(np.int64)
        for i in np.flatnonzero(_member(whole, known)):
            p = int(at[i])
            r = int(np.searchsorted(off, p, "right")) - 1
            out[r].append({"at": p - int(off[r]), "n": n, "window": int(whole[i]), "words": _normal(s.buf, ws, we, p, p + n)})
    return np.diff(off), out


def _scan(index_of: list, keep: list[str]):
    """Rows with a text to their columns ``keep``, n_words and places."""

    def run(batches):
        for batch in batches:
            n_words, found = [], []
            for s in tv.slices(batch.column(batch.schema.get_field_index("text"))):
                every = [places(s, index.value) for index in index_of]
                n_words.append(every[0][0])
                found += [[x for e in every for x in e[1][r]] for r in range(s.rows)]
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(found, pa.list_(PLACE))], names=[*keep, "n_words", "places"])

    return run


def _indexes(windows: DataFrame, block_windows: int) -> list:
    """The hashes of a stored table of windows as broadcasts of at most so many windows each."""
    blocks = max(1, -(-windows.count() // block_windows))
    out = []
    for b in range(blocks):
        mine = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("n", "window"), F.lit(blocks)) == b)
        t = mine.select("n", "window", F.explode_outer("prints").alias("print")).distinct().toArrow()
        prints = t.column("print").drop_null().to_numpy()
        out.append(windows.sparkSession.sparkContext.broadcast(Index(t.column("n").to_numpy(), t.column("window").to_numpy(), prints)))
    return out


def scan(docs: DataFrame, items: DataFrame, block_windows: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows, hits), both stored.

    rows: doc_id, key (the text's digest, null for null) and n_words of each row of docs (doc_id, text);
    hits: key, hit_from, hit_to, item_ids of each text in which a window occurs, word runs inside any
    occurring window being merged where they overlap.
    """
    windows = scratch.table(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(tv.tidy(_item_windows), "item_id long, n int, window long, words binary, prints array<long>"), "windows")
    keyed = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"), "text")
    rows = scratch.table(keyed.mapInArrow(tv.tidy(_scan(_indexes(windows, block_windows), ["doc_id", "key"])), "doc_id long, key string, " + OUT), "places")
    texts = rows.where(F.size("places") > 0).groupBy("key").agg(F.first("places").alias("places"))
    each = texts.select("key", F.explode("places").alias("p")).select("key", "p.*")
    of_window = windows.groupBy("n", "window", "words").agg(F.collect_set("item_id").alias("ids"))
    hit = each.join(of_window, ["n", "window", "words"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("hit_from"), (F.col("at") + F.col("n")).alias("hit_to")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    merged = F.aggregate(
        "runs",
        F.expr("cast(array() as array<struct<hit_from:int,hit_to:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["hit_to"] >= x["hit_from"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["hit_from"].alias("hit_from"), F.greatest(F.element_at(acc, -1)["hit_to"], x["hit_to"]).alias("hit_to")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    hits = hit.select("key", merged.alias("runs"), "item_ids").select("key", F.col("runs.hit_from").alias("hit_from"), F.col("runs.hit_to").alias("hit_to"), "item_ids")
    return rows.drop("places"), scratch.table(hits, "hits")


def find(docs: DataFrame, items: DataFrame, block_windows: int = 5_000_000) -> DataFrame:
    """Hits per row of docs (doc_id, text): (doc_id, n_words, hit_from, hit_to, item_ids)."""
    rows, hits = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, block_windows)
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    return rows.join(hits, "key", "left").select("doc_id", "n_words", none("hit_from", "int"), none("hit_to", "int"), none("item_ids", "bigint"))


def decontaminate(docs: DataFrame, items: DataFrame, block_windows: int = 5_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    found = find(docs, items, block_windows)
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, block_windows: int = 5_000_000) -> DataFrame:
    """The documents, all their columns, in which no window of any item occurs."""
    _, hits = scan(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), items, block_windows)
    key = F.md5(F.col("text").cast("binary"))
    return docs.withColumn("_key", key).join(hits.select(F.col("key").alias("_key")), "_key", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(item_ids) -> str:
    """items_sha256 of a list of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, item_ids))).encode()).hexdigest()
