"""Language-model scores by prediction by partial matching (PPM, escape method C, full exclusion).

The model is a byte-context trie of order 5, pretrained on all training texts: how often each symbol
(a byte, or the end of the text) followed each context of five bytes, from which the shorter
contexts' counts follow.  A symbol is predicted in the longest known context; if it never followed
there, an escape is paid, estimated from the number of distinct followers, and the next shorter
context predicts with the symbols of the longer one excluded; below order 0 all symbols not yet seen
are equally likely.  As an excluded set depends only on the context it escaped from, denominators
with exclusion are computed once per context and a text is scored with a few table look-ups a byte.

Beside it goes the add-one unigram score over the words of all training texts.

Scale: counts are distributed sums over all training texts, combined in each task first.  The whole
trie stays a distributed table and grows with them.  Of the grams that occurred, the ``max_grams``
most frequent are broadcast with their probabilities in the whole trie; a text's other grams are
joined by key to probabilities found in the parts of the trie (``Grams.resolve``), so the bound moves
work and changes no score.  Word counts stay a distributed table too; the ``max_words`` most frequent
are also broadcast, and the rest of a text's words are joined by hash, so no join key is hot.

Defined cases: a null text is the empty text, whose only token and symbol is the end; A-Z count as
a-z in both scores; repeated rows are scored each; with no training text every symbol costs
log10(1/257) and every token log10(1/1); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import textvec as tv

ORDER = 5
END = 256
SYMBOLS = 257
PAD = 10  # a text starts as if after line ends
TOKEN, GRAM, TEXTS = 0, 1, 2
SLICE = 1 << 19  # bytes of text worked on at once
PART = 2  # bytes of context by which the trie is in parts
PART_ROWS = 500_000  # grams of a task that are worked on at once, if they are of several parts


def _grams(s: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol of the slice, row by row with its end: (context << 9 | symbol), and rows' offsets."""
    step = ORDER + 1
    row = tv.row_of(s.off)
    out = np.full(len(s.buf) + s.rows * step, PAD, np.int64)
    out[np.arange(len(s.buf)) + ORDER + step * row] = tv.LOWER[s.buf]
    ends = s.off[1:] + ORDER + step * np.arange(s.rows)
    begin = s.off[:-1] + step * np.arange(s.rows)
    out[ends] = END
    key = out.copy()
    for j in range(ORDER):
        key[ORDER:] |= out[ORDER - 1 - j : len(out) - 1 - j] << (9 + 8 * j)
    valid = np.ones(len(out), bool)
    for j in range(ORDER):
        valid[begin + j] = False
    return key[valid], s.off + np.arange(s.rows + 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[new], np.add.reduceat(c, new) if len(new) else c


def _count(batches):
    """(text) to (kind, key, count), combined within the task up to about a million keys."""
    held: dict[int, list] = {TOKEN: [], GRAM: []}
    size, texts = 0, 0

    def flush():
        for kind, parts in held.items():
            if parts:
                k, c = _merge(parts)
                for lo in range(0, len(k), 100_000):
                    n = len(k[lo : lo + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(k[lo : lo + n]), pa.array(c[lo : lo + n])], names=["kind", "key", "c"])
                held[kind] = []

    for batch in batches:
        texts += batch.num_rows
        for s in tv.slices(batch.column(0), SLICE):
            ws, we, _ = s.words(tv.NONSPACE)
            for kind, keys in ((TOKEN, s.span_hash(ws, we).view(np.int64)), (GRAM, _grams(s)[0])):
                u, c = np.unique(keys, return_counts=True)
                if len(u):
                    held[kind].append((u, c))
                    size += len(u)
                if len(held[kind]) > 6:
                    before = sum(len(p[0]) for p in held[kind])
                    held[kind] = [_merge(held[kind])]
                    size += len(held[kind][0][0]) - before
            if size > 1_000_000:
                yield from flush()
                size = 0
    yield from flush()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "c"])


class Table:
    """int64 keys to rows, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rows = np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several in one slot the last stays
            mine = self.keys[at] == keys[left]
            self.rows[at[mine]] = left[mine]
            left, at = left[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.rows[at], -1)
        left = np.flatnonzero((got != keys) & (got != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (got != -1)]
        return out


def shorter(key: np.ndarray, order: int) -> np.ndarray:
    """The gram of a lower order inside a gram of order ORDER (or any higher one)."""
    return ((key >> 9) & ((1 << (8 * order)) - 1)) << 9 | (key & 511)


class Trie:
    """Natural-log costs from (order, gram, count) rows; contexts are grams without their symbol."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.grams, self.contexts = {}, {}
        self.top, self.log_c, self.denominator, self.escape, self.low, self.low_escape = {}, {}, {}, {}, {}, {}
        previous = None
        for k in range(ORDER + 1):
            key, c = grams.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            order = np.argsort(key)
            key, c = key[order], c[order].astype(np.float64)
            ctx, of = np.unique(key >> 9, return_inverse=True)
            total, distinct = np.bincount(of, c, len(ctx)), np.bincount(of, minlength=len(ctx)).astype(np.float64)
            self.grams[k], self.contexts[k] = Table(key), Table(ctx)
            self.log_c[k] = np.log(c)
            self.denominator[k] = np.log(total + distinct)
            self.top[k] = self.log_c[k] - self.denominator[k][of] if len(key) else np.zeros(0)
            self.escape[k] = np.log(distinct) - self.denominator[k]
            if previous is not None and len(ctx):
                # what is left in the shorter context when this one's followers are excluded
                under, counts, totals, distincts = previous
                row = under[0].find(shorter(key, k - 1))
                parent = under[1].find(ctx & ((1 << (8 * (k - 1))) - 1))
                rest = totals[parent] - np.bincount(of, counts[row], len(ctx))
                kinds = distincts[parent] - distinct
                gone = kinds <= 0
                self.low[k] = np.where(gone, 0.0, np.log(np.where(gone, 1.0, rest + kinds)))  # rest >= 0: a longer context's counts are part of a shorter one's
                self.low_escape[k] = np.where(gone, 0.0, np.log(np.where(gone, 1.0, kinds)) - self.low[k])
            for part in (self.log_c, self.top):
                part[k] = part[k].astype(np.float32)
            previous = ((self.grams[k], self.contexts[k]), c, total, distinct)
        kinds = len(self.log_c[0])
        self.unseen = -np.log(max(1, SYMBOLS - kinds))

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Natural log probability of each gram of order ORDER."""
        row = self.grams[ORDER].find(key)
        out = self.top[ORDER][row].astype(np.float64) if len(self.top[ORDER]) else np.zeros(len(key))
        left = np.flatnonzero(row < 0)
        out[left] = 0.0
        came = np.full(len(left), -1)  # the context escaped from, a row of the next order's contexts
        for k in range(ORDER, -1, -1):
            if not len(left):
                return out
            g = shorter(key[left], k)
            if k < ORDER:
                row = self.grams[k].find(g)
                hit = row >= 0
                if hit.any():
                    fresh = came[hit] < 0
                    value = np.empty(len(fresh))
                    value[fresh] = self.top[k][row[hit][fresh]]
                    value[~fresh] = self.log_c[k][row[hit][~fresh]] - (self.low[k + 1][came[hit][~fresh]] if (~fresh).any() else 0)
                    out[left[hit]] += value
                left, came, g = left[~hit], came[~hit], g[~hit]
            ctx = self.contexts[k].find(g >> 9)
            fresh, known = came < 0, ctx >= 0
            i = fresh & known
            out[left[i]] += self.escape[k][ctx[i]]
            if (~fresh).any():
                out[left[~fresh]] += self.low_escape[k + 1][came[~fresh]]
            came = ctx
        out[left] += self.unseen
        return out


def _part(key):
    """The part of the trie that holds a gram, of any order from PART on, and all its shorter ones."""
    return (F.shiftright(key, 9)).bitwiseAND((1 << (8 * PART)) - 1)


def _resolve(low_of):
    """(part, k, key, c) sorted by part, k = -1 for grams that are asked for, to (key, log_p)."""

    def run(batches):
        held: list = []

        def work(cols):
            k, key, c = cols[1:]
            asked = key[k < 0]
            if not len(asked):
                return
            trie = Trie({**low_of.value, **{i: (key[k == i], c[k == i]) for i in range(PART, ORDER + 1)}})
            for lo in range(0, len(asked), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(asked[lo : lo + SLICE]), pa.array(trie.log_p(asked[lo : lo + SLICE]))], names=["key", "log_p"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(x[0]) for x in held) < PART_ROWS:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last part may go on
            if last:
                yield from work([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
        if held:
            yield from work([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


class Grams:
    """The whole trie: ``levels`` has its grams by order as tables (k, key, c); the most frequent also here."""

    def __init__(self, spark, levels: dict[int, DataFrame], max_grams: int):
        self.spark, self.levels = spark, levels
        self.low = {k: tuple(levels[k].select("key", "c").toArrow().column(x).to_numpy() for x in ("key", "c")) for k in range(PART)}  # at most 257 * 257
        whole = levels[ORDER].select("key", "c", F.shiftright("key", 9).alias("ctx"))
        own = Window.partitionBy("ctx")
        seen = whole.select("key", "c", (F.log(F.col("c").cast("double")) - F.log((F.sum("c").over(own) + F.count(F.lit(1)).over(own)).cast("double"))).alias("log_p"))
        t = _frequent(seen, max_grams).select("key", "log_p").toArrow()
        self.top = t.column("key").to_numpy(), t.column("log_p").to_numpy()

    def resolve(self, asked: DataFrame) -> DataFrame:
        """(key, log_p), natural logarithms, of distinct grams (key) of order ORDER, by the whole trie.

        A gram's shorter ones have the last PART bytes of its context in common, so they are in one part.
        """
        rows = asked.select(_part(F.col("key")).alias("part"), F.lit(-1).alias("k"), "key", F.lit(0).cast("long").alias("c"))
        for k in range(PART, ORDER + 1):
            rows = rows.union(self.levels[k].select(_part(F.col("key")).alias("part"), "k", "key", "c"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tv.tidy(_resolve(self.spark.sparkContext.broadcast(self.low))), "key long, log_p double")

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Natural log probability of each gram of order ORDER, to look into the model from the driver."""
        asked = self.spark.createDataFrame(pa.table({"key": key})).distinct()
        found = {r["key"]: r["log_p"] for r in self.resolve(asked).collect()}
        return np.array([found[int(x)] for x in key])


def _rest(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[list, list]:
    """Distinct keys of each row and how often each is there."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))) if len(keys) else np.zeros(0, np.int64)
    cut = np.searchsorted(row[new], np.arange(1, rows))
    return np.split(keys[new], cut), np.split(np.diff(np.append(new, len(keys))), cut)


def _score(grams_of, words_of):
    def run(batches):
        grams, log_p = grams_of.value
        seen = Table(grams)
        words, log_words = words_of.value
        table = Table(words)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for s in tv.slices(batch.column(2), SLICE):
                key, off = _grams(s)
                at = seen.find(key)
                known = at >= 0
                cost = np.zeros(len(key))
                cost[known] = log_p[at[known]]
                sums = np.concatenate([[0.0], np.cumsum(cost)])
                far = _rest(key[~known], tv.row_of(off)[~known], s.rows)
                ws, we, woff = s.words(tv.NONSPACE)
                h = s.span_hash(ws, we).view(np.int64)
                row = tv.row_of(woff)
                at = table.find(h)
                known = at >= 0
                base = np.bincount(row[known], log_words[at[known]], s.rows) if known.any() else np.zeros(s.rows)
                rest, times = _rest(h[~known], row[~known], s.rows)
                cols[0] += np.diff(woff).tolist()
                cols[1] += np.bincount(row[known], minlength=s.rows).tolist()
                cols[2] += base.tolist()
                cols[3] += ((sums[off[1:]] - sums[off[:-1]]) / np.log(10)).tolist()
                for held, x in zip(cols[4:], (rest, times, *far), strict=True):
                    held += x
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), longs, longs, longs, longs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["row_id", "doc_id", "n_words", "n_top", "base", "score", "rest", "times", "grams", "gram_times"])

    return run


def _frequent(df: DataFrame, most: int) -> DataFrame:
    """Rows of the largest counts c, by a common threshold, at most ``most`` of them."""
    bucket = F.floor(F.log2(F.col("c").cast("double")) * 16)
    sizes = sorted(((r["b"], r["count"]) for r in df.groupBy(bucket.alias("b")).count().collect()), reverse=True)  # under 1100 rows
    total, least = 0, None
    for b, n in sizes:
        total += n
        if total > most:
            break
        least = b
    return df.where(F.lit(False)) if least is None else df.where(bucket >= least)


def fit(texts: DataFrame, max_grams: int = 1_000_000) -> tuple[DataFrame, Grams, int, int, int]:
    """(stored counts, whole trie, tokens N, distinct V, texts) of a DataFrame with a column ``text``."""
    counts = scratch.table(texts.select("text").mapInArrow(tv.tidy(_count), "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c")), "counts")
    stats = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_texts = int(stats[TEXTS]["n"]) if TEXTS in stats else 0
    n = n_texts + (int(stats[TOKEN]["n"]) if TOKEN in stats else 0)
    v = (n_texts > 0) + (int(stats[TOKEN]["v"]) if TOKEN in stats else 0)
    level = counts.where(F.col("kind") == GRAM).select(F.lit(ORDER).alias("k"), "key", "c")
    levels = {ORDER: level}
    for k in range(ORDER - 1, -1, -1):  # each order from the next, which is many times smaller than the texts
        key = F.expr(f"(((key >> 9) & {(1 << (8 * k)) - 1}) << 9) | (key & 511)")
        level = scratch.table(level.groupBy(key.alias("key")).agg(F.sum("c").alias("c")).select(F.lit(k).alias("k"), "key", "c"), "grams")
        levels[k] = level
    return counts, Grams(texts.sparkSession, levels, max_grams), n, v, n_texts


def score(docs: DataFrame, texts: DataFrame, max_grams: int = 1_000_000, max_words: int = 200_000) -> DataFrame:
    """Scores of docs (doc_id, text, further named columns kept) by models of ``texts``.

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    counts, grams, n, v, n_texts = fit(texts, max_grams)
    words = counts.where(F.col("kind") == TOKEN).select("key", "c")
    top = _frequent(words, max_words).toArrow()
    top_of = spark.sparkContext.broadcast((top.column("key").to_numpy(), np.log10(top.column("c").to_numpy() + 1.0)))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = scratch.table(rows.mapInArrow(tv.tidy(_score(spark.sparkContext.broadcast(grams.top), top_of)), "row_id long, doc_id long, n_words long, n_top long, base double, score double, rest array<long>, times array<long>, grams array<long>, gram_times array<long>"), "scored")
    rest = scored.select("row_id", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row_id", F.col("x.rest").alias("key"), F.col("x.times").alias("times"))
    found = rest.join(words, "key").groupBy("row_id").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("known"))
    far = scored.select("row_id", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row_id", F.col("x.grams").alias("key"), F.col("x.gram_times").alias("times"))
    log_p = scratch.table(grams.resolve(far.select("key").distinct()), "log_p")
    far = far.join(log_p, "key").groupBy("row_id").agg((F.sum(F.col("times") * F.col("log_p")) / float(np.log(10))).alias("far"))
    tokens = F.col("n_words") + 1
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + float(np.log10(n_texts + 1.0)) - tokens * float(np.log10(n + v + 1.0))
    return scored.drop("rest", "times", "grams", "gram_times").join(found, "row_id", "left").join(far, "row_id", "left").select(
        "doc_id",
        tokens.alias("n_tokens"),
        (F.col("n_top") + F.coalesce("known", F.lit(0)) + (1 if n_texts else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )
