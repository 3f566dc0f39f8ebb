"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the labelled examples; none is dropped but those of weight zero.  A term weighs
(1 + log tf) * idf * phi, phi being the strength of its tie to the label in the examples (the square root
of chi-square over their number: supervised term weighting, Debole and Sebastiani, 2003); a word that no
example has weighs nothing.  Without phi the topic decides which texts are near, not the insult: README
has the figures.  Vectors are normalised.  Examples lie in blocks of 32 of the
index; each term knows its largest weight in each block.  A text's bounds for the blocks come from
those, blocks are scored from the largest bound down, and the search ends when no block can hold a
nearer example than the k found: the k nearest are exact.  The vote is weighted by similarity and
mapped to a probability by isotonic regression on the examples' own leave-one-out votes.

Fitting uses at most about ``max_examples`` labelled rows (chosen by a hash), so the
broadcast index is bounded by that and the terms of a text.  Scoring is one scan.

Defined cases: a text without any known term, the null and the empty text among them, gets the
examples' label rate among texts without terms; with no labelled rows every score is 0; equal
similarities go to the earlier example of the index; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textvec as tv

BLOCK = 32
COMMON = 16


def _terms(s: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of all words."""
    ws, we, off = s.words(tv.ALPHA)
    return s.span_hash(ws, we), tv.row_of(off)


def _lowered(col):
    return pc.utf8_lower(col if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.cast(pa.string()))


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs in order, with counts."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def _document_counts(batches):
    """(text, label) to (term, texts with label 0, with label 1)."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        for s in tv.slices(_lowered(batch.column(0))):
            h, row, _ = _distinct(*_terms(s))
            y = label[s.first + row]
            u, of = np.unique(h, return_inverse=True)
            if len(u):
                c = [np.bincount(of[y == k], minlength=len(u)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, c)], names=["h", "n0", "n1"])


class Terms:
    """The terms, sorted by hash, with their weights (idf * phi)."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weight = hashes[order], weight[order]

    def vectors(self, s: tv.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: offsets, term numbers and normalised weights."""
        h, row, tf = _distinct(*_terms(s))
        if not len(h) or not len(self.hashes):
            return np.zeros(s.rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        t = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[t] == h
        t, row, tf = t[ok], row[ok], tf[ok]
        w = (1 + np.log(tf)) * self.weight[t]
        norm = np.sqrt(np.bincount(row, w * w, s.rows))
        return np.searchsorted(row, np.arange(s.rows + 1)), t, w / norm[row]


class Index:
    """Block-max inverted index of the examples that have terms.

    Terms of at least one example in ``COMMON`` are not looked up by list: a text's part of the cosine
    that comes from them is a matrix product, made for many texts at once (``common``); the bounds of
    blocks add that part to the largest weights of the other terms.
    """

    def __init__(self, vectors: list[tuple[list[int], list[float], int, int]], terms: int, k: int):
        vectors = [v for v in vectors if len(v[0])]
        df = np.bincount([x for v in vectors for x in v[0]], minlength=terms)
        # examples of a language, then of a leading term, share blocks, which keeps the block maxima tight
        vectors.sort(key=lambda v: (max(v[0], key=lambda x: (df[x], x)), v[0][max(range(len(v[1])), key=v[1].__getitem__)], v[3]))
        self.k, self.n, self.terms = k, len(vectors), terms
        self.label = np.array([v[2] for v in vectors], np.int8)
        self.ids = np.array([v[3] for v in vectors], np.int64)
        t = np.array([x for v in vectors for x in v[0]], np.int64)
        w = np.array([x for v in vectors for x in v[1]], np.float64)
        e = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        order = np.lexsort((e, t))
        t, self.w, self.e = t[order], w[order], e[order].astype(np.int32)
        self.at = np.searchsorted(t, np.arange(terms + 1))
        self.blocks = -(-self.n // BLOCK)
        key = t * max(1, self.blocks) + self.e // BLOCK
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.w, new) if len(new) else np.zeros(0)
        self.block = self.e[new] // BLOCK if len(new) else np.zeros(0, np.int32)
        self.block_at = np.searchsorted(t[new], np.arange(terms + 1))
        self.begin = np.append(new, len(t)).astype(np.int32)
        self.matrix = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"matrix": None}  # each worker makes its own

    def _common(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each term in the matrix of common terms (-1: none), and the matrix."""
        if self.matrix is None:
            wide = np.flatnonzero(np.diff(self.at) * COMMON >= max(1, self.n))
            row = np.full(self.terms, -1)
            row[wide] = np.arange(len(wide))
            m = np.zeros((len(wide), self.blocks * BLOCK))
            for r, x in enumerate(wide):
                m[r, self.e[self.at[x] : self.at[x + 1]]] = self.w[self.at[x] : self.at[x + 1]]
            self.matrix = row, m
        return self.matrix

    def common(self, at: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Texts by examples: the parts of the cosines that come from common terms."""
        row, m = self._common()
        text, r = np.repeat(np.arange(len(at) - 1), np.diff(at)), row[t]
        q = np.zeros((len(at) - 1, len(m)))
        q[text[r >= 0], r[r >= 0]] = w[r >= 0]
        return q @ m

    def nearest(self, t: np.ndarray, w: np.ndarray, without: int = -1, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of positive similarity, nearest first; ``part`` is the text's row of ``common``."""
        if part is None:
            part = self.common(np.array([0, len(t)]), t, w)[0]
        rare = np.flatnonzero(self._common()[0][t] < 0)
        t, w = t[rare], w[rare]
        count = self.block_at[t + 1] - self.block_at[t]
        cell = tv.ragged(self.block_at[t], count)  # the terms' blocks
        q = np.repeat(w, count)
        block = self.block[cell]
        bound = part.reshape(-1, BLOCK).max(1) + np.bincount(block, q * self.most[cell], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score = np.zeros(0, np.int64), np.zeros(0)
        for mine in (order[:8], order[8:]):
            if len(best) == self.k:
                mine = mine[bound[mine] >= score[-1] - 1e-12]
            if not len(mine):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[mine] = True
            use = np.flatnonzero(chosen[block])
            size = self.begin[cell[use] + 1] - self.begin[cell[use]]
            p = tv.ragged(self.begin[cell[use]], size)
            sims = np.where(np.repeat(chosen, BLOCK), part, 0.0)
            sims += np.bincount(self.e[p], np.repeat(q[use], size) * self.w[p], len(part))
            hit = np.flatnonzero(sims > 0)
            hit = hit[hit != without]
            if len(hit) > 4 * self.k:
                hit = hit[sims[hit] >= np.partition(sims[hit], -self.k)[-self.k] - 1e-9]
            best, score = np.append(best, hit), np.append(score, sims[hit])
            top = np.lexsort((best, -np.round(score, 12)))[: self.k]
            best, score = best[top], score[top]
        return best, score

    def vote(self, best: np.ndarray, score: np.ndarray, prior: float) -> float:
        return float(((score * self.label[best]).sum() + prior) / (score.sum() + 1))


class Model:
    def __init__(self, terms: Terms, index: Index, prior: float, bare: float):
        self.terms, self.index, self.prior, self.bare = terms, index, prior, bare
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression (pool adjacent violators) of labels on votes."""
        order = np.argsort(votes, kind="stable")
        blocks: list[list[float]] = []
        for v, y in zip(votes[order], labels[order], strict=True):
            blocks.append([v, v, float(y), 1.0])
            while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
                b = blocks.pop()
                a = blocks[-1]
                blocks[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
        if blocks:
            self.x = np.array([(b[0] + b[1]) / 2 for b in blocks])
            self.y = np.array([(b[2] + self.prior) / (b[3] + 1) for b in blocks])

    def score(self, vote: float) -> float:
        """A calibrated score that still orders votes within a step of the regression."""
        return float(min(1.0, max(0.0, 0.999 * np.interp(vote, self.x, self.y) + 0.001 * vote)))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 4000, k: int = 25) -> Model:
    """Model from the texts of docs (doc_id, text) that labels (doc_id, toxic) marks.

    The labels are sampled before any text is met, so they are a table of about ``max_examples`` rows
    at most and are broadcast to the texts.  Equal texts with equal labels count once: else whatever a
    much-copied text says would look tied to its label.  doc_id only names the evidence.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    few = marked.where(unit < min(1.0, max_examples / max(1, marked.count())))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "id")
    sample = scratch.table(rows.groupBy(F.md5("text").alias("_key"), "toxic").agg(F.min_by(F.struct("id", "text"), "id").alias("x")).select("x.id", "x.text", "toxic"), "examples")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    total = n0 + n1
    if total == 0:
        return Model(Terms(np.zeros(0, np.uint64), np.zeros(0)), Index([], 0, k), 0.0, 0.0)
    counts = sample.select("text", "toxic").mapInArrow(tv.tidy(_document_counts), "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    seen = counts.toArrow()  # the terms of the examples
    n_without, n_with = (seen.column(c).to_numpy().astype(np.float64) for c in ("n0", "n1"))
    df = n_with + n_without
    least = np.maximum(1.0, df * (total - df) * n0 * n1)  # zero only where phi is zero too
    phi = np.abs(n_with * (n0 - n_without) - n_without * (n1 - n_with)) / np.sqrt(least)
    hashes, weight = seen.column("h").to_numpy().view(np.uint64), np.log(1 + total / df) * phi
    terms = Terms(hashes[weight > 0], weight[weight > 0])
    terms_of = spark.sparkContext.broadcast(terms)

    def vectors(batches):
        for batch in batches:
            t, w = [], []
            for s in tv.slices(_lowered(batch.column(1))):
                at, ti, wi = terms_of.value.vectors(s)
                t += [ti[at[r] : at[r + 1]] for r in range(s.rows)]
                w += [wi[at[r] : at[r + 1]] for r in range(s.rows)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.int64())), pa.array(w, pa.list_(pa.float64())), batch.column(2), batch.column(0)], names=["t", "w", "toxic", "id"])

    found = sample.mapInArrow(tv.tidy(vectors), "t array<long>, w array<double>, toxic int, id long").toArrow()
    cols = [found.column(i).to_pylist() for i in range(4)]
    all_vectors = list(zip(*cols, strict=True))
    bare = [v[2] for v in all_vectors if not v[0]]
    prior = n1 / total
    index = Index(all_vectors, len(terms.hashes), k)
    model = Model(terms, index, prior, (sum(bare) + prior) / (len(bare) + 1))
    if index.n:
        model_of = spark.sparkContext.broadcast(model)

        def votes(batches):
            m = model_of.value
            term_of = np.repeat(np.arange(len(m.terms.hashes), dtype=np.int32), np.diff(m.index.at))
            for batch in batches:
                ids = batch.column(0).to_numpy()
                mine = np.zeros(m.index.n, bool)
                mine[ids] = True
                own = np.flatnonzero(mine[m.index.e])
                own = own[np.argsort(m.index.e[own], kind="stable")]
                e, w, t = m.index.e[own], m.index.w[own], term_of[own].astype(np.int64)
                lo, hi = np.searchsorted(e, ids), np.searchsorted(e, ids, "right")
                out = [m.index.vote(*m.index.nearest(t[a:b], w[a:b], int(i)), m.prior) for i, a, b in zip(ids, lo, hi, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "vote"])

        own = spark.range(index.n).repartition(min(64, -(-index.n // 256))).mapInArrow(tv.tidy(votes), "id long, vote double").toArrow()
        model.calibrate(own.column(1).to_numpy(), index.label[own.column(0).to_numpy()])
    return model


EVIDENCE = "array<struct<example_id:bigint,similarity:double,toxic:int>>"


def _score(model_of, keep: list[str]):
    kind = pa.list_(pa.struct([("example_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        m: Model = model_of.value
        memo: dict = {}  # texts of equal vectors have equal neighbours
        for batch in batches:
            scores, evidence = [], []
            for s in tv.slices(_lowered(batch.column(batch.schema.get_field_index("text")))):
                at, t, w = m.terms.vectors(s)
                for lo in range(0, s.rows, 128):
                    hi = min(s.rows, lo + 128)
                    part = m.index.common(at[lo : hi + 1] - at[lo], t[at[lo] : at[hi]], w[at[lo] : at[hi]]) if m.index.n else None
                    for r in range(lo, hi):
                        if at[r] == at[r + 1]:
                            scores.append(m.bare)
                            evidence.append([])
                            continue
                        ti, wi = t[at[r] : at[r + 1]], w[at[r] : at[r + 1]]
                        same = hashlib.md5(ti.tobytes() + wi.tobytes()).digest()
                        if same not in memo:
                            if len(memo) > 4096:
                                memo.clear()
                            best, sim = m.index.nearest(ti, wi, part=part[r - lo])
                            near = [{"example_id": int(m.index.ids[i]), "similarity": float(x), "toxic": int(m.index.label[i])} for i, x in zip(best[:3], sim[:3], strict=True)]
                            memo[same] = (m.score(m.index.vote(best, sim, m.prior)), near)
                        scores.append(memo[same][0])
                        evidence.append(memo[same][1])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(evidence, kind)], names=[*keep, "score", "predicted", "evidence"])

    return run


def score(docs: DataFrame, model: Model, with_text: bool = False) -> DataFrame:
    """docs (without its text, unless asked for) with score, predicted and the three nearest examples."""
    keep = [c for c in docs.columns if c not in ("score", "predicted", "evidence") and (with_text or c != "text")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep), *([] if with_text else ["text"]))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.mapInArrow(tv.tidy(_score(broadcast, keep)), f"{schema}, score double, predicted int, evidence {EVIDENCE}")


def remainder(doc_id: str, n: int):
    """crc32 of doc_id as text, modulo n, as a column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def training(labels: DataFrame, n: int = 5) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(remainder("doc_id", n) != 0)


