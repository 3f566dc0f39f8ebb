"""Language identification by words first, character n-grams for the rest.

A word that the model knows scores by its log frequency in each language.  Any other word backs off
to its character 5-grams, then 4-grams down to single characters: the longest length of which some
n-gram is known decides, with the mean of the known n-grams' log frequencies.  A text's language is
the one with the largest sum over all its words.

The model is fitted on a documented, bounded sample: about ``per_language`` different labelled texts of
each language (fewer where that would be over ``most`` texts in all), chosen by the hash of the text;
counts over it are distributed sums.  Every word and n-gram of the sample is kept: the sample alone
bounds what is broadcast.  Prediction is one scan without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text with letters but
no known word or n-gram falls to the most frequent language with score 1/languages; rows without a
label teach nothing; with no labels at all every text is ``und``; languages of equal score go to the
first by name; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

LONGEST = 5
UNKNOWN = "und"


def _lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.cast(pa.string()))


def _grams(s: tv.Slice, chars: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words of characters lo..hi, and each one's word."""
    size = np.maximum(hi - lo - n + 1, 0)
    at = tv.ragged(lo, size)
    return s.span_hash(chars[at], chars[at + n]), np.repeat(np.arange(len(lo)), size)


def _chars(s: tv.Slice) -> np.ndarray:
    return np.append(np.flatnonzero((s.buf & 0xC0) != 0x80), len(s.buf))


def _count(batches):
    """(text, lang) to (n, hash, lang, count); n is 0 for words."""
    for batch in batches:
        lang = batch.column(1).to_numpy(zero_copy_only=False)
        known, of = np.unique(lang.astype(str), return_inverse=True)
        for s in tv.slices(_lowered(batch.column(0))):
            ws, we, off = s.words(tv.ALPHA)
            mine = of[s.first + tv.row_of(off)]
            h = s.span_hash(ws, we)
            chars = _chars(s)
            lo, hi = np.searchsorted(chars, ws), np.searchsorted(chars, we)
            for n in range(LONGEST + 1):
                g, word = (h, np.arange(len(h))) if n == 0 else _grams(s, chars, lo, hi, n)
                for k, name in enumerate(known):
                    u, c = np.unique(g[mine[word] == k], return_counts=True)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), n, np.int32)), pa.array(u.view(np.int64)), pa.array([name] * len(u)), pa.array(c)], names=["n", "h", "lang", "c"])


class Model:
    """Sorted hashes and per-language log frequencies, for words (0) and n-grams (1..LONGEST)."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]], totals: np.ndarray):
        self.langs, self.totals = langs, totals
        self.hashes, self.logs = {}, {}
        for n, (h, c) in tables.items():
            self.hashes[n] = h
            self.logs[n] = np.log((c + 0.5) / (totals[n][None, :] + 0.5 * max(1, len(h)))).astype(np.float32)
        self.prior = totals[0] / max(1, totals[0].sum()) if len(langs) else totals[0]

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        table = self.hashes.get(n)
        if table is None or not len(table):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return np.where(table[at] == h, at, -1)

    def words(self, s: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log frequencies, rows by languages, and the number of scored words of each row."""
        ws, we, off = s.words(tv.ALPHA)
        row = tv.row_of(off)
        h = s.span_hash(ws, we)
        total, scored, langs = np.zeros((s.rows, len(self.langs))), np.zeros(s.rows), range(len(self.langs))
        at = self.find(0, h)
        known = at >= 0
        scored += np.bincount(row[known], minlength=s.rows)
        for k in langs:
            total[:, k] += np.bincount(row[known], self.logs[0][at[known], k] if known.any() else [], s.rows)
        rest = np.flatnonzero(~known)
        if len(rest):
            _, first, back = np.unique(h[rest], return_index=True, return_inverse=True)
            one = rest[first]
            chars = _chars(s)
            lo, hi = np.searchsorted(chars, ws[one]), np.searchsorted(chars, we[one])
            value, done = np.zeros((len(one), len(self.langs))), np.zeros(len(one), bool)
            for n in range(LONGEST, 0, -1):
                open_ = np.flatnonzero(~done & (hi - lo >= n))
                g, word = _grams(s, chars, lo[open_], hi[open_], n)
                at = self.find(n, g)
                hit = at >= 0
                if not hit.any():
                    continue
                count = np.bincount(word[hit], minlength=len(open_))
                some = count > 0
                for k in langs:
                    value[open_[some], k] = (np.bincount(word[hit], self.logs[n][at[hit], k], len(open_))[some]) / count[some]
                done[open_[some]] = True
            mine = done[back]
            scored += np.bincount(row[rest[mine]], minlength=s.rows)
            for k in langs:
                total[:, k] += np.bincount(row[rest[mine]], value[back[mine], k], s.rows)
        return total, scored


def lettered(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _predict(model_of, keep: list[str]):
    def run(batches):
        model: Model = model_of.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            langs, scores = [], []
            for s in tv.slices(_lowered(text)):
                if not model.langs:
                    langs += [UNKNOWN] * s.rows
                    scores += [0.0] * s.rows
                    continue
                total, n = model.words(s)
                total = total / np.sqrt(np.maximum(n, 1))[:, None]  # words of a text are not independent
                p = np.exp(total - total.max(1, keepdims=True)) * (1 + 1e-9 * model.prior)[None, :]
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                ascii_letters = tv.ALPHA.copy()
                ascii_letters[128:] = False
                ws = np.flatnonzero(ascii_letters[s.buf])
                plain = np.diff(np.searchsorted(ws, s.off)) > 0
                for r in range(s.rows):
                    if plain[r] or lettered(s.text(r)):
                        langs.append(model.langs[best[r]])
                        scores.append(float(p[r, best[r]]))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def fit(labelled: DataFrame, per_language: int = 1500, most: int = 50_000) -> Model:
    """Model from rows (text, lang) with a label; see the module for the bounds.  Equal texts of a language count once."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not sizes:
        return Model([], {}, np.zeros((LONGEST + 1, 0)))
    each = max(1, min(per_language, most // len(sizes)))
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, each / max(1, n))))))
    sample = rows.where(unit < share[F.col("lang")]).groupBy(F.md5("text").alias("key"), "lang").agg(F.first("text").alias("text"))
    counts = sample.select("text", "lang").mapInArrow(tv.tidy(_count), "n int, h long, lang string, c long").groupBy("n", "h", "lang").agg(F.sum("c").alias("c")).toArrow()
    langs = sorted(sizes)
    length, h = counts.column("n").to_numpy(), counts.column("h").to_numpy().view(np.uint64)
    lang, c = np.searchsorted(langs, counts.column("lang").to_numpy(zero_copy_only=False).astype(str)), counts.column("c").to_numpy().astype(np.float64)
    tables, totals = {}, np.zeros((LONGEST + 1, len(langs)))
    for n in range(LONGEST + 1):
        i = np.flatnonzero(length == n)
        known, of = np.unique(h[i], return_inverse=True)
        wide = np.zeros((len(known), len(langs)))
        wide[of, lang[i]] = c[i]
        tables[n] = (known, wide)
        totals[n] = wide.sum(0)
    return Model(langs, tables, totals)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs without its text, with lang_pred and score (0 to 1)."""
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep), "text")
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(tv.tidy(_predict(broadcast, keep)), f"{schema}, lang_pred string, score double")
