"""Token ids of whole columns with the public word-level BPE vocabulary.

The vocabulary's pre-tokens are independent of each other, so a batch is cut into pre-tokens with
array operations and only pre-tokens that the worker has not met yet are encoded.  The short cut
covers texts whose characters are all below U+0250 and that hold no special token's string; there
normalisation only lower-cases, and the character classes are exact.  Every other text goes to the
tokenizer whole.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

from . import textvec as tv

TOP = 0x250
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
MEMORY = 400_000  # pre-tokens remembered by a worker; beyond it the memory starts afresh


def _classes() -> np.ndarray:
    out = np.full(TOP, OTHER, np.uint8)
    for c in range(TOP):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


CLASS = _classes()


class Encoder:
    """encode(list of bytes) gives all ids and each text's number of them."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for word, i in self.tok.get_vocab().items():
            self.ends[i] = word.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.where = np.zeros(0, np.int64)  # of each: its place in start and size
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """New pre-tokens: encoded in one text, split again at the ends of words."""
        if len(self.start) + len(words) > MEMORY and len(self.start):
            raise MemoryError
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(words) or (len(end) and end[-1] != len(ids)):
            each = self.whole(words)
            ids = np.concatenate(each) if each else np.zeros(0, np.uint32)
            end = np.cumsum([len(x) for x in each])
        begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
        place = np.arange(len(self.start), len(self.start) + len(words))
        self.start = np.concatenate([self.start, begin + len(self.ids)])
        self.size = np.concatenate([self.size, end - begin])
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.where = np.insert(self.where, at, place)

    def fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low = "".join(texts).lower()
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        cp = np.frombuffer(low.encode("utf-16-le"), np.uint16)
        n = len(cp)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        kind = CLASS[cp]
        first = np.zeros(n + 1, bool)
        first[off[:-1]] = True
        first = first[:n]
        same = np.zeros(n, bool)
        same[1:] = (kind[1:] == kind[:-1]) & ~first[1:]
        begin = (kind != SPACE) & ~((kind != NUMBER) & same)
        tick = np.flatnonzero(begin & (cp == 39))
        if len(tick):
            wide = np.concatenate([cp, np.zeros(3, np.uint16)])
            edge = np.concatenate([first, np.ones(3, bool)])
            a, b = wide[tick + 1], wide[tick + 2]
            one = np.isin(a, [ord(c) for c in "stmd"]) & ~edge[tick + 1]
            two = (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & ~edge[tick + 1] & ~edge[tick + 2]
            two &= ~one
            begin[tick[one | two] + 1] = False
            for hit, step in ((one, 2), (two, 3)):
                to = tick[hit] + step
                to = to[to < n]
                begin[to[kind[to] == LETTER]] = True
        ts = np.flatnonzero(begin)
        stop = begin | (kind == SPACE) | first
        nxt = np.append(np.flatnonzero(stop), n)
        te = nxt[np.searchsorted(nxt, ts, "right")]
        _, inv = tv.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) * tv.COMBINE[0] + tv.COMBINE[1] ^ tv.CODES[cp & 255]) * tv.powers(n)[0], out=sums[1:])
        h = tv.mix((sums[te] - sums[ts]) * inv[ts] + (te - ts).astype(np.uint64) * tv.COMBINE[63])
        distinct, at, which = np.unique(h, return_index=True, return_inverse=True)

        def unknown():
            if not len(self.hashes):
                return np.arange(len(distinct))
            p = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            return np.flatnonzero(self.hashes[p] != distinct)

        new = unknown()
        if len(new):
            if len(self.start) + len(new) > MEMORY:
                self.forget()
                new = unknown()
            self.learn(distinct[new], [low[a:b] for a, b in zip(ts[at[new]].tolist(), te[at[new]].tolist(), strict=True)])
        place = self.where[np.searchsorted(self.hashes, distinct)][which]
        size = self.size[place]
        ids = self.ids[tv.ragged(self.start[place], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(upto[np.searchsorted(ts, off)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain, odd, decoded = [], [], []
        for i, raw in enumerate(texts):
            t = raw.decode("utf-8", "replace")
            decoded.append(t)
            # below U+0250 the UTF-8 lead bytes stop at 0xC9
            (odd if "<|" in t or (not t.isascii() and max(raw) > 0xC9) else plain).append(i)
        ids, size = self.fast([decoded[i] for i in plain])
        if not odd:
            return ids, size
        out: list[np.ndarray] = [None] * len(texts)
        for i, x in zip(plain, np.split(ids, np.cumsum(size)[:-1]), strict=True) if plain else ():
            out[i] = x
        for i, x in zip(odd, self.whole([decoded[i] for i in odd]), strict=True):
            out[i] = x
        return np.concatenate(out) if out else ids, np.array([len(x) for x in out], np.int64)


_made: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the Python worker."""
    if file not in _made:
        _made[file] = Encoder(file)
    return _made[file]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


assert sys.byteorder == "little", "ids are hashed as little-endian"
