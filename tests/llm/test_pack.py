import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from roadlens.llm import pack, tokens
from tests.llm import fixtures as fx


def brute(rows):
    tok = Tokenizer.from_file(tokens.vocabulary())
    out = []
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[lo : lo + 2048], "<u4")
            out.append((r[0], k, lo, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def filled(rows):
    """Every sequence is gapless from 0 and within capacity; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    return len(by)


def test_pieces_and_places(spark):
    rows = fx.odd_documents()
    got = pack.pack(fx.frame(spark, rows, clash=("piece", "sequence_id", "length"))).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == brute(rows)
    total = sum(r["length"] for r in got)
    assert filled(got) <= -(-total // 2048) + 2


def test_memory_of_words_is_bounded():
    enc = tokens.Encoder(tokens.vocabulary())
    old, tokens.MEMORY = tokens.MEMORY, 50
    try:
        texts = [r[1].encode() for r in fx.odd_documents() if r[1]][:20]
        for t in texts:
            assert enc.encode([t])[0].tolist() == enc.tok.encode(t.decode(), add_special_tokens=False).ids
    finally:
        tokens.MEMORY = old


def test_plan():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randint(1, 2048): rng.choice([1, 2, 3, 50]) for _ in range(rng.randint(0, 60))}
        classes = pack.plan(counts)
        got = {}
        for items, n in classes:
            assert sum(items) <= 2048 and n > 0 and sum(3 * s > 2048 for s in items) <= 2
            for s in items:
                got[s] = got.get(s, 0) + n
        assert got == counts


def test_empty(spark):
    assert pack.pack(spark.createDataFrame([], fx.SCHEMA)).collect() == []
