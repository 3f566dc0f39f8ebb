import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from roadlens.llm import bwt, suffix
from roadlens.llm import textvec as tv
from tests.llm import fixtures as fx


def brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def case(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    docs = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(0, 120)))
        k = rng.random()
        if k < 0.4:
            a = rng.randint(0, 100)
            t = t + passage[a : a + rng.randint(50, 200)] + t[:30]
        elif k < 0.5 and docs:
            old = list(rng.choice(docs)[1] or "")
            for _ in range(3):
                if old:
                    old[rng.randrange(len(old))] = "X"
            t = "".join(old)
        elif k < 0.6:
            t = word() * rng.randint(1, 200)
        elif k < 0.65:
            t = None
        docs.append((i * 3, t))
    docs += [(1000 + i, docs[5][1]) for i in range(3)] + [(2000, "For " * 400), (2001, "x" * 99), (2002, "y" * 500), (2003, "y" * 100), (2004, ""), (2005, "ab" * 80)]
    rng.shuffle(docs)
    return docs


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 as n_bytes", "'x' as kind")
    return sorted((tuple(r) for r in suffix.dedup(df, **kw).collect()), key=str if any(d[0] is None for d in docs) else None)


def test_against_brute_force(spark):
    docs = case(1)
    assert run(spark, docs) == brute(docs, 100)
    docs = case(2)
    assert run(spark, docs, length=40, gram=12) == brute(docs, 40)


def test_large_groups_are_resolved_by_window(spark, monkeypatch):
    docs = case(3)
    assert run(spark, docs, length=40, gram=12, group=3) == brute(docs, 40)


def test_real_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in fx.documents()]
    assert run(spark, docs) == brute(docs, 100)


def test_odd_rows(spark):
    assert run(spark, []) == []
    got = run(spark, [(None, "z" * 300), (1, None)])
    assert got[0][:4] == (None, 300, 0, 0) or got[1][:4] == (None, 300, 0, 0)


def test_merge_equals_sorting():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (50, 200, 7, 120)]
    shard, at, block = bwt.merge(texts, 10)
    prefix = [bytes(np.resize(np.roll(texts[s], -a), 10)) if len(texts[s]) >= 10 else bytes(np.tile(np.roll(texts[s], -a), 3)[:10]) for s, a in zip(shard, at, strict=True)]
    assert prefix == sorted(prefix)
    assert [block[i] == block[i - 1] for i in range(1, len(block))] == [prefix[i] == prefix[i - 1] for i in range(1, len(prefix))]


def shared(size, docs=40):
    """Unrelated texts that all hold one passage of ``size`` bytes."""
    rng = random.Random(size)
    some = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    passage = some(size)
    return [(i, some(300) + passage + some(300)) for i in range(docs)]


def test_runs_that_share_less_than_half_a_window_end_where_they_meet(spark, monkeypatch):
    docs, kinds = shared(50) + [(100, shared(50)[7][1][100:500])], []
    whole = suffix.scratch.table

    def table(df, tag):
        out = whole(df, tag)
        if tag == "runs":
            kinds.extend((r["doc_id"], r["kind"]) for r in out.collect())
        return out

    monkeypatch.setattr(suffix.scratch, "table", table)
    assert run(spark, docs) == brute(docs, 100)
    assert {d for d, kind in kinds if kind == suffix.EDGE} <= {7, 100}


def test_contexts_without_a_common_window_are_not_merged():
    for size, some in ((80, False), (120, True)):
        texts = [t.encode() for _, t in shared(size, 2)]
        s = suffix.tv.Slice(0, np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]))
        row, start, n, h, _ = suffix.runs_of(s, 100, 24)
        at = [i for i in np.argsort(h, kind="stable") if (h == h[i]).sum() > 1]
        pieces = [texts[row[i]][start[i] : start[i] + (n[i] & suffix.LOW) + 99] for i in at]
        off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        kept = suffix.partners(h[at], n[at], np.frombuffer(b"".join(pieces), np.uint8), off, 100, 24)
        assert len(at) > 1 and kept.any() == some


def peak_mb(work):
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / 1e6


def test_a_worker_stays_small_and_keeps_no_tables():
    """Two workers and the heap share an executor; before, the peaks were 161 and 88 MB, and 34 MB and more stayed."""
    rng = np.random.default_rng(7)
    groups, size = 8000, 140
    base = rng.integers(32, 127, (groups, size + 3)).astype(np.uint8)
    h = np.repeat(np.arange(groups), 4)
    j = np.tile(np.arange(4), groups)
    cols = [h, h * 0, h * 4 + j, j.astype(np.int32), (size - 99 | (70 - j) << 16).astype(np.int32), (j * 0).astype(np.int32)]
    text = pa.array([base[g, k : k + size].tobytes() for g, k in zip(h, j, strict=True)])
    batches = [pa.RecordBatch.from_arrays([*(pa.array(c[lo : lo + 2000]) for c in cols), text[lo : lo + 2000]], names=["h", "c", "doc_id", "start", "n", "kind", "bytes"]) for lo in range(0, len(h), 2000)]
    out, peak = peak_mb(lambda: list(tv.tidy(suffix._resolve(100, 24))(batches)))
    got = np.sort(np.concatenate([b.column(2).to_numpy() * 1000 + b.column(3).to_numpy() for b in out]))
    late = [k * 1000 + p for k in (1, 2, 3) for p in range(k, k + 40)]
    assert np.array_equal(got, (np.arange(groups)[:, None] * 4000 + late).ravel())
    assert peak < 90 and len(tv._pow) == len(tv._inv) == 1

    class Hot:
        value = np.zeros(0, np.int64)

    docs = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(["".join(map(chr, rng.integers(32, 127, 1000))) for _ in range(2000)])], names=["doc_id", "text"])
    _, peak = peak_mb(lambda: sum(b.num_rows for b in tv.tidy(suffix._anchors(100, 24, Hot))([docs])))
    assert peak < 50 and len(tv._pow) == len(tv._inv) == 1
