import math
import re
from collections import Counter

import numpy as np
import pytest

from roadlens.llm import ppm
from tests.llm import fixtures as fx

TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def brute_model(texts):
    counts = [dict() for _ in range(ppm.ORDER + 1)]
    for t in texts:
        s = [10] * ppm.ORDER + list(lower(t)) + [256]
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts[k].setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    return counts


def brute_p(counts, context, symbol):
    p, excluded = 1.0, set()
    for k in range(ppm.ORDER, -1, -1):
        c = counts[k].get(tuple(context[len(context) - k :]))
        if c is None:
            continue
        left = {x: n for x, n in c.items() if x not in excluded}
        if not left:
            continue
        total, distinct = sum(left.values()), len(left)
        if symbol in left:
            return p * left[symbol] / (total + distinct)
        p *= distinct / (total + distinct)
        excluded |= set(c)
    return p / (257 - len(excluded))


def brute_score(counts, t):
    s = [10] * ppm.ORDER + list(lower(t)) + [256]
    return sum(math.log10(brute_p(counts, s[i - ppm.ORDER : i], s[i])) for i in range(ppm.ORDER, len(s)))


def brute_base(train, t):
    c = Counter()
    for x in train:
        c.update(TOKEN.findall(lower(x)))
    c = dict(c) | ({"end": len(train)} if train else {})
    n, v = sum(c.values()), len(c)
    words = [*TOKEN.findall(lower(t)), "end"]
    return len(words), sum(w in c for w in words), n, sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in words)


def test_against_brute_force(spark):
    rows = [(r[0], r[1] if r[1] is None else r[1][:1500]) for r in fx.odd_documents()]
    train = [t for i, t in rows if i % 3]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as base").repartition(3)
    counts = brute_model(train)
    for kw in ({}, {"max_words": 5}):
        got = sorted(map(tuple, ppm.score(df, df.where("doc_id % 3 <> 0"), **kw).collect()))
        want = sorted((i, *brute_base(train, t), brute_score(counts, t)) for i, t in rows)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4] for g in got], [w[4] for w in want]) and np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-5)


def test_sums_to_one_after_pruning(spark):
    rows = [(r[0], r[1]) for r in fx.odd_documents()[:30]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10**6, 3000):
        trie = ppm.fit(df, most)[1]
        for context in (b"the th", b"\n\n\n\n\n\n", b"zzzzzz", b"on and"):
            ctx = 0
            for b in context[-ppm.ORDER :]:
                ctx = ctx << 8 | b
            p = np.exp(trie.log_p(np.array([ctx << 9 | s for s in range(257)])))
            assert p.sum() == pytest.approx(1, abs=1e-4)


def test_small_broadcast_loses_nothing(spark):
    rows = [(r[0], r[1] if r[1] is None else r[1][:1500]) for r in fx.odd_documents()]
    train = [t for i, t in rows if i % 3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = brute_model(train)
    want = sorted((i, brute_score(counts, t)) for i, t in rows)
    for most in (0, 500):
        got = sorted((r["doc_id"], r["score"]) for r in ppm.score(df, df.where("doc_id % 3 <> 0"), max_grams=most).collect())
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-5)


def test_no_training_text_and_empty(spark):
    df = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
    (row,) = ppm.score(df, df.where("false")).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["score"] == pytest.approx(5 * math.log10(1 / 257)) and row["base_score"] == pytest.approx(0)
    assert ppm.score(df.where("false"), df).collect() == []
