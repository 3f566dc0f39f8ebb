import collections
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from roadlens.llm import toxicity as tx
from tests.llm import fixtures as fx


def test_search_is_exact():
    rng = np.random.default_rng(1)
    terms, n = 60, 900
    vs = []
    for i in range(n):
        t = np.sort(rng.choice(terms, rng.integers(0, 8), replace=False))
        w = rng.random(len(t))
        vs.append((t.tolist(), (w / np.sqrt((w * w).sum())).tolist() if len(t) else [], int(rng.integers(2)), i))
    index = tx.Index(vs, terms, 25)
    dense = np.zeros((index.n, terms))
    by_id = {v[3]: v for v in vs}
    for k, i in enumerate(index.ids):
        dense[k, by_id[i][0]] = by_id[i][1]
    for _ in range(60):
        t = np.sort(rng.choice(terms, rng.integers(1, 9), replace=False))
        w = rng.random(len(t))
        w /= np.sqrt((w * w).sum())
        full = dense[:, t] @ w
        best, score = index.nearest(t, w)
        want = sorted(full[full > 1e-15], reverse=True)[:25]
        assert np.allclose(score, want) and np.allclose(full[best], score)


def test_learns_the_marked_word(spark):
    rows = [(i, f"plain text number {i} with words {i % 7} " + ("you idiotic fool" if i % 5 == 0 else "nice day"), "en", "s", 1) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 1, 1), (5000, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = fx.frame(spark, rows + fx.odd_documents(), clash=("score", "evidence", "predicted", "id"))
    model = tx.fit(docs, labels)
    got = tx.score(docs, model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len(got) == len(rows) + len(fx.odd_documents())
    want = {r[0]: "idiotic" in (r[1] or "") for r in rows}
    mine = [r for r in got if r["doc_id"] < 300 and r["source"] == "s"]
    assert sum(r["predicted"] == want[r["doc_id"]] for r in mine) >= len(mine) - 2
    assert any(len(r["evidence"]) == 3 and r["evidence"][0]["toxic"] == 1 for r in mine)


def test_no_labels_and_empty(spark):
    docs = fx.frame(spark, fx.odd_documents())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in tx.score(docs, tx.fit(docs, none)).collect()} == {0.0}
    assert tx.score(spark.createDataFrame([], fx.SCHEMA), tx.fit(docs, none)).collect() == []


def words_of(text):
    return collections.Counter(re.findall("[a-z\u0080-\U0010ffff]+", (text or "").lower()))


def test_fit_and_vote_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in fx.documents()}
    labels = [r for r in pq.read_table(f"{fx.SF}/labels.parquet").to_pylist() if r["toxic"] is not None]
    examples = {}
    for r in labels:
        key = (docs[r["doc_id"]], r["toxic"])
        examples[key] = min(examples.get(key, r["doc_id"]), r["doc_id"])
    examples = [(i, words_of(t), y) for (t, y), i in examples.items()]
    total, n1 = len(examples), sum(y for *_, y in examples)
    weight = {}
    for term in {t for _, c, _ in examples for t in c}:
        a, b = (sum(term in c for _, c, y in examples if y == k) for k in (1, 0))
        c, d = n1 - a, total - n1 - b
        chi = total * (a * d - b * c) ** 2 / ((a + b) * (c + d) * n1 * (total - n1)) if c + d else 0.0
        weight[term] = math.log(1 + total / (a + b)) * math.sqrt(chi / total)

    def vector(counts):
        w = {t: (1 + math.log(n)) * weight[t] for t, n in counts.items() if weight.get(t)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = [(i, vector(c), y) for i, c, y in examples]
    frame = fx.frame(spark, [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in fx.documents()])
    model = tx.fit(frame, spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in labels], "doc_id long, toxic int"))
    by_term = {h: i for i, h in enumerate(model.terms.hashes.tolist())}
    assert len(by_term) == sum(w > 0 for w in weight.values())
    compared = 0
    for r in tx.score(frame, model).collect():
        q = vector(words_of(docs[r["doc_id"]]))
        near = sorted(((sum(q[t] * v.get(t, 0) for t in q), i, y) for i, v, y in vectors), reverse=True)
        near = [x for x in near if x[0] > 1e-12]
        if not q or len(near) > 25 and near[24][0] - near[25][0] < 1e-9:
            continue
        got = [e["similarity"] for e in r["evidence"]]
        assert np.allclose(got, [x[0] for x in near[:3]])
        vote = (sum(s * y for s, _, y in near[:25]) + model.prior) / (sum(s for s, _, _ in near[:25]) + 1)
        assert abs(model.score(vote) - r["score"]) < 1e-9
        compared += 1
    assert compared > 150
    assert sum(bool(vector(words_of(t))) for t in docs.values()) > 0.95 * len([t for t in docs.values() if words_of(t)])


def test_calibration_is_isotonic_regression():
    rng = np.random.default_rng(3)
    votes = np.round(rng.random(80), 2)
    labels = (rng.random(80) < votes).astype(int)
    model = tx.Model(None, None, 0.3, 0.0)
    model.calibrate(votes, labels)
    levels = sorted(set(votes.tolist()))
    y = [labels[votes == v].sum() for v in levels]
    n = [(votes == v).sum() for v in levels]
    mean = lambda j, k: sum(y[j : k + 1]) / sum(n[j : k + 1])
    want = [max(min(mean(j, k) for k in range(i, len(levels))) for j in range(i + 1)) for i in range(len(levels))]
    assert len(model.y) == len({round(w, 12) for w in want})
    for block, value in zip(sorted({round(w, 12) for w in want}), model.y, strict=True):
        size = sum(c for c, w in zip(n, want, strict=True) if round(w, 12) == block)
        assert abs((block * size + 0.3) / (size + 1) - value) < 1e-9


def test_query_learns_outside_the_fold_and_keeps_its_contract(spark):
    from roadlens.llm import registry

    rows = registry.op4_toxicity(spark, fx.SF).collect()
    assert len(rows) == len(fx.documents())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert all(zlib.crc32(str(e["example_id"]).encode()) % 5 for e in r["evidence"])
