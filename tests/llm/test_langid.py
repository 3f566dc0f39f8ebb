import collections
import math
import re
import zlib

from roadlens.llm import langid, registry
from roadlens.llm.textvec import Slice
from tests.llm import fixtures as fx


def test_accuracy_and_cases(spark):
    docs = spark.read.parquet(f"{fx.SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.predict(docs.where("doc_id % 2 = 1").withColumnRenamed("n_chars", "score"), model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = langid.predict(fx.frame(spark, fx.odd_documents(), clash=("lang_pred",)), model).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert len(odd) == len(fx.odd_documents())
    assert [by[10_000 + i] for i in range(4)] == ["und"] * 4 and by[10_004] != "und" and by[10_006] != "und"
    none = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


def test_backs_off_to_shorter_grams():
    import numpy as np

    def table(*words):
        out = []
        for w in words:
            b = np.frombuffer(w.encode(), np.uint8)
            s = Slice(0, b, np.array([0, len(b)]))
            out.append(s.span_hash(np.array([0]), np.array([len(b)]))[0])
        return np.array(out, np.uint64)

    def sorted_(h, c):
        o = np.argsort(h)
        return h[o], np.array(c, float)[o]

    tables = {0: sorted_(table("known"), [[9, 1]]), 5: sorted_(table("abcde"), [[1, 9]]), 2: sorted_(table("xy", "yz"), [[8, 2], [2, 8]])}
    m = langid.Model(["a", "b"], tables, np.full((6, 2), 100.0))
    for text, n, want in (("known", 0, [9, 1]), ("zabcdexy", 5, [1, 9]), ("qxy", 2, [8, 2])):
        b = np.frombuffer(text.encode(), np.uint8)
        total, scored = m.words(Slice(0, b, np.array([0, len(b)])))
        v = 0.5 * len(tables[n][0])
        assert np.allclose(total[0], np.log((np.array(want) + 0.5) / (100 + v))) and scored[0] == 1
    b = np.frombuffer(b"xyz", np.uint8)  # the mean of the known 2-grams
    total, _ = m.words(Slice(0, b, np.array([0, 3])))
    assert np.allclose(total[0], np.mean(np.log((np.array([[8, 2], [2, 8]]) + 0.5) / 101), axis=0))
    b = np.frombuffer("ñ!".encode(), np.uint8)
    assert m.words(Slice(0, b, np.array([0, 3])))[1][0] == 0


def test_query_against_brute_force(spark):
    """Folds, counts, backoff, score and columns of the query, recomputed with dictionaries."""
    word = re.compile("[a-z\u0080-\U0010ffff]+")
    docs = fx.documents()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    texts = {(r["text"], r["lang"]) for r in docs if not held[r["doc_id"]] and r["text"] is not None and r["lang"] is not None}
    langs = sorted({lang for _, lang in texts})
    counts = {n: collections.defaultdict(collections.Counter) for n in range(6)}
    for text, lang in texts:
        for w in word.findall(text.lower()):
            counts[0][w][lang] += 1
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts[n][w[i : i + n]][lang] += 1
    totals = {n: {k: sum(c[k] for c in counts[n].values()) for k in langs} for n in counts}

    def log(n, x):
        return [math.log((counts[n][x][k] + 0.5) / (totals[n][k] + 0.5 * len(counts[n]))) for k in langs]

    def one(w):
        if w in counts[0]:
            return log(0, w)
        for n in range(5, 0, -1):
            found = [log(n, w[i : i + n]) for i in range(len(w) - n + 1) if w[i : i + n] in counts[n]]
            if found:
                return [sum(c) / len(found) for c in zip(*found, strict=True)]
        return None

    got = {r["doc_id"]: r for r in registry.op1_langid(spark, fx.SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert got[r["doc_id"]]["held_out"] == held[r["doc_id"]]
        values = [v for v in map(one, word.findall((r["text"] or "").lower())) if v]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        total = [sum(c) / math.sqrt(max(1, len(values))) for c in zip(*values, strict=True)] if values else [0.0] * len(langs)
        p = [math.exp(t - max(total)) for t in total]
        best = max(range(len(langs)), key=p.__getitem__)
        if sorted(p)[-1] - sorted(p)[-2] > 1e-4:
            assert got[r["doc_id"]]["lang_pred"] == langs[best]
        assert abs(got[r["doc_id"]]["score"] - max(p) / sum(p)) < 1e-3


def test_repeated_texts_count_once(spark):
    rows = [(i, "viele gleiche worte", "de", "s", 1) for i in range(300)] + [(400 + i, f"one two {i}", "en", "s", 1) for i in range(3)]
    model = langid.fit(fx.frame(spark, rows))
    assert model.totals[0].tolist() == [3, 6] and len(model.hashes[0]) == 5
