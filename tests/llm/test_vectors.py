import math

import numpy as np

from roadlens.llm import vectors


def brute(rows, cosine=0.93):
    ok = {}
    for k, (i, v, l) in enumerate(rows):
        if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            ok[k] = (l, len(v), x / np.sqrt((x * x).sum()))
    par, links = {k: k for k in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for a in ok:
        for b in ok:
            if a < b and ok[a][:2] == ok[b][:2] and float(ok[a][2] @ ok[b][2]) >= cosine:
                links[a] += 1
                links[b] += 1
                par[find(a)] = find(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(k)) if i is not None else None
        out.append((i, links[k], c, i is not None and i == c))
    return sorted(out, key=str)


def case(n=150, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5 and rows[k := rng.integers(len(rows))][1]:
            v = np.array(rows[k][1]) + rng.normal(0, 0.05, dim)
        else:
            v = rng.normal(size=dim)
        rows.append((int(i * 7 % 1009), [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(5)] + [(2010, [0.0] * dim, 1), (2011, None, 1), (2012, [], 1), (2013, [float("nan")] * dim, 1), (2014, [None, *[1.0] * (dim - 1)], 1), (2015, rows[3][1], None), (2016, [float("inf")] * dim, 0), (2017, [1.0, 2.0], 1), (2018, [2.0, 4.0], 1), (None, rows[3][1], rows[3][2])]
    rows.append(rows[3])
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "'x' as key").repartition(3)
    return sorted((tuple(r) for r in vectors.link(df, **kw).collect()), key=str)


def test_against_brute_force(spark):
    rows = case()
    assert run(spark, rows, recall=0.99999) == brute(rows)


def test_large_buckets_in_blocks(spark):
    rows = case(90, seed=9)
    assert run(spark, rows, recall=0.99999, bucket=6) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    p = vectors.plan(5000)
    h = vectors.Hash(p)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
    assert (h.keys(a) == h.keys(b)).any(1).mean() > 0.96


def test_links_found_at_the_shipped_recall(spark):
    rng = np.random.default_rng(5)
    n, dim = 400, 64
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(n, dim)))
    b = rng.normal(size=(n, dim))
    b = unit(b - (b * a).sum(1, keepdims=True) * a)
    cosine = rng.uniform(0.931, 0.95, (n, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    rows = [(2 * i + k, [float(np.float32(x)) for x in v], 1) for i in range(n) for k, v in enumerate((a[i], b[i]))]
    got = {r[0]: r[1] for r in run(spark, rows)}
    assert sum(got[2 * i] > 0 for i in range(n)) >= 0.96 * n


def test_extreme_lengths_link(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, [x * 1e-200 for x in v], 1), (2, [x * 1e200 for x in v], 1), (3, v, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["component_id"] for r in vectors.link(df).collect()} == {1}
