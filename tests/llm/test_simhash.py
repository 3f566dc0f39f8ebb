import random
import re

from roadlens.llm import components, simhash
from tests.llm import fixtures as fx

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows):
    sets = [None if t is None else shingles(t) for _, t in rows]
    par = list(range(len(rows)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] is None or sets[j] is None or rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][1] == rows[j][1] or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                par[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i))
        out.append((d, c, d is not None and d == c))
    return sorted(out, key=str)


def case(seed=1):
    rng = random.Random(seed)
    rows = [(r[0], r[1]) for r in fx.odd_documents() if not (r[1] and len(r[1]) > 50_000)]
    base = [r for r in rows if r[1] and len(r[1]) > 1500][:12]
    at = 50_000
    for d, t in base:
        for edits in (1, 2, 4, 8, 16):
            w = t.split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = "changed"
            rows.append((at, " ".join(w)))
            at += 1
    rows += [(60_000, "same short"), (60_001, "Same SHORT!"), (60_002, "same short one"), (60_003, None), (60_004, "..."), (60_005, "..."), (None, base[0][1])]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as f0", "'x' as key").repartition(3)
    return sorted((tuple(r) for r in simhash.classes(df, **kw).collect()), key=str)


def test_against_brute_force(spark):
    rows = case()
    assert run(spark, rows, recall=0.99999) == brute(rows)


def test_large_lists_in_blocks(spark):
    rows = case(2)
    assert run(spark, rows, recall=0.99999, limit=10) == brute(rows)


def test_one_row_stays_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, "a b c")]) == [(5, 5, True)]


def test_plan_reaches_its_recall():
    import numpy as np

    rng = np.random.default_rng(3)
    p = simhash.plan(50_000)
    f = simhash.Filters(p)
    a = rng.integers(0, 2, (400, 128)).astype(np.uint8)
    b = a ^ (rng.random((400, 128)) < 0.1516)
    both = np.packbits(np.concatenate([a, b]), axis=1).view(np.uint64)
    found = np.zeros(400, bool)
    for row, key in f.lists(both):
        left = set(zip(row[row < 400].tolist(), key[row < 400].tolist(), strict=True))
        for r, k in zip(row[row >= 400].tolist(), key[row >= 400].tolist(), strict=True):
            if (r - 400, k) in left:
                found[r - 400] = True
    assert found.mean() > 0.95


def test_borderline_pairs_with_the_production_recall(spark):
    rng = random.Random(8)
    rows, pairs = [], {8: 300, 16: 100, 64: 100}  # words of the shorter text; a fourth as many shingles more make 0.8
    for n, times in pairs.items():
        for _ in range(times):
            w = [f"v{rng.randrange(10**9)}" for _ in range(n + (n - 4) // 4)]
            rows += [(len(rows), " ".join(w[:n])), (len(rows) + 1, " ".join(w))]
    size = [n for n, times in pairs.items() for _ in range(times)]
    linked = {d for d, c, _ in run(spark, rows) if d % 2 and c == d - 1}
    for n, times in pairs.items():
        assert sum(size[d // 2] == n for d in linked) >= 0.96 * times


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 1), (3, 3), (20, 21), (22, 21), (5, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {9: 1, 8: 1, 7: 1, 21: 20, 22: 20, 5: 4} | {101 + i: 100 for i in range(40)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pivots_lose_no_link(spark, monkeypatch):
    """A group of texts about as far from each other as the threshold, with a pivot for each near group of three."""
    rng = random.Random(8)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10_000)}"
        rows.append((100 + i, " ".join(w)))
    whole = simhash.pivots
    monkeypatch.setattr(simhash, "pivots", lambda near, good, texts: whole(near, good, texts, 3))
    assert run(spark, rows, recall=0.99999) == brute(rows)


def test_shipped_recall_on_borderline_pairs(spark):
    """Pairs of similarity just over 0.8, long and short, by the shipped settings."""
    rng = random.Random(4)
    rows, want = [], 0
    for i in range(150):
        n = rng.choice((9, 20, 60, 200))
        w = [f"u{i}x{k}" for k in range(n + 4)]
        v = list(w)
        while True:  # change words at the end, as far as the similarity allows
            u = list(v)
            u[len(u) - 1 - sum(a != b for a, b in zip(w, v, strict=True))] = "changed" + str(i)
            a, b = shingles(" ".join(w)), shingles(" ".join(u))
            if len(a & b) < 0.8 * len(a | b):
                break
            v = u
        if v != w:
            rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
            want += 1
    got = {r[0]: r[1] for r in run(spark, rows)}
    assert sum(got[i] == got[i + 1] for i, _ in rows[::2]) >= 0.96 * want and want > 100


def test_fingerprints_near_by_chance_are_no_neighbours(spark):
    """Pass one asks all 256 bits: a text near in 128 bits only neither counts nor hides a text that is near."""
    import numpy as np

    rng = np.random.default_rng(6)
    f = np.repeat(rng.integers(-(2**63), 2**63, (1, 4)), 4, axis=0)
    f[1, :2] ^= [0b111, 0]  # the nearest in 128 bits, and by the other 128 no neighbour
    f[1, 2:] = ~f[1, 2:]
    f[2, 0] ^= 0b11111111
    f[3, 0] ^= 0b1111111100000000
    x = {"node": np.array([10, 11, 12, 13]), "block": np.zeros(4, np.int32)} | {f"f{k}": f[:, k].copy() for k in range(4)}
    found = simhash._nearest(np.concatenate(simhash._compare(x, False, False, simhash.NEAR, 0.8)))
    assert found.tolist() == [[10, 12, 8], [12, 10, 8], [13, 10, 8]]
    x |= {"root": x["node"], "pivot": -x["node"], "far": np.zeros(4)}
    assert np.concatenate(simhash._compare(x, False, True, simhash.NEAR, 0.8)).tolist() == [[10, 12, 8], [10, 13, 8], [12, 13, 16]]


def test_unrelated_texts_have_no_candidates(spark):
    """At 44 bits as many of 6000 fingerprints are near by chance as of millions at 36; none may reach pass two."""
    import numpy as np

    rng = np.random.default_rng(7)
    n = 6000
    f = rng.integers(-(2**63), 2**63, (n, 4))
    rows = [(i, *f[i].tolist(), False) for i in range(n)]
    reps = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long, few boolean")
    filters_of = spark.sparkContext.broadcast(simhash.Filters(simhash.plan(n)))
    assert simhash._candidates(reps, filters_of, simhash.LIST, False, 44).count() == 0
    seen = (np.bitwise_count((f[:2000, None, :2] ^ f[None, :2000, :2]).view(np.uint64)).sum(2) <= 44).sum() - 2000
    assert seen > 100


def test_sketches_lose_no_pair():
    """Sets of similarity 0.8 and just more, the worst case of the bounds, and sets far from it, which they end."""
    import numpy as np

    rng = np.random.default_rng(6)
    far = 0
    for n in (8, 80, 400, 4000, 40_000):  # shingles of both together
        for _ in range(20):
            h = rng.integers(0, 2**63, n, dtype=np.uint64)
            cut = rng.integers(0, n // 5 + 1)  # of the fifth that is in one only, what is the first's
            sets = [h[: n - n // 5 + cut], np.append(h[: n - n // 5], h[n - n // 5 + cut :]), h[: n // 2], h[n // 4 : n // 4 + n // 2]]
            odd = [np.packbits((np.bincount((simhash.tv.mix(s) % np.uint64(simhash.ODD)).astype(int), minlength=simhash.ODD) & 1).astype(bool)).view(np.uint64) for s in sets]
            x = {"size": np.array([len(s) for s in sets]), "odd": np.stack(odd)}
            assert simhash._alike(x, np.array([0, 1]), np.array([1, 0]), 0.8).all()
            far += not simhash._alike(x, np.array([2]), np.array([3]), 0.8).any()
    assert far >= 60


def resembling(n):
    """Texts about 0.6 to 0.75 alike, all near in bits, and two that are similar."""
    rng = random.Random(12)
    rows = []
    for i in range(n):
        w = [f"common{k}" for k in range(300)]
        for k in rng.sample(range(0, 300, 5), 8):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows + [(n, rows[7][1] + " and more"), (n + 1, rows[9][1] + " or less")]


def test_resembling_texts_are_not_fetched(spark, monkeypatch):
    """Their pairs grow with the square of a group that grows with the corpus."""
    rows, fetched, whole = resembling(60), [], simhash.verified

    def verified(pairs, texts, similarity=simhash.SIMILARITY):
        fetched.append(pairs.count())
        return whole(pairs, texts, similarity)

    monkeypatch.setattr(simhash, "verified", verified)
    got = run(spark, rows, recall=0.99999)
    assert got == brute(rows)
    assert sum(d != c for d, c, _ in got) == 2 and fetched[1] <= 30
