import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.functions import geometry as G
from roadlens.functions import kernels as K
from roadlens.operators import breakdown as B
from roadlens.operators import detection as D
from roadlens.operators import motion as M
from roadlens.operators import segmentation as S
from roadlens.operators import tracking as TR

PI = math.pi


@pytest.mark.parametrize(("a", "b", "kind", "want"), [
    ((0, 0, 0, 1, 2, 1, 0), (0, 0, 0, 1, 2, 1, 0), "aa", 1.0),
    ((0, 0, 0, 1, 2, 1, 0), (10, 10, 0, 1, 2, 1, 0), "aa", 0.0),
    ((0, 0, 0, 1, 2, 1, 0), (0.5, 0, 0, 1, 4, 1, 0), "aa", 0.2),
    ((0, 0, 0, 1, 2, 1, 0), (0, 0, 0, 0, 0, 1, 0), "aa", 0.0),
    ((0, 0, 0, 1, 2, 1, 0), (0.5, 0, 0, 1, 4, 1, PI / 2), "2d", 0.2),
    ((0, 0, 0, 1, 2, 1, 0), (0.5, 0, 0, 1, 4, 1, PI / 4), "2d", 0.24074958176697656),
    ((0, 0, 0, 1, 2, 2, 0), (0.5, 0, 0, 1, 4, 4, 0), "3d", 2 / 18),
    ((0, 0, 0, 1, 2, 2, 0), (0.5, 0, 0, 1, 4, 2, PI / 4), "3d", 0.24074958176697656),
    ((0, 0, 0, 1, 2, 2, 0), (0, 0, 0, 1, 1e-12, 1, 0), "3d", 0.0),
    ((0, 0, 0, 1, 2, 2, 0), (0, 0, 0, 1, 1.01e-2, 2, 0), "3d", 0.00505),
])
def test_iou(a, b, kind, want):
    assert K.iou(np.array([a], float), np.array([b], float), kind)[0, 0] == pytest.approx(want, abs=1e-9)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        r, c = rng.integers(1, 6, 2)
        w = rng.integers(0, 8, (r, c)) * (rng.random((r, c)) < 0.6)
        n = max(r, c)
        full = np.zeros((n, n))
        full[:r, :c] = w
        best = max(sum(full[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        got = K.assign(w)
        used = got[got >= 0]
        assert len(set(used)) == len(used) and all(w[i, j] > 0 for i, j in enumerate(got) if j >= 0)
        assert sum(w[i, j] for i, j in enumerate(got) if j >= 0) == best
    w = rng.random((60, 45))
    got = K.assign(w)
    assert (got >= 0).sum() == 45


def test_greedy():
    w = np.array([[5, 9], [8, 9]])
    assert K.greedy(w, np.array([0.1, 0.9])).tolist() == [0, 1]
    assert K.greedy(np.array([[5, 5]]), np.array([1.0])).tolist() == [0]


@pytest.mark.parametrize(("p", "r", "delta", "want"), [
    ([], [], 0.05, 0.0), ([0.1], [0.2], 0.05, 0.02), ([0.1, 0.05], [0.2, 1.0], 0.05, 0.06125), ([0.1, 0.05], [0.2, 1.0], 1.0, 0.08), ([0.1, 0.0, 0.05], [0.2, 0.4, 1.0], 0.05, 0.06125),
])
def test_average_precision(spark, p, r, delta, want):
    d = spark.createDataFrame([([(x, y) for x, y in zip(r, p, strict=True)],)], "pts array<struct<recall:double,precision:double>>")
    assert d.select(D.area(F.col("pts"), delta)).first()[0] == pytest.approx(want, abs=1e-6)


BOX = "frame long, id long, type long, cx double, cy double, cz double, length double, width double, height double, heading double"


def boxes(spark, preds, gts):
    p = spark.createDataFrame([(*x[:10], x[10], x[11]) for x in preds], BOX + ", score double, nlz boolean")
    g = spark.createDataFrame([(*x[:10], x[10], 0.0, 0.0) for x in gts], BOX + ", level int, speed_x double, speed_y double")
    return p, g


def unit(frame, id_, width, *rest, kind=1, heading=0.0):
    return (frame, id_, kind, 0.0, 0.0, 0.0, 1.0, width, 1.0, heading, *rest)


def test_detection_counts(spark):
    p, g = boxes(spark, [unit(1, 1, 0.9, 0.0, False), unit(1, 2, 0.6, 0.5, False)], [unit(1, 1, 1.0, 1)])
    for matcher in ("hungarian", "score_first"):
        c = {r["cutoff"]: (r["tp"], r["fp"], r["fn"]) for r in D.measure(p, g, [0.0, 0.5, 1.0], levels=(2,), thresholds={1: 0.5}, matcher=matcher).collect()}
        assert c == {0.0: (1, 1, 0), 0.5: (1, 0, 0), 1.0: (0, 0, 1)}
    both = [unit(f, 1, 1.0, 0.9, False) for f in (1, 2)], [unit(f, 1, 1.0, 1) for f in (1, 2)]
    (m,) = D.metrics(D.measure(*boxes(spark, *both), [0.0, 0.5], levels=(2,))).collect()
    assert (m["ap"], m["aph"], m["apl"]) == (pytest.approx(1), pytest.approx(1), pytest.approx(1))


def test_detection_zones_levels_and_headings(spark):
    p, g = boxes(spark, [unit(1, 1, 1.0, 0.9, True, kind=2), unit(2, 1, 1.0, 0.9, False, heading=PI)], [unit(1, 1, 1.0, 2, kind=1), unit(2, 1, 1.0, 1)])
    rows = {(r["shard"], r["level"]): (r["tp"], r["fp"], r["fn"]) for r in D.measure(p, g, [0.0]).collect()}
    assert rows[1, 1] == (0, 0, 0)  # in a no-label zone
    assert rows[0, 1] == (0, 0, 0) and rows[0, 2] == (0, 0, 1)  # level 2 counts at level 2; opposite heading counts as nothing


def test_velocity_breakdown(spark):
    p, _ = boxes(spark, [unit(1, 1, 1.0, 0.9, False)], [])
    g = spark.createDataFrame([(*unit(1, 1, 1.0, 1), 5.0, 0.0)], BOX + ", level int, speed_x double, speed_y double")
    rows = {r["shard"]: (r["tp"], r["fp"], r["fn"]) for r in D.measure(p, g, [0.0], ("VELOCITY",), (2,)).collect()}
    assert rows[3] == (1, 0, 0) and all(rows[s][0] == 0 for s in rows if s != 3)


def test_let(spark):
    far = (1, 1, 1, 51.43, 0.0, 2.18, 4.0, 2.0, 2.0, 0.0)
    gt = (1, 1, 1, 50.43, 0.0, 2.18, 4.0, 2.0, 2.0, 0.0)
    p, g = boxes(spark, [(*far, 0.9, False)], [(*gt, 1)])
    (r,) = D.measure(p, g, [0.0], levels=(2,), let=D.LET).collect()
    assert r["tp"] == 1 and r["sum_la"] == pytest.approx(1 - 1 / 4.9)
    j = p.select("cx", "cy", "cz").crossJoin(g.select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), F.col("cz").alias("gz")))
    assert j.select(G.let_affinity(*(F.col(c) for c in ("cx", "cy", "cz", "gx", "gy", "gz")))).first()[0] == pytest.approx(1 - 1 / 4.9)


def test_cutoffs(spark):
    s = spark.createDataFrame([(x / 10,) for x in range(10)], "score double")
    at = lambda n: [r["cutoff"] for r in D.estimate_cutoffs(s, n).orderBy("position").collect()]
    assert at(1) == [0.0] and at(3) == [0.0, 0.5, 1.0] and at(11) == pytest.approx([i / 10 for i in range(11)]) and at(4) == [0.0, 0.4, 0.7, 1.0]


def test_breakdowns(spark):
    d = spark.createDataFrame([(t, x, 0.0, 0.0, 8.0, 1.0, 1.0, 0.5, 0.0) for t in (0, 1, 3) for x in (10.0, 40.0, 60.0)], "type int, cx double, cy double, cz double, length double, width double, height double, speed_x double, speed_y double")
    rows = d.select("type", "cx", *(B.shard(g).alias(g) for g in ("OBJECT_TYPE", "RANGE", "SIZE", "VELOCITY", "ALL_BUT_SIGN", "ONE_SHARD", "CAMERA"))).collect()
    by = {(r["type"], r["cx"]): tuple(r)[2:] for r in rows}
    assert by[1, 40.0] == (0, 1, 1, 1, 0, 0, 0) and by[3, 60.0] == (2, 8, 5, 11, 1, 0, 10) and by[0, 10.0][:4] == (-1, -1, -1, -1)
    assert B.shard_name("RANGE", 1, 1) == "RANGE_TYPE_VEHICLE_[30, 50)_LEVEL_1"
    with pytest.raises(NotImplementedError):
        B.shard("WEATHER")


def frames(mot, spec):
    """spec: per frame a dict of (pd, gt) to similarity, with lists of ids."""
    for pds, gts, sim in spec:
        w = np.array([[sim.get((p, g), 0.0) for g in gts] for p in pds]).reshape(len(pds), len(gts))
        one = lambda x: np.ones(len(x), int)
        mot.step(np.array(pds), one(pds), np.zeros((len(pds), 7)), np.zeros(len(pds), bool), np.array(gts), one(gts), np.zeros((len(gts), 7)), one(gts), w)
    return mot.counts()


def test_mot():
    m = TR.Mot({1: 0.5})
    got = frames(m, [(["h"], ["o"], {("h", "o"): s}) for s in (0.8, 0.6, 0.4)])
    assert got[:5] == (1, 1, 2, 0, 3) and got[5] == pytest.approx(0.6)
    m = TR.Mot({1: 0.5})  # a sticky match is kept though another is better, then both switch
    spec = [(["a", "b"], ["x", "y"], {("a", "x"): 0.8, ("b", "y"): 0.8}), (["a", "b"], ["x", "y"], {("a", "x"): 0.6, ("b", "y"): 0.6, ("a", "y"): 0.9, ("b", "x"): 0.9}), (["a", "b"], ["x", "y"], {("a", "y"): 0.9, ("b", "x"): 0.9})]
    assert frames(m, spec)[:5] == (0, 0, 6, 2, 6)
    m = TR.Mot({1: 0.5})  # the prediction goes to a new truth while the old one is gone
    assert frames(m, [(["a"], ["x"], {("a", "x"): 0.8}), (["a"], ["y"], {("a", "y"): 0.8})])[3] == 1


def test_mota(spark):
    c = spark.createDataFrame([(1, 0, 0.0, 1, 1, 8, 0, 10, 2.0), (1, 0, 0.5, 2, 0, 8, 0, 10, 1.0), (1, 1, 0.0, 9, 9, 1, 0, 10, 0.1)], "scene long, shard long, cutoff double, misses long, fps long, matches long, mismatches long, objects long, cost double")
    rows = {r["shard"]: r for r in TR.metrics(c).collect()}
    assert rows[0]["mota"] == pytest.approx(0.8) and rows[0]["cutoff"] == 0.0
    assert rows[1]["mota"] == 0 and rows[1]["cutoff"] is None


def test_segmentation(spark):
    d = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, 2)], "gt int, pred int")
    ious = S.class_iou(S.confusion(d, [1, 2]), [1, 2])
    assert {r["class"]: r["iou"] for r in ious.collect()} == {1: pytest.approx(2 / 3), 2: pytest.approx(0.5)}
    assert S.mean_iou(ious).first()["miou"] == pytest.approx(0.583333, abs=1e-5)
    odd = S.confusion(spark.createDataFrame([(1, 9), (9, 1)], "gt int, pred int"), [1])
    assert S.class_iou(odd, [1]).first()["union"] == 1


def test_motion_precision(spark):
    def ap(text, total):
        rows = [(k, i, float(c[:-1]), c[-1] == "T") for i, c in enumerate(text.split()) for k in [i % total]]
        rows += [(k, 100 + k, None, None) for k in range(total)]
        d = spark.createDataFrame([(k, k, 5, 1, c, t) for k, _, c, t in rows if c is not None], "scenario long, group long, at int, shape int, confidence double, tp boolean")
        return M.average_precision(d).first()["map"]

    assert ap(".3T .7T .4F .8T .5F .2F", 4) == pytest.approx(0.65)
    assert ap(".8T .5F .5T .5T .5F .5F", 6) == pytest.approx(1 / 3)
