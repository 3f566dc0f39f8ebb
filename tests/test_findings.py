"""One small case for each finding of round 3."""

from __future__ import annotations

import numpy as np

from __spark_entry__ import queries
from roadlens.functions import kernels as K
from roadlens.operators import map_features as MF
from roadlens.operators import tracking as TR
from roadlens.sources import derived

SF = "/root/testdata/sf0.001"


def test_nearest_segment_ties_where_hypot_differs(spark):
    # both segments are at sqrt(6.4); hypot puts the first one a last bit further away
    box = lambda i, cx, cy, length, width: (1, i, cx + 2, cy - 1, cx + 2 + length, cy + width)
    segments = spark.createDataFrame([box(1, 19.0, 18.0, 1.8, 1.6), box(2, 20.0, 19.0, 1.0, 2.0)], "frame long, segment long, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 1, 20.0, 20.0)], "frame long, point long, x double, y double")
    assert MF.nearest_segment(points, segments, ["frame"], 5.0).select("segment").first()[0] == 1


def test_mismatches_over_arrays_are_those_of_mot():
    rng = np.random.default_rng(5)
    for _ in range(60):
        frames, mot, rows, present = 8, TR.Mot(), [], []
        for t in range(frames):
            gts, pds = np.flatnonzero(rng.random(5) < 0.7), np.flatnonzero(rng.random(5) < 0.8)
            n = int(rng.integers(0, min(len(gts), len(pds)) + 1))
            a, b = rng.permutation(len(pds))[:n], rng.permutation(len(gts))[:n]
            w = np.zeros((len(pds), len(gts)))
            w[a, b] = 0.9
            mot.step(pds.tolist(), np.ones(len(pds), int), None, np.zeros(len(pds), bool), gts.tolist(), np.ones(len(gts), int), None, np.ones(len(gts), int), w)
            rows += [(0, t, p, g) for p, g in zip(pds[a], gts[b], strict=True)]
            present += [t * 5 + g for g in gts]
        x = np.array(rows, int).reshape(-1, 4)
        assert len(TR._mismatches(*x.T, np.array(present, int), 5)) == mot.mismatches


def test_equal_assignments_go_to_the_later_pair():
    w = np.array([[700000.0, 700000.0], [0.0, 0.0]])
    assert K.assign(K.later(w)).tolist() == [1, -1]
    assert K.assign(K.later(np.array([[600000.0], [600000.0]]))).tolist() == [-1, 0]
    assert K.assign(K.later(np.array([[600001.0, 0], [600000.0, 0]]))).tolist() == [0, -1]


def test_box_distance_is_a_kernel(spark):
    a, b = np.array([[0.0, 0, 4, 2, 0]] * 3), np.array([[5.0, 0, 4, 2, 0], [3.0, 0, 4, 2, 0], [6.0, 4, 4, 2, 0.0]])
    assert np.allclose(K.box_distance(a, b), [1, -1, np.sqrt(8)])
    plan = queries()["box_distance"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "zip_with" not in plan


def test_a_large_table_is_dealt_by_its_size(spark, monkeypatch):
    assert "REPARTITION" not in derived.source(spark, f"{SF}/lineitem.parquet", "l_orderkey")
    monkeypatch.setattr(derived, "PART_BYTES", 10_000)
    small = {n: sorted(queries()[n](spark, SF).collect()) for n in ("missing_ids", "nearest_speed", "largest_overlap")}
    assert "REPARTITION" in derived.source(spark, f"{SF}/lineitem.parquet", "l_orderkey")
    plan = queries()["missing_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one a side
    monkeypatch.setattr(derived, "PART_BYTES", 1 << 40)
    assert small == {n: sorted(queries()[n](spark, SF).collect()) for n in small}


def test_samples_turn_boxes_once(spark):
    plan = queries()["agent_samples"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and not [x for x in plan.split("Generate")[0].splitlines() if "COS(" in x]
