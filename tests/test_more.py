import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens import catalog
from roadlens.functions import codecs
from roadlens.functions import geometry as G
from roadlens.operators import keypoints as KP
from roadlens.operators import lidar as L
from roadlens.operators import motion as M
from roadlens.operators import occupancy as O
from roadlens.operators import rater as R
from roadlens.operators import segmentation as S
from roadlens.sources import derived, scenarios, submission
from roadlens.streaming import metrics as SM


def test_delta_codec():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 500):
        x = np.where(rng.random(n) < 0.5, 0, rng.normal(size=n))
        before = x.copy()
        y = codecs.delta_decode(codecs.delta_encode(x, 0.01))
        assert len(y) == n and (x == before).all() and (n == 0 or np.abs(x - y).max() <= 0.005 + 1e-9)


def test_pca_and_tiles():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3, 12))
    x = rng.normal(size=(200, 3)) @ base
    p = codecs.Pca(x, 3, 1e-4)
    assert np.abs(p.decode(p.encode(x)) - x).max() < 0.01
    im = rng.normal(size=(10, 7, 2))
    assert (codecs.untile(codecs.tiles(im, 4), 10, 7, 2, 4) == im).all()


def test_geometry(spark):
    d = spark.range(1)
    lit = lambda *x: [F.lit(float(v)) for v in x]
    one = lambda c: d.select(c).first()[0]
    assert one(G.wrap(F.lit(3 * math.pi))) == pytest.approx(-math.pi)
    assert one(G.heading_accuracy(*lit(0, math.pi))) == pytest.approx(0) and one(G.heading_accuracy(*lit(0.1, 2 * math.pi + 0.1))) == pytest.approx(1)
    corners = G.box_corners(*lit(0, 0, 4, 2, math.pi / 2))
    assert one(G.polygon_area(corners)) == pytest.approx(8)
    assert one(G.point_in_convex(*lit(0.9, 1.9), corners)) and not one(G.point_in_convex(*lit(1.1, 0), corners))
    assert one(G.segment_distance(*lit(0, 1, -1, 0, 1, 0))) == pytest.approx(1) and one(G.segment_distance(*lit(3, 4, 0, 0, 0, 0))) == pytest.approx(5)
    assert one(G.point_in_box(*lit(1, 0, 0, 0, 0, 0, 2, 1, 1, 0))) and not one(G.point_in_box(*lit(0, 0, 0, 0, 0, 0, 0, 1, 1, 0)))
    m = F.array(*lit(0, -1, 0, 5, 1, 0, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1))
    assert [one(c) for c in G.matmul4(m, *lit(1, 2, 3))] == [3, 7, 10]
    r = np.array(one(G.rotation(*lit(0.1, 0.2, 0.3)))).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
    ray = lambda *x: one(codecs.rays_to_box(lit(*x[:3]), lit(*x[3:6]), lit(0, 0, 0), lit(2, 2, 2), F.lit(0.0)))
    assert ray(-5, 0, 0, 1, 0, 0) == pytest.approx(4) and ray(-5, 3, 0, 1, 0, 0) is None and ray(0, 0, 0, 0, 1, 0) == 0


def test_range_image_round_trip(spark):
    px = spark.createDataFrame([(r, c, 5.0 + r + c) for r in range(4) for c in range(8)], "row int, col int, range double")
    pts = L.point_cloud(px, 4, 8, -0.4, 0.2)
    inc = [-0.4 + (4 - 1 - r + 0.5) / 4 * 0.6 for r in range(4)]
    back = L.to_range_image(pts.withColumn("f", F.lit(1)), ["f"], inc, 8)
    got = {(r["row"], r["col"]): round(r["range"], 6) for r in back.collect()}
    assert got == {(r, c): 5.0 + r + c for r in range(4) for c in range(8)}


def test_occupancy(spark):
    agent = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 2.0, 0.0)], "t int, cx double, cy double, length double, width double, heading double")
    pts = O.sample_agents(agent)
    assert pts.count() == 48 * 16
    cells = O.rasterise(pts, ["t"])
    rows = {(r["row"], r["col"]) for r in cells.collect()}
    assert {r for r, _ in rows} == set(range(189, 196)) and (192, 128) in rows
    moved = O.flow(pts.withColumns({"x_before": F.col("x") - 1.25, "y_before": F.col("y")}), ["t"])
    assert {(r["dx"], r["dy"]) for r in moved.collect()} == {(4.0, 0.0)}
    occ = spark.createDataFrame([(1, 5, 5, 1.0)], "t int, row int, col int, occupied double")
    fl = spark.createDataFrame([(1, 5, 6, 1.0, 0.0), (1, 5, 7, 1.5, 0.0)], "t int, row int, col int, dx double, dy double")
    assert {(r["row"], r["col"]): r["occupied"] for r in O.warp(occ, fl, ["t"]).collect()} == {(5, 6): 1.0, (5, 7): 0.5}
    same = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, 0.0)], "w int, t double, p double")
    assert O.soft_iou(same, ["w"]).first()["soft_iou"] == 1 and O.auc(same, ["w"]).first()["auc"] == pytest.approx(1)


def test_keypoints(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 0.0, 2, 2, 1.0), (1, 2, 0.0, 0.0, 3.0, 4.0, 1, 2, 1.0), (1, 3, 0.0, 0.0, 9.0, 9.0, 0, 0, 1.0)], "id int, kind int, gx double, gy double, px double, py double, gv int, pv int, scale double")
    assert KP.mpjpe(d).first()[0] == 2.5 and KP.oks(d, {}).first()["oks"] == pytest.approx(0.5)
    # a truth without a prediction, a prediction without a truth: neither has an error; the latter is a false positive
    more = d.union(spark.createDataFrame([(1, 4, 7.0, 7.0, 0.0, 0.0, 2, 0, 1.0), (1, 5, 0.0, 0.0, 8.0, 8.0, 0, 2, 1.0)], d.schema))
    assert KP.mpjpe(more).first()[0] == 2.5 and KP.oks(more, {}).first()["oks"] == pytest.approx(0.5)
    assert KP.visibility(more).first() == (pytest.approx(1 / 3), 0.5)
    assert KP.pck(more, [0.1, 5.0]).orderBy("threshold").collect()[0]["pck"] == 0.5
    # no truth point: by the distance outside a box three times as large (here from -3 to 3)
    bare = spark.createDataFrame([(2, 1, 0.0, 0.0, 2.0, 0.0, 0, 2, 1.0, 0.0, 0.0, 2.0, 2.0), (2, 2, 0.0, 0.0, 4.0, 0.0, 0, 2, 1.0, 0.0, 0.0, 2.0, 2.0), (3, 1, 0.0, 0.0, 0.0, 0.0, 2, 2, 1.0, 0.0, 0.0, 0.0, 0.0)], "id int, kind int, gx double, gy double, px double, py double, gv int, pv int, scale double, bx double, by double, sx double, sy double")
    got = {r["id"]: r for r in KP.oks(bare, {}, 0.5).collect()}
    assert got[2]["oks"] == pytest.approx((1 + math.exp(-0.5)) / 2) and got[2]["valid"] and not got[3]["valid"]
    assert [r["precision"] for r in KP.average_precision(KP.oks(bare, {}, 0.5), [0.5, 0.9]).orderBy("level").collect()] == [1.0, 0.0]
    assert KP.mean_average_precision(KP.oks(bare, {}, 0.5), [0.5, 0.9]).first()["ap"] == 0.5
    assert KP.pck(d, [0.1, 10.0]).orderBy("threshold").collect()[1]["pck"] == 1.0
    assert {r["subset"] for r in KP.subsets(d, {"a": [1], "b": [1, 2]}).collect()} == {"a", "b"}


def test_keypoint_matching(spark):
    box = "frame long, id long, cx double, cy double, cz double, length double, width double, height double, heading double, points array<struct<kind:int,x:double,y:double,z:double,v:int>>"
    g = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, []), (1, 2, 9.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, [(1, 9.0, 0.0, 0.0, 2), (2, 9.0, 0.0, 1.0, 2)]), (2, 3, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, [])], box)
    p = spark.createDataFrame([(1, 7, [(1, 0.1, 0.0, 0.0, 2)]), (1, 8, [(1, 9.1, 0.0, 0.0, 2), (2, 9.0, 0.1, 1.0, 2)]), (1, 9, [(1, 9.2, 0.0, 0.0, 2)])], "frame long, id long, points array<struct<kind:int,x:double,y:double,z:double,v:int>>")
    assert sorted(tuple(r) for r in KP.match_by_error(g, p).collect()) == [(1, 1, 7), (1, 2, 8)]


def test_motion_overlap(spark):
    t = spark.createDataFrame([(1, o, s, float(x), 0.0, 0.0, True, 4.0, 2.0) for o, x0, v in ((1, 0, 1), (2, 10, 0), (3, 500, 0)) for s in range(8) for x in [x0 + v * s]], "scenario long, object long, step long, x double, y double, heading double, valid boolean, length double, width double")
    f = spark.createDataFrame([(1, o, j, o, s, float(x), 0.0, c) for o, j, c, x0, v in ((1, 0, 0.9, 1, 2.0), (1, 1, 0.1, 1, 0.0), (3, 0, 0.5, 500, 1.0)) for s in range(6) for x in [x0 + v * (s + 1)]], "scenario long, group long, joint long, object long, step long, x double, y double, confidence double")
    got = {(r["group"], r["at"]): r["overlap"] for r in M.overlap_rate(f, t, [1, 5], history=1, ratio=1).collect()}
    assert got == {(1, 1): 0, (1, 5): 1, (3, 1): 0, (3, 5): 0}


def test_rater(spark):
    line = [(float(i), 0.0) for i in range(20)]
    shift = lambda dx, dy: [(x + dx, y + dy) for x, y in line]
    schema = "k int, plans array<struct<points:array<struct<x:double,y:double>>,p:double>>, raters array<struct<points:array<struct<x:double,y:double>>,label:double>>, speed double"
    rows = [(0, [(line, 1.0)], [(line, 8.0)], 20.0), (1, [(shift(0, 2.0), 1.0)], [(line, 10.0)], 20.0), (2, [(shift(0, 500.0), 1.0)], [(line, 10.0)], 20.0), (3, [(line, 0.5), (shift(0, 500.0), 0.5)], [(line, 8.0)], 20.0)]
    got = {r["k"]: r["score"] for r in R.score(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == pytest.approx(8) and got[2] == pytest.approx(4) and got[3] == pytest.approx(6)
    # 2 m aside: d is 2 / 1.0 at 3 s and 2 / 1.8 at 5 s; the floor is for the mean: (1.0 + 7.7426) / 2 = 4.3713
    assert got[1] == pytest.approx(4.3713, abs=1e-4)
    # each rater's region holds the plan at one of the times only: outside of both
    bend = [(float(i), 0.0 if i < 15 else 30.0) for i in range(20)]
    apart = [(3, [(line, 1.0)], [([(x, 9.0) if i < 15 else (x, y) for i, (x, y) in enumerate(line)], 2.0), (bend, 2.0)], 20.0)]
    assert R.score(spark.createDataFrame(apart, schema)).first()["score"] == pytest.approx(4)


def test_scenarios(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 2.0)], "f int, position int, x double, y double")
    got = [(r["x"], r["y"]) for r in scenarios.resample(p, ["f"], 1.0).orderBy("k").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2)]
    t = spark.createDataFrame([(1, 0, 5.0, True), (1, 1, 6.0, False), (1, 3, 7.0, True)], "o int, step int, x double, valid boolean")
    r = scenarios.steps(t, ["o"], ["x"], past=1, future=2).first()
    assert (r["past_x"], r["current_x"], r["future_x"]) == ([5.0], [-1.0], [-1.0, 7.0])
    k = spark.createDataFrame([(1, 0, 9), (1, 1, 2), (1, 2, 9)], "f int, position int, kind int")
    assert [x["position"] for x in scenarios.cap_by_priority(k, ["f"], {2: 0, 9: 1}, 2).orderBy("position").collect()] == [0, 1]
    book = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "token int, vector array<double>")
    with pytest.raises(Exception, match="out of range"):
        scenarios.token_vectors(spark.createDataFrame([(2,)], "token int"), book, 2).collect()


def test_submission(spark, tmp_path):
    box = "frame long, id long, cx double, cy double, cz double, length double, width double, height double, heading double, score double"
    d = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.5), (1, 2, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.5), (2, 3, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.5), (2, 4, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.01)], box)
    assert sorted((r["id"], r["length"]) for r in submission.clean(d).collect()) == [(1, 1.0), (3, 1e-6)]
    with pytest.raises(ValueError, match="method"):
        submission.write(d, str(tmp_path / "s"), "", "me")
    submission.write(d, str(tmp_path / "s"), "m", "me")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    ok = d.where("id in (1, 4)")
    assert submission.consistent(ok, ok).first()["consistent"]
    r = submission.consistent(ok, ok.where("frame = 1")).first()
    assert r["unmatched"] == 1 and not r["consistent"]
    a = spark.createDataFrame([(1, 1.0, [1.0, 2.0], "x"), (2, 1.0, [1.0], "x")], "k int, v double, l array<double>, s string")
    b = spark.createDataFrame([(1, 1.0005, [1.0, 2.0], "x"), (2, 1.0, [1.0, 2.0], "x")], "k int, v double, l array<double>, s string")
    assert [r["k"] for r in submission.equal_examples(a, b, ["k"]).collect()] == [2]
    l = spark.createDataFrame([(7, [2, 4], [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.001, 9.0], [0.9, 0.9], [1, 1])], "frame long, shape array<int>, boxes array<double>, scores array<double>, classes array<int>")
    assert [(r["cx"], r["length"], r["height"]) for r in submission.from_latency(l).collect()] == [(1.0, 3.0, 1.0)]
    j = spark.createDataFrame([(1, 0, 5, [0.0] * 2)], "scenario int, rollout int, object int, x array<double>")
    e = spark.createDataFrame([(1, 5), (1, 6)], "scenario int, object int")
    assert {r["problem"] for r in submission.validate_rollouts(j, e, 2, 1).collect()} == {"missing object 6"}


def test_panoptic(spark):
    d = spark.createDataFrame([(1, 4, 70), (1, 4, 9), (1, 5, 0)], "frame int, semantic long, instance long")
    out, _ = S.relabel(d)
    assert sorted((r["semantic"], r["instance"], r["local"], r["label"]) for r in out.collect()) == [(4, 9, 1, 4001), (4, 70, 2, 4002), (5, 0, 0, 5000)]
    with pytest.raises(Exception, match="does not fit"):
        S.relabel(d.withColumn("semantic", F.lit(70).cast("long")))[0].collect()
    f = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, "b"), (5, "a")], "frame int, sequence_id string")
    assert [r["frame"] for r in S.first_sequence(f, 2).collect()] == [2, 3]


def _drain(q):
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streaming_sums_and_windows(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _drain(SM.windowed_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("win").start())
    want = {(r["event_type"], r["window"]["start"]): r["n"] for r in SM.windowed_counts(ev).collect()}
    assert {(r["event_type"], r["window"]["start"]): r["n"] for r in spark.sql("select * from win").collect()} == want
    pts = spark.createDataFrame([(1, 1), (1, 2), (1, 1)], "gt int, pred int")
    pts.write.parquet(str(tmp_path / "pts"))
    _drain(SM.running_confusion(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "pts"))).writeStream.outputMode("complete").format("memory").queryName("conf").start())
    assert {(r["gt"], r["pred"], r["n"]) for r in spark.sql("select * from conf").collect()} == {(1, 1, 2), (1, 2, 1)}


def test_streaming_tracking(spark, tmp_path):
    schema = "scene long, frame long, side string, id long, type long, cx double, cy double, cz double, length double, width double, height double, heading double, score double, nlz boolean, level int"
    row = lambda f, s, i, w: (1, f, s, i, 1, 0.0, 0.0, 0.0, 1.0, w, 1.0, 0.0, 1.0, False, 1)
    for k, rows in enumerate(([row(0, "p", 1, 0.8), row(0, "g", 9, 1.0)], [row(1, "p", 1, 0.9), row(1, "g", 9, 1.0)], [row(2, "p", 2, 0.1), row(2, "g", 9, 1.0)], [row(3, "p", 1, 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01 * k)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _drain(SM.running_mot(s, {1: 0.5}).writeStream.outputMode("append").format("memory").queryName("mot").start())
    got = {r["frame"]: (r["misses"], r["fps"], r["matches"]) for r in spark.sql("select * from mot").collect()}
    assert got == {0: (0, 0, 1), 1: (0, 0, 2), 2: (1, 1, 2)}


def test_every_query_has_rows_and_names_match(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("merge_right_group", "iou_pairs", "precision_recall_curve", "motion_map", "occupancy_auc", "breakdown_shards", "estimated_cutoffs"):
        df = catalog.QUERIES[name](spark, sf)
        want = con.sql(catalog.ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert df.count() == len(want.fetchall()) > 0
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert derived.read(spark, sf, "gt_boxes").count() == 6000
