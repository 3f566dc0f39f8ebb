"""The queries of catalog_scenes beside their SQL in DuckDB, and small cases worked out by hand."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from roadlens import catalog, catalog_scenes
from roadlens.operators import detection as D
from roadlens.operators import map_features as MF
from roadlens.operators import motion as M

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_scenes.__name__ and n in catalog.ORACLE)


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    left = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    assert left == right and left


def test_signed_distance(spark):
    box = lambda *x: tuple(F.lit(float(v)) for v in x)
    one = lambda a, b: spark.range(1).select(MF.signed_box_distance(box(*a), box(*b))).first()[0]
    assert one((0, 0, 4, 2, 0), (5, 0, 4, 2, 0)) == pytest.approx(1)
    assert one((0, 0, 4, 2, 0), (3.5, 0, 4, 2, 0)) == pytest.approx(-0.5)
    assert one((0, 0, 2, 2, 0), (4, 5, 2, 2, 0)) == pytest.approx(math.hypot(2, 3))
    assert one((0, 0, 2, 2, 0), (3, 0, 2, 2, math.pi / 4)) == pytest.approx(2 - math.sqrt(2))


def test_matcher_is_one_to_one(spark):
    schema = "frame long, id long, type int, cx double, cy double, cz double, length double, width double, height double, heading double, score double"
    p = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0, 0.9), (1, 2, 1, 0.4, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0, 0.5)], schema)
    g = spark.createDataFrame([(1, 7, 2, 0.2, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0, 1.0), (1, 8, 2, 0.8, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0, 1.0)], schema)
    assert sorted((r["pd"], r["gt"]) for r in D.match(p, g).collect()) == [(1, 7), (2, 8)]
    first = D.match(p, g, matcher="score_first", iou=catalog_scenes.near_centres)
    assert sorted((r["pd"], r["gt"]) for r in first.collect()) == [(1, 7), (2, 8)]


def test_type_of_highest_priority(spark):
    metric = spark.createDataFrame([(1, 1, 5, 2.0), (2, 2, 5, 4.0), (3, 3, 5, None)], "scenario int, group int, at int, v double")
    members = spark.createDataFrame([(1, 1, 2), (1, 1, 4), (2, 2, 4), (3, 3, 3)], "scenario int, group int, type int")
    got = {r["type"]: r["v"] for r in M.accumulate(M.bundle(metric, members, ["v"]), ["v"]).collect()}
    assert got == {4: 3.0, 3: None}


def test_nothing_wrong_with_complete_forecasts(spark):
    f = spark.createDataFrame([(1, 1, j, o, s, 0.0, 0.0, 1.0) for j in (0, 1) for o in (1, 2) for s in range(2)], "scenario int, group int, joint int, object int, step int, x double, y double, confidence double")
    t = spark.createDataFrame([(1, o, s) for o in (1, 2) for s in range(9)], "scenario int, object int, step int")
    wanted = t.select("scenario", "object").distinct()
    assert M.problems(f, t, wanted, 2, 2, 1).collect() == []
    assert [r["problem"] for r in M.problems(f.where("joint = 0 or object = 1"), t, wanted, 2, 2, 1).collect()] == ["joints of different objects"]


def test_examples_can_be_written_and_read(spark, tmp_path):
    from roadlens.sources import submission

    submission.prediction_example(spark).write.parquet(str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first()["score"] == 0.5
    s = submission.segmentation_example(spark, 2, 3, 4, 5)
    assert s.count() == 6 and {(len(r["first_return"]), r["second_return"][0]) for r in s.collect()} == {(20, 7)}


def test_keypoint_objects_by_overlap(spark):
    from roadlens.operators import keypoints as KP

    schema = "frame long, id long, cx double, cy double, cz double, length double, width double, height double, heading double"
    g = spark.createDataFrame([(1, 5, 0.0, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0), (1, 6, 9.0, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0)], schema)
    p = spark.createDataFrame([(1, 1, 0.5, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0), (1, 2, 50.0, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0)], schema)
    assert [tuple(r) for r in KP.match_by_overlap(g, p).collect()] == [(1, 5, 1)]
