import pytest
from pyspark.sql import functions as F

from roadlens import schemas
from roadlens.naming import col, keys
from roadlens.operators import relational as R


def table(spark, rows, names):
    return spark.createDataFrame(rows, names)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


AB = ["key.a", "key.b", "left"]


def test_single_and_two_keys(spark):
    a, b = table(spark, [(1, 3), (2, 4)], ["key.a", "left"]), table(spark, [(1, 5), (2, 6)], ["key.a", "right"])
    out = R.merge(a, b)
    assert out.columns == ["key.a", "left", "right"] and got(out) == [(1, 3, 5), (2, 4, 6)]
    a, b = table(spark, [(1, 2, 3), (2, 2, 4), (1, 1, 5)], AB), table(spark, [(1, 1, 6), (2, 2, 7)], ["key.a", "key.b", "right"])
    assert got(R.merge(a, b)) == [(1, 1, 5, 6), (2, 2, 4, 7)]


@pytest.mark.parametrize(("flags", "want"), [
    ({}, [(1, 3, 5)]),
    ({"left_nullable": True}, [(1, 3, 5), (3, None, 6)]),
    ({"right_nullable": True}, [(1, 3, 5), (2, 4, None)]),
    ({"left_nullable": True, "right_nullable": True}, [(1, 3, 5), (2, 4, None), (3, None, 6)]),
])
def test_nullable_sides(spark, flags, want):
    a, b = table(spark, [(1, 3), (2, 4)], ["key.a", "left"]), table(spark, [(1, 5), (3, 6)], ["key.a", "right"])
    assert got(R.merge(a, b, **flags)) == want


def test_groups(spark):
    a, b = table(spark, [(1, 1, 3), (2, 2, 4), (1, 3, 5)], AB), table(spark, [(1, 6), (2, 7)], ["key.a", "right"])
    assert got(R.merge(a, b, left_group=True)) == [(1, [1, 3], [3, 5], 6), (2, [2], [4], 7)]
    out = R.merge(b, a, right_group=True)
    assert got(out) == [(1, 6, [1, 3], [3, 5]), (2, 7, [2], [4])]
    small = a.withColumn("key.a", col("key.a").cast("byte"))
    assert R.merge(small, b.withColumn("key.a", col("key.a").cast("byte")), left_group=True).schema["key.a"].dataType.simpleString() == "tinyint"


def test_product_and_no_common_key(spark):
    a = table(spark, [(1, 3, 6), (2, 4, 7), (2, 5, 8)], AB)
    b = table(spark, [(1, -3, -6), (1, -4, -7), (2, -5, -8)], ["key.a", "key.c", "right"])
    assert len(got(R.merge(a, b))) == 4
    with pytest.raises(ValueError, match="no common key"):
        R.merge(a, table(spark, [(1,)], ["key.z"]))


def test_lists_keep_nulls_and_order(spark):
    d = spark.createDataFrame([("x", 2, None), ("x", 1, "a"), (None, 3, "b")], "k string, o int, v string")
    assert got(R.group_to_lists(d, ["k"])) == [("x", [1, 2], ["a", None])]


def test_nest_and_flatten(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0), (2, None, None)], "id int, a double, b double").select("id", F.col("a").alias("box.x"), F.col("b").alias("box.c.y"))
    n = R.nest(d)
    assert [f.name for f in n.schema] == ["id", "box"] and n.where("id = 2").first()["box"] is None
    assert R.flatten(n).columns == d.columns and got(R.flatten(n)) == got(d)


def test_fail_fast_and_gather(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no scenario: 2"):
        R.require_all(a, b, ["k"], "no scenario").collect()
    t = spark.createDataFrame([(5, "e"), (7, "g"), (7, "h")], "k int, v string")
    assert [tuple(r) for r in R.gather(t, [5], "k").collect()] == [(0, 5, "e")]
    for bad in ([6], [7]):
        with pytest.raises(Exception, match="missing or not unique"):
            R.gather(t, bad, "k").collect()


def test_schemas():
    assert len(schemas.COMPONENTS) == 23 and "lidar_flow" in schemas.UNTAGGED
    for s in [*schemas.COMPONENTS.values(), *schemas.UNTAGGED.values()]:
        assert s.fieldNames()[0] == "key.segment_context_name" and len(set(s.fieldNames())) == len(s)
    assert keys(type("D", (), {"columns": ["key.a", "x"]})()) == ["key.a"]


def test_component_round_trip(spark, tmp_path):
    from roadlens.sources import components

    s = schemas.COMPONENTS["lidar_calibration"]
    d = spark.createDataFrame([("seg1", 1, [1.0] * 16, -0.3, 0.1, None), ("seg2", 2, [2.0] * 16, None, None, [0.1])], s)
    components.write(d, str(tmp_path), "lidar_calibration")
    back = components.read(spark, str(tmp_path), "lidar_calibration")
    assert got(back) == got(d)
    with pytest.raises(ValueError, match="lacks"):
        components.write(d.select(col("key.laser_name").alias("key.laser_name")), str(tmp_path), "lidar_calibration")


def test_records_and_arrays(spark, tmp_path):
    import struct

    import numpy as np

    from roadlens.sources import components as c

    def rec(b):
        return struct.pack("<Q", len(b)) + b"\0\0\0\0" + b + struct.pack("<I", c.masked_crc32c(b))

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a").write_bytes(rec(b"one") + rec(b"") + rec(b"three"))
    assert [bytes(r["record"]) for r in c.records(spark, str(tmp_path / "r")).orderBy("position").collect()] == [b"one", b"", b"three"]
    assert c.masked_crc32c(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    (tmp_path / "r" / "a").write_bytes(rec(b"one")[:-6])
    with pytest.raises(Exception, match="cut off"):
        c.records(spark, str(tmp_path / "r")).collect()
    (tmp_path / "n" / "ctx" / "17").mkdir(parents=True)
    np.save(tmp_path / "n" / "ctx" / "17" / "boxes.npy", np.arange(6.0).reshape(2, 3))
    (row,) = c.arrays(spark, str(tmp_path / "n")).collect()
    assert tuple(row) == ("ctx", 17, "boxes", [2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
