"""Distances between shapes and joins of objects with map and camera features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.functions import geometry as G
from roadlens.functions import kernels as K


def signed_box_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of two rotated rectangles (cx, cy, length, width, heading); negative if they overlap.

    As an expression it is too long to be compiled, so a kernel reads both rectangles.
    """
    names = ["cx", "cy", "length", "width", "heading"]

    @F.pandas_udf(T.DoubleType())
    def distance(p: pd.DataFrame, q: pd.DataFrame) -> pd.Series:
        return pd.Series(K.box_distance(p.to_numpy(float), q.to_numpy(float)))

    return distance(*(F.struct(*(c.cast("double").alias(n) for c, n in zip(x, names, strict=True))) for x in (a, b)))


def nearest_segment(points: DataFrame, segments: DataFrame, by: list[str], reach: float) -> DataFrame:
    """(by.., point, segment, distance): each point's nearest segment (ties: least id) within ``reach``, else null.

    points: by.., point, x, y; segments: by.., segment, x0, y0, x1, y1.  A point meets only segments whose
    bounding box, widened by ``reach``, touches its cell of a grid.
    """
    g = lambda v: F.floor(v / (2 * reach)).cast("long")
    s = segments
    for k in "xy":
        s = s.withColumn(f"_g{k}", F.explode(F.sequence(g(F.least(f"{k}0", f"{k}1") - reach), g(F.greatest(f"{k}0", f"{k}1") + reach))))
    p = points.withColumns({"_gx": g(F.col("x")), "_gy": g(F.col("y"))})
    d = G.segment_distance(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    near = p.join(s, [*by, "_gx", "_gy"]).withColumn("distance", d).where(F.col("distance") <= reach)
    best = near.groupBy(*by, "point").agg(F.min(F.struct("distance", "segment")).alias("m")).select(*by, "point", "m.segment", "m.distance")
    return points.select(*by, "point").join(best, [*by, "point"], "left")


def lane_signals(objects: DataFrame, signals: DataFrame) -> DataFrame:
    """objects (scenario, step, lane, ..) with the state of their lane's signal at that step; 0 where it has none."""
    s = signals.groupBy("scenario", "step", "lane").agg(F.max("state").alias("state"))
    return objects.join(s, ["scenario", "step", "lane"], "left").withColumn("state", F.coalesce("state", F.lit(0)))


def associate(laser: DataFrame, camera: DataFrame, values: list[str]) -> DataFrame:
    """Laser labels (frame, id, ..) with ``cameras``: by camera name the values of the label associated with them.

    camera: frame, order, camera, laser_id and the values.  A later label of a camera and object replaces
    an earlier one; labels without an association are left out; an object without any has no cameras.
    """
    last = camera.where("laser_id is not null").groupBy("frame", F.col("laser_id").alias("id"), "camera").agg(F.max_by(F.struct(*values), "order").alias("label"))
    by = last.groupBy("frame", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("camera", "label")))).alias("cameras"))
    return laser.join(by, ["frame", "id"], "left")
