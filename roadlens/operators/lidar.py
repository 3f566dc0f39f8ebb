"""Range images and point clouds: pixels are rows made by posexplode, kernels are expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 0.00585532144  # metres of one step of the packed range


def pixels(df: DataFrame, values: str, shape: str, channels: list[str], keep: list[str]) -> DataFrame:
    """One row per pixel with row, col and its channels; value (r, c, k) is at (r * width + c) * channels + k."""
    n = len(channels)
    at = F.sequence(F.lit(0), F.element_at(shape, 1) * F.element_at(shape, 2) - 1)
    each = df.withColumn("_i", F.explode(at))
    val = lambda k: F.element_at(values, (F.col("_i") * n + k + 1).cast("int"))
    return each.select(*keep, F.floor(F.col("_i") / F.element_at(shape, 2)).cast("int").alias("row"), (F.col("_i") % F.element_at(shape, 2)).cast("int").alias("col"), *(val(k).alias(c) for k, c in enumerate(channels)))


def uniform_inclination(low: Column, high: Column, row: Column, height: int) -> Column:
    """Inclination of a row (0 on top) with beams evenly between low and high."""
    return low + (height - 1 - row + F.lit(0.5)) / height * (high - low)


def azimuth(col: Column, width: int, extrinsic_yaw: Column | float = 0.0) -> Column:
    """Azimuth of a column's centre; columns run from pi down to -pi."""
    yaw = extrinsic_yaw if isinstance(extrinsic_yaw, Column) else F.lit(float(extrinsic_yaw))
    return ((width - col - F.lit(0.5)) / width * 2 - 1) * math.pi - yaw


def cartesian(distance: Column, inclination: Column, azimuth_: Column) -> tuple[Column, Column, Column]:
    flat = distance * F.cos(inclination)
    return flat * F.cos(azimuth_), flat * F.sin(azimuth_), distance * F.sin(inclination)


def point_cloud(px: DataFrame, height: int, width: int, low: float, high: float) -> DataFrame:
    """Points of pixels with a range above 0."""
    inc = uniform_inclination(F.lit(low), F.lit(high), F.col("row"), height)
    x, y, z = cartesian(F.col("range"), inc, azimuth(F.col("col"), width))
    return px.where("range > 0").withColumns({"x": x, "y": y, "z": z})


def point_cloud_by_beams(px: DataFrame, inclinations: list[float], width: int, yaw: float = 0.0) -> DataFrame:
    """Points of pixels with a range above 0, each row having its own beam; beams are given from the lowest up."""
    beams = F.array(*(F.lit(float(b)) for b in reversed(inclinations)))
    x, y, z = cartesian(F.col("range"), F.element_at(beams, F.col("row") + 1), azimuth(F.col("col"), width, yaw))
    return px.where("range > 0").withColumns({"x": x, "y": y, "z": z})


def with_projections(points: DataFrame, projections: DataFrame, by: list[str]) -> DataFrame:
    """Points with their pixel's camera projections (camera1, u1, v1, camera2, u2, v2); camera 0 where a pixel has none."""
    names = [f"{c}{i}" for i in (1, 2) for c in ("camera", "u", "v")]
    out = points.join(projections.select(*by, "row", "col", *names), [*by, "row", "col"], "left")
    return out.withColumns({f"camera{i}": F.coalesce(f"camera{i}", F.lit(0)) for i in (1, 2)})


def to_range_image(points: DataFrame, by: list[str], inclinations: list[float], width: int) -> DataFrame:
    """(by.., row, col, range): points to pixels of the nearest beam and rounded column, nearest point wins."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    inc = F.atan2(F.col("z"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))
    beams = F.array(*(F.struct(F.abs(inc - F.lit(float(b))).alias("d"), F.lit(i).alias("i")) for i, b in enumerate(inclinations)))
    col = width - 0.5 - (F.atan2("y", "x") + math.pi) / (2 * math.pi) * width
    px = points.withColumns({"row": F.array_min(beams)["i"], "col": F.pmod(F.floor(col + 0.5), F.lit(width)).cast("int"), "range": r})
    return px.groupBy(*by, "row", "col").agg(F.min("range").alias("range"))


def depth_image(points: DataFrame, by: list[str]) -> DataFrame:
    """(by.., camera, v, u, depth): least distance per pixel.

    A point has up to two projections (camera1, u1, v1, camera2, u2, v2; camera 0 is none).  In a pixel
    a first projection beats a second one whatever the distance.
    """
    each = F.array(*(F.struct(F.col(f"camera{i}").alias("camera"), F.col(f"u{i}").alias("u"), F.col(f"v{i}").alias("v"), F.lit(i).alias("order")) for i in (1, 2)))
    p = points.withColumn("_p", F.explode(each)).select(*by, "_p.*", "distance").where("camera > 0")
    return p.groupBy(*by, "camera", "v", "u").agg(F.min_by("distance", F.struct("order", "distance")).alias("depth"))


def pack_range(distance: Column) -> Column:
    """Range in whole steps, as in packed images."""
    return F.floor(distance / UNIT + 0.5).cast("long")


def unpack_range(steps: Column) -> Column:
    return steps * UNIT


def pack_feature(range_steps: Column, intensity_bits: Column, elongation: Column) -> Column:
    """Range (16 bits), upper half of a float's bits (16) and elongation (8) in one long."""
    return F.shiftleft(range_steps.bitwiseAND(0xFFFF), 24).bitwiseOR(F.shiftleft(intensity_bits.bitwiseAND(0xFFFF), 8)).bitwiseOR(elongation.bitwiseAND(0xFF))


def unpack_feature(packed: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(packed, 24).bitwiseAND(0xFFFF), F.shiftright(packed, 8).bitwiseAND(0xFFFF), packed.bitwiseAND(0xFF)


def crop(px: DataFrame, height: int, width: int, top: int = 0, left: int = 0) -> DataFrame:
    inside = (F.col("row") >= top) & (F.col("row") < top + height) & (F.col("col") >= left) & (F.col("col") < left + width)
    return px.where(inside).withColumns({"row": F.col("row") - top, "col": F.col("col") - left})


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 10.0) -> DataFrame:
    """(frame, box, points): number of points in each box, by an equi-join on the grid cells a box may touch.

    Only points of a box's cells meet it, so no frame's points are paired with all its boxes.
    """
    from roadlens.functions import geometry as G

    half = F.sqrt(F.col("length") ** 2 + F.col("width") ** 2) / 2
    g = lambda v: F.floor(v / cell).cast("long")
    b = boxes.where("length > 0 and width > 0 and height > 0")
    b = b.withColumn("gx", F.explode(F.sequence(g(F.col("cx") - half), g(F.col("cx") + half)))).withColumn("gy", F.explode(F.sequence(g(F.col("cy") - half), g(F.col("cy") + half))))
    p = points.withColumns({"gx": g(F.col("x")), "gy": g(F.col("y"))})
    j = p.join(b, ["frame", "gx", "gy"])
    inside = G.point_in_box(*(F.col(c) for c in ("x", "y", "z", "cx", "cy", "cz", "length", "width", "height", "heading")))
    n = j.where(inside).groupBy("frame", F.col("id").alias("box")).agg(F.count(F.lit(1)).alias("points"))
    return boxes.select("frame", F.col("id").alias("box")).join(n, ["frame", "box"], "left").select("frame", "box", F.coalesce("points", F.lit(0)).cast("long").alias("points"))


def overlapping_boxes(a: DataFrame, b: DataFrame, cell: float = 20.0) -> DataFrame:
    """(frame, a, b) of axis-aligned boxes (cx, cy, length, width) that overlap: a grid in place of a tree.

    A pair that shares several cells is kept in the first one only.
    """
    g = lambda v: F.floor(v / cell).cast("long")

    def cells(df, p):
        lo = {"x": F.col("cx") - F.col("length") / 2, "y": F.col("cy") - F.col("width") / 2}
        hi = {"x": F.col("cx") + F.col("length") / 2, "y": F.col("cy") + F.col("width") / 2}
        d = df.select("frame", F.col("id").alias(p), *(lo[k].alias(f"{p}_lo{k}") for k in "xy"), *(hi[k].alias(f"{p}_hi{k}") for k in "xy"))
        for k in "xy":
            d = d.withColumn(f"g{k}", F.explode(F.sequence(g(F.col(f"{p}_lo{k}")), g(F.col(f"{p}_hi{k}")))))
        return d

    j = cells(a, "a").join(cells(b, "b"), ["frame", "gx", "gy"])
    for k in "xy":
        j = j.where((F.col(f"a_lo{k}") <= F.col(f"b_hi{k}")) & (F.col(f"b_lo{k}") <= F.col(f"a_hi{k}")))
        j = j.where(F.col(f"g{k}") == g(F.greatest(f"a_lo{k}", f"b_lo{k}")))
    return j.select("frame", "a", "b")
