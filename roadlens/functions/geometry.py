"""Geometry as column expressions: angles, boxes, transforms, segments, convex polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL, LARGE = 1e-2, 1e6  # boxes with a size outside overlap nothing
PI = math.pi


def wrap(angle: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(angle + PI, F.lit(2 * PI)) - PI


def heading_accuracy(a: Column, b: Column) -> Column:
    """1 for equal headings, 0 for opposite ones."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(wrap(a - b)) / PI))


def sane(*sizes: Column) -> Column:
    ok = F.lit(True)
    for s in sizes:
        ok = ok & (s > SMALL) & (s < LARGE)
    return ok


def overlap_1d(c1: Column, s1: Column, c2: Column, s2: Column) -> Column:
    """Length shared by two intervals given by centre and size."""
    return F.greatest(F.lit(0.0), F.least(c1 + s1 / 2, c2 + s2 / 2) - F.greatest(c1 - s1 / 2, c2 - s2 / 2))


def iou_aa(ax, ay, al, aw, bx, by, bl, bw) -> Column:
    """Intersection over union of axis-aligned rectangles, clamped to [0, 1]; insane sizes give 0."""
    inter = overlap_1d(ax, al, bx, bl) * overlap_1d(ay, aw, by, bw)
    union = al * aw + bl * bw - inter
    return F.when(sane(al, aw, bl, bw), F.greatest(F.lit(0.0), F.least(F.lit(1.0), inter / union))).otherwise(F.lit(0.0))


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y


def box_corners(cx, cy, length, width, heading) -> Column:
    """Four corners of a rotated box, counter-clockwise from the front right."""
    out = []
    for sx, sy in ((0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)):
        x, y = rotate(length * sx, width * sy, heading)
        out.append(F.struct((cx + x).alias("x"), (cy + y).alias("y")))
    return F.array(*out)


def point_in_box(px, py, pz, cx, cy, cz, length, width, height, heading) -> Column:
    """Bounds are inclusive; a box with a size of zero holds nothing."""
    x, y = rotate(px - cx, py - cy, -heading)
    inside = (F.abs(x) <= length / 2) & (F.abs(y) <= width / 2) & (F.abs(pz - cz) <= height / 2)
    return inside & (length > 0) & (width > 0) & (height > 0)


def matmul4(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A row-major 4x4 transform (array of 16) on a point."""
    at = lambda i: F.element_at(m, i + 1)
    return tuple(at(4 * r) * x + at(4 * r + 1) * y + at(4 * r + 2) * z + at(4 * r + 3) for r in range(3))


def rotation(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Row-major 3x3 of Rz(yaw) Ry(pitch) Rx(roll), as an array of 9."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return F.array(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr)


def let_affinity(px, py, pz, gx, gy, gz, tolerance: float = 0.1, least: float = 0.5, sensor=(1.43, 0.0, 2.18)) -> Column:
    """Longitudinal affinity of a prediction to a ground truth, seen from the sensor."""
    px, py, pz = px - sensor[0], py - sensor[1], pz - sensor[2]
    gx, gy, gz = gx - sensor[0], gy - sensor[1], gz - sensor[2]
    norm = lambda x, y, z: F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-6))
    g, p = norm(gx, gy, gz), norm(px, py, pz)
    cosine = (gx * px + gy * py + gz * pz) / g / p
    error = F.abs((p * cosine - g) / F.greatest(tolerance * g, F.lit(least)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - error))


def let_multiplier(px, py, pz, gx, gy, gz, kind: str = "range") -> Column:
    """How far along its line of sight an aligned prediction moves (sensor coordinates)."""
    m = (gx * px + gy * py + gz * pz) / F.greatest(px * px + py * py + pz * pz, F.lit(1e-6))
    return {
        "none": F.lit(1.0),
        "range": m,
        "further_only": F.when((m < 1) & (m >= 0), m).otherwise(F.lit(1.0)),
        "any_closer_only": F.when((m < 1) & (m >= 0), F.lit(1.0)).otherwise(m),
        "between_origin_and_gt_only": F.greatest(m, F.lit(1.0)),
    }[kind]


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment; a segment of no length is a point.

    The root of the sum of squares, not hypot: that is off by a last bit even for whole numbers, so equal
    distances would not tie.
    """
    dx, dy = bx - ax, by - ay
    sq = dx * dx + dy * dy
    t = F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / sq))).otherwise(F.lit(0.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs; positive if counter-clockwise."""
    n = F.size(points)
    at = lambda i: F.element_at(points, i)
    cross = F.transform(F.sequence(F.lit(1), n), lambda i: at(i)["x"] * at(i % n + 1)["y"] - at(i)["y"] * at(i % n + 1)["x"])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.aggregate(cross, F.lit(0.0), lambda t, x: t + x) / 2)


def point_in_convex(px: Column, py: Column, points: Column) -> Column:
    """Whether a point is in a convex counter-clockwise polygon; edges count as inside."""
    n = F.size(points)
    at = lambda i: F.element_at(points, i)
    left = F.transform(F.sequence(F.lit(1), n), lambda i: (at(i % n + 1)["x"] - at(i)["x"]) * (py - at(i)["y"]) - (at(i % n + 1)["y"] - at(i)["y"]) * (px - at(i)["x"]) >= 0)
    return (n >= 3) & F.forall(left, lambda x: x)
