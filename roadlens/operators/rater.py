"""Rater feedback score of planned trajectories, by array functions on one row a frame.

A row has plans array<struct<points array<struct<x,y>>, p>> and raters array<struct<points, label>> at
4 Hz (20 points, 5 s) and the initial speed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = {11: (1.0, 4.0), 19: (1.8, 7.2)}  # point (3 s and 5 s): lateral and longitudinal thresholds
FLOOR = 4.0
POINTS, RATERS = 20, 3


def pad(points: Column, n: int = POINTS) -> Column:
    """The first n points; shorter lists repeat their last point."""
    first = F.slice(points, 1, n)
    return F.slice(F.concat(first, F.array_repeat(F.element_at(first, -1), n)), 1, n)


def speed_scale(v: Column) -> Column:
    return F.when(v < 1.4, F.lit(0.5)).when(v > 11.0, F.lit(1.0)).otherwise(0.5 + 0.5 * (v - 1.4) / 9.6)


def direction(points: Column, at: int) -> Column:
    """Unit direction of the last moving step up to a point; (1, 0) if none moved."""
    start = F.struct(F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))

    def step(s, p):
        dx, dy = p["x"] - s["px"], p["y"] - s["py"]
        d = F.sqrt(dx * dx + dy * dy)
        moved = d > 1e-6
        return F.struct(p["x"].alias("px"), p["y"].alias("py"), F.when(moved, dx / d).otherwise(s["dx"]).alias("dx"), F.when(moved, dy / d).otherwise(s["dy"]).alias("dy"))

    return F.aggregate(F.slice(points, 1, at + 1), start, step)


def score(df: DataFrame) -> DataFrame:
    """Adds ``score``: the sum over plans of p times the mean over 3 s and 5 s of the best rater's
    label * 0.1 ** max(d - 1, 0), d being the larger of lateral and longitudinal error over its
    threshold; the mean is at least 4 unless one rater's region (d <= 1 at both times) holds the plan."""
    scale = speed_scale(F.col("speed"))

    def once(x: Column) -> Column:  # a generator, so that no later expression repeats the work
        return F.explode(F.array(x))

    def seen(r):
        return F.struct(r["label"].alias("label"), *(F.struct(F.element_at(r["points"], at + 1).alias("g"), direction(r["points"], at).alias("u")).alias(f"at{at}") for at in AT))

    raters = F.transform(F.slice("raters", 1, RATERS), lambda r: F.struct(pad(r["points"]).alias("points"), r["label"].alias("label")))
    plans = F.transform(F.transform("plans", lambda q: F.struct(pad(q["points"]).alias("points"), q["p"].alias("p"))), lambda q: F.struct(q["p"].alias("p"), *(F.element_at(q["points"], at + 1).alias(f"at{at}") for at in AT)))
    rows = df.withColumn("_raters", once(F.transform(raters, seen))).withColumn("_plans", once(plans))

    def distance(q, r, at: int) -> Column:
        lat, lon = AT[at]
        g, u = r[f"at{at}"]["g"], r[f"at{at}"]["u"]
        ex, ey = q[f"at{at}"]["x"] - g["x"], q[f"at{at}"]["y"] - g["y"]
        return F.greatest(F.abs(ey * u["dx"] - ex * u["dy"]) / (lat * scale), F.abs(ex * u["dx"] + ey * u["dy"]) / (lon * scale))

    def best(q) -> Column:
        near = F.transform("_raters", lambda r: F.struct(r["label"].alias("label"), *(distance(q, r, at).alias(f"d{at}") for at in AT)))
        start = F.struct(F.lit(False).alias("inside"), *(F.lit(0.0).alias(f"v{at}") for at in AT))

        def add(t, x):
            inside = t["inside"]
            here = F.lit(True)
            for at in AT:
                here = here & (x[f"d{at}"] <= 1)
            return F.struct((inside | here).alias("inside"), *(F.greatest(t[f"v{at}"], x["label"] * F.pow(F.lit(0.1), F.greatest(x[f"d{at}"] - 1, F.lit(0.0)))).alias(f"v{at}") for at in AT))

        mean = lambda t: sum((t[f"v{at}"] for at in AT), F.lit(0.0)) / len(AT)
        return F.aggregate(near, start, add, lambda t: F.when(t["inside"], mean(t)).otherwise(F.greatest(mean(t), F.lit(FLOOR))))

    return rows.withColumn("score", F.aggregate("_plans", F.lit(0.0), lambda t, q: t + q["p"] * best(q))).drop("_raters", "_plans")
