"""Occupancy and flow grids: sample agents, rasterise, compare.  Cells are rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, PER_METRE, ORIGIN_X, ORIGIN_Y = 256, 3.2, 128, 192


def to_grid(x: Column, y: Column) -> tuple[Column, Column]:
    """Cell of a point in the vehicle frame: columns grow with x, rows against y; half up."""
    return (F.floor(x * PER_METRE + 0.5) + ORIGIN_X).cast("int"), (F.floor(-y * PER_METRE + 0.5) + ORIGIN_Y).cast("int")


def sample_agents(agents: DataFrame, along: int = 48, across: int = 16) -> DataFrame:
    """Points spread evenly over each box (cx, cy, length, width, heading), one row a point."""
    grid = lambda n: F.explode(F.array(*(F.lit(i / (n - 1) - 0.5) for i in range(n))))
    turned = agents.withColumns({"_tc": F.cos("heading"), "_ts": F.sin("heading")})  # once a box, not once a point
    d = turned.withColumn("_u", grid(along)).withColumn("_v", grid(across))
    u, v = F.col("_u") * F.col("length"), F.col("_v") * F.col("width")
    c, s = F.col("_tc"), F.col("_ts")
    return d.select(*agents.columns, (F.col("cx") + c * u - s * v).alias("x"), (F.col("cy") + s * u + c * v).alias("y"))


def rasterise(points: DataFrame, by: list[str]) -> DataFrame:
    """(by.., row, col, occupied) of the cells inside the grid that any point falls into."""
    c, r = to_grid(F.col("x"), F.col("y"))
    inside = (F.col("row") >= 0) & (F.col("row") < CELLS) & (F.col("col") >= 0) & (F.col("col") < CELLS)
    return points.withColumns({"row": r, "col": c}).where(inside).groupBy(*by, "row", "col").agg(F.lit(1.0).alias("occupied"))


def flow(points: DataFrame, by: list[str]) -> DataFrame:
    """(by.., row, col, dx, dy): mean displacement per cell of points with x, y, x_before, y_before, in cells."""
    c, r = to_grid(F.col("x"), F.col("y"))
    c0, r0 = to_grid(F.col("x_before"), F.col("y_before"))
    inside = (F.col("row") >= 0) & (F.col("row") < CELLS) & (F.col("col") >= 0) & (F.col("col") < CELLS)
    return points.withColumns({"row": r, "col": c, "_r": r0, "_c": c0}).where(inside).groupBy(*by, "row", "col").agg(F.avg(F.col("col") - F.col("_c")).alias("dx"), F.avg(F.col("row") - F.col("_r")).alias("dy"))


def soft_iou(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., soft_iou) of truth t and prediction p in [0, 1]; groups without truth are left out."""
    both = F.sum(F.col("t") * F.col("p"))
    union = F.sum(F.col("t") + F.col("p") - F.col("t") * F.col("p"))
    return cells.groupBy(*by).agg(F.sum("t").alias("_t"), (both / F.when(union > 0, union)).alias("soft_iou")).where("_t > 0").drop("_t")


def auc(cells: DataFrame, by: list[str], thresholds: int = 100) -> DataFrame:
    """(by.., auc): area under precision and recall over evenly spaced thresholds; truth is t > 0.5.

    Cells are counted by threshold bucket, so what is ordered per group are buckets, not cells.
    """
    from pyspark.sql import Window

    b = F.least(F.floor(F.col("p") * (thresholds - 1)), F.lit(thresholds - 1)).cast("int")
    n = cells.groupBy(*by, b.alias("b")).agg(F.sum((F.col("t") > 0.5).cast("long")).alias("pos"), F.count(F.lit(1)).alias("all"))
    w = Window.partitionBy(*by).orderBy(F.desc("b"))
    run = n.select(*by, "b", F.sum("pos").over(w).alias("tp"), F.sum("all").over(w).alias("made"), F.sum("pos").over(Window.partitionBy(*by)).alias("real"))
    point = run.where("real > 0").select(*by, "b", (F.col("tp") / F.col("made")).alias("precision"), (F.col("tp") / F.col("real")).alias("recall"))
    step = point.select(*by, "precision", "recall", F.coalesce(F.lag("recall").over(w), F.lit(0.0)).alias("r0"), F.coalesce(F.lag("precision").over(w), F.col("precision")).alias("p0"))
    return step.groupBy(*by).agg(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2).alias("auc"))


def flow_error(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., epe): mean distance of flows over cells that truly move (tx, ty not both 0)."""
    e = F.sqrt((F.col("tx") - F.col("px")) ** 2 + (F.col("ty") - F.col("py")) ** 2)
    return cells.where("tx <> 0 or ty <> 0").groupBy(*by).agg(F.avg(e).alias("epe"))


def warp(occupied: DataFrame, flows: DataFrame, by: list[str]) -> DataFrame:
    """Occupancy moved along backward flow, by bilinear look-up: (by.., row, col, occupied).

    An extension: for each cell with flow the value at (col - dx, row - dy) of the earlier grid.
    """
    f = flows.select(*by, "row", "col", (F.col("col") - F.col("dx")).alias("_x"), (F.col("row") - F.col("dy")).alias("_y"))
    corner = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    near = f.withColumn("_k", F.explode(corner)).select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), (F.floor("_x") + F.col("_k.i")).cast("int").alias("col"), (F.floor("_y") + F.col("_k.j")).cast("int").alias("row"), "_x", "_y")
    weight = (1 - F.abs(F.col("_x") - F.col("col"))) * (1 - F.abs(F.col("_y") - F.col("row")))
    got = near.join(occupied, [*by, "row", "col"], "left")
    return got.groupBy(*by, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.sum(weight * F.coalesce("occupied", F.lit(0.0))).alias("occupied"))


def over_waypoints(metric: DataFrame, value: str) -> DataFrame:
    """Mean over the waypoints that were rated."""
    return metric.agg(F.avg(value).alias(value))


def trails(cells: DataFrame, by: list[str], decay: float = 0.8) -> DataFrame:
    """Occupancy faded by age: max over steps of occupied * decay ** (last step - step)."""
    last = cells.groupBy(*by).agg(F.max("step").alias("_last"))
    d = cells.join(last, by)
    return d.groupBy(*by, "row", "col").agg(F.max(F.col("occupied") * F.pow(F.lit(decay), F.col("_last") - F.col("step"))).alias("occupied"))


def roadgraph(points: DataFrame, vehicle: DataFrame, by: list[str], upright: bool = True) -> DataFrame:
    """(by.., row, col, occupied) of valid map points (by.., x, y, valid) seen from the vehicle (by.., x, y, heading).

    ``upright`` turns the scene so that the vehicle points up.
    """
    v = vehicle.select(*by, F.col("x").alias("_vx"), F.col("y").alias("_vy"), F.col("heading").alias("_h"))
    x, y = F.col("x") - F.col("_vx"), F.col("y") - F.col("_vy")
    a = F.lit(math.pi / 2) - F.col("_h")
    c, s = F.cos(a), F.sin(a)
    turned = (c * x - s * y, s * x + c * y) if upright else (x, y)
    p = points.where("valid").join(v, by)
    return rasterise(p.select(*by, turned[0].alias("x"), turned[1].alias("y")), by)


def waypoints(cells: DataFrame, by: list[str], steps: int = 10, cumulative: bool = False) -> DataFrame:
    """(by.., waypoint, row, col, occupied): future cells (by.., step from 1, row, col, occupied) at waypoints of ``steps`` steps.

    A waypoint shows its last step, or with ``cumulative`` the maximum over its steps.
    """
    w = F.floor((F.col("step") - 1) / steps).cast("int")
    d = cells.where("step >= 1").withColumn("waypoint", w)
    d = d if cumulative else d.where(F.col("step") % steps == 0)
    return d.groupBy(*by, "waypoint", "row", "col").agg(F.max("occupied").alias("occupied"))


def flow_origins(cells: DataFrame, by: list[str], steps: int = 10) -> DataFrame:
    """(by.., waypoint, row, col, occupied): where what a waypoint shows was one waypoint before (step 0 for the first)."""
    d = cells.where((F.col("step") >= 0) & (F.col("step") % steps == 0))
    return d.groupBy(*by, (F.col("step") / steps).cast("int").alias("waypoint"), "row", "col").agg(F.max("occupied").alias("occupied"))


def by_visibility(agents: DataFrame, by: list[str]) -> DataFrame:
    """Agents' states (by.., agent, step, valid, ..) with ``observed``: whether the agent was valid at any step up to 0."""
    seen = agents.groupBy(*by, "agent").agg(F.max(F.when(F.col("step") <= 0, F.col("valid").cast("int"))).alias("_s"))
    return agents.join(seen, [*by, "agent"]).withColumn("observed", F.coalesce(F.col("_s") == 1, F.lit(False))).drop("_s")
