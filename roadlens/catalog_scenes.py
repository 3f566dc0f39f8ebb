"""Further queries: shapes, map and camera features, occupancy grids, scenarios, validation, matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.catalog import _CELLS, _cells, _keypoints, _motion, query, r6, read
from roadlens.functions import geometry as G
from roadlens.operators import detection as D
from roadlens.operators import keypoints as K
from roadlens.operators import lidar as L
from roadlens.operators import map_features as MF
from roadlens.operators import motion as M
from roadlens.operators import occupancy as O
from roadlens.operators import relational as REL
from roadlens.sources import scenarios

_c = F.col

# ---- shapes ----------------------------------------------------------------------------------------


def _seg(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Distance of a point to a segment in SQL."""
    t = f"CASE WHEN ({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2 > 0 THEN greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2))) ELSE 0 END"
    return f"sqrt(({px} - ({ax} + {t} * ({bx} - {ax}))) ** 2 + ({py} - ({ay} + {t} * ({by} - {ay}))) ** 2)"


_CORNERS = "(VALUES (0, 0.5, -0.5), (1, 0.5, 0.5), (2, -0.5, 0.5), (3, -0.5, -0.5)) AS k(k, u, v)"


@query(f"""WITH pairs AS (SELECT row_number() OVER () AS pair, a.frame, a.id AS a, b.id AS b, a.cx AS ax, a.cy AS ay, a.length AS al, a.width AS aw, a.heading AS ah, b.cx AS bx, b.cy AS b_y, b.length AS bl, b.width AS bw, b.heading AS bh
  FROM {{gt}} a JOIN {{gt}} b ON a.frame = b.frame AND a.id + 1 = b.id),
ca AS (SELECT pair, k, ax + cos(ah) * al * u - sin(ah) * aw * v AS x, ay + sin(ah) * al * u + cos(ah) * aw * v AS y FROM pairs, {_CORNERS}),
cb AS (SELECT pair, k, bx + cos(bh) * bl * u - sin(bh) * bw * v AS x, b_y + sin(bh) * bl * u + cos(bh) * bw * v AS y FROM pairs, {_CORNERS}),
sa AS (SELECT s.pair, s.x AS x0, s.y AS y0, t.x AS x1, t.y AS y1 FROM ca s JOIN ca t ON s.pair = t.pair AND t.k = (s.k + 1) % 4),
sb AS (SELECT s.pair, s.x AS x0, s.y AS y0, t.x AS x1, t.y AS y1 FROM cb s JOIN cb t ON s.pair = t.pair AND t.k = (s.k + 1) % 4),
far AS (SELECT pair, min(d) AS d FROM (SELECT c.pair, {_seg('c.x', 'c.y', 's.x0', 's.y0', 's.x1', 's.y1')} AS d FROM ca c JOIN sb s ON s.pair = c.pair
  UNION ALL SELECT c.pair, {_seg('c.x', 'c.y', 's.x0', 's.y0', 's.x1', 's.y1')} FROM cb c JOIN sa s ON s.pair = c.pair) GROUP BY 1),
axes AS (SELECT pair, h, sin(h) AS nx, -cos(h) AS ny FROM (SELECT pair, unnest([ah, ah + pi() / 2, bh, bh + pi() / 2]) AS h FROM pairs)),
pa AS (SELECT pair, h, min(x * nx + y * ny) AS lo, max(x * nx + y * ny) AS hi FROM ca JOIN axes USING (pair) GROUP BY ALL),
pb AS (SELECT pair, h, min(x * nx + y * ny) AS lo, max(x * nx + y * ny) AS hi FROM cb JOIN axes USING (pair) GROUP BY ALL),
gap AS (SELECT pair, max(greatest(pb.lo - pa.hi, pa.lo - pb.hi)) AS gap FROM pa JOIN pb USING (pair, h) GROUP BY 1)
SELECT frame, a, b, round(CASE WHEN gap <= 0 THEN gap ELSE d END, 5) AS distance FROM pairs JOIN far USING (pair) JOIN gap USING (pair)""")
def box_distance(spark, sf):
    """Signed distance of each box to the next one of its frame."""
    box = ["cx", "cy", "length", "width", "heading"]
    # ids of a frame are 1, 2, ..: the next row of a frame that is already together, not a join
    after = F.lead(F.struct("id", *box)).over(Window.partitionBy("frame").orderBy("id"))
    g = read(spark, sf, "gt_boxes").select("frame", "id", *box, after.alias("_n")).where(_c("_n.id") == _c("id") + 1)
    g = g.select("frame", "id", *box, *(_c(f"_n.{c}").alias(f"_{c}") for c in box))
    side = lambda p: tuple(_c(p + c) for c in box)
    return g.select("frame", _c("id").alias("a"), (_c("id") + 1).alias("b"), F.round(MF.signed_box_distance(side(""), side("_")), 5).alias("distance"))


@query("""SELECT frame, id, round(sin(0.1 * id) * cx + 0.5 * cy + 1, 6) AS x, round(cx - cy + 2 * cz, 6) AS y, round(r00 * cx + r01 * cy + r02, 6) AS rx, round(r10 * cx + r11 * cy + r12, 6) AS ry, round(r20 * cx + r21 * cy + r22, 6) AS rz FROM (
SELECT *, cos(heading) * cos(0.2) AS r00, cos(heading) * sin(0.2) * sin(0.1) - sin(heading) * cos(0.1) AS r01, cos(heading) * sin(0.2) * cos(0.1) + sin(heading) * sin(0.1) AS r02,
 sin(heading) * cos(0.2) AS r10, sin(heading) * sin(0.2) * sin(0.1) + cos(heading) * cos(0.1) AS r11, sin(heading) * sin(0.2) * cos(0.1) - cos(heading) * sin(0.1) AS r12, -sin(0.2) AS r20, cos(0.2) * sin(0.1) AS r21, cos(0.2) * cos(0.1) AS r22 FROM {gt})""")
def transforms(spark, sf):
    """Points by 4x4 transforms and by rotations of roll, pitch and yaw."""
    one, no = F.lit(1.0), F.lit(0.0)
    m = F.array(F.sin(0.1 * _c("id")), F.lit(0.5), no, one, one, F.lit(-1.0), F.lit(2.0), no, no, no, one, no, no, no, no, one)
    x, y, _ = G.matmul4(m, _c("cx"), _c("cy"), _c("cz"))
    r = G.rotation(F.lit(0.1), F.lit(0.2), _c("heading"))
    at = lambda i: F.element_at(r, i + 1)
    rows = [at(3 * k) * _c("cx") + at(3 * k + 1) * _c("cy") + at(3 * k + 2) for k in range(3)]
    return read(spark, sf, "gt_boxes").select("frame", "id", r6(x).alias("x"), r6(y).alias("y"), *(r6(v).alias(f"r{a}") for v, a in zip(rows, "xyz", strict=True)))


@query(f"""SELECT frame, id, round(length * width, 6) AS area, abs(cos(heading) * 0.4 - sin(heading) * 0.3) <= width / 2 AND abs(cos(heading) * 0.3 + sin(heading) * 0.4) <= length / 2 AS inside,
round({_seg('cx + 0.3', 'cy + 0.4', 'cx', 'cy', 'cx + cos(heading) * length', 'cy + sin(heading) * length')}, 6) AS distance FROM {{gt}}""")
def polygons(spark, sf):
    """Area of a box's polygon, whether it holds a point, and the point's distance to the box's axis."""
    corners = G.box_corners(*(_c(c) for c in ("cx", "cy", "length", "width", "heading")))
    px, py = _c("cx") + 0.3, _c("cy") + 0.4
    g = read(spark, sf, "gt_boxes").withColumn("corners", F.explode(F.array(corners)))
    axis = G.segment_distance(px, py, _c("cx"), _c("cy"), _c("cx") + F.cos("heading") * _c("length"), _c("cy") + F.sin("heading") * _c("length"))
    return g.select("frame", "id", r6(G.polygon_area(_c("corners"))).alias("area"), G.point_in_convex(px, py, _c("corners")).alias("inside"), r6(axis).alias("distance"))


@query("""SELECT obj AS id, kind, round(dx * c - dy * s, 6) AS dx, round(dx * s + dy * c, 6) AS dy FROM (SELECT *, greatest(least(u, sx / 2), -sx / 2) - u AS dx, greatest(least(v, sy / 2), -sy / 2) - v AS dy FROM (
SELECT *, (px - bx) * c + (py - b_y) * s AS u, (py - b_y) * c - (px - bx) * s AS v FROM (SELECT frame AS obj, part AS kind, cx + turn AS px, cy + discount AS py, cx + 1 AS bx, cy AS b_y, length / 4 AS sx, width AS sy, cos(heading) AS c, sin(heading) AS s FROM {gt})))""")
def keypoint_displacement(spark, sf):
    """The shift that moves each predicted point into its (turned) box."""
    g = read(spark, sf, "gt_boxes")
    p = g.select(_c("frame").alias("id"), _c("part").alias("kind"), (_c("cx") + _c("turn")).alias("px"), (_c("cy") + _c("discount")).alias("py"), (_c("cx") + 1).alias("bx"), _c("cy").alias("by"), (_c("length") / 4).alias("sx"), _c("width").alias("sy"), "heading")
    dx, dy = K.displacement(p, heading=_c("heading"))
    return p.select("id", "kind", r6(dx).alias("dx"), r6(dy).alias("dy"))


@query("""SELECT subset, round(coalesce(avg(sqrt((gx - px) ** 2 + (gy - py) ** 2)) FILTER (gv > 0 AND pv > 0), 0), 6) AS mpjpe FROM (
SELECT part % 14 AS kind, cx AS gx, cy AS gy, cx + turn AS px, cy + discount AS py, points % 3 AS gv, part % 3 AS pv FROM {gt})
JOIN (VALUES ('HEAD', 1), ('HEAD', 2), ('ARMS', 3), ('ARMS', 4), ('ALL', 1), ('ALL', 2), ('ALL', 3), ('ALL', 4), ('ALL', 5)) AS s(subset, k) ON k = kind GROUP BY 1""")
def keypoint_subsets(spark, sf):
    """A keypoint metric by named subsets of point types."""
    return K.mpjpe(K.subsets(_keypoints(spark, sf), {"HEAD": [1, 2], "ARMS": [3, 4], "ALL": [1, 2, 3, 4, 5]}), ["subset"]).withColumn("mpjpe", r6("mpjpe"))


# ---- map and camera features -----------------------------------------------------------------------

_LABELS = "SELECT frame, id AS order_, points % 5 AS camera, CASE WHEN points > 1 THEN 1 + id % 3 END AS laser_id, cx, part FROM {gt}"


@query(f"""SELECT frame, id, list_sort(list(camera) FILTER (camera IS NOT NULL)) AS cameras, list(cx ORDER BY camera) FILTER (camera IS NOT NULL) AS xs
FROM (SELECT frame, id FROM {{gt}}) g LEFT JOIN (SELECT frame, laser_id AS id, camera, arg_max(cx, order_) AS cx FROM ({_LABELS}) WHERE laser_id IS NOT NULL GROUP BY ALL) USING (frame, id) GROUP BY 1, 2""")
def camera_association(spark, sf):
    """Lidar objects with their camera labels."""
    g = read(spark, sf, "gt_boxes")
    camera = g.select("frame", _c("id").alias("order"), (_c("points") % 5).alias("camera"), F.when(_c("points") > 1, 1 + _c("id") % 3).alias("laser_id"), "cx")
    out = MF.associate(g.select("frame", "id"), camera, ["cx"])
    return out.select("frame", "id", F.map_keys("cameras").alias("cameras"), F.transform(F.map_values("cameras"), lambda x: x["cx"]).alias("xs"))


@query("""SELECT t.object AS scenario, t.step, t.event_id % 6 AS lane, coalesce(state, 0) AS state FROM {tracks} t LEFT JOIN (SELECT object, step, event_id % 4 AS lane, 1 + event_id % 8 AS state FROM {tracks}) s
ON s.object = t.object AND s.step = t.step AND s.lane = t.event_id % 6""")
def lane_signals(spark, sf):
    t = read(spark, sf, "tracks").withColumnRenamed("object", "scenario")
    signals = t.select("scenario", "step", (_c("event_id") % 4).alias("lane"), (1 + _c("event_id") % 8).alias("state"))
    return MF.lane_signals(t.select("scenario", "step", (_c("event_id") % 6).alias("lane")), signals).select("scenario", "step", "lane", "state")


@query(f"""WITH p AS (SELECT frame, id AS point, cx AS x, cy AS y FROM {{gt}}), s AS (SELECT frame, id AS segment, cx + 2 AS x0, cy - 1 AS y0, cx + 2 + length AS x1, cy + width AS y1 FROM {{gt}}),
d AS (SELECT p.frame, point, segment, {_seg('x', 'y', 'x0', 'y0', 'x1', 'y1')} AS d FROM p JOIN s USING (frame))
SELECT p.frame, p.point, m.segment, round(m.d, 6) AS distance FROM p LEFT JOIN (SELECT frame, point, arg_min(segment, (d, segment)) AS segment, min(d) AS d FROM d WHERE d <= 5 GROUP BY 1, 2) m ON m.frame = p.frame AND m.point = p.point""")
def nearest_edges(spark, sf):
    """Each box centre's nearest road-edge segment within five metres."""
    g = read(spark, sf, "gt_boxes")
    segments = g.select("frame", _c("id").alias("segment"), (_c("cx") + 2).alias("x0"), (_c("cy") - 1).alias("y0"), (_c("cx") + 2 + _c("length")).alias("x1"), (_c("cy") + _c("width")).alias("y1"))
    return MF.nearest_segment(g.select("frame", _c("id").alias("point"), _c("cx").alias("x"), _c("cy").alias("y")), segments, ["frame"], 5.0).withColumn("distance", r6("distance"))


# ---- motion ----------------------------------------------------------------------------------------

_ERRORS = """(SELECT f.object, f.joint, f.step, CASE WHEN t.valid THEN sqrt((f.x - t.x) ** 2 + (f.y - t.y) ** 2) END AS error FROM (SELECT * FROM {forecasts} WHERE step < 16) f JOIN {tracks} t ON t.object = f.object AND t.step = f.step + 6)"""


@query(f"""WITH o AS (SELECT object, joint, h AS horizon, avg(error) AS ade, max(CASE WHEN step = h THEN error END) AS fde FROM {_ERRORS} JOIN (SELECT unnest([5, 9, 15]) AS h) ON step <= h GROUP BY ALL),
m AS (SELECT object, horizon, min(ade) AS ade, min(fde) AS fde FROM o GROUP BY 1, 2), k AS (SELECT object, max(kind) AS type FROM (SELECT object, type AS kind FROM {{tracks}} UNION ALL SELECT object, 4 FROM {{tracks}} WHERE object % 5 = 0) GROUP BY 1)
SELECT type, CAST(horizon AS INTEGER) AS horizon, round(avg(ade), 6) AS min_ade, round(avg(fde), 6) AS min_fde FROM m JOIN k USING (object) GROUP BY 1, 2""")
def motion_by_type(spark, sf):
    """Displacement by the type of highest priority in a group and by step, accumulated over two parts of the scenarios."""
    t, p = _motion(spark, sf)
    d = M.displacement(p, [5, 9, 15])
    kinds = t.select("scenario", _c("object").alias("group"), "type")
    members = kinds.union(kinds.where("group % 5 = 0").select("scenario", "group", F.lit(4).cast("long")))
    values = ["min_ade", "min_fde"]
    parts = [M.bundle(d.where(_c("scenario") % 2 == k), members, values) for k in (0, 1)]
    return M.accumulate(parts[0].union(parts[1]), values).select("type", _c("at").alias("horizon"), *(r6(v).alias(v) for v in values))


@query(f"""SELECT object, CAST(h AS INTEGER) AS horizon, round(max(error), 6) AS worst, count(error) AS measured FROM {_ERRORS} JOIN (SELECT unnest([5, 15]) AS h) ON step <= h GROUP BY ALL""")
def motion_custom(spark, sf):
    """A user's own measures over the aligned points."""
    _, p = _motion(spark, sf)
    out = M.custom(p, [5, 15], {"worst": F.max("error"), "measured": F.count("error")})
    return out.select(_c("scenario").alias("object"), _c("at").alias("horizon"), r6("worst").alias("worst"), "measured")


@query("""WITH f AS (SELECT * FROM {forecasts} WHERE step < 16 AND object % 7 <> joint), got AS (SELECT DISTINCT object FROM f), w AS (SELECT object FROM {tracks} WHERE object % 10 <> 0 GROUP BY 1)
SELECT object AS scenario, 'wrong number of steps' AS problem FROM (SELECT object, joint, count(DISTINCT step) AS n FROM f GROUP BY 1, 2) WHERE n <> 16 GROUP BY 1
UNION ALL SELECT object, 'too many joints' FROM f GROUP BY 1 HAVING count(DISTINCT joint) > 2 UNION ALL SELECT object, 'object not wanted' FROM got WHERE object NOT IN (FROM w) UNION ALL SELECT object, 'object missing' FROM w WHERE object NOT IN (FROM got)
UNION ALL SELECT object, 'tracks too short' FROM {tracks} WHERE object IN (FROM got) GROUP BY 1 HAVING max(step) < 21""")
def motion_problems(spark, sf):
    """What is invalid about forecasts."""
    t = read(spark, sf, "tracks").withColumn("scenario", _c("object"))
    f = read(spark, sf, "forecasts").where((_c("step") < 16) & (_c("object") % 7 != _c("joint"))).withColumns({"scenario": _c("object"), "group": _c("object")})
    wanted = t.where("object % 10 <> 0").select("scenario", "object").distinct()
    return M.problems(f, t, wanted, steps=16, history=5, ratio=1, most=2)


@query("""WITH t AS (SELECT *, object % 20 AS scenario, object < 20 AS is_sdc FROM {tracks}) SELECT DISTINCT scenario, object FROM t WHERE step = 5 AND valid AND (is_sdc OR object % 3 = 0)""")
def evaluated_agents(spark, sf):
    t = read(spark, sf, "tracks").withColumns({"scenario": _c("object") % 20, "is_sdc": _c("object") < 20})
    return M.modelled(t, t.where("object % 3 = 0").select("scenario", "object").distinct(), history=5)


_HITS = """p AS (SELECT f.object, f.step, f.x, f.y, f.x - lag(f.x) OVER w AS bx, f.y - lag(f.y) OVER w AS b_y, lead(f.x) OVER w - f.x AS ax, lead(f.y) OVER w - f.y AS ay FROM {forecasts} f
 JOIN (SELECT object, arg_min(joint, (-confidence, joint)) AS joint FROM {forecasts} WHERE step < 16 GROUP BY 1) b ON b.object = f.object AND b.joint = f.joint WHERE step < 16 WINDOW w AS (PARTITION BY f.object ORDER BY f.step)),
h AS (SELECT object, step, x, y, atan2(coalesce(b_y / nullif(sqrt(bx * bx + b_y * b_y), 0), 0) + coalesce(ay / nullif(sqrt(ax * ax + ay * ay), 0), 0), coalesce(bx / nullif(sqrt(bx * bx + b_y * b_y), 0), 0) + coalesce(ax / nullif(sqrt(ax * ax + ay * ay), 0), 0)) AS h FROM p)"""


@query(f"""WITH {_HITS}, n AS (SELECT object FROM {{tracks}} WHERE step = 5 AND valid), t AS (SELECT object, step, x, y, heading FROM {{tracks}} WHERE valid AND object IN (FROM n)),
m AS (SELECT h.object, h.step, h.x, h.y, h.h, t.x AS ox, t.y AS oy, t.heading AS oh FROM h JOIN t ON t.step = h.step + 6 AND t.object % 20 = h.object % 20 AND t.object <> h.object WHERE h.object IN (FROM n)),
s AS (SELECT *, abs((ox - x) * cos(h) + (oy - y) * sin(h)) AS du, abs((oy - y) * cos(h) - (ox - x) * sin(h)) AS dv, abs((ox - x) * cos(oh) + (oy - y) * sin(oh)) AS eu, abs((oy - y) * cos(oh) - (ox - x) * sin(oh)) AS ev, abs(cos(oh - h)) AS c, abs(sin(oh - h)) AS s FROM m),
f AS (SELECT object, min(step) AS first FROM s WHERE greatest(du - 2 - 2 * c - 1 * s, dv - 1 - 2 * s - 1 * c, eu - 2 - 2 * c - 1 * s, ev - 1 - 2 * s - 1 * c) < -1e-9 GROUP BY 1)
SELECT DISTINCT o.object, CAST(a AS INTEGER) AS horizon, CAST(coalesce(first <= a, false) AS INTEGER) AS overlap FROM (SELECT DISTINCT object FROM {{forecasts}} WHERE step < 16) o CROSS JOIN (SELECT unnest([5, 9, 15]) AS a) LEFT JOIN f USING (object)""")
def motion_overlap(spark, sf):
    """Whether the most confident forecast of an object, as a 4 x 2 m box, meets another object of its scenario."""
    t = read(spark, sf, "tracks").withColumns({"scenario": _c("object") % 20, "length": F.lit(4.0), "width": F.lit(2.0)})
    f = read(spark, sf, "forecasts").where("step < 16").withColumns({"scenario": _c("object") % 20, "group": _c("object")})
    return M.overlap_rate(f, t, [5, 9, 15], history=5, ratio=1).select(_c("group").alias("object"), _c("at").alias("horizon"), "overlap")


# ---- occupancy -------------------------------------------------------------------------------------

_GX, _GY = "CAST(floor(({x}) * 3.2 + 0.5) + 128 AS INTEGER)", "CAST(floor(-({y}) * 3.2 + 0.5) + 192 AS INTEGER)"


def _grid(x: str, y: str) -> str:
    return f"{_GY.format(y=y)} AS row, {_GX.format(x=x)} AS col"


_IN = "row BETWEEN 0 AND 255 AND col BETWEEN 0 AND 255"


@query("""SELECT frame, id, count(*) AS points, round(sum(x), 5) + 0.0::double AS sum_x, round(sum(y * i), 5) + 0.0::double AS sum_y FROM (SELECT frame, id, i, cx + cos(heading) * u * length - sin(heading) * v * width AS x, cy + sin(heading) * u * length + cos(heading) * v * width AS y
FROM {gt}, (SELECT unnest(range(12)) AS i) a, (SELECT i AS n, i / 11.0::double - 0.5 AS u FROM (SELECT unnest(range(12)) AS i)) b, (SELECT i / 3.0::double - 0.5 AS v FROM (SELECT unnest(range(4)) AS i)) c WHERE a.i = b.n) GROUP BY 1, 2""")
def agent_samples(spark, sf):
    """Checksums of the points spread over each agent's box."""
    g = read(spark, sf, "gt_boxes").select("frame", "id", "cx", "cy", "length", "width", "heading", F.cos("heading").alias("c"), F.sin("heading").alias("s"))
    p = O.sample_agents(g, 12, 4)
    u = F.floor(((_c("x") - _c("cx")) * _c("c") + (_c("y") - _c("cy")) * _c("s")) / _c("length") * 11 + 6).cast("double")
    return p.groupBy("frame", "id").agg(F.count(F.lit(1)).alias("points"), (F.round(F.sum("x"), 5) + 0.0).alias("sum_x"), (F.round(F.sum(_c("y") * u), 5) + 0.0).alias("sum_y"))


_FLOW = f"""SELECT frame, row, col, avg(col - c0) AS dx, avg(row - r0) AS dy FROM (SELECT frame, {_grid('cx', 'cy')}, {_GY.format(y='cy - discount * 3')} AS r0, {_GX.format(x='cx - turn')} AS c0 FROM {{gt}}) WHERE {_IN} GROUP BY 1, 2, 3"""


def _flow(spark, sf):
    g = read(spark, sf, "gt_boxes")
    return O.flow(g.select("frame", _c("cx").alias("x"), _c("cy").alias("y"), (_c("cx") - _c("turn")).alias("x_before"), (_c("cy") - _c("discount") * 3).alias("y_before")), ["frame"])


@query(f"SELECT frame, row, col, round(dx, 6) AS dx, round(dy, 6) AS dy FROM ({_FLOW})")
def flow_grid(spark, sf):
    return _flow(spark, sf).withColumns({"dx": r6("dx"), "dy": r6("dy")})


@query(f"""WITH f AS ({_FLOW}), o AS (SELECT DISTINCT frame, row, col FROM (SELECT frame, {_grid('cx - turn', 'cy')} FROM {{gt}}) WHERE {_IN}), m AS (SELECT frame, row, col, col - dx AS x, row - dy AS y FROM f)
SELECT m.frame, m.row, m.col, round(coalesce(sum((1 - abs(x - o.col)) * (1 - abs(y - o.row))), 0), 6) AS occupied FROM m LEFT JOIN o ON o.frame = m.frame AND o.col IN (floor(x), floor(x) + 1) AND o.row IN (floor(y), floor(y) + 1) GROUP BY 1, 2, 3""")
def flow_warp(spark, sf):
    g = read(spark, sf, "gt_boxes")
    before = O.rasterise(g.select("frame", (_c("cx") - _c("turn")).alias("x"), _c("cy").alias("y")), ["frame"])
    return O.warp(before, _flow(spark, sf), ["frame"]).withColumn("occupied", r6("occupied"))


_STEPS = f"(SELECT object % 50 AS scenario, step, row, col, 1.0::double / (1 + min(event_id % 3)) AS occupied FROM (SELECT object, step, event_id, {_grid('x / 10', 'y')} FROM {{tracks}}) WHERE {_IN} GROUP BY ALL)"


def _steps(spark, sf):
    row, col = _c("row"), _c("col")
    cc, rr = O.to_grid(_c("x") / 10, _c("y"))
    t = read(spark, sf, "tracks").withColumns({"row": rr, "col": cc, "scenario": _c("object") % 50})
    t = t.where(row.between(0, 255) & col.between(0, 255))
    return t.groupBy("scenario", "step", "row", "col").agg((1 / (1 + F.min(_c("event_id") % 3))).alias("occupied"))


@query(f"SELECT scenario, row, col, round(max(occupied * 0.8 ** (last - step)), 6) AS occupied FROM {_STEPS} JOIN (SELECT scenario, max(step) AS last FROM {_STEPS} GROUP BY 1) USING (scenario) GROUP BY 1, 2, 3")
def occupancy_trails(spark, sf):
    return O.trails(_steps(spark, sf), ["scenario"]).withColumn("occupied", r6("occupied"))


@query(f"""SELECT 'last' AS kind, scenario, CAST((step - 1) // 10 AS INTEGER) AS waypoint, row, col, max(occupied) AS occupied FROM {_STEPS} WHERE step >= 1 AND step % 10 = 0 GROUP BY ALL UNION ALL
SELECT 'all', scenario, CAST((step - 1) // 10 AS INTEGER), row, col, max(occupied) FROM {_STEPS} WHERE step >= 1 GROUP BY ALL UNION ALL SELECT 'origin', scenario, CAST(step // 10 AS INTEGER), row, col, max(occupied) FROM {_STEPS} WHERE step % 10 = 0 GROUP BY ALL""")
def waypoint_grids(spark, sf):
    """Occupancy at waypoints, over whole waypoints, and where a waypoint's flow begins."""
    s = _steps(spark, sf)
    each = {"last": O.waypoints(s, ["scenario"]), "all": O.waypoints(s, ["scenario"], cumulative=True), "origin": O.flow_origins(s, ["scenario"])}
    parts = [d.select(F.lit(k).alias("kind"), "scenario", "waypoint", "row", "col", "occupied") for k, d in each.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH p AS (SELECT t.object, t.x / 10 - v.x / 10 AS x, t.y - v.y AS y, pi() / 2 - v.heading AS a FROM {{tracks}} t JOIN {{tracks}} v ON v.object = t.object AND v.step = 0 WHERE t.valid)
SELECT DISTINCT object, row, col, 1.0::double AS occupied FROM (SELECT object, {_grid('cos(a) * x - sin(a) * y', 'sin(a) * x + cos(a) * y')} FROM p) WHERE {_IN}""")
def roadgraph_raster(spark, sf):
    """Map points around the vehicle's first state, turned upright."""
    t = read(spark, sf, "tracks").select("object", "step", (_c("x") / 10).alias("x"), "y", "valid", "heading")
    return O.roadgraph(t.select("object", "x", "y", "valid"), t.where("step = 0").select("object", "x", "y", "heading"), ["object"])


@query("""SELECT object, step, coalesce(max(CASE WHEN step <= 5 THEN valid::int END) OVER (PARTITION BY object) = 1, false) AS observed FROM {tracks}""")
def observed_agents(spark, sf):
    t = read(spark, sf, "tracks").select(_c("object").alias("agent"), (_c("step") - 5).alias("step"), "valid", F.lit(0).alias("scenario"))
    return O.by_visibility(t, ["scenario"]).select(_c("agent").alias("object"), (_c("step") + 5).alias("step"), "observed")


# ---- range images, scenarios -----------------------------------------------------------------------


@query("""SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(min(d), 6) AS range FROM (SELECT frame % 8 AS image, sqrt(cx * cx + cy * cy + (cx - cy) ** 2 / 100) AS d, (SELECT arg_min(i, (abs(atan2((cx - cy) / 10, sqrt(cx * cx + cy * cy)) - b), i)) FROM (VALUES (0, 0.1), (1, 0.05), (2, 0.0), (3, -0.05), (4, -0.1)) AS k(i, b)) AS row,
((CAST(floor(64 - 0.5 - (atan2(cy, cx) + pi()) / (2 * pi()) * 64 + 0.5) AS INTEGER) % 64) + 64) % 64 AS col FROM {gt}) GROUP BY 1, 2""")
def built_range_image(spark, sf):
    """Points to the pixels of a range image."""
    g = read(spark, sf, "gt_boxes").select(F.lit(0).alias("image"), _c("cx").alias("x"), _c("cy").alias("y"), ((_c("cx") - _c("cy")) / 10).alias("z"))
    return L.to_range_image(g, ["image"], [0.1, 0.05, 0.0, -0.05, -0.1], 64).select("row", "col", r6("range").alias("range"))


_BEAMS = "[0.1, 0.07, 0.05, 0.02, 0.0, -0.05, -0.1, -0.2]"


@query(f"""WITH p AS (SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col, r FROM (SELECT vec_id, unnest(embedding)::double AS r, unnest(range(1, 65)) AS i FROM embeddings WHERE embedding IS NOT NULL) WHERE r > 0),
q AS (SELECT *, {_BEAMS}[row + 1] AS b, ((8 - col - 0.5) / 8 * 2 - 1) * pi() - 0.3 AS a, CASE WHEN (row + col) % 3 <> 0 THEN 1 + (row + vec_id) % 5 ELSE 0 END AS camera FROM p)
SELECT vec_id, camera, count(*) AS n, round(sum(r * cos(b) * cos(a)), 4) + 0.0::double AS x, round(sum(r * cos(b) * sin(a)), 4) + 0.0::double AS y, round(sum(r * sin(b)), 4) + 0.0::double AS z, CAST(sum(CASE WHEN camera > 0 THEN col * 10 END) AS BIGINT) AS u FROM q GROUP BY 1, 2""")
def projected_points(spark, sf):
    """Points of a table of beams with their camera projections."""
    e = read(spark, sf, "embeddings").where("embedding is not null").select("vec_id", _c("embedding").cast("array<double>").alias("values"), F.array(F.lit(8), F.lit(8), F.lit(1)).alias("shape"))
    px = L.pixels(e, "values", "shape", ["range"], ["vec_id"])
    cloud = L.point_cloud_by_beams(px, [-0.2, -0.1, -0.05, 0.0, 0.02, 0.05, 0.07, 0.1], 8, 0.3)
    none = F.lit(0).cast("long")
    seen = px.where((_c("row") + _c("col")) % 3 != 0).select("vec_id", "row", "col", (1 + (_c("row") + _c("vec_id")) % 5).alias("camera1"), (_c("col") * 10).cast("long").alias("u1"), none.alias("v1"), none.alias("camera2"), none.alias("u2"), none.alias("v2"))
    out = L.with_projections(cloud, seen, ["vec_id"]).groupBy("vec_id", _c("camera1").alias("camera"))
    return out.agg(F.count(F.lit(1)).alias("n"), *((F.round(F.sum(c), 4) + 0.0).alias(c) for c in "xyz"), F.sum("u1").alias("u"))


@query("SELECT frame, id, points FROM (SELECT frame, id, points, CASE WHEN part % 3 > 0 THEN part END AS part, CASE WHEN points > 2 THEN [points] ELSE [] END AS labels FROM {gt}) WHERE part IS NOT NULL AND len(labels) > 0")
def present_fields(spark, sf):
    """Rows that have a nested field and a list with anything in it."""
    g = read(spark, sf, "gt_boxes")
    rows = g.select("frame", "id", "points", F.struct(F.when(_c("part") % 3 > 0, _c("part")).alias("part")).alias("box"), F.when(_c("points") > 2, F.array("points")).otherwise(F.array().cast("array<bigint>")).alias("labels"))
    return REL.has_fields(rows, ["box.part", "labels"]).select("frame", "id", "points")


@query("SELECT object % 20 AS scenario, step, x, y FROM {tracks} WHERE object < 20")
def vehicle_states(spark, sf):
    """The states of each scenario's own vehicle."""
    t = read(spark, sf, "tracks").withColumns({"scenario": _c("object") % 20, "is_sdc": _c("object") < 20})
    return scenarios.of_vehicle(t, ["scenario"], ["x", "y"]).select("scenario", "step", "x", "y")


@query("""SELECT coalesce(g.id, p.id) AS object, coalesce(g.kind, p.kind) AS kind, coalesce(g.x, 0) AS gx, coalesce(p.x, 0) AS px, coalesce(gv, 0) AS gv, coalesce(pv, 0) AS pv FROM (SELECT part AS id, id AS kind, min(cx) AS x, min(points % 3) AS gv FROM {gt} WHERE points > 0 GROUP BY 1, 2) g
FULL JOIN (SELECT part AS id, id AS kind, min(cx + turn) AS x, min(part % 3) AS pv FROM {gt} WHERE points < 8 GROUP BY 1, 2) p ON p.id = g.id AND p.kind = g.kind""")
def padded_keypoints(spark, sf):
    """Matched objects' points side by side, with zeros for what one side lacks."""
    g = read(spark, sf, "gt_boxes")
    gt = g.where("points > 0").groupBy(_c("part").alias("id"), _c("id").alias("kind")).agg(F.min("cx").alias("gx"), F.lit(0.0).alias("gy"), F.min(_c("points") % 3).alias("gv"), F.lit(1.0).alias("scale"))
    pd_ = g.where("points < 8").groupBy(_c("part").alias("id"), _c("id").alias("kind")).agg(F.min(_c("cx") + _c("turn")).alias("px"), F.lit(0.0).alias("py"), F.min(_c("part") % 3).alias("pv"))
    match = gt.select(_c("id").alias("gt")).distinct().withColumn("pred", _c("gt"))
    return K.with_unmatched(gt, pd_, match).select(F.coalesce("gt", "pred").alias("object"), "kind", "gx", "px", "gv", "pv")


@query("SELECT 'soft_iou' AS metric, round(avg(v), 6) AS value FROM (SELECT sum(t * p) / sum(t + p - t * p) AS v FROM " + _CELLS + " GROUP BY waypoint HAVING sum(t) > 0) UNION ALL SELECT 'epe', round(avg(v), 6) FROM (SELECT avg(sqrt((tx - px) ** 2 + (ty - py) ** 2)) AS v FROM " + _CELLS + " WHERE tx <> 0 OR ty <> 0 GROUP BY waypoint)")
def occupancy_means(spark, sf):
    """Occupancy and flow metrics averaged over waypoints."""
    cells = _cells(spark, sf)
    a = O.over_waypoints(O.soft_iou(cells, ["waypoint"]), "soft_iou").select(F.lit("soft_iou").alias("metric"), r6("soft_iou").alias("value"))
    return a.union(O.over_waypoints(O.flow_error(cells, ["waypoint"]), "epe").select(F.lit("epe"), r6("epe")))


@query("SELECT frame, CAST(id AS INTEGER) - 2 AS row, CAST(part % 10 AS INTEGER) - 3 AS col, cx AS range FROM {gt} WHERE id BETWEEN 2 AND 5 AND part % 10 BETWEEN 3 AND 7")
def range_crop(spark, sf):
    px = read(spark, sf, "gt_boxes").select("frame", _c("id").cast("int").alias("row"), (_c("part") % 10).cast("int").alias("col"), _c("cx").alias("range"))
    return L.crop(px, 4, 5, 2, 3)


@query("""SELECT o_orderkey AS scenario, o_totalprice AS total, coalesce(parts, []) AS parts FROM orders LEFT JOIN (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_quantity) AS parts FROM lineitem WHERE l_tax > 0.03 GROUP BY 1) ON l_orderkey = o_orderkey""")
def scenario_augment(spark, sf):
    """Scenarios with the list of another table's rows, empty where it has none."""
    s = read(spark, sf, "orders").select(_c("o_orderkey").alias("scenario"), _c("o_totalprice").alias("total"))
    part = read(spark, sf, "lineitem").where("l_tax > 0.03").select(_c("l_orderkey").alias("scenario"), "l_partkey", "l_quantity")
    return scenarios.augment(s, part, "scenario", "parts").select("scenario", "total", F.transform("parts", lambda x: x["l_partkey"]).alias("parts"))


@query("SELECT l_orderkey AS scenario, l_partkey % 16 AS token, (l_partkey % 16) * 0.5 AS first FROM lineitem")
def token_vectors(spark, sf):
    t = read(spark, sf, "lineitem").select(_c("l_orderkey").alias("scenario"), (_c("l_partkey") % 16).alias("token"))
    book = spark.range(20).select(_c("id").alias("token"), F.array(_c("id") * 0.5, F.lit(1.0)).alias("vector"))
    return scenarios.token_vectors(t, book, 16).select("scenario", "token", F.element_at("vector", 1).alias("first"))


@query("SELECT position, nation, name FROM (VALUES (0::bigint, 7), (1, 3), (2, 24), (3, 0)) AS w(position, nation) JOIN (SELECT n_nationkey, n_name AS name FROM nation) ON nation = n_nationkey")
def strict_gather(spark, sf):
    n = read(spark, sf, "nation").select(_c("n_nationkey").alias("nation"), _c("n_name").alias("name"))
    return REL.gather(n, [7, 3, 24, 0], "nation").select("position", "nation", "name")


@query("""WITH s AS (SELECT object, step, x, y, sum(d) OVER (PARTITION BY object ORDER BY step) AS s FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM {tracks} WHERE step < 30 WINDOW w AS (PARTITION BY object ORDER BY step))),
g AS (SELECT object, lag(s) OVER w AS s0, s AS s1, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1 FROM s WINDOW w AS (PARTITION BY object ORDER BY step)),
k AS (SELECT *, unnest(range(CAST(floor(s0 / 50) + 1 AS BIGINT), CAST(floor(s1 / 50) + 1 AS BIGINT))) AS k FROM g WHERE s1 > s0)
SELECT object, 0::bigint AS k, round(x1, 5) AS x, round(y1, 5) AS y FROM g WHERE s0 IS NULL UNION ALL SELECT object, k, round(x0 + (k * 50 - s0) / (s1 - s0) * (x1 - x0), 5), round(y0 + (k * 50 - s0) / (s1 - s0) * (y1 - y0), 5) FROM k""")
def resampled_lines(spark, sf):
    """Polylines at even spacing."""
    t = read(spark, sf, "tracks").where("step < 30").select("object", _c("step").alias("position"), "x", "y")
    return scenarios.resample(t, ["object"], 50.0).select("object", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("SELECT object, step FROM (SELECT object, step, row_number() OVER (PARTITION BY object ORDER BY CASE type WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END, step) AS r FROM (SELECT object, step, 1 + event_id % 3 AS type FROM {tracks})) WHERE r <= 8")
def capped_points(spark, sf):
    """At most eight points a scenario, by the priority of their kind."""
    t = read(spark, sf, "tracks").select("object", _c("step"), (1 + _c("event_id") % 3).alias("kind"))
    return scenarios.cap_by_priority(t, ["object"], {2: 0, 1: 1}, 8, "step").select("object", "step")


@query("""WITH m AS (SELECT object, step, x FROM {tracks} WHERE valid AND step < 12), o AS (SELECT DISTINCT object FROM {tracks})
SELECT object, list(coalesce(x, -1) ORDER BY step) FILTER (step < 3) AS past, list(coalesce(x, -1) ORDER BY step) FILTER (step = 3) AS now, list(coalesce(x, -1) ORDER BY step) FILTER (step > 3) AS future
FROM (SELECT object, unnest(range(12)) AS step FROM o) LEFT JOIN m USING (object, step) GROUP BY 1""")
def scenario_states(spark, sf):
    """States by absolute step: past, current and future, padded."""
    s = scenarios.steps(read(spark, sf, "tracks"), ["object"], ["x"], past=3, future=8)
    return s.select("object", _c("past_x").alias("past"), _c("current_x").alias("now"), _c("future_x").alias("future"))


# ---- matching --------------------------------------------------------------------------------------

_IOU = """SELECT p.frame, p.type, p.id AS p, g.id AS g, p.score, g.level, greatest(0, least(p.cx + p.length / 2, g.cx + g.length / 2) - greatest(p.cx - p.length / 2, g.cx - g.length / 2)) * greatest(0, least(p.cy + p.width / 2, g.cy + g.width / 2) - greatest(p.cy - p.width / 2, g.cy - g.width / 2)) AS i,
 p.length * p.width + g.length * g.width AS u, least(p.length, p.width, g.length, g.width) AS least_side FROM {pd} p JOIN (SELECT *, CASE WHEN points <= 5 THEN 2 ELSE 1 END AS level FROM {gt} WHERE points > 0) g ON p.frame = g.frame AND p.type = g.type"""
#: all sets of disjoint pairs of a frame, type and cutoff, grown pair by pair: the heaviest is the assignment
_BEST = f"""pairs AS MATERIALIZED (SELECT frame, type, p, g, score, level, CAST(round(i / (u - i) * 1000000) AS BIGINT) AS w FROM ({_IOU}) WHERE least_side > 0.01 AND i > 0 AND round(i / (u - i), 9) >= CASE WHEN type = 1 THEN 0.7 ELSE 0.5 END),
sets AS (SELECT frame, type, cutoff, [p] AS ps, [g] AS gs, [level] AS levels, w FROM pairs, (VALUES (0.0::double), (0.3::double), (0.6::double)) AS k(cutoff) WHERE score >= cutoff
 UNION ALL SELECT s.frame, s.type, s.cutoff, list_append(ps, x.p), list_append(gs, x.g), list_append(levels, x.level), s.w + x.w FROM sets s JOIN pairs x ON x.frame = s.frame AND x.type = s.type AND x.score >= s.cutoff AND x.p > s.ps[-1] AND NOT list_contains(gs, x.g)),
best AS (SELECT frame, type, cutoff, max(len(ps)) AS n, arg_max(levels, w) AS levels, arg_max(ps, w) AS ps, arg_max(gs, w) AS gs, max(w) AS w FROM sets GROUP BY 1, 2, 3)"""


_COUNTED = f"""WITH RECURSIVE {_BEST}, m AS (SELECT frame, type, cutoff, unnest(ps) AS p, unnest(levels) AS level FROM best),
tp AS (SELECT type, cutoff, count(*) AS tp, count(*) FILTER (level = 1) AS tp1 FROM m GROUP BY 1, 2),
p AS (SELECT type, cutoff, count(*) FILTER (NOT nlz OR hit) AS made FROM (SELECT d.*, k.cutoff, EXISTS (SELECT 1 FROM m WHERE m.frame = d.frame AND m.p = d.id AND m.type = d.type AND m.cutoff = k.cutoff) AS hit FROM {{pd}} d JOIN (VALUES (0.0::double), (0.3::double), (0.6::double)) AS k(cutoff) ON d.score >= k.cutoff) GROUP BY 1, 2),
g AS (SELECT type, count(*) AS n, count(*) FILTER (points > 5) AS n1 FROM {{gt}} WHERE points > 0 GROUP BY 1),
counted AS (SELECT CAST(g.type - 1 AS INTEGER) AS shard, CAST(l AS INTEGER) AS level, k.cutoff, coalesce(tp, 0) AS tp, coalesce(made, 0) - coalesce(tp, 0) AS fp, CASE WHEN l = 2 THEN n - coalesce(tp, 0) ELSE n1 - coalesce(tp1, 0) END AS fn
FROM g CROSS JOIN (VALUES (0.0::double), (0.3::double), (0.6::double)) AS k(cutoff) CROSS JOIN (VALUES (1), (2)) AS v(l) LEFT JOIN tp ON tp.type = g.type AND tp.cutoff = k.cutoff LEFT JOIN p ON p.type = g.type AND p.cutoff = k.cutoff),
curved AS (SELECT *, CASE WHEN tp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM counted)"""


def _counted(spark, sf):
    p, g = read(spark, sf, "pd_boxes"), D.ground_truths(read(spark, sf, "gt_boxes"))
    return D.measure(p, g, [0.0, 0.3, 0.6], kind="aa")


@query(f"{_COUNTED} SELECT shard, level, cutoff, tp, fp, fn FROM counted")
def detection_counts(spark, sf):
    """Counters of optimal matching with axis-aligned overlap; the SQL tries every set of disjoint pairs."""
    return _counted(spark, sf).select("shard", "level", "cutoff", "tp", "fp", "fn")


@query(f"{_COUNTED} SELECT shard, level, cutoff, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curved")
def precision_recall_curve(spark, sf):
    """Precision and recall of one-to-one matches."""
    return D.curve(_counted(spark, sf)).select("shard", "level", "cutoff", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(f"{_COUNTED} SELECT shard, level, round(max(CASE WHEN precision > 0.75 THEN recall END), 6) AS recall FROM curved GROUP BY 1, 2")
def recall_at_precision(spark, sf):
    """The largest recall at a precision above 0.75."""
    return D.recall_at(_counted(spark, sf), 0.75).select("shard", "level", r6("recall").alias("recall"))


@query(f"""WITH RECURSIVE {_BEST.replace("(VALUES (0.0::double), (0.3::double), (0.6::double))", "(VALUES (0.0::double))")}, b AS (SELECT frame, type, sum(w) AS w, max(n) AS n FROM best GROUP BY 1, 2)
SELECT frame, type, CAST(sum(w) AS BIGINT) AS weight FROM b GROUP BY 1, 2""")
def matched_weight(spark, sf):
    """Total overlap (in millionths) of each frame and type's optimal matching."""
    p, g = read(spark, sf, "pd_boxes"), D.ground_truths(read(spark, sf, "gt_boxes"))
    # types are kept apart by frames of their own
    split = lambda d, own: d.where(own).select((_c("frame") * 8 + _c("type")).alias("frame"), "id", *D.BOX)
    m = None
    for own, least in ((_c("type") == 1, 0.7), (_c("type") != 1, 0.5)):
        one = D.match(split(p, own), split(g, own), least, "aa")
        m = one if m is None else m.union(one)
    m = m.withColumns({"type": _c("frame") % 8, "frame": F.floor(_c("frame") / 8)})
    return m.groupBy("frame", "type").agg(F.sum(F.round(_c("iou") * 1_000_000)).cast("long").alias("weight"))


@query()
def detection_evaluator(spark, sf):
    """The usual configuration: types and ranges, two levels, 101 cutoffs."""
    return D.evaluate(read(spark, sf, "pd_boxes"), read(spark, sf, "gt_boxes"))


@query()
def detection_custom_overlap(spark, sf):
    """A user's overlap: centres within two metres of each other."""
    return D.measure(read(spark, sf, "pd_boxes"), D.ground_truths(read(spark, sf, "gt_boxes")), [0.0, 0.5], iou=near_centres)


def near_centres(a, b):
    import numpy as np

    return np.clip(1 - np.hypot(a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]) / 2, 0, 1)
