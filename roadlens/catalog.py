"""All queries outside roadlens.llm, by name, and their SQL where SQL can express them.

A query is a function of (spark, sf_dir).  SQL runs in DuckDB over views of the same tables; derived
tables are the queries of ``roadlens.sources.derived`` in either engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import codecs
from roadlens.functions import geometry as G
from roadlens.naming import col
from roadlens.operators import breakdown as B
from roadlens.operators import detection as D
from roadlens.operators import keypoints as K
from roadlens.operators import lidar as L
from roadlens.operators import motion as M
from roadlens.operators import occupancy as O
from roadlens.operators import rater as R
from roadlens.operators import relational as REL
from roadlens.operators import segmentation as S
from roadlens.operators import tracking as TR
from roadlens.sources import derived, scenarios, submission

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql may name derived tables as {gt}, {pd}, {tracks}, {forecasts}."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("{gt}", f"({derived.SQL['gt_boxes']})").replace("{pd}", f"({derived.SQL['pd_boxes']})").replace("{tracks}", f"({derived.SQL['tracks']})").replace("{forecasts}", f"({derived.SQL['forecasts']})")
        return f

    return take


def read(spark, sf, name) -> DataFrame:
    return derived.read(spark, sf, name)


def r6(c):
    return F.round(c, 6)


# ---- keyed tables ----------------------------------------------------------------------------------


def _orders(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("key.customer"), F.col("o_orderkey").alias("key.order"), F.col("o_totalprice").alias("[Order].total"))


def _customers(spark, sf):
    """Every fifth customer has a key that no order has."""
    key = F.when(F.col("c_custkey") % 5 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return read(spark, sf, "customer").select(key.alias("key.customer"), F.col("c_name").alias("[Customer].name"))


def _merged(sql_join: str, **flags):
    def run(spark, sf):
        key = col("key.customer")
        orders = _orders(spark, sf).withColumn("key.customer", F.when(key % 7 == 0, -1_000_000_000 - key).otherwise(key))  # a seventh without a customer
        out = REL.merge(_customers(spark, sf), orders, **flags)
        return out.select(*(col(c).alias(n) for c, n in (("key.customer", "customer"), ("[Customer].name", "name"), ("key.order", "order_id"), ("[Order].total", "total"))))

    sql = f"""SELECT coalesce(c.c_custkey, o.o_custkey) AS customer, c_name AS name, o_orderkey AS order_id, o_totalprice AS total
FROM (SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey) FROM customer) c {sql_join} JOIN (SELECT * REPLACE (CASE WHEN o_custkey % 7 = 0 THEN -1000000000 - o_custkey ELSE o_custkey END AS o_custkey) FROM orders) o ON c.c_custkey = o.o_custkey"""
    return run, sql


for _name, _join, _flags in (("merge_inner", "INNER", {}), ("merge_left_nullable", "RIGHT", {"left_nullable": True}), ("merge_right_nullable", "LEFT", {"right_nullable": True}), ("merge_both_nullable", "FULL", {"left_nullable": True, "right_nullable": True})):
    QUERIES[_name], ORACLE[_name] = _merged(_join, **_flags)


@query("""SELECT c_custkey AS customer, c_name AS name, list(o_orderkey ORDER BY o_orderkey) AS order_ids, list(o_totalprice ORDER BY o_orderkey) AS totals
FROM (SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey) FROM customer) JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def merge_right_group(spark, sf):
    out = REL.merge(_customers(spark, sf), _orders(spark, sf), right_group=True)
    return out.select(col("key.customer").alias("customer"), col("[Customer].name").alias("name"), col("key.order").alias("order_ids"), col("[Order].total").alias("totals"))


@query("""SELECT c_custkey AS customer, c_name AS name, len(list(o_orderkey)) AS n_orders, list(o_orderkey ORDER BY o_orderkey)[1] AS first_order
FROM orders LEFT JOIN (SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey) FROM customer) ON c_custkey = o_custkey WHERE c_custkey IS NOT NULL GROUP BY 1, 2""")
def merge_left_group(spark, sf):
    out = REL.merge(_orders(spark, sf), _customers(spark, sf), left_group=True)
    return out.select(col("key.customer").alias("customer"), col("[Customer].name").alias("name"), F.size(col("key.order")).cast("long").alias("n_orders"), F.element_at(col("key.order"), 1).alias("first_order"))


@query("""SELECT o_custkey AS customer, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b USING (o_custkey)""")
def merge_product(spark, sf):
    o = _orders(spark, sf)
    a = o.select(col("key.customer").alias("key.customer"), col("key.order").alias("key.a"))
    b = o.select(col("key.customer").alias("key.customer"), col("key.order").alias("key.b"))
    return REL.merge(a, b).select(col("key.customer").alias("customer"), col("key.a").alias("a"), col("key.b").alias("b"))


@query("""SELECT n_name AS nation, r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def star_join(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key.customer"), "o_totalprice")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("key.customer"), F.col("c_nationkey").alias("key.nation"))
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("key.nation"), F.col("n_regionkey").alias("key.region"), "n_name")
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("key.region"), "r_name")
    out = REL.merge(REL.merge(REL.merge(o, c), n), r)
    return out.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT object, list(step ORDER BY step) AS step, list(x ORDER BY step) AS x FROM {tracks} GROUP BY object")
def group_to_lists(spark, sf):
    return REL.group_to_lists(read(spark, sf, "tracks").select("object", "step", "x"), ["object"])


@query("SELECT DISTINCT frame, type FROM {gt}")
def unique_ids(spark, sf):
    return read(spark, sf, "gt_boxes").select("frame", "type").distinct()


@query("SELECT frame, id, cx, cy, length FROM {gt}")
def nest_and_flatten(spark, sf):
    flat = read(spark, sf, "gt_boxes").select("frame", "id", F.col("cx").alias("box.center.x"), F.col("cy").alias("box.center.y"), F.col("length").alias("box.size.x"))
    back = REL.flatten(REL.nest(flat))
    return back.select("frame", "id", col("box.center.x").alias("cx"), col("box.center.y").alias("cy"), col("box.size.x").alias("length"))


@query("SELECT DISTINCT frame, id FROM {gt} g WHERE NOT EXISTS (SELECT 1 FROM {pd} p WHERE p.frame = g.frame AND p.id = g.id)")
def missing_ids(spark, sf):
    return REL.missing_ids(read(spark, sf, "gt_boxes"), read(spark, sf, "pd_boxes"), ["frame", "id"])


@query("""SELECT frame, coalesce(n_pd, 0) AS n_pd, coalesce(n_gt, 0) AS n_gt FROM (SELECT frame, count(*) AS n_pd FROM {pd} GROUP BY 1)
FULL JOIN (SELECT CASE WHEN frame % 3 = 0 THEN -frame ELSE frame END AS frame, count(*) AS n_gt FROM {gt} GROUP BY 1) USING (frame)""")
def cogroup_frames(spark, sf):
    a = read(spark, sf, "pd_boxes").select("frame", "id", "score")
    b = read(spark, sf, "gt_boxes").select(F.when(F.col("frame") % 3 == 0, -F.col("frame")).otherwise(F.col("frame")).alias("frame"), "id", "cx")
    return REL.cogroup_frames(a, b, ["frame"], ["id"]).select("frame", F.size("left").cast("long").alias("n_pd"), F.size("right").cast("long").alias("n_gt"))


@query("SELECT frame, id, o_custkey AS customer FROM {gt} JOIN orders ON frame = o_orderkey")
def fail_fast_join(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("customer"))
    g = read(spark, sf, "gt_boxes").select("frame", "id").join(o.select("frame"), "frame", "left_semi")
    return REL.require_all(g, o, ["frame"], "no scenario").select("frame", "id", "customer")


# ---- boxes and detection ---------------------------------------------------------------------------

_AA = """CASE WHEN least(p.length, p.width, g.length, g.width) > 0.01 THEN greatest(0, least(1, i / (p.length * p.width + g.length * g.width - i))) ELSE 0 END"""
_PAIRS = f"""(SELECT frame, type, pd, gt, iou FROM (SELECT p.frame, p.type, p.id AS pd, g.id AS gt, round({_AA.replace(' i /', ' (x * y) /').replace('- i)', '- x * y)')}, 6) AS iou FROM
(SELECT p.*, g.id AS gid, greatest(0, least(p.cx + p.length / 2, g.cx + g.length / 2) - greatest(p.cx - p.length / 2, g.cx - g.length / 2)) AS x,
 greatest(0, least(p.cy + p.width / 2, g.cy + g.width / 2) - greatest(p.cy - p.width / 2, g.cy - g.width / 2)) AS y
 FROM {{pd}} p JOIN {{gt}} g ON p.frame = g.frame AND p.type = g.type) p JOIN {{gt}} g ON g.frame = p.frame AND g.id = p.gid) WHERE iou > 0)"""
_THR = "CASE WHEN type = 1 THEN 0.7 ELSE 0.5 END"


def _pairs(spark, sf):
    return D.pairs(read(spark, sf, "pd_boxes"), read(spark, sf, "gt_boxes"))


@query(f"SELECT * FROM {_PAIRS}")
def iou_pairs(spark, sf):
    return _pairs(spark, sf)


@query(f"""WITH m AS (SELECT type, gt, arg_min(iou, (-iou, pd)) AS iou FROM {_PAIRS} WHERE iou >= {_THR} GROUP BY frame, type, gt)
SELECT g.type, count(m.iou) AS tp, any_value(p.n) AS predictions, any_value(g.n) AS truths, round(count(m.iou) / any_value(p.n), 6) AS precision, round(count(m.iou) / any_value(g.n), 6) AS recall, round(avg(m.iou), 6) AS mean_iou
FROM (SELECT type, count(*) AS n FROM {{gt}} GROUP BY 1) g JOIN (SELECT type, count(*) AS n FROM {{pd}} GROUP BY 1) p ON p.type = g.type LEFT JOIN m ON m.type = g.type GROUP BY g.type""")
def merge_iou_precision_recall(spark, sf):
    m = D.best_per_gt(_pairs(spark, sf), D.threshold(F.col("type")))
    hit = m.groupBy("type").agg(F.count("iou").alias("tp"), F.avg("iou").alias("mean"))
    g = read(spark, sf, "gt_boxes").groupBy("type").agg(F.count(F.lit(1)).alias("truths"))
    p = read(spark, sf, "pd_boxes").groupBy("type").agg(F.count(F.lit(1)).alias("predictions"))
    j = g.join(p, "type").join(hit, "type", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return j.select("type", "tp", "predictions", "truths", r6(F.col("tp") / F.col("predictions")).alias("precision"), r6(F.col("tp") / F.col("truths")).alias("recall"), r6("mean").alias("mean_iou"))


@query(f"SELECT frame, pd, arg_max(gt, (iou, gt)) AS gt, max(iou) AS iou FROM {_PAIRS} WHERE iou >= 0.01 GROUP BY frame, pd")
def largest_overlap(spark, sf):
    return D.largest_overlap(_pairs(spark, sf))


@query("""SELECT frame, id, coalesce(arg_min(sx, (d, gid)), 0) AS speed_x, coalesce(arg_min(sy, (d, gid)), 0) AS speed_y FROM (
SELECT p.frame, p.id, g.id AS gid, g.speed_x AS sx, g.speed_y AS sy, sqrt((p.cx - g.cx) ** 2 + (p.cy - g.cy) ** 2 + (p.cz - g.cz) ** 2) AS d
FROM {pd} p LEFT JOIN (SELECT * REPLACE (CASE WHEN frame % 4 = 0 THEN -frame ELSE frame END AS frame) FROM {gt}) g ON p.frame = g.frame) GROUP BY frame, id""")
def nearest_speed(spark, sf):
    frame = F.when(F.col("frame") % 4 == 0, -F.col("frame")).otherwise(F.col("frame"))  # every fourth frame of predictions has no truth
    return D.nearest_speed(read(spark, sf, "pd_boxes"), read(spark, sf, "gt_boxes").withColumn("frame", frame)).select("frame", "id", "speed_x", "speed_y")


@query("SELECT frame, id, CAST(CASE WHEN points <= 5 THEN 2 ELSE 1 END AS INTEGER) AS level FROM {gt} WHERE points > 0")
def ground_truth_levels(spark, sf):
    return D.ground_truths(read(spark, sf, "gt_boxes")).select("frame", "id", "level")


@query("""SELECT cutoff, count(*) AS n FROM {pd} JOIN (VALUES (0.0::double), (0.25::double), (0.5::double), (0.75::double), (1.0::double)) c(cutoff) ON score >= cutoff GROUP BY 1""")
def score_cutoffs(spark, sf):
    return D.above_cutoffs(read(spark, sf, "pd_boxes").select("score"), [0.0, 0.25, 0.5, 0.75, 1.0]).groupBy("cutoff").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rank, count(*) OVER () AS n FROM {pd}),
b AS (SELECT i, n // 10 * i + least(i, n % 10) AS place FROM (SELECT unnest(range(10)) AS i) CROSS JOIN (SELECT any_value(n) AS n FROM s))
SELECT CAST(i AS INTEGER) AS position, score AS cutoff FROM b JOIN s ON rank = place UNION ALL SELECT 10, 1.0""")
def estimated_cutoffs(spark, sf):
    return D.estimate_cutoffs(read(spark, sf, "pd_boxes").select("score"), 11)


_SHARDS = """SELECT 'OBJECT_TYPE' AS generator, type - 1 AS shard FROM {gt} UNION ALL SELECT 'ONE_SHARD', 0 FROM {gt} UNION ALL SELECT 'ALL_BUT_SIGN', CASE WHEN type = 3 THEN 1 ELSE 0 END FROM {gt}
UNION ALL SELECT 'RANGE', 3 * (type - 1) + CASE WHEN sqrt(cx * cx + cy * cy + cz * cz) < 30 THEN 0 WHEN sqrt(cx * cx + cy * cy + cz * cz) < 50 THEN 1 ELSE 2 END FROM {gt}
UNION ALL SELECT 'SIZE', 2 * (type - 1) + CASE WHEN greatest(length, width, height) < 7 THEN 0 ELSE 1 END FROM {gt}
UNION ALL SELECT 'VELOCITY', 5 * (type - 1) + k FROM {gt} CROSS JOIN (SELECT unnest(range(5)) AS k)
UNION ALL SELECT 'CAMERA', 5 * (type - 1) + c - 1 FROM {gt} JOIN (VALUES (1, 0.0), (2, 45.0), (3, -45.0), (4, 90.0), (5, -90.0)) cam(c, a) ON abs(degrees(atan2(cy, cx)) - a) <= 25.2"""


@query(f"SELECT generator, CAST(shard AS INTEGER) AS shard, count(*) AS n FROM ({_SHARDS}) GROUP BY 1, 2")
def breakdown_shards(spark, sf):
    every = ["ONE_SHARD", "ALL_BUT_SIGN", "OBJECT_TYPE", "RANGE", "SIZE", "VELOCITY", "CAMERA"]
    return B.explode_shards(read(spark, sf, "gt_boxes"), every).groupBy("generator", "shard").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT type, round(avg(greatest(0, least(1, 1 - abs(d - 2 * pi() * floor((d + pi()) / (2 * pi()))) / pi()))), 6) AS accuracy
FROM (SELECT g.type, p.heading - g.heading AS d FROM {pd} p JOIN {gt} g ON p.frame = g.frame AND p.id = g.id) GROUP BY 1""")
def heading_accuracy(spark, sf):
    g = read(spark, sf, "gt_boxes").select("frame", "id", "type", F.col("heading").alias("gh"))
    j = read(spark, sf, "pd_boxes").select("frame", "id", "heading").join(g, ["frame", "id"])
    return j.groupBy("type").agg(r6(F.avg(G.heading_accuracy(F.col("heading"), F.col("gh")))).alias("accuracy"))


@query("""WITH j AS (SELECT g.type, p.cx - 1.43 AS px, p.cy AS py, p.cz - 2.18 AS pz, g.cx - 1.43 AS gx, g.cy AS gy, g.cz - 2.18 AS gz FROM {pd} p JOIN {gt} g ON p.frame = g.frame AND p.id = g.id),
n AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS rp, sqrt(gx * gx + gy * gy + gz * gz) AS rg FROM j)
SELECT type, round(avg(greatest(0, least(1, 1 - abs(((gx * px + gy * py + gz * pz) / rg - rg) / greatest(0.1 * rg, 0.5))))), 6) AS affinity FROM n GROUP BY 1""")
def longitudinal_affinity(spark, sf):
    g = read(spark, sf, "gt_boxes").select("frame", "id", "type", *(F.col(f"c{a}").alias(f"g{a}") for a in "xyz"))
    j = read(spark, sf, "pd_boxes").select("frame", "id", "cx", "cy", "cz").join(g, ["frame", "id"])
    a = G.let_affinity(*(F.col(c) for c in ("cx", "cy", "cz", "gx", "gy", "gz")))
    return j.groupBy("type").agg(r6(F.avg(a)).alias("affinity"))


def _boxes(spark, sf):
    return read(spark, sf, "pd_boxes"), D.ground_truths(read(spark, sf, "gt_boxes"))


@query()
def detection_hungarian(spark, sf):
    """AP, APH, APL by optimal assignment over two breakdowns, levels 1 and 2; detection_counts has its counters in SQL."""
    p, g = _boxes(spark, sf)
    return D.metrics(D.measure(p, g, [i / 10 for i in range(11)], ("OBJECT_TYPE", "RANGE")))


@query()
def detection_velocity_breakdown(spark, sf):
    p, g = _boxes(spark, sf)
    return D.measure(p, g, [0.0, 0.5], ("VELOCITY",))


@query()
def detection_score_first(spark, sf):
    p, g = _boxes(spark, sf)
    return D.metrics(D.measure(p, g, [i / 10 for i in range(11)], matcher="score_first"))


@query()
def detection_let(spark, sf):
    p, g = _boxes(spark, sf)
    return D.metrics(D.measure(p, g, [0.0, 0.5, 1.0], thresholds={1: 0.5, 2: 0.3, 3: 0.3, 4: 0.3}, let=D.LET))


@query()
def tracking_mot(spark, sf):
    """MOTA and MOTP of boxes seen as scenes of eight frames; tested against hand-made cases."""
    p, g = _boxes(spark, sf)
    scene = [(F.col("frame") / 8).cast("long").alias("scene"), (F.col("type") - 1).alias("shard")]
    return TR.metrics(TR.measure(p.select("*", *scene), g.select("*", *scene), [0.0, 0.5, 0.9]))


@query("SELECT frame, id, score, greatest(length, 0.000001) AS length FROM {pd} WHERE score >= 0.03")
def submission_clean(spark, sf):
    return submission.clean(read(spark, sf, "pd_boxes")).select("frame", "id", "score", "length")


@query()
def submission_consistency(spark, sf):
    p = read(spark, sf, "pd_boxes")
    return submission.consistent(p, p.where("id % 50 <> 0").withColumn("score", F.col("score") + 0.01))


# ---- points, grids, segmentation -------------------------------------------------------------------

_POINTS = """(SELECT frame, id AS point, cx + 0.3 AS x, cy - 0.2 AS y, 0.5 AS z FROM {gt})"""


def _points(spark, sf):
    return read(spark, sf, "gt_boxes").select("frame", F.col("id").alias("point"), (F.col("cx") + 0.3).alias("x"), (F.col("cy") - 0.2).alias("y"), F.lit(0.5).alias("z"))


@query(f"""SELECT b.frame, b.id AS box, count(p.point) AS points FROM {{gt}} b LEFT JOIN {_POINTS} p ON p.frame = b.frame
AND abs(cos(-b.heading) * (x - cx) - sin(-b.heading) * (y - cy)) <= length / 2 AND abs(sin(-b.heading) * (x - cx) + cos(-b.heading) * (y - cy)) <= width / 2 AND abs(z - cz) <= height / 2 AND length > 0 GROUP BY 1, 2""")
def points_in_boxes(spark, sf):
    return L.points_in_boxes(_points(spark, sf), read(spark, sf, "gt_boxes"))


@query("""SELECT p.frame, p.id AS a, g.id AS b FROM {pd} p JOIN {gt} g ON p.frame = g.frame AND p.cx - p.length / 2 <= g.cx + g.length / 2 AND g.cx - g.length / 2 <= p.cx + p.length / 2
AND p.cy - p.width / 2 <= g.cy + g.width / 2 AND g.cy - g.width / 2 <= p.cy + p.width / 2""")
def overlapping_boxes(spark, sf):
    return L.overlapping_boxes(read(spark, sf, "pd_boxes"), read(spark, sf, "gt_boxes"))


@query("""WITH p AS (SELECT quality AS gt, CASE WHEN doc_id % 9 = 0 THEN 7 ELSE toxic END AS pred FROM labels), k AS (SELECT unnest([0, 1]) AS class)
SELECT class, count(*) FILTER (gt = class AND pred = class) AS intersection, count(*) FILTER (gt = class OR (pred = class AND gt IN (0, 1))) AS "union",
round(count(*) FILTER (gt = class AND pred = class) / count(*) FILTER (gt = class OR (pred = class AND gt IN (0, 1))), 6) AS iou FROM p CROSS JOIN k GROUP BY 1""")
def segmentation_iou(spark, sf):
    p = read(spark, sf, "labels").select(F.col("quality").alias("gt"), F.when(F.col("doc_id") % 9 == 0, F.lit(7)).otherwise(F.col("toxic")).alias("pred"))
    return S.class_iou(S.confusion(p, [0, 1]), [0, 1]).withColumn("iou", r6("iou"))


@query("""SELECT doc_id AS frame, quality AS gt, coalesce(pred, 0) AS pred FROM labels LEFT JOIN (SELECT doc_id, toxic AS pred FROM labels WHERE doc_id % 3 = 0) USING (doc_id)""")
def segmentation_default_fill(spark, sf):
    y = read(spark, sf, "labels")
    gt = y.select(F.col("doc_id").alias("frame"), F.col("quality").alias("gt"))
    return S.align_frames(gt, y.where("doc_id % 3 = 0").select(F.col("doc_id").alias("frame"), F.col("toxic").alias("pred")), ["frame"])


@query("""SELECT l_orderkey AS frame, l_partkey % 20 AS semantic, l_suppkey % 50 AS instance, (l_partkey % 20) * 1000 + l_suppkey % 50 AS label FROM lineitem""")
def panoptic_labels(spark, sf):
    d = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), S.encode_panoptic(F.col("l_partkey") % 20, F.col("l_suppkey") % 50, 1000).alias("label"))
    sem, ins = S.decode_panoptic(F.col("label"), 1000)
    return d.select("frame", sem.alias("semantic"), ins.alias("instance"), "label")


@query("""SELECT frame, semantic, instance, CASE WHEN instance > 0 THEN dense_rank() OVER (PARTITION BY frame, semantic, instance > 0 ORDER BY instance) ELSE 0 END AS local
FROM (SELECT l_orderkey AS frame, l_partkey % 20 AS semantic, l_suppkey % 50 AS instance FROM lineitem)""")
def panoptic_relabel(spark, sf):
    d = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 20).alias("semantic"), (F.col("l_suppkey") % 50).alias("instance"))
    return S.relabel(d)[0].select("frame", "semantic", "instance", "local")


@query("""SELECT frame, "row", col FROM (SELECT frame % 8 AS frame, CAST(floor(-y * 3.2 + 0.5) + 192 AS INTEGER) AS "row", CAST(floor(x * 3.2 + 0.5) + 128 AS INTEGER) AS col FROM """ + _POINTS + """)
WHERE "row" BETWEEN 0 AND 255 AND col BETWEEN 0 AND 255 GROUP BY ALL""")
def occupancy_grid(spark, sf):
    p = _points(spark, sf).withColumn("frame", F.col("frame") % 8)
    return O.rasterise(p, ["frame"]).select("frame", "row", "col")


_CELLS = "(SELECT frame % 8 AS waypoint, abs(discount) * 10 AS p, CASE WHEN type = 2 THEN 1.0 ELSE 0.0 END AS t, cx - 20 AS tx, cy - 20 AS ty, cx - 20.5 AS px, cy - 19 AS py FROM {gt})"


def _cells(spark, sf):
    c = F.col
    return read(spark, sf, "gt_boxes").select((c("frame") % 8).alias("waypoint"), (F.abs("discount") * 10).alias("p"), F.when(c("type") == 2, F.lit(1.0)).otherwise(F.lit(0.0)).alias("t"), (c("cx") - 20).alias("tx"), (c("cy") - 20).alias("ty"), (c("cx") - 20.5).alias("px"), (c("cy") - 19).alias("py"))


@query(f"SELECT waypoint, round(sum(t * p) / sum(t + p - t * p), 6) AS soft_iou FROM {_CELLS} GROUP BY 1 HAVING sum(t) > 0")
def occupancy_soft_iou(spark, sf):
    return O.soft_iou(_cells(spark, sf), ["waypoint"]).withColumn("soft_iou", r6("soft_iou"))


@query(f"SELECT waypoint, round(avg(sqrt((tx - px) ** 2 + (ty - py) ** 2)), 6) AS epe FROM {_CELLS} WHERE tx <> 0 OR ty <> 0 GROUP BY 1")
def occupancy_flow_error(spark, sf):
    return O.flow_error(_cells(spark, sf), ["waypoint"]).withColumn("epe", r6("epe"))


@query(f"""WITH b AS (SELECT waypoint, least(floor(p * 99), 99) AS b, count(*) FILTER (t > 0.5) AS pos, count(*) AS n FROM {_CELLS} GROUP BY 1, 2),
r AS (SELECT waypoint, b, sum(pos) OVER w AS tp, sum(n) OVER w AS made, sum(pos) OVER (PARTITION BY waypoint) AS total FROM b WINDOW w AS (PARTITION BY waypoint ORDER BY b DESC)),
q AS (SELECT waypoint, b, tp / made AS p, tp / total AS r FROM r WHERE total > 0), s AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY waypoint ORDER BY b DESC), 0) AS r0, coalesce(lag(p) OVER (PARTITION BY waypoint ORDER BY b DESC), p) AS p0 FROM q)
SELECT waypoint, round(sum((r - r0) * (p + p0) / 2), 6) AS auc FROM s GROUP BY 1""")
def occupancy_auc(spark, sf):
    return O.auc(_cells(spark, sf), ["waypoint"]).withColumn("auc", r6("auc"))


@query("""SELECT frame, camera, v, u, arg_min(distance, (o, distance)) AS depth FROM (
SELECT frame % 16 AS frame, id % 6 AS camera, CAST(cy AS INTEGER) AS v, CAST(cx AS INTEGER) AS u, 1 AS o, length + width AS distance FROM {gt}
UNION ALL SELECT frame % 16, part % 6, CAST(cy AS INTEGER), CAST(cx AS INTEGER), 2, length + width FROM {gt}) WHERE camera > 0 GROUP BY ALL""")
def depth_image(spark, sf):
    c = F.col
    p = read(spark, sf, "gt_boxes").select((c("frame") % 16).alias("frame"), (c("id") % 6).alias("camera1"), (c("part") % 6).alias("camera2"), *(c("cy").cast("int").alias(f"v{i}") for i in (1, 2)), *(c("cx").cast("int").alias(f"u{i}") for i in (1, 2)), (c("length") + c("width")).alias("distance"))
    return L.depth_image(p, ["frame"])


@query("""SELECT vec_id, count(*) AS n, round(sum(x), 4) AS x, round(sum(z), 4) AS z FROM (SELECT vec_id, r, (i - 1) // 8 AS "row", (i - 1) % 8 AS col,
r * cos(-0.3 + (7 - (i - 1) // 8 + 0.5) / 8 * 0.4) * cos(((8 - (i - 1) % 8 - 0.5) / 8 * 2 - 1) * pi()) AS x, r * sin(-0.3 + (7 - (i - 1) // 8 + 0.5) / 8 * 0.4) AS z
FROM (SELECT vec_id, unnest(embedding)::double AS r, unnest(range(1, 65)) AS i FROM embeddings WHERE embedding IS NOT NULL)) WHERE r > 0 GROUP BY 1""")
def range_image_points(spark, sf):
    e = read(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("values"), F.array(F.lit(8), F.lit(8), F.lit(1)).alias("shape"))
    px = L.pixels(e, "values", "shape", ["range"], ["vec_id"])
    return L.point_cloud(px, 8, 8, -0.3, 0.1).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("z"), 4).alias("z"))


@query("""SELECT frame, id, CAST(floor(cx / 0.00585532144 + 0.5) AS BIGINT) AS steps, part % 65536 AS intensity, points AS elongation FROM {gt}""")
def packed_lidar_features(spark, sf):
    d = read(spark, sf, "gt_boxes").select("frame", "id", L.pack_feature(L.pack_range(F.col("cx")), F.col("part") % 65536, F.col("points")).alias("packed"))
    a, b, c = L.unpack_feature(F.col("packed"))
    return d.select("frame", "id", a.alias("steps"), b.alias("intensity"), c.alias("elongation"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(round(x::double / 0.01) * 0.01, 4) + 0.0) AS decoded FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL")
def delta_codec(spark, sf):
    e = read(spark, sf, "embeddings").where("embedding is not null and label is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    back = e.select("vec_id", codecs.decode(codecs.encode("v", F.lit(0.01))).alias("d"))
    return back.select("vec_id", F.transform("d", lambda x: F.round(x, 4) + F.lit(0.0)).alias("decoded"))


# ---- motion, keypoints, planning -------------------------------------------------------------------

_ALIGNED = """(SELECT f.object, f.joint, f.step, f.confidence, CASE WHEN t.valid THEN sqrt((f.x - t.x) ** 2 + (f.y - t.y) ** 2) END AS error,
CASE WHEN t.valid THEN (f.y - t.y) * cos(t.heading) - (f.x - t.x) * sin(t.heading) END AS side_err, CASE WHEN t.valid THEN (f.x - t.x) * cos(t.heading) + (f.y - t.y) * sin(t.heading) END AS longitudinal
FROM (SELECT * FROM {forecasts} WHERE step < 16) f JOIN {tracks} t ON t.object = f.object AND t.step = f.step + 6)"""
_SCALE = "CASE WHEN v < 1.4 THEN 0.5 WHEN v > 11 THEN 1.0 ELSE 0.5 + 0.5 * (v - 1.4) / 9.6 END"
_MATCH = f"""(SELECT a.object, joint, step AS horizon, any_value(confidence) AS confidence, CASE WHEN count(side_err) = count(*) THEN bool_and(abs(side_err / scale) <= lat AND abs(longitudinal / scale) <= lon) END AS match
FROM {_ALIGNED} a JOIN (VALUES (5, 1.0, 2.0), (9, 1.8, 3.6), (15, 3.0, 6.0)) k(horizon, lat, lon) ON a.step = k.horizon JOIN (SELECT object, {_SCALE} AS scale FROM (SELECT object, sqrt(vx * vx + vy * vy) AS v FROM {{tracks}} WHERE step = 5)) s ON s.object = a.object GROUP BY ALL)"""


def _motion(spark, sf):
    t = read(spark, sf, "tracks").withColumn("scenario", F.col("object"))
    f = read(spark, sf, "forecasts").where("step < 16").withColumns({"scenario": F.col("object"), "group": F.col("object")})
    return t, M.aligned(f, t, history=5, ratio=1)


@query(f"""WITH o AS (SELECT object, joint, horizon, avg(error) AS ade, max(CASE WHEN step = horizon THEN error END) AS fde FROM {_ALIGNED} a JOIN (SELECT unnest([5, 9, 15]) AS horizon) k ON step <= horizon GROUP BY ALL)
SELECT object, horizon, round(min(ade), 6) AS min_ade, round(min(fde), 6) AS min_fde FROM o GROUP BY 1, 2""")
def motion_displacement(spark, sf):
    _, p = _motion(spark, sf)
    return M.displacement(p, [5, 9, 15]).select(F.col("scenario").alias("object"), F.col("at").alias("horizon"), r6("min_ade").alias("min_ade"), r6("min_fde").alias("min_fde"))


@query(f"SELECT object, CAST(horizon AS INTEGER) AS horizon, CAST(CASE WHEN count(match) = 0 THEN NULL WHEN bool_or(match) THEN 0 ELSE 1 END AS INTEGER) AS miss FROM {_MATCH} GROUP BY 1, 2")
def motion_miss_rate(spark, sf):
    t, p = _motion(spark, sf)
    return M.miss_rate(M.matches(p, t, history=5)).select(F.col("scenario").alias("object"), F.col("at").alias("horizon"), "miss")


_SHAPE = """(WITH s AS (SELECT * FROM {tracks} WHERE step = 5 AND valid), e AS (SELECT object, arg_max(x, step) AS x, arg_max(y, step) AS y, arg_max(heading, step) AS heading, arg_max(vx, step) AS vx, arg_max(vy, step) AS vy FROM {tracks} WHERE step > 5 AND valid GROUP BY 1),
j AS (SELECT s.object, (e.x - s.x) AS dx0, (e.y - s.y) AS dy0, (e.x - s.x) * cos(s.heading) + (e.y - s.y) * sin(s.heading) AS dx, (e.y - s.y) * cos(s.heading) - (e.x - s.x) * sin(s.heading) AS dy,
 e.heading - s.heading - 2 * pi() * floor((e.heading - s.heading + pi()) / (2 * pi())) AS turn, greatest(sqrt(s.vx ** 2 + s.vy ** 2), sqrt(e.vx ** 2 + e.vy ** 2)) AS speed FROM s JOIN e ON s.object = e.object),
k AS (SELECT object, CASE WHEN speed < 2 AND sqrt(dx0 * dx0 + dy0 * dy0) < 3 THEN 0 WHEN abs(turn) < pi() / 6 AND abs(dy) < 2.5 THEN 1 WHEN abs(turn) < pi() / 6 AND dy < 0 THEN 3 WHEN abs(turn) < pi() / 6 THEN 2
 WHEN dy < 0 AND dx < 0 THEN 6 WHEN dy < 0 THEN 7 WHEN dx < 0 THEN 4 ELSE 5 END AS shape FROM j) SELECT o.object, CAST(shape AS INTEGER) AS shape FROM (SELECT DISTINCT object FROM {tracks}) o LEFT JOIN k ON k.object = o.object)"""


@query(f"SELECT * FROM {_SHAPE}")
def motion_shapes(spark, sf):
    t, _ = _motion(spark, sf)
    return M.shape(t, history=5).select("object", "shape")


def _map(soft: str) -> str:
    return f"""WITH m AS (SELECT * FROM {_MATCH} WHERE match IS NOT NULL), s AS (SELECT m.*, CASE WHEN shape = 6 THEN 7 ELSE shape END AS shape, coalesce(max(match::int) OVER (PARTITION BY m.object, horizon ORDER BY confidence DESC, joint ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e
FROM m JOIN {_SHAPE} h ON h.object = m.object WHERE shape IS NOT NULL), t AS (SELECT object, horizon, shape, confidence, match AND e = 0 AS tp FROM s {soft}),
r AS (SELECT horizon, shape, tp, row_number() OVER w AS made, sum(tp::int) OVER w AS hits FROM t WINDOW w AS (PARTITION BY horizon, shape ORDER BY confidence DESC, tp ROWS UNBOUNDED PRECEDING)),
b AS (SELECT horizon, shape, tp, max(hits / made) OVER (PARTITION BY horizon, shape ORDER BY made DESC ROWS UNBOUNDED PRECEDING) AS best FROM r),
a AS (SELECT b.horizon, b.shape, sum(CASE WHEN tp THEN best ELSE 0 END) / any_value(n) AS ap FROM b JOIN (SELECT horizon, shape, count(DISTINCT object) AS n FROM t GROUP BY 1, 2) g ON g.horizon = b.horizon AND g.shape = b.shape GROUP BY 1, 2)
SELECT CAST(horizon AS INTEGER) AS horizon, round(avg(ap), 6) AS map FROM a GROUP BY 1"""


def _mean_ap(spark, sf, soft):
    t, p = _motion(spark, sf)
    shapes = M.shape(t, history=5).select("scenario", F.col("object").alias("group"), "shape")
    return M.average_precision(M.samples(M.matches(p, t, history=5), shapes, soft)).select(F.col("at").alias("horizon"), r6("map").alias("map"))


@query(_map(""))
def motion_map(spark, sf):
    return _mean_ap(spark, sf, False)


@query(_map("WHERE NOT (match AND e = 1)"))
def motion_soft_map(spark, sf):
    return _mean_ap(spark, sf, True)


@query("""SELECT object, step, round((lead(x) OVER w - lag(x) OVER w) / 0.2, 6) AS speed, last_value(CASE WHEN vx > 2 THEN heading END IGNORE NULLS) OVER (PARTITION BY object ORDER BY step ROWS UNBOUNDED PRECEDING) AS moving_heading
FROM {tracks} WINDOW w AS (PARTITION BY object ORDER BY step)""")
def track_kinematics(spark, sf):
    t = read(spark, sf, "tracks").withColumn("scenario", F.col("object"))
    return t.select("object", "step", r6(M.central_difference(t, "x")).alias("speed"), M.carry_forward(t, F.col("vx") > 2, F.col("heading")).alias("moving_heading"))


@query("""WITH t AS (SELECT *, object % 20 AS scenario, object < 20 AS is_sdc FROM {tracks}), s AS (SELECT scenario, x AS sx, y AS sy FROM t WHERE is_sdc AND step = 5),
o AS (SELECT scenario, object, max(CASE WHEN step = 5 AND valid THEN x END) AS x, max(CASE WHEN step = 5 AND valid THEN y END) AS y, sum(valid::int) AS n FROM t GROUP BY 1, 2)
SELECT scenario, object, CAST(rank AS INTEGER) AS rank FROM (SELECT o.scenario, object, row_number() OVER (PARTITION BY o.scenario ORDER BY x IS NULL, sqrt((x - sx) ** 2 + (y - sy) ** 2) NULLS LAST, n DESC, object) AS rank FROM o LEFT JOIN s ON s.scenario = o.scenario) WHERE rank <= 6""")
def context_agents(spark, sf):
    t = read(spark, sf, "tracks").withColumns({"scenario": F.col("object") % 20, "is_sdc": F.col("object") < 20})
    return M.context_agents(t, most=6, history=5)


@query("""SELECT object, list_concat(list(x ORDER BY step), list_transform(range(20), lambda i: -1.0::double))[1:20] AS x FROM {tracks} WHERE step < 20 GROUP BY 1""")
def padded_tracks(spark, sf):
    return scenarios.padded(read(spark, sf, "tracks"), ["object"], "step", ["x"], 20)


_KEYPOINTS = "(SELECT frame AS obj, part % 14 AS kind, cx AS gx, cy AS gy, cx + turn AS px, cy + discount AS py, points % 3 AS gv, part % 3 AS pv, length + 1 AS scale, cx + 1 AS ux, cy AS uy, length / 4 AS sx, CASE WHEN points = 0 THEN 0 ELSE width END AS sy FROM {gt})"


def _keypoints(spark, sf):
    c = F.col
    return read(spark, sf, "gt_boxes").select(c("frame").alias("id"), (c("part") % 14).alias("kind"), c("cx").alias("gx"), c("cy").alias("gy"), (c("cx") + c("turn")).alias("px"), (c("cy") + c("discount")).alias("py"), (c("points") % 3).alias("gv"), (c("part") % 3).alias("pv"), (c("length") + 1).alias("scale"), (c("cx") + 1).alias("bx"), c("cy").alias("by"), (c("length") / 4).alias("sx"), F.when(c("points") == 0, 0.0).otherwise(c("width")).alias("sy"))


_E = "sqrt((gx - px) ** 2 + (gy - py) ** 2)"


_BOTH = "gv > 0 AND pv > 0"
_OUT = "pow(greatest(abs(px - ux) - 1.5 * sx, 0), 2) + pow(greatest(abs(py - uy) - 1.5 * sy, 0), 2)"


def _oks(sigma: str) -> str:
    wide = f"(2 * pow(scale * 2 * {sigma}, 2))"
    return f"""CASE WHEN max(gv) > 0 THEN coalesce(avg(exp(-pow({_E}, 2) / {wide})) FILTER ({_BOTH}), 0) ELSE avg(exp(-({_OUT}) / {wide})) END"""


@query(f"SELECT obj AS id, round({_oks('CASE WHEN kind = 1 THEN 0.08 ELSE 0.05 END')}, 6) AS oks FROM {_KEYPOINTS} GROUP BY 1")
def keypoint_oks(spark, sf):
    return K.oks(_keypoints(spark, sf), {1: 0.08}).select("id", r6("oks").alias("oks"))


@query(f"""SELECT level, round(avg((oks > level)::int) FILTER (valid), 6) AS precision FROM (SELECT obj, {_oks('0.05')} AS oks, max(greatest(sx, sy)) > 1e-5 AS valid FROM {_KEYPOINTS} GROUP BY 1)
CROSS JOIN (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double AS level) GROUP BY 1""")
def keypoint_ap(spark, sf):
    return K.average_precision(K.oks(_keypoints(spark, sf), {})).withColumn("precision", r6("precision"))


@query(f"SELECT kind, round(coalesce(avg({_E}) FILTER ({_BOTH}), 0), 6) AS mpjpe FROM {_KEYPOINTS} GROUP BY 1")
def keypoint_mpjpe(spark, sf):
    return K.mpjpe(_keypoints(spark, sf), ["kind"]).withColumn("mpjpe", r6("mpjpe"))


@query(f"SELECT round(sum(CASE WHEN gv > 0 AND pv > 0 THEN {_E} WHEN (gv > 0) <> (pv > 0) THEN 0.25 ELSE 0 END) / count(*) FILTER (gv > 0 OR pv > 0), 6) AS pem FROM {_KEYPOINTS}")
def keypoint_pem(spark, sf):
    return K.pem(_keypoints(spark, sf)).withColumn("pem", r6("pem"))


@query(f"SELECT round(count(*) FILTER (gv = 2 AND pv = 2) / count(*) FILTER (pv = 2), 6) AS precision, round(count(*) FILTER (gv = 2 AND pv = 2) / count(*) FILTER (gv = 2), 6) AS recall FROM {_KEYPOINTS}")
def keypoint_visibility(spark, sf):
    return K.visibility(_keypoints(spark, sf)).select(r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(f"SELECT threshold, round(avg(({_E} / scale <= threshold)::int), 6) AS pck FROM {_KEYPOINTS} CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2])::double AS threshold) WHERE {_BOTH} GROUP BY 1")
def keypoint_pck(spark, sf):
    return K.pck(_keypoints(spark, sf), [0.05, 0.1, 0.2]).withColumn("pck", r6("pck"))


_RATER = f"""WITH t AS (SELECT object, step, x, y, vx FROM {{tracks}} WHERE step < 20 AND object IN (SELECT object FROM {{tracks}} GROUP BY 1 HAVING count(*) >= 5)),
speeds AS (SELECT object, {_SCALE} AS scale FROM (SELECT object, arg_min(vx, step) AS v FROM t GROUP BY 1)),
moves AS (SELECT object, label, step, x + s AS x, y, x + s - lag(x + s, 1, 0) OVER w AS mx, y - lag(y, 1, 0) OVER w AS my FROM t, (VALUES (0.0::double, 8.0::double), (2.0, 6.0)) AS r(s, label) WINDOW w AS (PARTITION BY object, label ORDER BY step)),
truth AS (SELECT object, label, last, lat, lon, arg_max(x, step) AS x, arg_max(y, step) AS y, coalesce(arg_max(mx / sqrt(mx * mx + my * my), step) FILTER (mx * mx + my * my > 1e-12), 1) AS dx,
  coalesce(arg_max(my / sqrt(mx * mx + my * my), step) FILTER (mx * mx + my * my > 1e-12), 0) AS dy FROM moves, (VALUES (11, 1.0, 4.0), (19, 1.8, 7.2)) AS h(last, lat, lon) WHERE step <= last GROUP BY ALL),
plans AS (SELECT object, last, plan, p, arg_max(x, step) + s AS x, arg_max(y, step) AS y FROM t, (VALUES (0.5, 0.6::double, 0), (3.0, 0.4, 1)) AS q(s, p, plan), (VALUES (11), (19)) AS h(last) WHERE step <= last GROUP BY object, last, plan, p, s),
near AS (SELECT object, plan, p, label, last, greatest(abs((plans.y - truth.y) * dx - (plans.x - truth.x) * dy) / (lat * scale), abs((plans.x - truth.x) * dx + (plans.y - truth.y) * dy) / (lon * scale)) AS d
  FROM plans JOIN truth USING (object, last) JOIN speeds USING (object)),
best AS (SELECT object, plan, p, last, max(label * 0.1 ** greatest(d - 1, 0)) AS v FROM near GROUP BY ALL),
held AS (SELECT object, plan, bool_or(inside) AS inside FROM (SELECT object, plan, label, max(d) <= 1 AS inside FROM near GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT object, plan, p, inside, avg(v) AS v FROM best JOIN held USING (object, plan) GROUP BY ALL)
SELECT object, round(sum(p * CASE WHEN inside THEN v ELSE greatest(v, 4) END), 6) AS score FROM scored GROUP BY 1"""


@query(_RATER)
def rater_scores(spark, sf):
    """Plans and raters made of tracks of at least five steps."""
    t = read(spark, sf, "tracks").where("step < 20")
    pts = t.groupBy("object").agg(F.sort_array(F.collect_list(F.struct("step", "x", "y"))).alias("s"), F.min_by("vx", "step").alias("speed")).where(F.size("s") >= 5)
    xy = lambda shift: F.transform("s", lambda p: F.struct((p["x"] + shift).alias("x"), p["y"].alias("y")))
    rows = pts.select("object", F.col("speed"), F.array(F.struct(xy(0.5).alias("points"), F.lit(0.6).alias("p")), F.struct(xy(3.0).alias("points"), F.lit(0.4).alias("p"))).alias("plans"), F.array(F.struct(xy(0.0).alias("points"), F.lit(8.0).alias("label")), F.struct(xy(2.0).alias("points"), F.lit(6.0).alias("label"))).alias("raters"))
    return R.score(rows).select("object", r6("score").alias("score"))


@query("""SELECT event_type, epoch_us(time_bucket(INTERVAL 5 MINUTES, ts)) // 1000000 AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark, sf):
    """The batch form of the streaming window counts."""
    from roadlens.streaming import metrics as SM

    out = SM.windowed_counts(read(spark, sf, "events"))
    return out.select("event_type", F.unix_timestamp("window.start").alias("window_start"), "n", F.round("total", 4).alias("total"))




from roadlens import catalog_scenes  # noqa: E402, F401 - it adds its queries to these
