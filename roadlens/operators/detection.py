"""Detection metrics: pair table, matching, additive counters, curves, average precision.

The pair table (frame and type equi-join with IoU) is computed once and feeds every shard and cutoff.
Matchers that must look at a frame as a whole run one Arrow call per group of frames, which handles all
shards, cutoffs and levels of a frame; what leaves it are counters, summed by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions import geometry as G
from roadlens.functions import kernels as K
from roadlens.operators import breakdown as B

THRESHOLDS = {1: 0.7, 2: 0.5, 3: 0.5, 4: 0.5}
QUANTUM = 1_000_000  # weights are IoU in millionths


def ground_truths(gt: DataFrame) -> DataFrame:
    """Boxes that lidar saw; a missing level is 2 with at most five points, else 1."""
    level = F.when(F.col("points") <= 5, F.lit(2)).otherwise(F.lit(1))
    given = F.nullif(F.col("level"), F.lit(0)) if "level" in gt.columns else F.lit(None).cast("int")
    return gt.where("points > 0").withColumn("level", F.coalesce(given, level).cast("int"))


def pairs(pd_: DataFrame, gt: DataFrame, iou: Column | None = None) -> DataFrame:
    """All prediction and ground truth pairs of a frame and type that overlap: frame, type, pd, gt, iou.

    A user's own measure may be given as an expression over p.* and g.* columns.
    """
    p, g = pd_.alias("p"), gt.alias("g")
    c = lambda side, *names: [F.col(f"{side}.{n}") for n in names]
    value = iou if iou is not None else G.iou_aa(*c("p", "cx", "cy", "length", "width"), *c("g", "cx", "cy", "length", "width"))
    on = [F.col("p.frame") == F.col("g.frame"), F.col("p.type") == F.col("g.type")]
    return p.join(g, on).select(F.col("p.frame").alias("frame"), F.col("p.type").alias("type"), F.col("p.id").alias("pd"), F.col("g.id").alias("gt"), F.round(value, 6).alias("iou")).where("iou > 0")


def threshold(kind: Column, thresholds: dict[int, float] = THRESHOLDS) -> Column:
    out = F.lit(None).cast("double")
    for t, v in thresholds.items():
        out = F.when(kind == t, F.lit(v)).otherwise(out)
    return out


def best_per_gt(pair: DataFrame, least: Column | float) -> DataFrame:
    """Of each ground truth its best prediction of at least the threshold (ties: least id)."""
    ok = pair.where(F.col("iou") >= least)
    return ok.groupBy("frame", "type", "gt").agg(F.min_by(F.struct("pd", "iou"), F.struct(-F.col("iou"), F.col("pd"))).alias("m")).select("frame", "type", "gt", F.col("m.pd").alias("pd"), F.col("m.iou").alias("iou"))


def above_cutoffs(pd_: DataFrame, cutoffs: list[float]) -> DataFrame:
    """One row per prediction and cutoff it reaches."""
    each = F.array(*(F.lit(float(c)) for c in cutoffs))
    return pd_.withColumn("cutoff", F.explode(F.filter(each, lambda c: F.col("score") >= c)))


def estimate_cutoffs(scores: DataFrame, n: int) -> DataFrame:
    """(position, cutoff): n cutoffs that split the sorted scores into equal buckets; the last is 1.

    One cutoff is 0; with at most n scores the cutoffs are an even grid over [0, 1].
    """
    spark = scores.sparkSession
    total = scores.count()
    if n == 1:
        return spark.createDataFrame([(0, 0.0)], "position int, cutoff double")
    if n >= total:
        return spark.createDataFrame([(i, i / (n - 1)) for i in range(n)], "position int, cutoff double")
    buckets = n - 1
    sizes = [total // buckets + (i < total % buckets) for i in range(buckets)]
    at = [0, *np.cumsum(sizes)[:-1].tolist()]
    want = spark.createDataFrame([(i, int(r)) for i, r in enumerate(at)], "position int, rank long")
    # at most n wanted ranks against ranges of ranks, one a distinct score
    among = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    found = ranked(scores).join(F.broadcast(want), among).select("position", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("cutoff"))
    return found.union(spark.createDataFrame([(n - 1, 1.0)], "position int, cutoff double"))


def ranked(scores: DataFrame) -> DataFrame:
    """(score, first, n): the least rank and number of each distinct score, without one task of all rows.

    Scores are counted by value; the running count over values is made of sums over ranges of values.
    """
    from pyspark.sql import Window

    values = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    bucketed = values.withColumn("b", F.floor(F.col("score") * 1024))
    sums = bucketed.groupBy("b").agg(F.sum("n").alias("m"))  # one row per 1/1024 of the score range
    before = sums.select("b", (F.sum("m").over(Window.orderBy("b")) - F.col("m")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("score")) - F.col("n")
    return bucketed.withColumn("inside", inside).join(F.broadcast(before), "b").select("score", (F.col("base") + F.col("inside")).alias("first"), "n")


COUNTS = "generator string, shard int, level int, cutoff double, tp long, fp long, fn long, sum_ha double, sum_la double"


BOX = ["cx", "cy", "cz", "length", "width", "height", "heading"]


def frame_pairs(p_frame: np.ndarray, g_frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of two sides, each sorted by frame, that share a frame."""
    frames = np.intersect1d(p_frame, g_frame)
    p0, p1 = np.searchsorted(p_frame, frames, "left"), np.searchsorted(p_frame, frames, "right")
    g0, g1 = np.searchsorted(g_frame, frames, "left"), np.searchsorted(g_frame, frames, "right")
    wide, size = g1 - g0, (p1 - p0) * (g1 - g0)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(p0, size) + inside // np.repeat(wide, size), np.repeat(g0, size) + inside % np.repeat(wide, size)


def match_pairs(frame: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray, score: np.ndarray, matcher: str, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Matched (i, j) among possible pairs of many frames; memo keeps what was matched before.

    A pair whose two sides have no other partner needs no assignment; only frames with competing pairs
    are matched one by one, on those.
    """
    if not len(i):
        return i, j
    many = (np.bincount(i)[i] > 1) | (np.bincount(j)[j] > 1)
    out_i, out_j = [i[~many]], [j[~many]]
    if many.any():
        ci, cj, cw = i[many], j[many], weight[many]
        cut = np.flatnonzero(np.append(True, frame[ci][1:] != frame[ci][:-1]))
        for lo, hi in zip(cut, np.append(cut[1:], len(ci)), strict=True):
            x, y = ci[lo:hi], cj[lo:hi]
            key = (x.tobytes(), y.tobytes())
            if key not in memo:
                rows, cols = np.unique(x), np.unique(y)
                w = np.zeros((len(rows), len(cols)))
                w[np.searchsorted(rows, x), np.searchsorted(cols, y)] = cw[lo:hi]
                match = K.greedy(w, score[rows]) if matcher == "score_first" else K.assign(K.later(w))
                memo[key] = rows[match >= 0], cols[match[match >= 0]]
            out_i.append(memo[key][0])
            out_j.append(memo[key][1])
    return np.concatenate(out_i), np.concatenate(out_j)


def _members(shards, n: int) -> dict[int, np.ndarray]:
    """For each shard which rows are in it, from the rows' lists of shards."""
    size = [len(x) for x in shards]
    row, shard = np.repeat(np.arange(n), size), np.array([y for x in shards for y in x], int)
    out = {}
    for s in np.unique(shard[shard >= 0]):
        out[int(s)] = np.zeros(n, bool)
        out[int(s)][row[shard == s]] = True
    return out


def _frame_counts(config: dict):
    """Counters of a bucket of frames, summed over them."""
    kind, cutoffs, generators = config["kind"], config["cutoffs"], config["generators"]
    matcher, least_heading, let, levels = config["matcher"], config["least_heading"], config["let"], config["levels"]
    limit = np.full(max(config["thresholds"]) + 1, np.inf)
    for t, v in config["thresholds"].items():
        limit[t] = v
    only = {g: g in B.GT_ONLY for g in generators}

    def run(key, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        p, g = p.sort_values(["frame", "id"]), g.sort_values(["frame", "id"])
        n, m = len(p), len(g)
        a, b = p[BOX].to_numpy(float), g[BOX].to_numpy(float)
        frame, kind_p, kind_g = p["frame"].to_numpy(), p["type"].to_numpy(int), g["type"].to_numpy(int)
        score, nlz, level = p["score"].to_numpy(float), p["nlz"].to_numpy(bool), g["level"].to_numpy(int)
        # the overlaps of all pairs of a frame and type, at once
        i, j = frame_pairs(frame, g["frame"].to_numpy())
        same = kind_p[i] == kind_g[j]
        i, j = i[same], j[same]
        raw = config["iou"](a[i], b[j]) if config["iou"] else let_iou(a[i], b[j], let, kind) if let else K.pair_iou(a[i], b[j], kind, digits=None if kind == "aa" else 9)
        overlap = np.round(raw, 9) if kind == "aa" and not config["iou"] and not let else raw
        affinity = let_affinity(a[i], b[j], let) if let else np.ones(len(i))
        ha = 1 - np.abs((a[i, 6] - b[j, 6] + np.pi) % (2 * np.pi) - np.pi) / np.pi
        need = np.where(kind_p < len(limit), limit[np.clip(kind_p, 0, len(limit) - 1)], np.inf)[i]
        weight = np.floor(raw * affinity * QUANTUM + 0.5)  # half up, of the overlap itself, as SQL rounds
        can = np.flatnonzero((overlap >= need) & (affinity > 0) & (overlap > 0) & (weight > 0))
        code = i * m + j  # rises with (i, j)
        steps = np.sort(np.array(cutoffs, float))
        top = np.where(np.isnan(score), 0, np.searchsorted(steps, score, "right"))  # a prediction is there at steps before this one

        def there(rows: np.ndarray, weights=None) -> np.ndarray:
            """For each step the number, or sum, of predictions that are there."""
            return np.cumsum(np.bincount(top[rows], weights, len(steps) + 1)[:0:-1])[::-1]

        out, memo = [], {}
        for gen in generators:
            gs = g[f"g_{gen}"].to_numpy(int)
            in_ps = _members(p[f"s_{gen}"], n)
            in_gs = _members(g[f"s_{gen}"], m) if only[gen] else {int(s): gs == s for s in np.unique(gs[gs >= 0])}
            for shard in sorted({*in_ps, *in_gs}):
                in_p, in_g = in_ps.get(shard, np.zeros(n, bool)), in_gs.get(shard, np.zeros(m, bool))
                mine = can[in_p[i[can]] & in_g[j[can]]]
                other = np.zeros(n, bool)  # predictions that overlap most with a truth of another shard (ties: the last)
                if only[gen]:
                    k = np.flatnonzero(in_p[i] & in_g[j])
                    k = k[np.lexsort((j[k], overlap[k], i[k]))]
                    last = k[np.append(i[k][1:] != i[k][:-1], True)] if len(k) else k
                    other[i[last]] = (overlap[last] >= 0.01) & (gs[j[last]] != shard)
                own = gs == shard if only[gen] else np.ones(m, bool)  # truths that count
                many = (np.bincount(i[mine])[i[mine]] > 1) | (np.bincount(j[mine])[j[mine]] > 1) if len(mine) else np.zeros(0, bool)
                lone, rivals = mine[~many], mine[many]
                # a pair without a rival is matched at all steps that its prediction reaches: sums over all steps at once
                hit = lone[own[j[lone]] & (ha[lone] > least_heading)]
                free_p, free_g = in_p & ~nlz & ~other, in_g & own
                free_p[i[mine]] = False
                free_g[j[mine]] = False
                tp, fp = there(i[hit]), there(np.flatnonzero(free_p))
                sum_ha, sum_la = there(i[hit], ha[hit]), there(i[hit], affinity[hit])
                fn = {}
                for lv in levels:
                    late = lone[own[j[lone]] & (level[j[lone]] <= lv)]
                    fn[lv] = (level[free_g] <= lv).sum() + len(late) - there(i[late])
                # the few pairs with rivals are matched anew where one of their predictions has gone
                px, gx, done = np.unique(i[rivals]), np.unique(j[rivals]), None
                gone = set(top[px].tolist())
                for at in range(len(steps) if len(px) else 0):
                    if done is None or at in gone:
                        mi, mj = match_pairs(frame, *(x[top[i[rivals]] > at] for x in (i[rivals], j[rivals], weight[rivals])), score, matcher, memo)
                        pair = np.searchsorted(code, mi * m + mj)
                        pair = pair[own[mj] & (ha[pair] > least_heading)]
                        miss = np.setdiff1d(px[(top[px] > at) & ~nlz[px] & ~other[px]], mi)
                        lost = np.setdiff1d(gx[own[gx]], mj)
                        done = len(pair), len(miss), ha[pair].sum(), affinity[pair].sum(), {lv: (level[lost] <= lv).sum() for lv in levels}
                    for total, more in zip((tp, fp, sum_ha, sum_la), done, strict=False):
                        total[at] += more
                    for lv in levels:
                        fn[lv][at] += done[4][lv]
                for lv in levels:
                    out += [(gen, shard, int(lv), float(cut), int(tp[at]), int(fp[at]), int(fn[lv][at]), float(sum_ha[at]), float(sum_la[at])) for at, cut in enumerate(steps)]
        return pd.DataFrame(out, columns=["generator", "shard", "level", "cutoff", "tp", "fp", "fn", "sum_ha", "sum_la"])

    return run


LET = {"tolerance": 0.1, "least": 0.5, "sensor": (1.43, 0.0, 2.18), "align": "range"}


def _seen(x: np.ndarray, let: dict) -> np.ndarray:
    return x[:, :3] - np.array(let["sensor"])


def let_affinity(a: np.ndarray, b: np.ndarray, let: dict) -> np.ndarray:
    """Longitudinal affinity of the pairs a[i], b[i]."""
    p, g = _seen(a, let), _seen(b, let)
    rg = np.maximum(np.linalg.norm(g, axis=1), 1e-6)
    along = (p * g).sum(1) / rg  # the prediction's range along the ground truth's direction
    return np.clip(1 - np.abs((along - rg) / np.maximum(let["tolerance"] * rg, let["least"])), 0, 1)


def let_iou(a: np.ndarray, b: np.ndarray, let: dict, kind: str) -> np.ndarray:
    """IoU of the pairs a[i], b[i], each prediction moved along its line of sight towards the ground truth."""
    moved, p, g = a.copy(), _seen(a, let), _seen(b, let)
    if let["align"] == "center":
        moved[:, :2] = b[:, :2]
    elif let["align"] != "none":
        m = (p * g).sum(1) / np.maximum((p * p).sum(1), 1e-6)
        inner = (m < 1) & (m >= 0)
        m = {"range": m, "further_only": np.where(inner, m, 1), "any_closer_only": np.where(inner, 1, m), "between_origin_and_gt_only": np.maximum(m, 1)}[let["align"]]
        moved[:, :3] = p * m[:, None] + np.array(let["sensor"])
    return K.pair_iou(moved, b, kind)


def measure(pd_: DataFrame, gt: DataFrame, cutoffs: list[float], generators=("OBJECT_TYPE",), levels=(1, 2), matcher: str = "hungarian", kind: str = "3d", thresholds: dict[int, float] = THRESHOLDS, least_heading: float = 0.0, let: dict | None = None, iou=None) -> DataFrame:
    """Summed counters per generator, shard, level and cutoff.

    pd_: frame, id, type, box columns, score, nlz; gt: frame, id, type, box columns, level, speeds.
    Unmatched predictions in no-label zones are no false positives; unmatched ground truths count up to
    their level; a match whose heading accuracy is at most ``least_heading`` counts as nothing.
    Counters are additive, so partial results of parts of the frames can be summed.  ``iou`` replaces the
    overlap: a function of two arrays of paired boxes (cx, cy, cz, length, width, height, heading).
    """
    if matcher not in ("hungarian", "score_first"):
        raise ValueError(f"unknown matcher {matcher}")
    config = {"kind": kind, "thresholds": thresholds, "cutoffs": list(cutoffs), "generators": list(generators), "levels": list(levels), "matcher": matcher, "least_heading": least_heading, "let": let, "iou": iou}
    box = ["frame", "id", "type", "cx", "cy", "cz", "length", "width", "height", "heading"]
    speed = [c for c in ("speed_x", "speed_y") if c in gt.columns]
    p = pd_.select(*box, "score", "nlz", *(B.shards_for_matching(g).alias(f"s_{g}") for g in generators))
    g = gt.select(*box, "level", *speed)
    g = g.select(*box, "level", *(B.shards_for_matching(x).alias(f"s_{x}") for x in generators), *(F.coalesce(B.shard(x), F.lit(-1)).alias(f"g_{x}") for x in generators))
    bucket = buckets(p, "frame")
    found = p.select(bucket, "*").groupBy("bucket").cogroup(g.select(bucket, "*").groupBy("bucket")).applyInPandas(_frame_counts(config), COUNTS)
    return merge_counts(found)


def buckets(df: DataFrame, *key: str) -> Column:
    """A column ``bucket`` of a key's hash: the frames of one Arrow call, as a call costs more than a frame.

    There are eight to each shuffle partition, so that a bucket is an eighth of what the session lets a
    task hold; nothing is counted.
    """
    n = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*key), F.lit(n)).alias("bucket")


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum counters of any number of partial results."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("generator", "shard", "level", "cutoff").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "sum_ha", "sum_la")))


def curve(counts: DataFrame, least_precision: float = 0.0) -> DataFrame:
    """Adds precision, precision_ha, precision_la and recall; no recall forces precision 1."""
    made, real = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    recall = F.when(real > 0, F.col("tp") / real).otherwise(F.lit(0.0))

    def precise(top: Column) -> Column:
        p = F.when(made > 0, top / made).otherwise(F.lit(0.0))
        return F.when(recall == 0, F.lit(1.0)).when(p < least_precision, F.lit(0.0)).otherwise(p)

    return counts.select("*", precise(F.col("tp")).alias("precision"), precise(F.col("sum_ha")).alias("precision_ha"), precise(F.col("sum_la")).alias("precision_la"), recall.alias("recall"))


def area(points: Column, delta: float = 0.05) -> Column:
    """Average precision of an array of (recall, precision) structs, as a fold.

    Precision at a recall is the best at any recall not below it; between recalls further apart than
    delta points are put in at that best precision; the point at recall 0 takes its neighbour's.
    """
    both = F.concat(points, F.array(F.struct(F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))))
    down = F.reverse(F.array_sort(F.transform(both, lambda x: F.struct(x["recall"].alias("recall"), x["precision"].alias("precision")))))
    start = F.struct(F.lit(-1.0).alias("recall"), F.lit(0.0).alias("best"), F.lit(0.0).alias("area"))

    def step(s, x):
        gap = F.when(s["recall"] < 0, F.lit(0.0)).otherwise(s["recall"] - x["recall"])
        flat = F.greatest(F.lit(0.0), F.ceil((gap - 1e-6) / delta) - 1) * delta  # up to the last inserted point
        best = F.greatest(s["best"], x["precision"])
        right = F.when(x["recall"] <= 0, s["best"]).otherwise(best)
        return F.struct(x["recall"].alias("recall"), best.alias("best"), (s["area"] + flat * s["best"] + (gap - flat) * (s["best"] + right) / 2).alias("area"))

    return F.when(F.size(points) == 0, F.lit(0.0)).otherwise(F.aggregate(down, start, step)["area"])


def metrics(counts: DataFrame, delta: float = 0.05, least_precision: float = 0.0) -> DataFrame:
    """AP, heading-weighted and longitudinal-affinity-weighted AP per generator, shard and level."""
    c = curve(counts, least_precision)
    listed = lambda p: F.collect_list(F.struct("recall", F.col(p).alias("precision")))
    grouped = c.groupBy("generator", "shard", "level").agg(*(listed(p).alias(p) for p in ("precision", "precision_ha", "precision_la")))
    return grouped.select("generator", "shard", "level", area(F.col("precision"), delta).alias("ap"), area(F.col("precision_ha"), delta).alias("aph"), area(F.col("precision_la"), delta).alias("apl"))


def evaluate(pd_: DataFrame, gt: DataFrame, cutoffs: int = 101, **options) -> DataFrame:
    """AP, APH and APL by the usual configuration: types and ranges, two levels, evenly spaced cutoffs."""
    return metrics(measure(pd_, ground_truths(gt), [i / (cutoffs - 1) for i in range(cutoffs)], **{"generators": ("OBJECT_TYPE", "RANGE"), "levels": (1, 2)} | options))


def match(pd_: DataFrame, gt: DataFrame, least: float = 0.5, kind: str = "3d", matcher: str = "hungarian", iou=None) -> DataFrame:
    """(frame, pd, gt, iou): one-to-one matches of boxes of at least that overlap, whatever their type.

    Boxes without a valid size match nothing; ``iou`` may replace the overlap, as in ``measure``.
    """

    def run(key, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        p, g = p.sort_values(["frame", "id"]), g.sort_values(["frame", "id"])
        a, b, frame = p[BOX].to_numpy(float), g[BOX].to_numpy(float), p["frame"].to_numpy()
        i, j = frame_pairs(frame, g["frame"].to_numpy())
        overlap = iou(a[i], b[j]) if iou else K.pair_iou(a[i], b[j], kind)
        ok = np.flatnonzero((overlap >= least) & (overlap > 0))
        mi, mj = match_pairs(frame, i[ok], j[ok], np.round(overlap[ok] * QUANTUM), p["score"].to_numpy(float), matcher, {})
        at = np.searchsorted(i * len(g) + j, mi * len(g) + mj)
        return pd.DataFrame({"frame": frame[mi], "pd": p["id"].to_numpy()[mi], "gt": g["id"].to_numpy()[mj], "iou": overlap[at]})

    score = F.col("score") if "score" in pd_.columns else F.lit(1.0)
    p = pd_.select(buckets(pd_, "frame"), "frame", "id", *BOX, score.alias("score"))
    g = gt.select(buckets(pd_, "frame"), "frame", "id", *BOX)
    return p.groupBy("bucket").cogroup(g.groupBy("bucket")).applyInPandas(run, "frame long, pd long, gt long, iou double")


def recall_at(counts: DataFrame, precision: float) -> DataFrame:
    """Largest recall at a precision above the given one."""
    return curve(counts).groupBy("generator", "shard", "level").agg(F.max(F.when(F.col("precision") > precision, F.col("recall"))).alias("recall"))


def nearest_speed(pd_: DataFrame, gt: DataFrame) -> DataFrame:
    """Predictions with the speed of the nearest ground truth of their frame (ties: least id; none: 0)."""
    g = gt.select(F.col("frame").alias("_f"), F.col("id").alias("_gid"), *(F.col(c).alias(f"_{c}") for c in ("cx", "cy", "cz", "speed_x", "speed_y")))
    d = F.sqrt((F.col("cx") - F.col("_cx")) ** 2 + (F.col("cy") - F.col("_cy")) ** 2 + (F.col("cz") - F.col("_cz")) ** 2)
    near = pd_.select("frame", "id", "cx", "cy", "cz").join(g, F.col("frame") == F.col("_f")).groupBy("frame", "id").agg(F.min_by(F.struct("_speed_x", "_speed_y"), F.struct(d, "_gid")).alias("s"))
    return pd_.join(near, ["frame", "id"], "left").select(*pd_.columns, F.coalesce("s._speed_x", F.lit(0.0)).alias("speed_x"), F.coalesce("s._speed_y", F.lit(0.0)).alias("speed_y"))


def largest_overlap(pair: DataFrame, least: float = 0.01) -> DataFrame:
    """Of each prediction the ground truth of largest IoU, at least ``least`` (ties: the last)."""
    return pair.where(F.col("iou") >= least).groupBy("frame", "pd").agg(F.max_by(F.struct("gt", "iou"), F.struct("iou", "gt")).alias("m")).select("frame", "pd", F.col("m.gt").alias("gt"), F.col("m.iou").alias("iou"))
