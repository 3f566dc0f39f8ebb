"""Keypoint metrics over long rows: object, point, truth and prediction coordinates, visibility.

Columns: id, kind (point type), gx, gy[, gz], px, py[, pz], gv, pv (0 missing, 1 occluded, 2 visible),
scale (box volume to the power 1/d); optionally weight (of a point) and the truth's box: bx, by[, bz]
(centre) and sx, sy[, sz] (size).  A point counts in errors only where both sides have it; a mean
without any weight is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OKS_LEVELS = [0.5 + 0.05 * i for i in range(10)]


def error(df: DataFrame) -> Column:
    axes = "xyz" if "gz" in df.columns else "xy"
    return F.sqrt(sum(((F.col(f"g{a}") - F.col(f"p{a}")) ** 2 for a in axes), F.lit(0.0)))


def _axes(df: DataFrame) -> str:
    return "xyz" if "gz" in df.columns else "xy"


def shared(df: DataFrame) -> Column:
    """A point's weight: 0 unless both sides have it."""
    both = ((F.col("gv") > 0) & (F.col("pv") > 0)).cast("double")
    return both * F.col("weight") if "weight" in df.columns else both


def weighted(value: Column, weight: Column) -> Column:
    """Weighted mean as an aggregate; 0 without weight."""
    total = F.sum(weight)
    return F.coalesce(F.sum(F.when(weight > 0, value * weight)) / F.when(total > 0, total), F.lit(0.0))


def displacement(df: DataFrame, enlarge: float = 1.0, heading: Column | None = None) -> list[Column]:
    """The shift of each axis that moves a prediction to the nearest point of the (enlarged) box."""
    d = [F.col(f"p{a}") - F.col(f"b{a}") for a in _axes(df)]
    c, s = (F.cos(heading), F.sin(heading)) if heading is not None else (F.lit(1.0), F.lit(0.0))
    d[:2] = [d[0] * c + d[1] * s, d[1] * c - d[0] * s]  # in the box's frame
    for k, a in enumerate(_axes(df)):
        half = F.col(f"s{a}") * (enlarge / 2)
        d[k] = F.greatest(F.least(d[k], half), -half) - d[k]
    d[:2] = [d[0] * c - d[1] * s, d[0] * s + d[1] * c]
    return d


def _sigma(sigmas: dict[int, float], default: float) -> Column:
    sigma = F.lit(default)
    for k, v in sigmas.items():
        sigma = F.when(F.col("kind") == k, F.lit(v)).otherwise(sigma)
    return sigma


def oks(points: DataFrame, sigmas: dict[int, float], default: float = 0.05) -> DataFrame:
    """(id, oks, valid, weight): mean over points that both sides have of exp(-e^2 / (2 scale^2 (2 sigma)^2)).

    An object without any truth point is scored by how far all its predicted points lie outside a box of
    three times the size (null where no box is given).  ``valid``: the box has a side over 1e-5.
    ``weight``: the sum of the object's point weights (1 where none are given).
    """
    wide = 2 * (F.col("scale") * 2 * _sigma(sigmas, default)) ** 2
    similar = lambda square: F.when(wide > 0, F.exp(-square / wide)).otherwise(1.0)
    boxed = "sx" in points.columns
    by_box = F.avg(similar(sum((d * d for d in displacement(points, 3.0)), F.lit(0.0)))) if boxed else F.lit(None).cast("double")
    side = F.greatest(*(F.col(f"s{a}") for a in _axes(points))) if boxed else F.lit(1.0)
    some = F.max((F.col("gv") > 0).cast("int")) == 1
    return points.groupBy("id").agg(
        F.when(some, weighted(similar(error(points) ** 2), shared(points))).otherwise(by_box).alias("oks"),
        (F.max(side) > 1e-5).alias("valid"),
        (F.sum("weight") if "weight" in points.columns else F.lit(1.0)).alias("weight"),
    )


def average_precision(scores: DataFrame, levels=OKS_LEVELS) -> DataFrame:
    """(level, precision): weighted share of objects with a valid box whose OKS is above the level; misses have OKS 0."""
    each = scores.withColumn("level", F.explode(F.array(*(F.lit(round(x, 4)) for x in levels))))
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in scores.columns else F.lit(1.0)
    if "valid" in scores.columns:
        weight = weight * F.coalesce("valid", F.lit(False)).cast("double")
    hit = (F.coalesce("oks", F.lit(0.0)) > F.col("level")).cast("double")
    return each.groupBy("level").agg(weighted(hit, weight).alias("precision"))


def mean_average_precision(scores: DataFrame, levels=OKS_LEVELS) -> DataFrame:
    """(ap): the mean of the levels' precisions."""
    return average_precision(scores, levels).agg(F.avg("precision").alias("ap"))


def mpjpe(points: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean error over points that both sides have."""
    return points.groupBy(*by).agg(weighted(error(points), shared(points)).alias("mpjpe"))


def pem(points: DataFrame, mismatch: float = 0.25) -> DataFrame:
    """Error with a penalty for each point only one side has: (error sum + penalty) / (points of either side)."""
    both = (F.col("gv") > 0) & (F.col("pv") > 0)
    one = (F.col("gv") > 0) != (F.col("pv") > 0)
    total = F.sum(F.when(both, error(points)).when(one, F.lit(mismatch)).otherwise(0.0))
    n = F.sum((both | one).cast("long"))
    return points.agg(F.when(n > 0, total / n).alias("pem"))


def visibility(points: DataFrame) -> DataFrame:
    """Precision and recall of predicted visible points, unlabelled points among them; 0 without any."""
    weight = F.col("weight") if "weight" in points.columns else F.lit(1.0)
    count = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    hit, made, real = count((F.col("gv") > 1) & (F.col("pv") > 1)), count(F.col("pv") > 1), count(F.col("gv") > 1)
    share = lambda n: F.coalesce(hit / F.when(n > 0, n), F.lit(0.0))
    return points.agg(share(made).alias("precision"), share(real).alias("recall"))


def pck(points: DataFrame, thresholds: list[float], per_kind: dict[int, float] | None = None) -> DataFrame:
    """(threshold, pck): share of points that both sides have with error at most threshold * scale * per-kind factor."""
    factor = F.lit(1.0)
    for k, v in (per_kind or {}).items():
        factor = F.when(F.col("kind") == k, F.lit(v)).otherwise(factor)
    each = points.select((error(points) / (F.col("scale") * factor)).alias("_e"), shared(points).alias("_w"), F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    return each.groupBy("threshold").agg(weighted((F.col("_e") <= F.col("threshold")).cast("double"), F.col("_w")).alias("pck"))


def subsets(points: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """One row per point and named subset of kinds that holds it."""
    each = F.array(*(F.when(F.col("kind").isin(k), F.lit(n)) for n, k in groups.items()))
    return points.withColumn("subset", F.explode(F.filter(each, lambda x: x.isNotNull())))


def with_unmatched(gt: DataFrame, pred: DataFrame, match: DataFrame) -> DataFrame:
    """Pairs (gt, pred) with misses and false alarms kept, missing coordinates 0 and visibility 0."""
    g = gt.select(F.col("id").alias("gt"), "kind", "gx", "gy", "gv", "scale")
    p = pred.select(F.col("id").alias("pred"), "kind", "px", "py", "pv")
    j = g.join(match, "gt", "left").join(p, ["pred", "kind"], "outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return j.select("gt", "pred", "kind", *(zero(c) for c in ("gx", "gy", "px", "py")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("gv", "pv")), F.coalesce("scale", F.lit(1.0)).alias("scale"))


def match_by_error(gt: DataFrame, pred: DataFrame, penalty: float = 0.25, reach: float = 0.25) -> DataFrame:
    """(frame, gt, pred): matches of objects by their points, in two optimal assignments a frame.

    gt: frame, id, box (cx, cy, cz, length, width, height, heading), points array<struct<kind,x,y,z,v>>;
    pred: frame, id, points.  Truths without a labelled point first take predictions by the number of
    points inside their box; the rest are matched by least mean error over shared kinds (below
    ``penalty``) among pairs whose nearest points are within ``reach``.
    """
    import numpy as np
    import pandas as pd

    from roadlens.functions import kernels as K
    from roadlens.operators.detection import buckets

    def table(points) -> tuple[np.ndarray, np.ndarray]:
        kept = [p for p in points if p["v"] > 0]
        return np.array([p["kind"] for p in kept], int), np.array([(p["x"], p["y"], p["z"]) for p in kept], float).reshape(-1, 3)

    def frame(g: pd.DataFrame, p: pd.DataFrame):
        gp, pp = [table(x) for x in g["points"]], [table(x) for x in p["points"]]
        bare = np.flatnonzero([len(x[0]) == 0 for x in gp])
        w = np.zeros((len(bare), len(p)))
        for k, i in enumerate(bare):
            b = g.iloc[i]
            for j, (_, xyz) in enumerate(pp):
                d = xyz - [b["cx"], b["cy"], b["cz"]]
                c, s = np.cos(b["heading"]), np.sin(b["heading"])
                inside = (np.abs(d[:, 0] * c + d[:, 1] * s) <= b["length"] / 2) & (np.abs(d[:, 1] * c - d[:, 0] * s) <= b["width"] / 2) & (np.abs(d[:, 2]) <= b["height"] / 2)
                w[k, j] = inside.sum()
        got = K.assign(w)
        out = [(i, j) for i, j in zip(bare, got, strict=True) if j >= 0]
        left_p = np.setdiff1d(np.arange(len(p)), got[got >= 0])
        rest = np.setdiff1d(np.arange(len(g)), bare)
        w = np.zeros((len(rest), len(left_p)))
        for k, i in enumerate(rest):
            for m, j in enumerate(left_p):
                (ka, xa), (kb, xb) = gp[i], pp[j]
                if not len(kb):
                    continue
                if np.sqrt(((xa[:, None] - xb[None]) ** 2).sum(2)).min() > reach:
                    continue
                both, ia, ib = np.intersect1d(ka, kb, return_indices=True)
                e = np.sqrt(((xa[ia] - xb[ib]) ** 2).sum(1)).mean() if len(both) else penalty
                w[k, m] = max(0.0, penalty - e)
        return out + [(rest[k], left_p[m]) for k, m in enumerate(K.assign(w)) if m >= 0]

    def run(key, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_p = dict(list(p.sort_values("id").groupby("frame")))
        for f, one in g.sort_values("id").groupby("frame"):
            if f in by_p:
                out += [(f, one["id"].iloc[i], by_p[f]["id"].iloc[j]) for i, j in frame(one, by_p[f])]
        return pd.DataFrame(out, columns=["frame", "gt", "pred"])

    bucket = buckets(gt, "frame")
    return gt.select(bucket, "*").groupBy("bucket").cogroup(pred.select(bucket, "*").groupBy("bucket")).applyInPandas(run, "frame long, gt long, pred long")


def match_by_overlap(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """(frame, gt, pred): one-to-one matches of objects by the overlap of their boxes."""
    from roadlens.operators.detection import match

    return match(pred, gt, least).select("frame", "gt", F.col("pd").alias("pred"))
