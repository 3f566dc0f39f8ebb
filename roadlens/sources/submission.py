"""Submissions: filters and shards of prediction tables, validation, comparison with latency runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = ("length", "width", "height")


def clean(pred: DataFrame, least: float = 0.03) -> DataFrame:
    """Drop low scores and boxes with NaN, and raise sizes to 1e-6 at least."""
    box = [c for c in ("cx", "cy", "cz", *SIZES, "heading") if c in pred.columns]
    fine = F.col("score") >= least
    for c in box:
        fine = fine & ~F.isnan(c) & F.col(c).isNotNull()
    return pred.where(fine).withColumns({c: F.greatest(c, F.lit(1e-6)) for c in SIZES if c in pred.columns})


def shards(pred: DataFrame, order: list[str], n: int = 4) -> DataFrame:
    """Adds ``shard``: by frame hash, so that a frame stays whole and no task sees all rows."""
    return pred.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))


def write(pred: DataFrame, path: str, method: str, account: str, n: int = 4) -> None:
    if not method or not account:
        raise ValueError("a submission needs a method and an account name")
    out = shards(clean(pred), ["frame"], n).withColumns({"method": F.lit(method), "account": F.lit(account)})
    out.repartition(n, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def from_latency(results: DataFrame, least: float = 0.03, smallest: float = 0.01) -> DataFrame:
    """Arrays of boxes [n, 7 or 4], scores and classes per frame to prediction rows, small or weak ones dropped."""
    d = F.element_at("shape", 2)
    i = F.explode(F.sequence(F.lit(0), F.element_at("shape", 1) - 1))
    e = results.where(F.element_at("shape", 1) > 0).withColumn("i", i)
    v = lambda k: F.element_at("boxes", F.col("i") * d + k + 1)
    flat = F.when(d == 4, F.lit(True)).otherwise(F.lit(False))
    col = lambda k7, k4: F.when(flat, v(k4) if k4 is not None else F.lit(0.0)).otherwise(v(k7))
    out = e.select("frame", F.col("i").alias("id"), F.element_at("classes", F.col("i") + 1).alias("type"), F.element_at("scores", F.col("i") + 1).alias("score"), col(0, 0).alias("cx"), col(1, 1).alias("cy"), col(2, None).alias("cz"), col(3, 2).alias("length"), col(4, 3).alias("width"), F.when(flat, F.lit(1.0)).otherwise(v(5)).alias("height"), col(6, None).alias("heading"))
    return out.where((F.col("score") >= least) & (F.least(*SIZES) >= smallest))


def consistent(latency: DataFrame, submitted: DataFrame, iou: float = 0.9, score: float = 0.05, loose: float = 0.05) -> DataFrame:
    """One row: unmatched share of both sides' boxes and whether it is at most ``loose``.

    Frames (integers) on one side only count all their boxes as unmatched.
    """
    import numpy as np
    import pandas as pd

    from roadlens.functions import kernels as K
    from roadlens.operators.detection import buckets, frame_pairs, match_pairs

    box = ["cx", "cy", "cz", "length", "width", "height", "heading"]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("frame"), b.sort_values("frame")
        fa, fb, sa, sb = a["frame"].to_numpy(), b["frame"].to_numpy(), a["score"].to_numpy(float), b["score"].to_numpy(float)
        i, j = frame_pairs(fa, fb)
        near = np.abs(sa[i] - sb[j]) <= score
        i, j = i[near], j[near]
        w = K.pair_iou(a[box].to_numpy(float)[i], b[box].to_numpy(float)[j], "3d")
        ok = np.flatnonzero((w >= iou) & (w > 0))
        hit = len(match_pairs(fa, i[ok], j[ok], w[ok], sa, "hungarian", {})[0])
        return pd.DataFrame([(len(a) + len(b), len(a) + len(b) - 2 * hit)], columns=["boxes", "unmatched"])

    keep = ["frame", *box, "score"]
    bucket = buckets(latency, "frame")
    found = latency.select(bucket, *keep).groupBy("bucket").cogroup(submitted.select(bucket, *keep).groupBy("bucket")).applyInPandas(run, "boxes long, unmatched long")
    n = found.agg(F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"), F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched"))
    share = F.when(F.col("boxes") > 0, F.col("unmatched") / F.col("boxes")).otherwise(F.lit(0.0))
    return n.select("boxes", "unmatched", share.alias("share"), (share <= loose).alias("consistent"))


def equal_examples(a: DataFrame, b: DataFrame, on: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Rows that differ: doubles by more than the tolerance, lists also in length, other values at all."""
    j = a.alias("a").join(b.alias("b"), on, "outer")
    bad = F.lit(False)
    for f in a.schema:
        if f.name in on:
            continue
        x, y = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            same = F.abs(x - y) <= tolerance
        elif kind in ("array<double>", "array<float>"):
            same = (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: F.abs(p - q) <= tolerance), lambda s: s)
        else:
            same = x.eqNullSafe(y)
        bad = bad | ~F.coalesce(same, x.isNull() & y.isNull())
    return j.where(bad).select(*on)


def validate_rollouts(joint: DataFrame, expected: DataFrame, steps: int = 80, rollouts: int = 32) -> DataFrame:
    """Problems of simulated rollouts (scenario, rollout, object, steps): (scenario, problem)."""
    want = expected.select("scenario", "object")
    got = joint.select("scenario", "object").distinct()
    lack = want.join(got, ["scenario", "object"], "left_anti").select("scenario", F.concat(F.lit("missing object "), F.col("object").cast("string")).alias("problem"))
    more = got.join(want, ["scenario", "object"], "left_anti").select("scenario", F.concat(F.lit("unknown object "), F.col("object").cast("string")).alias("problem"))
    long_ = joint.where(F.size("x") != steps).select("scenario", F.lit("wrong number of steps").alias("problem")).distinct()
    few = joint.groupBy("scenario").agg(F.countDistinct("rollout").alias("n")).where(F.col("n") != rollouts).select("scenario", F.lit("wrong number of rollouts").alias("problem"))
    return lack.union(more).union(long_).union(few)


PREDICTION = "context string, timestamp long, camera int, id string, type int, score double, cx double, cy double, cz double, length double, width double, height double, heading double"


def prediction_example(spark) -> DataFrame:
    """A table of predictions as a submission wants it, with one box to be replaced by real ones."""
    return spark.createDataFrame([("context name", -1, 1, "track id", 2, 0.5, *[0.0] * 7)], PREDICTION)


def segmentation_example(spark, contexts: int = 2, frames: int = 3, rows: int = 64, columns: int = 2650) -> DataFrame:
    """A table of predicted classes of both returns' range images, row by row: all 1 in the first, all 7 in the second."""
    ids = spark.range(contexts).select(F.concat(F.lit("context "), F.col("id").cast("string")).alias("context"))
    each = ids.withColumn("timestamp", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("timestamp", F.col("timestamp").cast("long") * 1_000_000)
    classes = lambda k: F.array_repeat(F.lit(k), rows * columns)
    return each.select("context", "timestamp", F.array(F.lit(rows), F.lit(columns)).alias("shape"), classes(1).alias("first_return"), classes(7).alias("second_return"))
