"""Segmentation: confusion counts, IoU, panoptic label algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(points: DataFrame, classes: list[int], by: list[str] = ()) -> DataFrame:
    """(by.., gt, pred, n): class ids outside ``classes`` and nulls become -1."""
    known = lambda c: F.when(F.col(c).isin(classes), F.col(c)).otherwise(F.lit(-1)).cast("int").alias(c)
    return points.select(*by, known("gt"), known("pred")).groupBy(*by, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_iou(conf: DataFrame, classes: list[int], by: list[str] = ()) -> DataFrame:
    """(by.., class, intersection, union, iou); a class with no union has IoU 1.

    A known truth predicted as something unknown counts in the union; an unknown truth does not.
    """
    each = F.array(*(F.lit(c) for c in classes))
    rows = conf.withColumn("class", F.explode(each))
    same = (F.col("gt") == F.col("class")) & (F.col("pred") == F.col("class"))
    either = (F.col("gt") == F.col("class")) | ((F.col("pred") == F.col("class")) & (F.col("gt") != -1))
    out = rows.groupBy(*by, "class").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("intersection"), F.sum(F.when(either, F.col("n")).otherwise(0)).alias("union"))
    return out.withColumn("iou", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(F.lit(1.0)))


def merge(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sum (class, intersection, union) of partial results and rate them anew."""
    out = parts.groupBy(*by, "class").agg(F.sum("intersection").alias("intersection"), F.sum("union").alias("union"))
    return out.withColumn("iou", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(F.lit(1.0)))


def mean_iou(ious: DataFrame, by: list[str] = ()) -> DataFrame:
    return ious.groupBy(*by).agg(F.avg("iou").alias("miou"))


def align_frames(gt: DataFrame, pred: DataFrame, on: list[str], undefined: int = 0) -> DataFrame:
    """Truth points with their predictions; frames or points without one are ``undefined``."""
    out = gt.join(pred, on, "left")
    return out.select(*gt.columns, F.coalesce("pred", F.lit(undefined)).alias("pred"))


def encode_panoptic(semantic: Column, instance: Column, divisor: Column | int) -> Column:
    return semantic * divisor + instance


def decode_panoptic(label: Column, divisor: Column | int) -> tuple[Column, Column]:
    d = divisor if isinstance(divisor, Column) else F.lit(divisor)
    return F.floor(label / d).cast("long"), F.pmod(label, d)


def remap_instances(pixels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Local instance ids of each frame to global ones; unmapped ids become 0."""
    m = mapping.select("frame", F.col("local").alias("instance"), F.col("global").alias("_g"))
    return pixels.join(m, ["frame", "instance"], "left").withColumn("instance", F.coalesce("_g", F.lit(0).cast("long"))).drop("_g")


def relabel(pixels: DataFrame, by: str = "frame", limit: int = 65535) -> tuple[DataFrame, DataFrame]:
    """Instances of each label numbered from 1 in order; (pixels, mapping local to global).

    The divisor is the largest new number plus one, at least 1000; a label that would not fit below
    ``limit`` fails.
    """
    from pyspark.sql import Window

    ids = pixels.where("instance > 0").select(by, "semantic", "instance").distinct()
    number = F.dense_rank().over(Window.partitionBy(by, "semantic").orderBy("instance")).cast("long")
    mapping = ids.select(by, "semantic", "instance", number.alias("local"))
    divisor = mapping.groupBy(by).agg(F.greatest(F.lit(1000).cast("long"), F.max("local") + 1).alias("divisor"))
    out = pixels.join(mapping, [by, "semantic", "instance"], "left").join(divisor, by, "left")
    label = F.col("semantic") * F.coalesce("divisor", F.lit(1000).cast("long")) + F.coalesce("local", F.lit(0).cast("long"))
    checked = F.when(label >= limit, F.raise_error(F.concat(F.lit("label does not fit: "), label.cast("string"))).cast("long")).otherwise(label)
    return out.select(*pixels.columns, F.coalesce("local", F.lit(0).cast("long")).alias("local"), F.coalesce("divisor", F.lit(1000).cast("long")).alias("divisor"), checked.alias("label")), mapping


def first_sequence(frames: DataFrame, k: int) -> DataFrame:
    """The first k labelled frames of the first sequence (sequence_id null: not labelled), in frame order."""
    labelled = frames.where("sequence_id is not null")
    first = labelled.agg(F.min_by("sequence_id", "frame").alias("sequence_id"))
    return labelled.join(F.broadcast(first), "sequence_id").select(*frames.columns).orderBy("frame").limit(k)
