"""Breakdown generators: the shard or shards of an object, as a column, and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.schemas import LABEL_TYPES

RANGES = (30.0, 50.0)
SPEEDS = (0.2, 1.0, 3.0, 10.0)
BIG = 7.0
FIELD = 25.2  # half a camera's field of view, degrees
CAMERAS = {1: 0.0, 2: 45.0, 3: -45.0, 4: 90.0, 5: -90.0}
GT_ONLY = {"VELOCITY", "CAMERA"}


def _step(value: Column, bounds) -> Column:
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(value < b, F.lit(i)).otherwise(out)
    return out


def shard(generator: str, camera: Column | None = None) -> Column:
    """The shard of an object with columns type, cx, cy, cz, length, width, height, speed_x, speed_y; -1 is none."""
    kind = F.col("type").cast("int")
    known = lambda c: F.when(kind >= 1, c).otherwise(F.lit(-1)).cast("int")
    if generator == "ONE_SHARD":
        return F.lit(0)
    if generator == "ALL_BUT_SIGN":
        return F.when(kind == 3, F.lit(1)).otherwise(F.lit(0))
    if generator == "OBJECT_TYPE":
        return known(kind - 1)
    if generator == "RANGE":
        return known(3 * (kind - 1) + _step(F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2 + F.col("cz") ** 2), RANGES))
    if generator == "SIZE":
        return known(2 * (kind - 1) + F.when(F.greatest("length", "width", "height") < BIG, F.lit(0)).otherwise(F.lit(1)))
    if generator == "VELOCITY":
        speed = F.sqrt(F.coalesce("speed_x", F.lit(0.0)) ** 2 + F.coalesce("speed_y", F.lit(0.0)) ** 2)
        return known(5 * (kind - 1) + _step(speed, SPEEDS))
    if generator == "CAMERA":
        return known(5 * (kind - 1) + (camera if camera is not None else first_camera()) - 1)
    if generator in ("TIME_OF_DAY", "LOCATION", "WEATHER"):
        raise NotImplementedError(f"{generator} has no rule")
    raise ValueError(f"unknown breakdown generator {generator}")


def in_view() -> Column:
    """The cameras (1..5) whose field of view holds the box centre, in order."""
    azimuth = F.degrees(F.atan2("cy", "cx"))
    each = [F.when(F.abs(azimuth - F.lit(at)) <= FIELD, F.lit(c)) for c, at in CAMERAS.items()]
    return F.filter(F.array(*each), lambda c: c.isNotNull())


def first_camera() -> Column:
    return F.try_element_at(in_view(), F.lit(1))


def shards_for_matching(generator: str) -> Column:
    """All shards in which an object is a candidate; predictions of ground-truth-only breakdowns have several."""
    kind = F.col("type").cast("int")
    if generator == "VELOCITY":
        return F.when(kind >= 1, F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: 5 * (kind - 1) + i)).otherwise(F.array().cast("array<int>"))
    if generator == "CAMERA":
        return F.when(kind >= 1, F.transform(in_view(), lambda c: 5 * (kind - 1) + c - 1)).otherwise(F.array().cast("array<int>"))
    one = shard(generator)
    return F.when(one >= 0, F.array(one)).otherwise(F.array().cast("array<int>"))


def explode_shards(df: DataFrame, generators: list[str]) -> DataFrame:
    """One row per object, generator and shard."""
    def named(g: str) -> Column:
        return F.transform(shards_for_matching(g), lambda s: F.struct(F.lit(g).alias("generator"), s.alias("shard")))

    each = F.flatten(F.array(*(named(g) for g in generators)))
    return df.withColumn("_s", F.explode(each)).select(*df.columns, "_s.generator", "_s.shard")


def shard_name(generator: str, shard_: int, level: int | None = None) -> str:
    if generator == "ONE_SHARD":
        name = "ONE_SHARD"
    elif generator == "ALL_BUT_SIGN":
        name = "ALL_BUT_SIGN_" + ("ALL" if shard_ == 0 else "SIGN")
    else:
        per = {"OBJECT_TYPE": 1, "RANGE": 3, "SIZE": 2, "VELOCITY": 5, "CAMERA": 5}[generator]
        name = f"{generator}_TYPE_{LABEL_TYPES[shard_ // per + 1]}"
        part = {
            "RANGE": ("[0, 30)", "[30, 50)", "[50, +inf)"),
            "SIZE": ("small", "large"),
            "VELOCITY": ("STATIONARY", "SLOW", "MEDIUM", "FAST", "VERY_FAST"),
            "CAMERA": ("FRONT", "FRONT_LEFT", "FRONT_RIGHT", "SIDE_LEFT", "SIDE_RIGHT"),
        }.get(generator)
        name += f"_{part[shard_ % per]}" if part else ""
    return name if level is None else f"{name}_LEVEL_{level}"
