"""Scenario tables to flat, fixed-size examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAD = -1.0


def padded(df: DataFrame, by: list[str], order: str, values: list[str], n: int, pad: float = PAD) -> DataFrame:
    """(by.., values as arrays of exactly n): rows in order, cut at n, padded with ``pad``."""
    w = Window.partitionBy(*by).orderBy(order)
    kept = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    g = kept.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_r", *values))).alias("_rows"))
    fill = F.array_repeat(F.lit(pad), n)
    return g.select(*by, *(F.slice(F.concat(F.transform(F.col(f"_rows.{v}"), lambda x: F.coalesce(x.cast("double"), F.lit(pad))), fill), 1, n).alias(v) for v in values))


def steps(tracks: DataFrame, by: list[str], values: list[str], past: int = 10, future: int = 80) -> DataFrame:
    """(by.., past_v, current_v, future_v): states by absolute step, absent or invalid ones padded."""
    n = past + 1 + future
    valid = F.map_from_entries(F.collect_list(F.when(F.col("valid") & (F.col("step") < n), F.struct(F.col("step").cast("int"), F.struct(*values)))))
    g = tracks.groupBy(*by).agg(valid.alias("_m"))
    at = lambda v, lo, hi: F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda i: F.coalesce(F.try_element_at("_m", i)[v], F.lit(PAD)))
    return g.select(*by, *(a.alias(f"{p}_{v}") for v in values for p, a in (("past", at(v, 0, past - 1)), ("current", at(v, past, past)), ("future", at(v, past + 1, n - 1)))))


def resample(points: DataFrame, by: list[str], spacing: float) -> DataFrame:
    """Polyline points (by.., position, x, y) at even arc-length spacing by linear interpolation: (by.., k, x, y)."""
    w = Window.partitionBy(*by).orderBy("position")
    d = F.coalesce(F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2), F.lit(0.0))
    s = points.withColumn("_d", d).withColumn("_s", F.sum("_d").over(w))
    seg = s.select(*by, F.lag("_s").over(w).alias("s0"), F.col("_s").alias("s1"), F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("position"))
    first = seg.where("s0 is null").select(*by, F.lit(0).cast("long").alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    k0, k1 = F.floor(F.col("s0") / spacing) + 1, F.floor(F.col("s1") / spacing)
    more = seg.where("s1 > s0").withColumn("k", F.explode(F.when(k1 >= k0, F.sequence(k0, k1)).otherwise(F.array().cast("array<bigint>"))))
    t = (F.col("k") * spacing - F.col("s0")) / (F.col("s1") - F.col("s0"))
    return first.union(more.select(*by, "k", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y")))


def cap_by_priority(points: DataFrame, by: list[str], priority: dict[int, int], most: int = 30_000, order: str = "position") -> DataFrame:
    """At most ``most`` points a scenario, kinds of low priority number first."""
    rank = F.lit(len(priority))
    for kind, p in priority.items():
        rank = F.when(F.col("kind") == kind, F.lit(p)).otherwise(rank)
    w = Window.partitionBy(*by).orderBy(rank, order)
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def augment(scenarios: DataFrame, parts: DataFrame, on: str, name: str) -> DataFrame:
    """Scenarios with a list of the other table's rows for the same id (empty if none)."""
    rest = [c for c in parts.columns if c != on]
    g = parts.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    out = scenarios.join(g, on, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def of_vehicle(tracks: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by.., step, values..) of the vehicle's own track, one a scenario; fails where a step has two."""
    own = tracks.where("is_sdc").groupBy(*by, "step").agg(F.count(F.lit(1)).alias("_n"), *(F.first(v).alias(v) for v in values))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.lit("several tracks of the vehicle itself")).cast("boolean")).otherwise(F.lit(True))
    return own.where(ok).drop("_n")


def token_vectors(tokens: DataFrame, codebook: DataFrame, size: int) -> DataFrame:
    """Tokens with their code vectors; the codebook holds ``size`` rows, and a token outside it fails."""
    ok = F.when((F.col("token") < 0) | (F.col("token") >= size), F.raise_error(F.concat(F.lit("token out of range: "), F.col("token").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    small = codebook.where((F.col("token") >= 0) & (F.col("token") < size)).select("token", "vector")
    return tokens.where(ok).join(F.broadcast(small), "token")
