"""Streaming forms: additive metric states as running sums, tracking as a keyed state."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.operators.detection import THRESHOLDS
from roadlens.operators.tracking import BOX, Mot


def running_counts(parts: DataFrame, watermark: str | None = None) -> DataFrame:
    """Counters of arriving partial results summed by shard; write in update or complete mode."""
    d = parts.withWatermark("ts", watermark) if watermark else parts
    return d.groupBy("generator", "shard", "level", "cutoff").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "sum_ha", "sum_la")))


def running_confusion(points: DataFrame) -> DataFrame:
    return points.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and type with late rows up to ``late``; append mode emits closed windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


OUT = "scene long, frame long, misses long, fps long, matches long, mismatches long, objects long, cost double"


def running_mot(rows: DataFrame, thresholds=THRESHOLDS, kind: str = "3d", level: int = 2) -> DataFrame:
    """Tracking counters after each frame of a scene.

    rows: scene, frame, side ('p' or 'g'), id, type, box, score, nlz, level.  A frame is complete when a
    row of a later frame of its scene has come; frames are taken in order, later rows of a past frame fail.
    """

    def run(key, batches, state):
        mot, waiting, done = pickle.loads(state.get[0]) if state.exists else (Mot(thresholds, kind, level), None, -1)
        new = pd.concat(list(batches))
        if len(new) and new["frame"].min() <= done:
            raise ValueError(f"scene {key[0]}: a row of a past frame came late")
        waiting = new if waiting is None else pd.concat([waiting, new])
        out = []
        for f in sorted(waiting["frame"].unique())[:-1]:
            rows = waiting[waiting["frame"] == f].sort_values("id")
            a, b = rows[rows["side"] == "p"], rows[rows["side"] == "g"]
            mot.step(a["id"].to_numpy(), a["type"].to_numpy(), a[BOX].to_numpy(float), a["nlz"].to_numpy(bool), b["id"].to_numpy(), b["type"].to_numpy(), b[BOX].to_numpy(float), b["level"].to_numpy())
            done = int(f)
            out.append((key[0], done, *mot.counts()))
        waiting = waiting[waiting["frame"] > done]
        state.update((pickle.dumps((mot, waiting, done)),))
        yield pd.DataFrame(out, columns=["scene", "frame", "misses", "fps", "matches", "mismatches", "objects", "cost"])

    return rows.groupBy("scene").applyInPandasWithState(run, OUT, "state binary", "append", "NoTimeout")
