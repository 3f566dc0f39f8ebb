"""Multi-object tracking: sticky matching over a scene's frames, counters and MOTA/MOTP.

A scene, shard and cutoff is sequential in time, so it is one group of an Arrow call; scenes are bounded
(tens of seconds) and spread over the cluster.  Counters are additive over scenes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import kernels as K
from roadlens.operators.detection import BOX, QUANTUM, THRESHOLDS, buckets, frame_pairs


class Mot:
    """Matching state of one scene, shard and cutoff; ``step`` takes a frame."""

    def __init__(self, thresholds=THRESHOLDS, kind: str = "3d", level: int = 2):
        self.thresholds, self.kind, self.level = thresholds, kind, level
        self.of_gt: dict = {}
        self.of_pd: dict = {}
        self.misses = self.fps = self.matches = self.mismatches = self.objects = 0
        self.cost = 0.0

    def step(self, pd_ids, pd_types, pd_boxes, nlz, gt_ids, gt_types, gt_boxes, levels, weight=None) -> None:
        """weight: a given similarity matrix in place of IoU, for tests."""
        overlap = K.iou(pd_boxes, gt_boxes, self.kind, pd_types[:, None] == gt_types[None, :]) if weight is None else weight
        need = np.array([self.thresholds.get(int(t), np.inf) for t in pd_types])
        can = (overlap >= need[:, None]) & (overlap > 0) if overlap.size else np.zeros_like(overlap, bool)
        p_at, g_at = {}, {}
        for i, x in enumerate(pd_ids):
            p_at.setdefault(x, i)  # a repeated prediction is ignored
        for j, x in enumerate(gt_ids):
            if x in g_at:
                raise ValueError(f"ground truth {x} occurs twice in a frame")
            g_at[x] = j
        new: dict = {}
        for g, p in self.of_gt.items():
            if p in p_at and g in g_at and can[p_at[p], g_at[g]]:
                new[g] = p
                self.cost += 1 - float(overlap[p_at[p], g_at[g]])
        for g, p in new.items():
            del p_at[p], g_at[g]
        rest_p, rest_g = list(p_at.values()), list(g_at.values())
        w = np.where(can, np.round(overlap * QUANTUM), 0)[np.ix_(rest_p, rest_g)] if rest_p and rest_g else np.zeros((len(rest_p), len(rest_g)))
        match = K.assign(w)
        for i, m in zip(rest_p, match, strict=True):
            if m >= 0:
                j = rest_g[m]
                new[gt_ids[j]] = pd_ids[i]
                self.cost += 1 - float(overlap[i, j])
            elif not nlz[i]:
                self.fps += 1
        lost = [j for k, j in enumerate(rest_g) if k not in set(match.tolist())]
        counted = sum(int(levels[j]) <= self.level for j in lost)
        self.misses += counted
        self.objects += len(gt_ids) - (len(lost) - counted)
        self.matches += len(new)
        for g, p in new.items():
            if g in self.of_gt and self.of_gt[g] != p:
                self.mismatches += 1
            before = self.of_pd.get(p)
            if before is not None and before not in g_at and before not in new:
                self.mismatches += 1
        gone = [self.of_pd[p] for p in new.values() if p in self.of_pd and self.of_pd[p] not in new]
        self.of_gt.update(new)
        for g in gone:
            self.of_gt.pop(g, None)
        self.of_pd = {p: g for g, p in self.of_gt.items()}

    def counts(self) -> tuple:
        return self.misses, self.fps, self.matches, self.mismatches, self.objects, self.cost


def _mismatches(scene: np.ndarray, step: np.ndarray, p: np.ndarray, g: np.ndarray, present: np.ndarray, truths: int) -> np.ndarray:
    """Indices of the matches (p, g) that ``Mot`` counts as mismatches, once for each of its two reasons.

    ``g`` are ranks among ``truths`` ids and ``present`` the sorted codes step * truths + g of all truths.  A truth
    keeps its last prediction until another truth takes that one.
    """
    n = len(step)
    never = np.iinfo(np.int64).max

    def neighbours(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each match the one before with the same member, or -1, and the step of the one after."""
        order = np.lexsort((step, who, scene))
        same = (scene[order][1:] == scene[order][:-1]) & (who[order][1:] == who[order][:-1])
        before, after = np.full(n, -1), np.full(n, never)
        before[order[1:][same]] = order[:-1][same]
        after[order[:-1][same]] = step[order[1:][same]]
        return before, after

    before_g, after_g = neighbours(g)
    before_p, after_p = neighbours(p)
    r = np.flatnonzero(before_g >= 0)
    q = before_g[r]
    other = r[(p[q] != p[r]) & (after_p[q] >= step[r])]
    r = np.flatnonzero(before_p >= 0)
    q = before_p[r]
    r, q = r[after_g[q] >= step[r]], q[after_g[q] >= step[r]]
    code = step[r] * truths + g[q]
    at = np.minimum(np.searchsorted(present, code), max(len(present) - 1, 0))
    left = r[present[at] != code] if len(r) else r
    return np.concatenate([other, left])


def _scene(config: dict):
    limit = np.full(max(config["thresholds"]) + 1, np.inf)
    for t, v in config["thresholds"].items():
        limit[t] = v

    def run(key, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        order = ["scene", "shard", "frame", "id"]
        p, g = p.sort_values(order), g.sort_values(order)
        both = pd.concat([p[order], g[order]])
        if g.duplicated(order).any():
            raise ValueError("a ground truth occurs twice in a frame")
        p_first = ~p.duplicated(order).to_numpy()  # a repeated prediction is ignored
        group = both.groupby(order[:2], sort=True).ngroup().to_numpy()
        step = both.groupby(order[:3], sort=True).ngroup().to_numpy()
        groups = both[order[:2]].drop_duplicates().sort_values(order[:2]).to_numpy()
        n = len(p)
        pg, gg, ps, gs = group[:n], group[n:], step[:n], step[n:]
        pid, pt, a, score, nlz = (p["id"].to_numpy(), p["type"].to_numpy(int), p[BOX].to_numpy(float), p["score"].to_numpy(float), p["nlz"].to_numpy(bool))
        gid, gt, b, level = g["id"].to_numpy(), g["type"].to_numpy(int), g[BOX].to_numpy(float), g["level"].to_numpy(int)
        i, j = frame_pairs(ps, gs)
        ok = pt[i] == gt[j]
        i, j = i[ok], j[ok]
        overlap = K.pair_iou(a[i], b[j], config["kind"])
        can = (overlap >= np.where(pt < len(limit), limit[np.clip(pt, 0, len(limit) - 1)], np.inf)[i]) & (overlap > 0)
        i, j, overlap = i[can], j[can], overlap[can]
        p0, p1 = np.searchsorted(ps, np.arange(step.max() + 1)), np.searchsorted(ps, np.arange(step.max() + 1), "right")
        g0, g1 = np.searchsorted(gs, np.arange(step.max() + 1)), np.searchsorted(gs, np.arange(step.max() + 1), "right")
        counted = level <= config["level"]
        twice = np.zeros(len(groups), bool)  # scenes with a repeated prediction
        twice[pg[~p_first]] = True
        truth = np.unique(gid)
        present = gs * len(truth) + np.searchsorted(truth, gid)  # rises: truths go by step and id
        out = []
        for cut in config["cutoffs"]:
            act = score >= cut
            k = np.flatnonzero(act[i])
            x, y = i[k], j[k]
            many = (np.bincount(x)[x] > 1) | (np.bincount(y)[y] > 1) if len(k) else np.zeros(0, bool)
            # where nothing competes in a scene all matches are known; only other scenes go frame by frame
            hard = twice.copy()
            hard[pg[x[many]]] = True
            busy = np.zeros(step.max() + 1, bool)
            busy[ps[x[hard[pg[x]]]]] = True
            easy, k = k[~hard[pg[x]]], k[hard[pg[x]]]
            x, y = i[easy], j[easy]
            free_p, free_g = act & p_first & ~busy[ps] & ~nlz, ~busy[gs] & counted
            free_p[x] = False
            free_g[y] = False
            total = lambda group, weights=None: np.bincount(group, weights, len(groups))
            fps, missed, matched = total(pg[free_p]), total(gg[free_g]), total(pg[x])
            cost, swapped = total(pg[x], 1 - overlap[easy]), total(pg[x[_mismatches(pg[x], ps[x], pid[x], np.searchsorted(truth, gid[y]), present, len(truth))]])
            mots = {}
            bounds = np.searchsorted(ps[i[k]], np.flatnonzero(busy)), np.searchsorted(ps[i[k]], np.flatnonzero(busy), "right")
            for f, lo, hi in zip(np.flatnonzero(busy).tolist(), *bounds, strict=True):
                x = np.arange(p0[f], p1[f])[act[p0[f] : p1[f]]]
                y = np.arange(g0[f], g1[f])
                w = np.zeros((len(x), len(y)))
                w[np.searchsorted(x, i[k[lo:hi]]), j[k[lo:hi]] - g0[f]] = overlap[k[lo:hi]]
                of = int(pg[x[0]])
                if of not in mots:
                    mots[of] = Mot(config["thresholds"], config["kind"], config["level"])
                mots[of].step(pid[x].tolist(), pt[x], None, nlz[x], gid[y].tolist(), gt[y], None, level[y], w)
            sums = np.stack([missed, fps, matched, swapped, matched + missed], 1)
            for of, mot in mots.items():
                c = mot.counts()
                sums[of] += c[:5]
                cost[of] += c[5]
            found = pd.DataFrame(sums, columns=["misses", "fps", "matches", "mismatches", "objects"])
            out.append(found.assign(scene=groups[:, 0], shard=groups[:, 1], cutoff=float(cut), cost=cost))
        return pd.concat(out)[["scene", "shard", "cutoff", "misses", "fps", "matches", "mismatches", "objects", "cost"]]

    return run


def measure(pd_: DataFrame, gt: DataFrame, cutoffs: list[float], thresholds=THRESHOLDS, kind: str = "3d", level: int = 2) -> DataFrame:
    """Counters per scene, shard and cutoff; both sides have scene, shard, frame (ordered), id, type, box."""
    config = {"cutoffs": list(cutoffs), "thresholds": thresholds, "kind": kind, "level": level}
    p = pd_.select("scene", "shard", "frame", "id", "type", *BOX, "score", "nlz")
    g = gt.select("scene", "shard", "frame", "id", "type", *BOX, "level")
    schema = "scene long, shard long, cutoff double, misses long, fps long, matches long, mismatches long, objects long, cost double"
    bucket = buckets(p, "scene", "shard")
    return p.select(bucket, "*").groupBy("bucket").cogroup(g.select(bucket, "*").groupBy("bucket")).applyInPandas(_scene(config), schema)


def metrics(counts: DataFrame) -> DataFrame:
    """MOTA, MOTP and ratios per shard at the cutoff of best MOTA.

    A shard whose MOTA is nowhere positive reports 0 and no cutoff.
    """
    s = counts.groupBy("shard", "cutoff").agg(*(F.sum(c).alias(c) for c in ("misses", "fps", "matches", "mismatches", "objects", "cost")))
    per = lambda c: F.when(F.col("objects") > 0, F.col(c) / F.col("objects")).otherwise(F.lit(0.0))
    rated = s.select("shard", "cutoff", (1 - per("misses") - per("fps") - per("mismatches")).alias("mota"), F.when(F.col("matches") > 0, F.col("cost") / F.col("matches")).otherwise(F.lit(0.0)).alias("motp"), per("misses").alias("miss"), per("fps").alias("fp"), per("mismatches").alias("mismatch"), "objects")
    best = F.max_by(F.struct("cutoff", "mota", "motp", "miss", "fp", "mismatch"), F.when((F.col("mota") > 0) & (F.col("objects") > 0), F.struct("mota", -F.col("cutoff"))))
    got = rated.groupBy("shard").agg(best.alias("b"))
    zero = lambda n: F.coalesce(f"b.{n}", F.lit(0.0)).alias(n)
    return got.select("shard", F.col("b.cutoff").alias("cutoff"), *(zero(n) for n in ("mota", "motp", "miss", "fp", "mismatch")))
