"""NumPy kernels for what column expressions cannot say: assignment and convex clipping.

They run inside Arrow functions, a frame or scene at a time; a frame's boxes are bounded by the scene.
"""

from __future__ import annotations

import numpy as np

SMALL, LARGE = 1e-2, 1e6


def assign(weight: np.ndarray) -> np.ndarray:
    """Maximum-weight assignment: for each row its column, or -1.

    Shortest augmenting paths with potentials over the padded square cost matrix (Jonker and Volgenant
    1987), O(n^3), rows vectorised.  Weights are non-negative; a pair of weight 0 is no pair.
    """
    rows, cols = weight.shape
    some_r, some_c = np.flatnonzero(weight.any(1)), np.flatnonzero(weight.any(0))
    out = np.full(rows, -1)
    if not len(some_r):
        return out
    alone = weight[np.ix_(some_r, some_c)]
    per_r, per_c = np.count_nonzero(alone, 1), np.count_nonzero(alone, 0)
    if (per_r == 1).all() and (per_c == 1).all():  # nothing competes
        out[some_r] = some_c[alone.argmax(1)]
        return out
    if len(some_r) < rows or len(some_c) < cols:
        got = assign(alone)
        out[some_r[got >= 0]] = some_c[got[got >= 0]]
        return out
    n = max(rows, cols)
    top = weight.max()
    cost = np.full((n + 1, n + 1), float(top))
    cost[1 : rows + 1, 1 : cols + 1] = top - weight
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, np.int64)  # of each column
    for i in range(1, n + 1):
        owner[0] = i
        j0, least = 0, np.full(n + 1, np.inf)
        way, used = np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            free = ~used
            free[0] = False
            now = cost[i0] - u[i0] - v
            better = free & (now < least)
            least[better], way[better] = now[better], j0
            at = np.flatnonzero(free)
            j1 = at[np.argmin(least[at])]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    for j in range(1, cols + 1):
        i = owner[j] - 1
        if i < rows and weight[i, j - 1] > 0:
            out[i] = j - 1
    return out


def later(weight: np.ndarray) -> np.ndarray:
    """Whole weights with less than a half in all added to pairs, so that of equal assignments the one of later rows, then later columns, is best."""
    rows, cols = weight.shape
    most = min(rows, cols)
    rank = np.arange(rows)[:, None] * (cols * most + 1) + np.arange(cols)[None, :]
    return np.where(weight > 0, weight + rank / (2.0 * most * (rank[-1, -1] + 1)), 0)


def greedy(weight: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Predictions by falling score (ties: first) each take their best free ground truth (ties: first)."""
    out, free = np.full(len(weight), -1), np.ones(weight.shape[1], bool)
    for i in np.argsort(-score, kind="stable"):
        w = np.where(free, weight[i], 0)
        if len(w) and w.max() > 0:
            out[i] = int(w.argmax())
            free[out[i]] = False
    return out


def corners(box: np.ndarray) -> np.ndarray:
    """Boxes (n, 5: cx, cy, l, w, heading) to corners (n, 4, 2), counter-clockwise."""
    s = np.array([[0.5, -0.5], [0.5, 0.5], [-0.5, 0.5], [-0.5, -0.5]])
    x, y = box[:, 2:3] * s[:, 0], box[:, 3:4] * s[:, 1]
    c, n = np.cos(box[:, 4:5]), np.sin(box[:, 4:5])
    return np.stack([box[:, 0:1] + c * x - n * y, box[:, 1:2] + n * x + c * y], 2)


def _seen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of boxes b in the frame of boxes a: the larger gap along a's sides, the least squared distance of a corner of b to a."""
    dx, dy, turn = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1], b[:, 4] - a[:, 4]
    c, s, tc, ts = np.cos(a[:, 4]), np.sin(a[:, 4]), np.cos(turn), np.sin(turn)
    u, v = dx * c + dy * s, dy * c - dx * s
    l, w, bl, bw = a[:, 2] / 2, a[:, 3] / 2, b[:, 2] / 2, b[:, 3] / 2
    gap = np.maximum(np.abs(u) - l - (bl * np.abs(tc) + bw * np.abs(ts)), np.abs(v) - w - (bl * np.abs(ts) + bw * np.abs(tc)))
    least = np.full(len(a), np.inf)
    for k, m in ((1, -1), (1, 1), (-1, 1), (-1, -1)):
        x = np.maximum(np.abs(u + k * bl * tc - m * bw * ts) - l, 0)
        y = np.maximum(np.abs(v + k * bl * ts + m * bw * tc) - w, 0)
        least = np.minimum(least, x * x + y * y)
    return gap, least


def box_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed distances of boxes a[i] and b[i] (n, 5: cx, cy, l, w, heading).

    Overlapping, it is the largest (least negative) separation along the four side normals; apart, the
    least distance of a corner of one to the other.
    """
    (ga, da), (gb, db) = _seen(a, b), _seen(b, a)
    gap = np.maximum(ga, gb)
    return np.where(gap <= 0, gap, np.sqrt(np.minimum(da, db)))


def clip_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas shared by pairs of convex counter-clockwise polygons (m, k, 2): clipping by half planes."""
    m = len(a)
    poly, n = a, np.full(m, a.shape[1])
    for k in range(b.shape[1]):
        v = poly.shape[1]
        slot = np.arange(v)
        p = b[:, k, None]
        d = b[:, (k + 1) % b.shape[1], None] - p
        side = d[..., 0] * (poly[..., 1] - p[..., 1]) - d[..., 1] * (poly[..., 0] - p[..., 0])
        nxt = np.where(slot + 1 < n[:, None], slot + 1, 0)
        there = slot < n[:, None]
        other = np.take_along_axis(side, nxt, 1)
        cross = there & (((side > 1e-12) & (other < -1e-12)) | ((side < -1e-12) & (other > 1e-12)))
        t = side / np.where(cross, side - other, 1)
        cut = poly + (np.take_along_axis(poly, nxt[..., None], 1) - poly) * t[..., None]
        points = np.stack([poly, cut], 2).reshape(m, 2 * v, 2)
        keep = np.stack([there & (side >= -1e-12), cross], 2).reshape(m, 2 * v)
        n = keep.sum(1)
        order = np.argsort(~keep, 1, kind="stable")[:, : max(1, n.max(initial=0))]
        poly = np.take_along_axis(points, order[..., None], 1)
    slot = np.arange(poly.shape[1])
    nxt = np.where(slot + 1 < n[:, None], slot + 1, 0)
    q = np.take_along_axis(poly, nxt[..., None], 1)
    twice = np.where(slot < n[:, None], poly[..., 0] * q[..., 1] - poly[..., 1] * q[..., 0], 0).sum(1)
    return np.where(n >= 3, np.abs(twice) / 2, 0)


def pair_iou(a: np.ndarray, b: np.ndarray, kind: str = "3d", digits: int | None = 9) -> np.ndarray:
    """IoU of boxes a[i] and b[i] (m, 7: cx, cy, cz, l, w, h, heading): kind aa, 2d or 3d; ``digits`` None does not round."""
    dims = slice(3, 6) if kind == "3d" else slice(3, 5)
    ok = lambda x: ((x[:, dims] > SMALL) & (x[:, dims] < LARGE)).all(1)
    fine = np.flatnonzero(ok(a) & ok(b))
    out = np.zeros(len(a))
    a, b = a[fine], b[fine]
    shared = lambda i: np.clip(np.minimum(a[:, i] + a[:, 3 + i] / 2, b[:, i] + b[:, 3 + i] / 2) - np.maximum(a[:, i] - a[:, 3 + i] / 2, b[:, i] - b[:, 3 + i] / 2), 0, None)
    if kind == "aa":
        inter = shared(0) * shared(1)
    else:
        inter = np.zeros(len(a))
        flat = [0, 1, 3, 4, 6]
        reach = np.hypot(a[:, 3], a[:, 4]) / 2 + np.hypot(b[:, 3], b[:, 4]) / 2
        near = np.flatnonzero(np.hypot(a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]) <= reach)  # circles first
        if len(near):
            inter[near] = clip_areas(corners(a[near][:, flat]), corners(b[near][:, flat]))
    va, vb = a[:, 3] * a[:, 4], b[:, 3] * b[:, 4]
    if kind == "3d":
        inter, va, vb = inter * shared(2), va * a[:, 5], vb * b[:, 5]
    value = inter / (va + vb - inter)
    out[fine] = np.clip(value if digits is None else np.round(value, digits), 0, 1)  # a threshold must not hang on the last bits
    return out


def iou(a: np.ndarray, b: np.ndarray, kind: str = "3d", wanted: np.ndarray | None = None) -> np.ndarray:
    """IoU of all (or the wanted) pairs of boxes of a and b, as a matrix."""
    out = np.zeros((len(a), len(b)))
    i, j = np.nonzero(np.ones_like(out, bool) if wanted is None else wanted)
    if len(i):
        out[i, j] = pair_iou(a[i], b[j], kind)
    return out
