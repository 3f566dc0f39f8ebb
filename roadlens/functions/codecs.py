"""Array codecs: quantised delta coding with a run-length mask, and PCA tiles.  NumPy per value."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delta_encode(values: np.ndarray, step: float) -> bytes:
    """Flat float values, quantised to step; zeros are a run-length mask, the rest are differences.

    The input is not changed.  Layout: zlib of count, step, runs, differences.
    """
    q = np.rint(np.asarray(values, np.float64) / step).astype(np.int64).ravel()
    mask = q != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask]).astype(np.int8)) != 0)
    runs = np.diff(np.concatenate([[0], edge, [len(q)]])).astype(np.int32)
    kept = np.diff(q[mask], prepend=0)
    wide = np.int32 if len(kept) == 0 or np.abs(kept).max() < 2**31 else np.int64
    return zlib.compress(struct.pack("<qdib", len(q), step, len(runs), np.dtype(wide).itemsize) + runs.tobytes() + kept.astype(wide).tobytes())


def delta_decode(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    head = struct.calcsize("<qdib")
    n, step, k, size = struct.unpack("<qdib", raw[:head])
    runs = np.frombuffer(raw, np.int32, k, head)
    mask = np.repeat(np.arange(k) % 2 == 1, runs)
    out = np.zeros(n, np.int64)
    out[mask] = np.cumsum(np.frombuffer(raw, np.int32 if size == 4 else np.int64, -1, head + 4 * k))
    return out * step


@F.pandas_udf(T.BinaryType())
def encode(values: pd.Series, step: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else delta_encode(v, s) for v, s in zip(values, step, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode(blobs: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else delta_decode(bytes(b)) for b in blobs])


class Pca:
    """Standardise, project to k components, quantise to a step; fitted on a bounded set of rows."""

    def __init__(self, rows: np.ndarray, k: int, step: float = 0.01):
        x = np.asarray(rows, np.float64)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-12)
        _, _, v = np.linalg.svd((x - self.mean) / self.scale, full_matrices=False)
        self.basis, self.step = v[:k], step

    def encode(self, rows: np.ndarray) -> np.ndarray:
        return np.rint((np.asarray(rows, np.float64) - self.mean) / self.scale @ self.basis.T / self.step).astype(np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes * self.step @ self.basis * self.scale + self.mean


def tiles(image: np.ndarray, size: int) -> np.ndarray:
    """(h, w, c) to (tiles, size * size * c); edges are padded by reflection."""
    h, w, c = image.shape
    p = np.pad(image, ((0, -h % size), (0, -w % size), (0, 0)), mode="reflect" if min(h, w) > size else "edge")
    a, b = p.shape[0] // size, p.shape[1] // size
    return p.reshape(a, size, b, size, c).swapaxes(1, 2).reshape(a * b, -1)


def untile(rows: np.ndarray, height: int, width: int, channels: int, size: int) -> np.ndarray:
    a, b = -(-height // size), -(-width // size)
    return rows.reshape(a, b, size, size, channels).swapaxes(1, 2).reshape(a * size, b * size, channels)[:height, :width]


def rays_to_box(origin, direction, centre, size, heading):
    """Column: distance along a ray at which it enters a box, null if it misses (slab method)."""
    from roadlens.functions.geometry import rotate

    ox, oy = rotate(origin[0] - centre[0], origin[1] - centre[1], -heading)
    dx, dy = rotate(direction[0], direction[1], -heading)
    near, far = F.lit(float("-inf")), F.lit(float("inf"))
    for o, d, s in ((ox, dx, size[0]), (oy, dy, size[1]), (origin[2] - centre[2], direction[2], size[2])):
        a, b = (-s / 2 - o) / F.nullif(d, F.lit(0.0)), (s / 2 - o) / F.nullif(d, F.lit(0.0))
        outside = F.abs(o) > s / 2
        near = F.greatest(near, F.when(d == 0, F.when(outside, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.least(a, b)))
        far = F.least(far, F.when(d == 0, F.lit(float("inf"))).otherwise(F.greatest(a, b)))
    return F.when((near <= far) & (far >= 0), F.greatest(near, F.lit(0.0)))
