"""Component tables on disk: one folder a tag, one file a segment; fixed schemas, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.naming import KEY, q
from roadlens.schemas import COMPONENTS, UNTAGGED


def read(spark: SparkSession, root: str, tag: str, segments: list[str] | None = None) -> DataFrame:
    """A component table, of all segments or some; filters on keys and column choices reach the scan."""
    schema = {**COMPONENTS, **UNTAGGED}[tag]
    paths = [f"{root}/{tag}/{s}.parquet" for s in segments] if segments else [f"{root}/{tag}"]
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


def write(df: DataFrame, root: str, tag: str) -> None:
    """Check the columns against the tag's schema and write, partition files by segment."""
    schema = {**COMPONENTS, **UNTAGGED}[tag]
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{tag} lacks {missing}")
    out = df.select(*(F.col(q(f.name)).cast(f.dataType).alias(f.name) for f in schema))
    out.repartition(q(f"{KEY}segment_context_name")).write.mode("append").parquet(f"{root}/{tag}")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Length-prefixed record files (8-byte length, checksum, bytes, checksum) as (path, position, record).

    A file is the unit: the format has no sync marks.  Bodies' checksums are verified.
    """

    def run(batches):
        import struct

        import pyarrow as pa

        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, k, rows = 0, 0, []
                while at < len(blob):
                    if at + 12 > len(blob):
                        raise ValueError(f"{name}: cut off at byte {at}")
                    (n,) = struct.unpack_from("<Q", blob, at)
                    body = blob[at + 12 : at + 12 + n]
                    if len(body) < n or len(blob) < at + 16 + n:
                        raise ValueError(f"{name}: cut off at byte {at}")
                    if masked_crc32c(body) != struct.unpack_from("<I", blob, at + 12 + n)[0]:
                        raise ValueError(f"{name}: bad checksum of record {k}")
                    rows.append((name, k, body))
                    at, k = at + 16 + n, k + 1
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], names=["path", "position", "record"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], names=["path", "position", "record"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, position long, record binary")


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_CRC = _crc_table()


def masked_crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """A tree of .npy files as (context, timestamp, field, shape, values)."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(blob), allow_pickle=False)
                context, stamp, field = name.rsplit("/", 3)[1:]
                rows.append((context, int(stamp), field.removesuffix(".npy"), list(a.shape), a.astype(np.float64).ravel()))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["context", "timestamp", "field", "shape", "values"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(run, "context string, timestamp long, field string, shape array<int>, values array<double>")
