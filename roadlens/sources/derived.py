"""Domain tables derived from the driver's tables by expressions that DuckDB evaluates alike.

``SQL`` has each table's defining query; Spark runs the same text over views of the Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GT = """SELECT l_orderkey AS frame,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS id,
  l_partkey AS part, CAST(1 + l_partkey % 4 AS BIGINT) AS type, l_quantity AS cx, CAST(l_suppkey % 40 AS DOUBLE) AS cy, CAST(0 AS DOUBLE) AS cz,
  1 + l_tax * 20 AS length, 1 + abs(l_discount) * 20 AS width, CAST(2 AS DOUBLE) AS height,
  CAST(l_partkey % 7 AS DOUBLE) * 0.4 - 1.2 AS heading, CAST(l_suppkey % 3 - 1 AS DOUBLE) * 0.3 AS turn,
  CAST(l_suppkey % 10 AS BIGINT) AS points, CAST(l_partkey % 12 AS DOUBLE) AS speed_x, CAST(l_suppkey % 2 AS DOUBLE) AS speed_y, abs(l_discount) AS discount
  FROM {lineitem}"""
PD = """SELECT frame, id, type, cx + CAST(part % 5 - 2 AS DOUBLE) * 0.2 AS cx, cy, cz, length, width, height, heading + turn AS heading,
  least(discount * 10, CAST(1 AS DOUBLE)) AS score, part % 13 = 0 AS nlz FROM ({gt}) g WHERE part % 11 <> 0"""
TRACKS = """SELECT user_id AS object, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
  value AS x, CAST(event_id % 17 AS DOUBLE) AS y, CAST(event_id % 6 AS DOUBLE) * 0.5 AS heading,
  CAST(event_id % 9 AS DOUBLE) AS vx, CAST(event_id % 4 AS DOUBLE) AS vy, event_id % 8 <> 0 AS valid, CAST(1 + user_id % 3 AS BIGINT) AS type, event_id FROM {events}"""
FORECASTS = """SELECT t.object, t.step, CAST(k.k AS BIGINT) AS joint, t.x + CAST((t.event_id + k.k) % 5 - 2 AS DOUBLE) * 0.7 AS x,
  t.y + CAST((t.event_id * 3 + k.k) % 7 - 3 AS DOUBLE) * 0.5 AS y, 1 / CAST(1 + (t.object + k.k) % 6 AS DOUBLE) AS confidence
  FROM ({tracks}) t CROSS JOIN (VALUES (0), (1), (2)) AS k(k)"""


def tables(lineitem: str = "lineitem", events: str = "events") -> dict[str, str]:
    gt = GT.format(lineitem=lineitem)
    tracks = TRACKS.format(events=events)
    return {"gt_boxes": gt, "pd_boxes": PD.format(gt=gt), "tracks": tracks, "forecasts": FORECASTS.format(tracks=tracks)}


SQL = tables()
KEYS = {"lineitem": "l_orderkey", "events": "user_id"}  # what the rows of a frame or track are found by
PART_BYTES = 4 << 20  # of Parquet: some 200,000 rows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one of the derived ones."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = "events" if name in ("tracks", "forecasts") else "lineitem"
    # rows of a frame or object are together from here on: joins on it and more need no other exchange
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.sql(tables(**{n: source(spark, f"{sf_dir}/{n}.parquet", KEYS[n])})[name])


def source(spark: SparkSession, path: str, key: str) -> str:
    """A Parquet file in SQL; a large one dealt by its key to partitions of PART_BYTES.

    So a task holds as much of a larger table as of a smaller one, where the session's number of shuffle
    partitions would let it grow.
    """
    table = f"parquet.`{path}`"
    size = int(str(spark.read.parquet(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = size // PART_BYTES
    if n <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return table
    return f"(SELECT /*+ REPARTITION({n}, {key}) */ * FROM {table})"
