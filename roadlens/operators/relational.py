"""Keyed tables: auto-keyed merge, grouping to lists, nesting and flattening of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.naming import KEY, col, keys, q

HOW = {(False, False): "inner", (True, False): "right", (False, True): "left", (True, True): "outer"}


def group_to_lists(df: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per value of ``by``; every other column becomes a list.

    Lists keep nulls and are aligned with each other: a row's values stand at one position in all of
    them.  Their order is that of ``order`` (default: all other columns from left to right), nulls
    first.  Rows with a null in ``by`` are dropped.
    """
    rest = [c for c in df.columns if c not in by]
    order = order or rest
    names = [f"c{i}" for i in range(len(rest))]
    sortable = [c for c in order if not isinstance(df.schema[c].dataType, (T.MapType,))]
    row = F.struct(*(col(c).alias(f"o{i}") for i, c in enumerate(sortable)), *(col(c).alias(n) for c, n in zip(rest, names, strict=True)))
    grouped = df.dropna(subset=[q(c) for c in by]).groupBy(*(col(c) for c in by)).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return grouped.select(*(col(c) for c in by), *(F.col(f"_rows.{n}").alias(c) for c, n in zip(rest, names, strict=True)))


def merge(left: DataFrame, right: DataFrame, left_nullable: bool = False, right_nullable: bool = False, left_group: bool = False, right_group: bool = False, key_prefix: str = KEY) -> DataFrame:
    """Equi-join on the key columns both sides have.

    A side with further keys is first grouped to lists if its group flag is set; without it unmatched
    keys give the product of the rows of a common key.  ``left_nullable`` lets the left side be missing
    (a right join), ``right_nullable`` the right side, both give a full outer join.  Null keys join
    nothing.
    """
    lk, rk = keys(left, key_prefix), keys(right, key_prefix)
    common = [c for c in lk if c in rk]
    if not common:
        raise ValueError(f"no common key columns: {lk} and {rk}")
    if left_group and set(lk) != set(common):
        left = group_to_lists(left, common)
    if right_group and set(rk) != set(common):
        right = group_to_lists(right, common)
    # joining by name cannot see through dots in names, so keys travel under plain ones
    plain = {c: f"_k{i}" for i, c in enumerate(common)}
    bare = lambda df: df.select(*(col(c).alias(plain.get(c, c)) for c in df.columns))
    out = bare(left).join(bare(right), list(plain.values()), HOW[left_nullable, right_nullable])
    rest = [c for c in out.columns if c not in plain.values()]
    return out.select(*(F.col(p).alias(c) for c, p in plain.items()), *(col(c) for c in rest))


def nest(df: DataFrame, sep: str = ".") -> DataFrame:
    """Columns a.b.c to nested structs; names without the separator stay."""

    def build(paths: list[tuple[list[str], str]]) -> list:
        heads: dict[str, list] = {}
        for parts, full in paths:
            heads.setdefault(parts[0], []).append((parts[1:], full))
        out = []
        for head, below in heads.items():
            if len(below) == 1 and not below[0][0]:
                out.append(col(below[0][1]).alias(head))
            else:
                inner = build(below)
                null = F.lit(True)
                for _, full in below:
                    null = null & col(full).isNull()
                out.append(F.when(~null, F.struct(*inner)).alias(head))
        return out

    return df.select(*build([(c.split(sep), c) for c in df.columns]))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to columns a.b.c; a null struct gives nulls in all its leaves."""

    def leaves(kind: T.StructType, path: list[str]):
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                full = [*path, f.name]
                yield F.col(".".join(q(p) for p in full)).alias(sep.join(full))

    return df.select(*leaves(df.schema, []))


def require_all(left: DataFrame, right: DataFrame, on: list[str], message: str) -> DataFrame:
    """Inner join that fails at run time if a left row has no partner."""
    mark = right.withColumn("_there", F.lit(True))
    out = left.join(mark, on, "left")
    key = F.concat_ws(",", *(F.col(c).cast("string") for c in on))
    ok = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(message + ": "), key)).cast("boolean")).otherwise(F.lit(True))
    return out.where(ok).drop("_there")


def has_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which all the (possibly nested) fields are present; an empty list counts as absent."""
    ok = F.lit(True)
    for name in fields:
        kind = df.select(name).schema[0].dataType
        ok = ok & F.col(name).isNotNull() & (F.size(name) > 0 if isinstance(kind, T.ArrayType) else F.lit(True))
    return df.where(ok)


def missing_ids(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Ids of left that right lacks, once each."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def cogroup_frames(left: DataFrame, right: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Full outer join of the rows of each frame as lists of structs; a missing side is an empty list."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in by]
        row = F.struct(*order, *(c for c in rest if c not in order))
        return df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias(name))

    a, b = listed(left, "left"), listed(right, "right")
    out = a.join(b, by, "outer")
    return out.select(*by, *(F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n) for n in ("left", "right")))


def gather(df: DataFrame, wanted: list, id_col: str) -> DataFrame:
    """Rows of the wanted ids in their order; fails if an id is missing or occurs twice."""
    spark = df.sparkSession
    want = spark.createDataFrame([(x, i) for i, x in enumerate(wanted)], T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("position", T.LongType())]))
    one = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in df.columns if c != id_col))
    out = F.broadcast(want).join(one, id_col, "left")
    bad = F.when(F.coalesce("_n", F.lit(0)) != 1, F.raise_error(F.concat(F.lit("id missing or not unique: "), F.col(id_col).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return out.where(bad).select("position", id_col, *(c for c in df.columns if c != id_col))
