"""What a physical plan does: pushed filters, columns read, shuffles, joins, Python."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    """The formatted plan, before adaptive changes."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed_filters(df: DataFrame) -> list[str]:
    return [x for m in re.findall(r"PushedFilters: \[(.*?)\]\n", text(df)) for x in m.split("), ") if x]


def columns_read(df: DataFrame) -> list[set[str]]:
    """Of each scan, the columns in its read schema."""
    return [{c.split(":")[0] for c in re.split(r",(?![^<]*>)", m) if c} for m in re.findall(r"ReadSchema: struct<(.*)>\n", text(df))]


def operators(df: DataFrame) -> Counter:
    return Counter(re.findall(r"^\(\d+\) (\w+)", text(df), re.M))


def shuffles(df: DataFrame) -> int:
    return operators(df)["Exchange"]


def all_pairs(df: DataFrame) -> bool:
    """Whether a cross product or a nested loop join is in the plan."""
    return any(re.search("Cartesian|NestedLoop", o) for o in operators(df))
