"""Flat column names: ``key.x`` for keys, ``[Component].field.sub`` for payload, ``field[*]`` for lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "key."


def q(name: str) -> str:
    """Back-quote a column name that holds dots or brackets."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def keys(df: DataFrame, prefix: str = KEY) -> list[str]:
    """Key columns of a table, in its order."""
    return [c for c in df.columns if c.startswith(prefix)]
