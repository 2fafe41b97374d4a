"""Renderers over DataFrames: a text a row, made by the tasks that hold the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..storage import map_rows


def rendered(df: DataFrame, render: Callable[..., str], *columns: str, name: str = "text") -> DataFrame:
    """df's other columns, and what render makes of the given ones in `name`. Structs and maps come as dicts."""
    rest = [c for c in df.columns if c not in columns]
    fields = [df.schema[c] for c in rest] + [T.StructField(name, T.StringType())]
    k = len(columns)
    return map_rows(df.select(*columns, *rest), lambda rows: ((*r[k:], render(*r[:k])) for r in rows), T.StructType(fields))
