"""Columns that operators add, without a clash with what the table has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def free(df: DataFrame | T.StructType, name: str) -> str:
    """name, with underscores before it until no column of df has it (case ignored)."""
    taken = {c.lower() for c in (df.names if isinstance(df, T.StructType) else df.columns)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns named, under the operator's own names: ``pick(df, doc_id="id")``."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
