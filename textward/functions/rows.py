"""Columns that a plan computes once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later projections read and the optimizer does not write out again wherever they are used: they come from a generator of one row."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
