"""Columns that are made once a row, apart from what reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, through a one-element array: the optimizer would copy them into each of their uses."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select("*", F.explode(F.array(made)).alias("_made")).select(*rows.columns, "_made.*")
