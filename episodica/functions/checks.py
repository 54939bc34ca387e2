"""Checks of the strict modes: what the caller asks for must be there."""

from __future__ import annotations

from pyspark.sql import DataFrame


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no row. Evaluates as much of it as one row needs."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def none_of(bad: DataFrame, what: str) -> None:
    """An error that names the first row of ``bad``, if there is one."""
    if row := bad.first():
        raise ValueError(f"{what}: {row.asDict()}")
