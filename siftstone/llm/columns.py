"""Columns of callers' tables, which may have any names, clashing ones included; names are compared as Spark does."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of ``df`` other than ``names``."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def as_row(df: DataFrame, without: Iterable[str] = ()) -> Column:
    """All columns of ``df`` but ``without`` as one struct, so that none of them can clash with an operator's own.

    ``select("row.*")`` gives them back. A table without other columns gives a struct of one null.
    """
    kept = others(df, without)
    return F.struct(*map(quoted, kept)) if kept else F.struct(F.lit(None).cast("boolean").alias("_"))


def row_columns(df: DataFrame, without: Iterable[str] = (), row: str = "row") -> list[Column]:
    """The columns that ``as_row`` packed, out of the struct ``row``."""
    return [F.col(row).getField(c).alias(c) for c in others(df, without)]
