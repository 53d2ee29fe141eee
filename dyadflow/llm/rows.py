"""Rows carried along as one struct, so that no column of theirs can clash with a name used on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly that name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame) -> Column:
    """All columns of a row as one struct; ``select("<alias>.*")`` gives them back."""
    return F.struct(*map(named, df.columns))
