"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: Column | str, *keep, value: str, pos: str | None = None) -> DataFrame:
    """``keep`` columns and one row per array element; empty and null arrays vanish.

    The plain generators make the optimizer add "the array is not empty" below
    the generator, where the array is not there yet and is computed a second
    time. The outer ones do not, so the array is computed once and empty arrays
    are dropped afterwards.
    """
    if pos is None:
        rows = df.select(*keep, F.explode_outer(array).alias(value))
        return rows.filter(F.col(value).isNotNull())
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with these costly columns shielded from later filters.

    A filter on a computed column is pushed below it and brings along a second
    copy of the computation. It cannot pass a generator, so the columns are sent
    through one as a single struct.
    """
    others = [c for c in df.columns if c not in columns]
    one = F.array(F.struct(*columns))
    return exploded(df, one, *others, value="_once").select(*others, "_once.*")
