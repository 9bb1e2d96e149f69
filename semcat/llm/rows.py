"""Passing rows through Arrow batches with some columns added."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# rows of one outgoing batch
ROWS = 2048


def with_arrays(
    df: DataFrame, text_col: str, fields: dict[str, T.DataType], compute: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """``df`` with new columns ``fields``, which ``compute`` makes of its texts; equal names are replaced."""
    given = [c for c in df.columns if c not in fields]
    spare = "_text"
    while spare in df.columns:
        spare = f"_{spare}"
    rows = df.select(*[F.col(f"`{c}`") for c in given])
    # a text that is kept anyway is not sent twice
    source = text_col if text_col in given and dict(rows.dtypes)[text_col] == "string" else spare
    if source == spare:
        rows = df.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{text_col}`").cast("string").alias(spare))
    schema = T.StructType([f for f in rows.schema if f.name in given])
    for name, kind in fields.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                made = compute(part.column(source))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in given] + made, names=given + list(fields)
                )

    return rows.mapInArrow(run, schema)


def fold(id_col: str | Column, parts: int, one: int) -> Column:
    """Whether crc32 of the id, as text, leaves the remainder ``one``; false for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string")) % parts == one, F.lit(False))
