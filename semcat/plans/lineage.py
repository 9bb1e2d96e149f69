"""Cutting a plan at a stored intermediate result, and sizing the short side of a join."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# application id to its run folder
_RUNS: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names for checkpoints.

    Only a session on one machine may leave it unset; a temporary folder serves then.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.partition("[")[0] != "local":
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: {master} has no local one")
    return tempfile.mkdtemp(prefix="semcat-")


def run_folder(spark: SparkSession) -> str:
    """The folder below which this application keeps all its intermediate tables."""
    key = spark.sparkContext.applicationId
    if key not in _RUNS:
        _RUNS[key] = f"{_root(spark)}/semcat-{key}-{uuid.uuid4().hex[:8]}"
    return _RUNS[key]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the run folder."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def close(spark: SparkSession) -> None:
    """Delete the run folder; results that read from it cannot be read any more."""
    folder = _RUNS.pop(spark.sparkContext.applicationId, None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder.

    It outlives the executors that wrote it, is read by columns, and its size is
    known to the planner, so joins with it need no guess.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# bytes of values (not of compressed files) that every executor can hold
BROADCAST_BYTES = 64 << 20


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values of a stored frame: eight a field, and texts at their length."""
    parts = [F.lit(8 * len(df.columns) + 16)]
    for field in df.schema:
        if field.dataType.typeName() == "string":
            parts.append(F.coalesce(F.octet_length(field.name), F.lit(0)))
        elif field.dataType.typeName() in ("array", "map", "struct"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return df.agg(F.sum(total.cast("long")).alias("n")).first().n or 0


def side_hint(df: DataFrame, limit: int = BROADCAST_BYTES) -> str:
    """How to join the short side ``df``, a stored frame, by the measured bytes of its values."""
    return "broadcast" if value_bytes(df) <= limit else "merge"


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, stored and measured, marked as the short side of a join.

    The planner guesses generated rows far too low and might send the long side
    to everyone. Up to ``limit`` bytes the short side is sent; above, both sides
    are shuffled and sorted, and hot keys are split at run time.
    """
    kept = stored(df)
    return kept.hint(side_hint(kept, limit))
