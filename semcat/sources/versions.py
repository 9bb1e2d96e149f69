"""Numbered versions of a stored table set: small JSON texts that say which folders count.

A writer puts its data into folders of its own and then publishes the next version, which is complete or not
there at all. Readers take the newest version and read the folders it names, so they never see half a change,
and what a killed writer left behind is named by no version.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, folder: str):
    """The folder's file system, and the folder as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; nothing if there is none."""
    system, path = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def delete(spark: SparkSession, folder: str) -> bool:
    system, path = file_system(spark, folder)
    return system.delete(path, True)


def known(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    done = (int(n) for n in folders(spark, f"{path}/versions") if n.isdigit())
    return sorted(n for n in done if "_SUCCESS" in folders(spark, f"{path}/versions/{n}"))


def read(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{number}", wholetext=True).first().value)


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Write version ``number``; of two writers of one number the second one fails."""
    text = spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1)
    text.write.mode("errorifexists").text(f"{path}/versions/{number}")


def forget(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the newest ``keep`` versions."""
    for number in known(spark, path)[:-keep]:
        delete(spark, f"{path}/versions/{number}")
