"""Source trees and small configuration files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_source_files(
    spark: SparkSession, root: str, repo_id: str, glob: str = "*.{java,properties}"
) -> DataFrame:
    """``(repo_id, path, src)`` of all files below ``root`` that fit ``glob``.

    Paths are relative to the root. Invalid UTF-8 becomes the replacement
    character instead of failing the job.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "content")
    )
    # "file:/a/b" and "/a/b" name the same place
    bare = F.regexp_replace("path", F.lit(r"^[a-z0-9]+:(//[^/]*(?=/))?"), F.lit(""))
    base = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    if "://" in root:
        base = "/" + base.partition("/")[2]
    base = base.rstrip("/") + "/"
    path = F.when(bare.startswith(base), F.substr(bare, F.lit(len(base) + 1))).otherwise(bare)
    return raw.select(
        F.lit(repo_id).alias("repo_id"),
        path.alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("src"),
    ).filter(~F.contains(F.concat(F.lit("/"), F.col("path")), F.lit("/target/")))


def read_domain_map(spark: SparkSession, path: str) -> DataFrame:
    """``(prefix, domain)`` of a JSON object."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", "map<string,string>")).alias("prefix", "domain"))
    )
