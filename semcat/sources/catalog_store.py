"""The stored catalog: Parquet tables partitioned by repo, in versions.

A write puts all its tables into folders ``<table>/gen=G/repo_id=R`` of a new generation G and then publishes
a version that names, for every table, which generation holds which repo. Readers stay with the version they
took, so they see all tables of one write or none; :func:`sweep` deletes what no version names any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcat.sources import versions

# replaced as a whole when a repo is extracted again
REPLACED = (
    "repos",
    "tables",
    "columns",
    "enums",
    "enum_values",
    "relations",
    "i18n_keys",
    "bindings",
    "rejects",
)
# written by people or by repeated checks, kept over extractions
KEPT = ("table_meta", "drift_reports")
ALL_TABLES = REPLACED + KEPT

SCHEMAS = {
    "repos": (
        "root_path string, rule_id string, extracted_at timestamp, extractor_version string,"
        " table_count bigint, enum_count bigint, base_entity string,"
        " domain_map map<string,string>"
    ),
    "tables": (
        "name string, entity_class string, source_file string, purpose string, domain string,"
        " extends_base boolean, soft_delete_column string, dimension_fields array<string>"
    ),
    "columns": (
        "table_name string, name string, java_field string, type_raw string, type string,"
        " is_pk boolean, is_nullable boolean, comment string, name_inferred boolean,"
        " from_base_entity boolean, enum_class string, ordinal int"
    ),
    "enums": (
        "enum_class string, short_name string, paradigm string, source_file string,"
        " java_type string"
    ),
    "enum_values": (
        "enum_class string, code bigint, name string, message_key string, meaning string,"
        " aggregators array<bigint>, is_default boolean, warning string"
    ),
    "relations": (
        "from_table string, from_column string, to_table string, to_column string,"
        " kind string, confidence string"
    ),
    "i18n_keys": "key string, value string, bundle_file string",
    "bindings": "table_name string, name string, enum_class string, confidence string",
    "rejects": "source_file string, reason string",
    "table_meta": (
        "table_name string, kind string, content string, source string, updated_at timestamp"
    ),
    "drift_reports": (
        "checked_at timestamp, source string, added bigint, removed bigint,"
        " type_changed bigint"
    ),
}


def _schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(f"{SCHEMAS[name]}, repo_id string")


def _columns(name: str) -> list[str]:
    return _schema(name).fieldNames()


# the folder of rows without a repo
_NO_REPO = "__HIVE_DEFAULT_PARTITION__"
# table to its generations: (generation, repos that count in it)
Named = dict[str, list[tuple[str, list[str]]]]


def _latest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, Named]:
    """The newest version, or the one asked for, and what it names; version 0 names nothing."""
    numbers = versions.known(spark, path)
    if version is not None and version not in numbers:
        raise FileNotFoundError(f"no version {version} of {path}")
    number = version if version is not None else numbers[-1] if numbers else 0
    return number, versions.read(spark, path, number) if number else {}


def _written(df: DataFrame, folder: str) -> set[str]:
    """Write a table's rows by repo; the repos."""
    seen = Observation()
    (
        df.observe(seen, F.collect_set(F.coalesce("repo_id", F.lit(_NO_REPO))).alias("repos"))
        .write.partitionBy("repo_id")
        .parquet(folder)
    )
    return set(seen.get.get("repos") or ())


def _without(named: Named, tables: Iterable[str], repos: set[str]) -> Named:
    """What is named, but for these repos of these tables."""
    left = {}
    for name, generations in named.items():
        if name in tables:
            generations = [(gen, [r for r in own if r not in repos]) for gen, own in generations]
            generations = [(gen, own) for gen, own in generations if own]
        left[name] = generations
    return left


def write_catalog(
    catalog: dict[str, DataFrame], path: str, repo_ids: Iterable[str] = ()
) -> int:
    """Replace the catalog's repos in all its tables at once; other repos stay. Returns the new version.

    A repo that no longer has rows in a table loses its old ones there too; one
    that has no rows at all any more is named in ``repo_ids``.
    A run that fails leaves the old version as it is and can simply be started again;
    of two writers at a time the second one fails.
    """
    spark = next(iter(catalog.values())).sparkSession
    number, named = _latest(spark, path)
    gen = uuid.uuid4().hex[:12]
    written = {
        name: _written(catalog[name].select(*_columns(name)), f"{path}/{name}/gen={gen}")
        for name in REPLACED
        if name in catalog
    }
    named = _without(named, written, set(repo_ids).union(*written.values()))
    for name, present in written.items():
        named[name] = [*named.get(name, []), (gen, sorted(present))] if present else named.get(name, [])
    versions.publish(spark, path, number + 1, named)
    return number + 1


def append_rows(df: DataFrame, path: str, name: str) -> None:
    """Add curated notes or a drift report."""
    if name not in KEPT:
        raise ValueError(f"{name} is replaced by extraction, not appended to")
    number, named = _latest(df.sparkSession, path)
    gen = uuid.uuid4().hex[:12]
    present = _written(df.select(*_columns(name)), f"{path}/{name}/gen={gen}")
    named[name] = [*named.get(name, []), (gen, sorted(present))] if present else named.get(name, [])
    versions.publish(df.sparkSession, path, number + 1, named)


def _folder(spark: SparkSession, repo: str) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"repo_id={escape(repo)}"


def read_catalog(
    spark: SparkSession, path: str, repo_id: str | None = None, version: int | None = None
) -> dict[str, DataFrame]:
    """All tables of one version, the newest unless named, optionally of one repo only."""
    out = {}
    for name, generations in _latest(spark, path, version)[1].items():
        places = [
            f"{path}/{name}/gen={gen}/{_folder(spark, repo)}"
            for gen, repos in generations
            for repo in repos
            if repo_id is None or repo == repo_id
        ]
        if places:
            read = spark.read.schema(_schema(name)).option("basePath", f"{path}/{name}").parquet(*places)
            out[name] = read.select(*_columns(name))
        else:
            out[name] = spark.createDataFrame([], _schema(name))
    return out


def remove_repo(catalog: dict[str, DataFrame], repo_id: str) -> dict[str, DataFrame]:
    """The catalog without one repo, in every table."""
    return {name: df.filter(F.col("repo_id") != repo_id) for name, df in catalog.items()}


def delete_repo(spark: SparkSession, path: str, repo_id: str) -> None:
    """Delete one repo from the stored catalog, in every table at once."""
    number, named = _latest(spark, path)
    versions.publish(spark, path, number + 1, _without(named, list(named), {repo_id}))


def sweep(spark: SparkSession, path: str, keep_versions: int = 1) -> int:
    """Delete folders that none of the newest versions names, and older versions; returns how many folders.

    Readers of older versions, and writers that are not done, must be gone.
    """
    live: dict[str, set[str]] = {}
    for number in versions.known(spark, path)[-keep_versions:]:
        for name, generations in versions.read(spark, path, number).items():
            live.setdefault(name, set()).update(f"gen={g}/{_folder(spark, r)}" for g, repos in generations for r in repos)
    gone = 0
    for name in ALL_TABLES:
        for gen in versions.folders(spark, f"{path}/{name}"):
            own = [f for f in versions.folders(spark, f"{path}/{name}/{gen}") if f.startswith("repo_id=")]
            stale = [f for f in own if f"{gen}/{f}" not in live.get(name, ())]
            for folder in [gen] if len(stale) == len(own) else [f"{gen}/{f}" for f in stale]:
                gone += versions.delete(spark, f"{path}/{name}/{folder}")
    versions.forget(spark, path, keep_versions)
    return gone
