"""From source files to the whole catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.config import DEFAULTS, Settings
from semcat.functions.rows import exploded
from semcat.operators import entities as ent
from semcat.operators import enums as enu
from semcat.operators import semantics as sem
from semcat.plans.lineage import stored


def no_meta(files: DataFrame) -> DataFrame:
    """An empty table of curated notes."""
    names = ("repo_id", "table_name", "kind", "content", "source")
    empty = files.sparkSession.range(0)
    return empty.select(
        *[F.lit("").alias(n) for n in names],
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def annotate_entities(entities: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add domain, soft-delete column and tenant columns without a shuffle."""
    return entities.withColumns(
        {
            "domain": sem.domain_of(
                F.col("name"), settings.domain_map, settings.default_domain
            ),
            "soft_delete_column": sem.soft_delete_of(
                F.col("columns"), settings.soft_delete_names
            ),
            "dimension_fields": sem.dimensions_of(F.col("columns"), settings.dimension_names),
        }
    )


def tables_of(entities: DataFrame) -> DataFrame:
    return entities.select(
        "repo_id",
        "name",
        "entity_class",
        "source_file",
        "purpose",
        "domain",
        "extends_base",
        "soft_delete_column",
        "dimension_fields",
    )


def build_values(enums: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of the kept enums with meaning, default flag and warning.

    Equal code and tenant set in one enum: the first constant stands.
    """
    tenants = F.array_join(F.transform("aggregators", lambda a: a.cast("string")), ",")
    exploded = enu.explode_values(enums).withColumn("tenants", F.coalesce(tenants, F.lit("")))
    once = sem.best_per(
        exploded, ["repo_id", "enum_class", "code", "tenants"], F.asc("value_no")
    ).drop("tenants", "paradigm", "value_no")
    flagged = enu.flag_default_meaning(enu.attach_messages(once, keys))
    return flagged.select(
        "repo_id",
        "enum_class",
        "code",
        "name",
        "message_key",
        "meaning",
        "aggregators",
        "is_default",
        "warning",
    )


def _reasons(parsed: DataFrame, *reasons: Column) -> DataFrame:
    found = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return exploded(parsed, found, "repo_id", "source_file", value="reason")


def rejects_of(entities: DataFrame, enums: DataFrame) -> DataFrame:
    """Reasons out of parsed files, nameless ones included."""
    of_entities = _reasons(
        entities,
        F.when(F.col("name") == "", "no table name"),
        F.when((F.col("name") != "") & (F.col("repeated") > 0), "repeated column name"),
        F.when((F.col("name") != "") & (F.col("unread") > 0), "column annotation on no field"),
    )
    named = F.col("short_name") != ""
    of_enums = _reasons(
        enums,
        F.when(~named, "no enum"),
        F.when(named & (F.col("unreadable") > 0), "unreadable tenant set").when(
            named & (F.size("values") == 0), "no enum values"
        ),
    )
    return of_entities.unionByName(of_enums)


def rejects(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Files that were chosen but gave nothing, or not everything, and why."""
    return rejects_of(
        ent.parse_entities(files, settings, root, unnamed=True),
        enu.parse_enums(files, settings, root, unnamed=True),
    )


_BUILT = (
    "tables", "columns", "enums", "enum_values", "relations", "i18n_keys", "bindings", "table_meta", "rejects",
)


def build_catalog(
    files: DataFrame,
    settings: Settings = DEFAULTS,
    root: Column | None = None,
    declared_relations: DataFrame | None = None,
    curated_bindings: DataFrame | None = None,
    table_meta: DataFrame | None = None,
    store: bool = False,
    names: Iterable[str] | None = None,
) -> dict[str, DataFrame]:
    """All catalog tables of the files given, or those that ``names`` lists.

    With ``store`` the parsed files, and those kept of them, which all tables
    here start from, are written once to the session's shared folder instead of
    being parsed again by every table's plan, and so are the bindings. Of tables
    that ``names`` leaves out nothing is written; without ``bindings`` the
    columns have no ``enum_class``.
    """
    wanted = set(_BUILT if names is None else names)
    if not wanted <= set(_BUILT):
        raise ValueError(f"names must be among {_BUILT}")
    parsed = ent.parse_entities(files, settings, root, unnamed=True)
    parsed_enums = enu.parse_enums(files, settings, root, unnamed=True)
    if store and "rejects" in wanted:
        parsed, parsed_enums = stored(parsed), stored(parsed_enums)
    kept = sem.dedupe_entities(
        annotate_entities(parsed.filter(F.col("name") != ""), settings)
    )
    kept_enums = sem.dedupe_enums(enu.with_values(parsed_enums))
    if store and wanted & {"tables", "columns", "relations", "bindings"}:
        kept = stored(kept)
    if store and wanted & {"enums", "enum_values", "bindings"}:
        kept_enums = stored(kept_enums)

    tables = tables_of(kept)
    columns = ent.explode_columns(kept).drop("source_file")
    enums = kept_enums.select(
        "repo_id", "enum_class", "short_name", "paradigm", "source_file", "java_type"
    )
    keys = enu.latest_key(enu.parse_bundles(files, settings, root))
    bindings = sem.bind_enums(columns, enums, curated_bindings)
    if store and "bindings" in wanted:
        # read for the columns, too
        bindings = stored(bindings)
    inferred = sem.infer_relations(
        columns,
        tables,
        settings.relation_prefixes,
        settings.relation_suffix,
        settings.relation_to_column,
    )
    built = {
        "tables": tables,
        "columns": sem.apply_bindings(columns, bindings) if "bindings" in wanted else columns,
        "enums": enums,
        "enum_values": build_values(kept_enums, keys),
        "relations": (
            inferred
            if declared_relations is None
            else sem.all_relations(declared_relations, inferred)
        ),
        "i18n_keys": keys,
        "bindings": bindings,
        "table_meta": no_meta(files) if table_meta is None else table_meta,
        "rejects": rejects_of(parsed, parsed_enums),
    }
    return {name: df for name, df in built.items() if name in wanted}


# counted table, name of its count
_COUNTED = (
    ("tables", "tables"),
    ("enums", "enums"),
    ("relations", "relations"),
    ("i18n_keys", "i18n_keys"),
    ("rejects", "warnings"),
)


def extraction_report(catalog: dict[str, DataFrame]) -> DataFrame:
    """Rows per repo and catalog table, one line per repo."""
    counts = [
        catalog[name]
        .groupBy("repo_id")
        .agg(F.count("*").alias("n"))
        .select("repo_id", F.lit(label).alias("label"), "n")
        for name, label in _COUNTED
        if name in catalog
    ]
    tall = counts[0]
    for part in counts[1:]:
        tall = tall.unionByName(part)
    sums = [
        F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0)).alias(label)
        for _, label in _COUNTED
    ]
    return tall.groupBy("repo_id").agg(*sums)


def repo_registry(
    catalog: dict[str, DataFrame],
    settings: Settings = DEFAULTS,
    root: str = "",
    version: str = "0.1.0",
) -> DataFrame:
    """One row per repo: where, how, when and how much was extracted."""
    report = extraction_report(
        {k: v for k, v in catalog.items() if k in ("tables", "enums")}
    )
    domains = F.create_map(
        *[F.lit(x) for kv in sorted(settings.domain_map.items()) for x in kv]
    ) if settings.domain_map else F.lit(None).cast("map<string,string>")
    return report.select(
        "repo_id",
        F.lit(root).alias("root_path"),
        F.lit(settings.rule_id).alias("rule_id"),
        F.current_timestamp().alias("extracted_at"),
        F.lit(version).alias("extractor_version"),
        F.col("tables").alias("table_count"),
        F.col("enums").alias("enum_count"),
        F.lit(settings.base_entity).alias("base_entity"),
        domains.alias("domain_map"),
    )


def store_catalog(catalog: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """The catalog with the named tables, or all, written to the shared folder."""
    return {
        name: stored(df) if not names or name in names else df for name, df in catalog.items()
    }
