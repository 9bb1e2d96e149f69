"""Reads of the catalog, each for many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semcat.config import (
    ACTIVE_FLAG_NAMES,
    CANDIDATE_LIMIT,
    CODE_NAME_PARTS,
    CODE_TYPES,
    DEFAULTS,
    RELATION_LIMIT,
    Settings,
)
from semcat.functions.rows import exploded
from semcat.operators.semantics import best_per
from semcat.operators.substring import substring_pairs

TABLE = ["repo_id", "table_name"]


# --------------------------------------------------------------------- repos


def default_repo(repos: DataFrame) -> DataFrame:
    """The repo extracted last; the greatest name on a tie."""
    return repos.agg(F.max(F.struct("extracted_at", "repo_id"))["repo_id"].alias("repo_id"))


def list_repos(repos: DataFrame) -> DataFrame:
    """The registry, newest first."""
    return repos.select(
        "repo_id", "root_path", "rule_id", "extracted_at", "table_count", "enum_count"
    ).orderBy(F.desc("extracted_at"), F.asc("repo_id"))


def repo_status(repos: DataFrame, repo_id: str) -> DataFrame:
    """One repo's row of the registry."""
    return list_repos(repos).filter(F.col("repo_id") == repo_id)


# -------------------------------------------------------------------- tables


def guidance(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """How to leave out deleted rows and which tenant columns to filter by."""
    soft = F.col("soft_delete_column")
    live = F.when(soft.isin(*ACTIVE_FLAG_NAMES), F.lit(1)).otherwise(F.lit(0))
    dims = F.array_join("dimension_fields", ", ")
    return tables.select(
        "repo_id",
        F.col("name").alias("table_name"),
        F.when(
            soft.isNotNull(), F.format_string("live rows have %s = %d", soft, live)
        )
        .otherwise("no soft-delete column; do not filter by one")
        .alias("soft_delete_guidance"),
        F.when(
            F.size("dimension_fields") > 0,
            F.format_string("filter by [%s] or tenants mix", dims),
        )
        .otherwise("")
        .alias("dimension_guidance"),
    )


def bound_enums(columns: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """Columns that carry an enum class.

    With the catalog's ``bindings`` those that were only matched by name are ``inferred``, not ``declared``.
    """
    found = columns.filter("enum_class is not null").select(*TABLE, "name", "enum_class", F.lit(True).alias("bound"))
    if bindings is None:
        return found.withColumn("confidence", F.lit("declared"))
    key = [*TABLE, "name", "enum_class"]
    guessed = bindings.filter("confidence = 'inferred'").select(*key, "confidence").distinct()
    return found.join(guessed, key, "left").withColumn("confidence", F.coalesce("confidence", F.lit("declared")))


def enum_candidates(
    columns: DataFrame, enums: DataFrame, k: int | None = CANDIDATE_LIMIT
) -> DataFrame:
    """Up to ``k`` (``None``: all) enums whose short name holds the column's name, for code columns
    without an enum. Equal names are looked up once."""
    name_fits = F.lit(False)
    for part in CODE_NAME_PARTS:
        name_fits = name_fits | F.col("name").contains(part)
    open_columns = columns.filter(
        F.col("enum_class").isNull() & F.col("type_raw").isin(*CODE_TYPES) & name_fits
    ).select(*TABLE, "name", F.replace(F.col("name"), F.lit("_"), F.lit("")).alias("needle"))
    needles = open_columns.select("repo_id", "needle").distinct()
    hay = enums.select("repo_id", F.lower("short_name").alias("hay"), "enum_class")
    window = Window.partitionBy("repo_id", "needle").orderBy("enum_class")
    ranked = (
        substring_pairs(hay, needles, "hay", "needle", ["repo_id"])
        .withColumn("rank", F.row_number().over(window))
        .filter(F.lit(True) if k is None else F.col("rank") <= k)
        .select("repo_id", "needle", "enum_class", "rank")
    )
    return open_columns.join(ranked, ["repo_id", "needle"]).select(
        *TABLE,
        "name",
        "enum_class",
        "rank",
        F.lit(False).alias("bound"),
        F.lit("low").alias("confidence"),
    )


def relations_of(relations: DataFrame, k: int | None = RELATION_LIMIT) -> DataFrame:
    """Up to ``k`` (``None``: all) outgoing relations per table."""
    window = Window.partitionBy("repo_id", "from_table").orderBy("from_column", "to_table")
    return (
        relations.withColumn("rank", F.row_number().over(window))
        .filter(F.lit(True) if k is None else F.col("rank") <= k)
    )


def curated_notes(tables: DataFrame, meta: DataFrame) -> DataFrame:
    """Traps and query templates per table, and whether people wrote any."""
    order = F.struct("source", "content")

    def texts(kind: str):
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, order)))
        return F.transform(rows, lambda r: r["content"])

    notes = meta.filter(F.col("kind").isin("trap", "query_template")).groupBy(*TABLE).agg(
        texts("trap").alias("traps"), texts("query_template").alias("query_templates")
    )
    none = F.expr("cast(array() as array<string>)")
    return (
        tables.select("repo_id", F.col("name").alias("table_name"))
        .join(notes, TABLE, "left")
        .select(
            *TABLE,
            F.coalesce("traps", none).alias("traps"),
            F.coalesce("query_templates", none).alias("query_templates"),
            F.when(F.col("traps").isNull(), "auto_only")
            .otherwise("human_curated")
            .alias("coverage"),
        )
    )


def table_detail(
    catalog: dict[str, DataFrame],
    tables: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    k_relations: int | None = None,
    k_candidates: int | None = None,
) -> DataFrame:
    """Everything known about each requested table, one row per table.

    All relations and enum candidates, or the first so many.

    ``tables`` holds requests ``(repo_id, table_name)``; left out, all tables are
    described. A request that fits no table has only ``error`` filled in.
    """
    known = catalog["tables"]
    wanted = None
    if tables is not None:
        wanted = tables.select(*TABLE).distinct()
        known = known.join(
            wanted.withColumnRenamed("table_name", "name"), ["repo_id", "name"], "left_semi"
        )
    names = known.select("repo_id", F.col("name").alias("table_name"))

    def of_wanted(df: DataFrame) -> DataFrame:
        return df if wanted is None else df.join(wanted, TABLE, "left_semi")

    columns = of_wanted(catalog["columns"])
    # a table's columns, bindings and outgoing relations are few: they may be lists
    fields = F.struct(
        "ordinal",
        "name",
        F.col("type_raw").alias("type"),
        "is_pk",
        "is_nullable",
        "comment",
        "from_base_entity",
        "name_inferred",
    )
    listed = columns.groupBy(*TABLE).agg(F.sort_array(F.collect_list(fields)).alias("columns"))
    candidates = (
        enum_candidates(columns, catalog["enums"], k_candidates)
        .groupBy(*TABLE, "name", "bound", "confidence")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "enum_class"))),
                lambda x: x["enum_class"],
            ).alias("enums")
        )
    )
    bound = bound_enums(columns, catalog.get("bindings")).select(
        *TABLE, "name", "bound", "confidence", F.array("enum_class").alias("enums")
    )
    bindings = (
        bound.unionByName(candidates)
        .groupBy(*TABLE)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("name", "bound", "confidence", "enums"))
            ).alias("enum_bindings")
        )
    )
    outgoing = (
        relations_of(
            of_wanted(catalog["relations"].withColumnRenamed("from_table", "table_name"))
            .withColumnRenamed("table_name", "from_table"),
            k_relations,
        )
        .withColumnRenamed("from_table", "table_name")
        .groupBy(*TABLE)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("rank", "from_column", "to_table", "to_column", "kind", "confidence")
                )
            ).alias("relations")
        )
    )
    detail = (
        known.withColumnRenamed("name", "table_name")
        .join(guidance(known, settings), TABLE)
        .join(listed, TABLE, "left")
        .join(bindings, TABLE, "left")
        .join(outgoing, TABLE, "left")
        .join(curated_notes(known, of_wanted(catalog["table_meta"])), TABLE)
        .withColumn("error", F.lit(None).cast("string"))
    )
    if wanted is None:
        return detail
    missing = wanted.join(names, TABLE, "left_anti").withColumn(
        "error", F.format_string("table %s not found", F.col("table_name"))
    )
    return detail.unionByName(missing, allowMissingColumns=True)


# --------------------------------------------------------------------- enums


def _named(enums: DataFrame, requests: DataFrame) -> DataFrame:
    """Enum of every request ``(repo_id, request)``, by class or by short name.

    The full class name goes before the short name, then the smallest class.
    """
    by_class = enums.select("*", F.col("enum_class").alias("request"), F.lit(1).alias("step"))
    by_name = enums.select("*", F.col("short_name").alias("request"), F.lit(2).alias("step"))
    hits = requests.select("repo_id", "request").distinct().join(
        by_class.unionByName(by_name), ["repo_id", "request"]
    )
    return best_per(
        hits, ["repo_id", "request"], F.asc("step"), F.asc("enum_class")
    ).drop("step", "source_file")


def resolve_enum(catalog: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """All values of every requested enum ``(repo_id, request)``, in order.

    Values are ordered by code, the default meaning first. A request that fits
    no enum has one row with ``error``.
    """
    named = _named(catalog["enums"], requests)
    values = catalog["enum_values"].withColumnRenamed("name", "value_name")
    divergent = values.filter(F.size("aggregators") > 0).select("repo_id", "enum_class").distinct()
    warned = named.join(
        divergent.withColumn("divergent", F.lit(True)), ["repo_id", "enum_class"], "left"
    ).withColumn(
        "dimension_warning",
        F.when(
            F.col("divergent"), "codes mean different things per tenant; decide by tenant"
        ).otherwise(""),
    ).drop("divergent")
    found = warned.join(values, ["repo_id", "enum_class"]).withColumn(
        "error", F.lit(None).cast("string")
    )
    missing = (
        requests.select("repo_id", "request")
        .distinct()
        .join(named, ["repo_id", "request"], "left_anti")
        .withColumn("error", F.format_string("enum %s not found", F.col("request")))
    )
    # a total order: the sort stays even when one class holds most values
    return found.unionByName(missing, allowMissingColumns=True).orderBy(
        "repo_id",
        "request",
        "code",
        F.array_join(F.transform("aggregators", lambda a: a.cast("string")), ",").asc_nulls_first(),
        "value_name",
    )


def resolve_column(catalog: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """Values of the enum bound to each requested column ``(repo_id, table_name, name)``."""
    target = ["repo_id", "table_name", "name"]
    wanted = requests.select(*target).distinct()
    complete = wanted.filter("table_name is not null and name is not null")
    bindings = catalog["bindings"].select(*target, "enum_class")
    bound = complete.join(bindings, target)
    values = catalog["enum_values"].withColumnRenamed("name", "value_name")
    found = bound.join(values, ["repo_id", "enum_class"]).withColumn(
        "error", F.lit(None).cast("string")
    )
    unbound = complete.join(bindings, target, "left_anti").withColumn(
        "error",
        F.format_string("no enum bound to %s.%s", F.col("table_name"), F.col("name")),
    )
    partial = wanted.filter("table_name is null or name is null").withColumn(
        "error", F.lit("give a class, or both table and column")
    )
    return found.unionByName(unbound, allowMissingColumns=True).unionByName(
        partial, allowMissingColumns=True
    )


def divergent_codes(values: DataFrame) -> DataFrame:
    """Codes that mean one thing by default and another, or several, per tenant."""
    specific = F.coalesce(F.size("aggregators"), F.lit(0)) > 0
    counts = values.groupBy("repo_id", "enum_class", "code").agg(
        F.sum(F.when(specific, 0).otherwise(1)).alias("n_default"),
        F.sum(F.when(specific, 1).otherwise(0)).alias("n_tenant"),
    )
    return counts.filter("n_tenant > 1 or (n_tenant = 1 and n_default > 0)")


def decode_codes(
    facts: DataFrame,
    code_col: str,
    tenant_col: str,
    values: DataFrame,
    enum_class: str | None = None,
) -> DataFrame:
    """Add ``meaning`` and ``is_divergent`` to every fact row.

    A tenant's own meaning goes before the default one. Codes are met within
    ``repo_id`` and ``enum_class`` where the facts have such columns; else the
    values must be of one repo and ``enum_class`` names the enum. Facts are never
    grouped: they meet at most one default and one tenant row. The values are
    small as a rule and then sent to the facts; their size decides.
    """
    keys = [c for c in ("repo_id", "enum_class") if c in facts.columns and c in values.columns]
    if enum_class is not None:
        values = values.filter(F.col("enum_class") == enum_class)
    specific = F.coalesce(F.size("aggregators"), F.lit(0)) > 0
    defaults = (
        values.filter(~specific)
        .groupBy(*keys, F.col("code").alias(code_col))
        .agg(F.min_by("meaning", "name").alias("_default"))
    )
    own = (
        values.filter(specific)
        .transform(
            lambda d: exploded(
                d, "aggregators", *keys, "code", "meaning", "name", value="tenant"
            )
        )
        .groupBy(*keys, F.col("code").alias(code_col), F.col("tenant").alias(tenant_col))
        .agg(F.min_by("meaning", "name").alias("_own"))
    )
    return (
        facts.join(defaults, [*keys, code_col], "left")
        .join(own, [*keys, code_col, tenant_col], "left")
        .withColumn("meaning", F.coalesce("_own", "_default"))
        .withColumn("is_divergent", F.col("_own").isNotNull())
        .drop("_own", "_default")
    )
