"""Differences between a catalog and another schema."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.plans.lineage import sized, stored

KEY = ["repo_id", "table_name", "name"]

# what each normalized type may be called in a real schema
SPARK_TYPES = {
    "string": ("string", "varchar", "char"),
    "integer": ("tinyint", "smallint", "int"),
    "long": ("bigint",),
    "decimal": ("decimal", "double", "float"),
    "boolean": ("boolean",),
    "date": ("date",),
    "datetime": ("timestamp", "timestamp_ntz"),
    "text": ("string",),
    "blob": ("binary",),
    "enum": ("string",),
}


def schema_rows(df: DataFrame, repo_id: str, table_name: str) -> DataFrame:
    """Columns of a DataFrame as rows for :func:`drift_check`; one row per column."""
    fields = F.array(
        *[
            F.struct(F.lit(f.name.lower()).alias("name"), F.lit(f.dataType.simpleString()).alias("data_type"))
            for f in df.schema.fields
        ]
    )
    one = df.sparkSession.range(1).select(F.explode(fields).alias("f"))
    return one.select(
        F.lit(repo_id).alias("repo_id"), F.lit(table_name).alias("table_name"), "f.*"
    )


def drift_check(columns: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns that differ from the real schema ``(repo_id, table_name, name, data_type)``.

    ``change`` is ``added`` (real only), ``removed`` (catalog only) or
    ``type_changed``. A catalog type of ``unknown`` fits any real type.
    """
    expected = columns.select(*KEY, "type", F.lit(True).alias("_mined"))
    real = actual.select(
        *KEY,
        "data_type",
        F.substring_index(F.lower("data_type"), "(", 1).alias("_base"),
        F.lit(True).alias("_real"),
    )
    fits = F.col("type") == "unknown"
    for mined, names in SPARK_TYPES.items():
        fits = fits | ((F.col("type") == mined) & F.col("_base").isin(*names))
    change = (
        F.when(F.col("_mined").isNull(), "added")
        .when(F.col("_real").isNull(), "removed")
        .when(~fits, "type_changed")
    )
    return (
        expected.join(real, KEY, "full")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(*KEY, "change", "type", "data_type")
    )


def drift_report(drift: DataFrame, source: str) -> DataFrame:
    """Counts per repo, ready to be added to the history."""

    def count(change: str):
        return F.count(F.when(F.col("change") == change, 1)).alias(change)

    return (
        drift.groupBy("repo_id")
        .agg(count("added"), count("removed"), count("type_changed"))
        .withColumns({"checked_at": F.current_timestamp(), "source": F.lit(source)})
    )


def drift_trend(reports: DataFrame) -> DataFrame:
    """Every check of the history with what its counts grew by since the check before.

    Checks follow each other within a repo and source; the first has nulls. The history holds one row per check.
    """
    before = Window.partitionBy("repo_id", "source").orderBy("checked_at")
    counts = ("added", "removed", "type_changed")
    return reports.withColumns(
        {
            "check_no": F.row_number().over(before),
            **{f"{c}_since": F.col(c) - F.lag(c).over(before) for c in counts},
        }
    )


# catalog table: its key, what is compared, and what an item keeps when it is renamed.
# Where a row was read (its file) and where it stands among others are not compared.
_COMPARED = {
    "tables": (
        ["name"],
        ["entity_class", "purpose", "domain", "extends_base", "soft_delete_column", "dimension_fields"],
        ["entity_class"],
    ),
    "columns": (
        ["table_name", "name"],
        [
            "java_field", "type_raw", "type", "is_pk", "is_nullable", "comment", "name_inferred",
            "from_base_entity", "enum_class",
        ],
        ["table_name", "java_field"],
    ),
    "enums": (["enum_class"], ["short_name", "paradigm", "java_type"], []),
    "enum_values": (
        ["enum_class", "code", "name"],
        ["message_key", "meaning", "aggregators", "is_default", "warning"],
        ["enum_class", "code", "aggregators"],
    ),
    "relations": (["from_table", "from_column", "to_table"], ["to_column", "kind", "confidence"], []),
    "i18n_keys": (["key"], ["value"], []),
    "bindings": (["table_name", "name"], ["enum_class", "confidence"], []),
    "table_meta": (["table_name", "kind", "source", "content"], [], []),
}


def _diff_of(name: str, rows: DataFrame, left: str, right: str) -> DataFrame:
    """Differences within one catalog table."""
    key, values, lasting = _COMPARED[name]
    sets = {f.name for f in rows.schema.fields if f.dataType.typeName() == "array"}

    def content(names: list[str]) -> list[Column]:
        # lists hold sets, so their order says nothing
        return [(F.array_sort(v) if v in sets else F.col(v)).alias(v) for v in names]

    have = [v for v in values if v in rows.columns]
    lasting = lasting if set(lasting) <= set(rows.columns) else []

    def side(repo: str, label: str) -> DataFrame:
        whole = F.struct(*content(list(dict.fromkeys([*key, *have, *lasting])))).alias(label)
        return rows.filter(F.col("repo_id") == repo).select(
            *[F.col(k).alias(f"{label}_{k}") for k in key], whole
        )

    same = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in key]
    both = side(left, "l").join(side(right, "r"), functools.reduce(Column.__and__, same), "full")
    one = F.coalesce("l", "r")
    differ = F.array_compact(
        F.array(*[F.when(~F.col("l")[v].eqNullSafe(F.col("r")[v]), F.lit(v)) for v in have])
        if have
        else F.expr("cast(array() as array<string>)")
    )
    change = (
        F.when(F.col("r").isNull(), "only_left")
        .when(F.col("l").isNull(), "only_right")
        .when(F.size("differ") > 0, "changed")
    )
    complete = [one[v].isNotNull() for v in lasting if v not in sets]
    identity = (
        F.when(
            (F.col("change") != "changed") & functools.reduce(Column.__and__, complete),
            F.to_json(F.struct(*[one[v].alias(v) for v in lasting])),
        )
        if complete
        else F.lit(None).cast("string")
    )
    return (
        both.withColumn("differ", differ)
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(
            F.lit(name).alias("catalog_table"),
            F.concat_ws(".", *[one[k] for k in key]).alias("item"),
            "change",
            F.when(F.col("change") == "changed", F.col("differ")).alias("fields"),
            identity.alias("identity"),
        )
    )


def repo_diff(catalog: dict[str, DataFrame], left: str, right: str) -> DataFrame:
    """Rows of the compared catalog tables that only one repo has, or that differ.

    ``(catalog_table, item, change, fields, identity)``: ``change`` is ``only_left``, ``only_right`` or
    ``changed``, and ``fields`` names what differs. ``identity`` is what a row that only one repo has would
    keep under another name (see :func:`pair_renames`). Null keys are equal to each other.
    """
    parts = [_diff_of(name, catalog[name], left, right) for name in _COMPARED if name in catalog]
    return functools.reduce(DataFrame.unionByName, parts)


def pair_renames(diff: DataFrame) -> DataFrame:
    """The differences with renamed items as one row each, ``renamed`` with ``renamed_to``.

    Two rows, one of each repo, are one renamed item if they alone share their identity: the entity class of
    a table, the field of a column, the code and tenants of an enum value. All other rows stay as they are.
    """
    kept = stored(diff)
    on = ["catalog_table", "identity"]
    named = kept.filter(F.col("identity").isNotNull())

    def of(side: str) -> Column:
        return F.when(F.col("change") == side, F.col("item"))

    pairs = sized(
        named.groupBy(*on)
        .agg(
            F.count(of("only_left")).alias("n_left"),
            F.count(of("only_right")).alias("n_right"),
            F.max(of("only_left")).alias("item"),
            F.max(of("only_right")).alias("renamed_to"),
        )
        .filter("n_left = 1 and n_right = 1")
        .select(*on, "item", "renamed_to")
    )
    shown = ["catalog_table", "item", "change", "fields"]
    apart = kept.filter(F.col("identity").isNull()).select(*shown).unionByName(
        named.join(pairs, on, "left_anti").select(*shown)
    )
    renamed = pairs.withColumns(
        {"change": F.lit("renamed"), "fields": F.lit(None).cast("array<string>")}
    )
    return apart.withColumn("renamed_to", F.lit(None).cast("string")).unionByName(
        renamed.select(*shown, "renamed_to")
    )
