"""Tables and columns out of entity source files.

One input row is one file, and one file becomes one row with its columns in an
array. Extraction therefore needs no shuffle at all; exploding the array is the
last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.config import DEFAULTS, Settings
from semcat.functions import java
from semcat.functions.rows import computed_once, exploded
from semcat.operators.routing import entity_files

KEY = ("repo_id", "source_file", "table_name")


def _with_code(chosen: DataFrame, settings: Settings) -> DataFrame:
    """Adds what is read as code: nothing that is commented out, no brackets too deep for patterns."""
    if settings.compat:
        return computed_once(chosen.withColumn("code", F.col("src")), "code")
    bare = computed_once(chosen.withColumn("code", java.without_comments(F.col("src"))), "code")
    return computed_once(bare.withColumn("code", java.flat("code")), "code")


def _header(
    src: Column, code: Column, path: Column, settings: Settings, root: Column | None
) -> list[Column]:
    return [
        java.table_name(code).alias("name"),
        java.qualified_class(code, path).alias("entity_class"),
        java.relative_path(path, root).alias("source_file"),
        java.purpose(src).alias("purpose"),
        java.extends_base(code, settings.base_entity).alias("extends_base"),
    ]


def parse_entities(
    files: DataFrame,
    settings: Settings = DEFAULTS,
    root: Column | None = None,
    unnamed: bool = False,
) -> DataFrame:
    """One row per entity file, with all its columns in order as ``columns``.

    Files without a table name are left out unless ``unnamed`` asks for them.
    """
    src, path = F.col("src"), F.col("path")
    chosen = entity_files(files, settings, root)
    chosen = _with_code(chosen, settings)
    if not unnamed:
        # found before the costly part of the work
        chosen = chosen.filter(java.table_name(F.col("code")) != "")
    blocks = chosen.select(
        "repo_id",
        *_header(src, F.col("code"), path, settings, root),
        "code",
        java.field_blocks(F.col("code"), settings.compat).alias("blocks"),
    )
    declared = blocks.withColumn(
        "declared", java.declared_columns(F.col("blocks"), settings.compat)
    )
    inferred = declared.withColumn(
        "inferred",
        java.inferred_columns(
            F.col("blocks"), F.transform("declared", lambda c: c["java_field"])
        ),
    )
    listed = inferred.withColumn("listed", F.concat("declared", "inferred"))
    own = listed.withColumn("own", java.first_per_name(F.col("listed")))
    return own.select(
        "repo_id",
        "name",
        "entity_class",
        "source_file",
        "purpose",
        "extends_base",
        java.merged_columns(F.col("own"), F.col("extends_base"), settings).alias("columns"),
        (F.size("listed") - F.size("own")).alias("repeated"),
        java.unread_columns(F.col("code"), F.col("blocks")).alias("unread"),
    ).transform(lambda d: computed_once(d, "name", "columns", "repeated", "unread"))


def extract_tables(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Name, purpose, class and source of every entity file."""
    src, path = F.col("src"), F.col("path")
    chosen = entity_files(files, settings, root)
    named = _with_code(chosen, settings)
    named = named.filter(java.table_name(F.col("code")) != "")
    return named.select("repo_id", *_header(src, F.col("code"), path, settings, root))


def explode_columns(entities: DataFrame) -> DataFrame:
    """One row per column, numbered from 1: base, declared, inferred."""
    return exploded(
        entities,
        "columns",
        "repo_id",
        "source_file",
        F.col("name").alias("table_name"),
        value="c",
        pos="pos",
    ).select(*KEY, "c.*", (F.col("pos") + 1).alias("ordinal"))


def extract_columns(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """All columns of all entity files."""
    return explode_columns(parse_entities(files, settings, root))


def extract_declared_columns(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Columns named by an annotation."""
    columns = extract_columns(files, settings, root)
    return columns.filter(~F.col("name_inferred") & ~F.col("from_base_entity"))


def attach_preceding_comment(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Comment of every declared column.

    The comment is the one in the field's own annotations. In compatible mode
    it is the nearest one in the characters before the column annotation, even
    if that belongs to the field above.
    """
    columns = extract_declared_columns(files, settings, root)
    return columns.select(*KEY, "name", "java_field", "comment")


def extract_inferred_columns(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Columns whose name is taken from a commented field."""
    return extract_columns(files, settings, root).filter("name_inferred")


def mark_primary_keys(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Columns of an identifier field, and the base entity's key."""
    return extract_columns(files, settings, root).filter("is_pk")


def merge_base_columns(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Columns an entity has from the shared base entity."""
    return extract_columns(files, settings, root).filter("from_base_entity")


def number_columns(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Position of every column in its table."""
    return extract_columns(files, settings, root).select(*KEY, "name", "ordinal")
