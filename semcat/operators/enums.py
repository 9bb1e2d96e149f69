"""Code-to-meaning enums and message bundles out of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.config import DEFAULTS, Settings
from semcat.functions import java
from semcat.functions.rows import computed_once, exploded
from semcat.functions.text import decode_escapes, strip_space
from semcat.operators.routing import bundle_files, enum_files


def parse_enums(
    files: DataFrame,
    settings: Settings = DEFAULTS,
    root: Column | None = None,
    unnamed: bool = False,
) -> DataFrame:
    """One row per enum file, with its constants in order as ``values``.

    Files that define no enum are left out unless ``unnamed`` asks for them.

    Constants whose tenant set cannot be read are counted in ``unreadable`` and
    left out of ``values``.
    """
    path = F.col("path")
    chosen = enum_files(files, settings, root)
    if settings.compat:
        chosen = chosen.withColumn("text", F.col("src"))
    else:
        chosen = computed_once(chosen.withColumn("text", java.without_comments(F.col("src"))), "text")
        chosen = computed_once(chosen.withColumn("text", java.flat("text")), "text")
    named = chosen.withColumn("short_name", java.enum_name(F.col("text")))
    if not unnamed:
        named = named.filter(F.col("short_name") != "")
    found = (
        named.select(
            "repo_id",
            java.qualified_enum(F.col("text")).alias("enum_class"),
            "short_name",
            java.paradigm(F.col("text")).alias("paradigm"),
            java.relative_path(path, root).alias("source_file"),
            F.lit("Short").alias("java_type"),
            java.constants(java.constant_text(F.col("text"), settings.compat)).alias("found"),
        )
        .withColumn(
            "all_values",
            F.when(
                F.col("paradigm") == "B",
                java.tenant_values(F.col("found"), F.col("short_name")),
            ).otherwise(java.simple_values(F.col("found"))),
        )
    )
    readable = F.filter("all_values", lambda v: ~v["unreadable"])
    listed = (
        found.withColumn("values", F.transform(readable, lambda v: v.dropFields("unreadable")))
        .withColumn("unreadable", F.size("all_values") - F.size("values"))
        .drop("found", "all_values")
    )
    return computed_once(listed, "short_name", "values", "unreadable")


def with_values(enums: DataFrame) -> DataFrame:
    return enums.filter((F.col("short_name") != "") & (F.size("values") > 0))


def extract_enums(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Enum classes with at least one value."""
    return with_values(parse_enums(files, settings, root)).drop("values", "unreadable")


def classify_paradigm(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """``A`` (one meaning per code) or ``B`` (meaning depends on a tenant)."""
    return extract_enums(files, settings, root).select("repo_id", "enum_class", "paradigm")


def explode_values(enums: DataFrame) -> DataFrame:
    """One row per enum constant, in text order."""
    return exploded(
        enums, "values", "repo_id", "enum_class", "paradigm", value="v", pos="value_no"
    ).select("repo_id", "enum_class", "paradigm", "value_no", "v.*")


def extract_simple_values(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Constants of enums with one meaning per code."""
    enums = parse_enums(files, settings, root).filter(F.col("paradigm") == "A")
    return explode_values(enums).drop("paradigm", "aggregators")


def extract_tenant_values(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Constants of enums whose meaning depends on a tenant."""
    enums = parse_enums(files, settings, root).filter(F.col("paradigm") == "B")
    return explode_values(enums).drop("paradigm")


def parse_bundles(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Key, raw value and line number of every message line."""
    lines = exploded(
        bundle_files(files, settings, root),
        java.bundle_lines(F.col("src")),
        "repo_id",
        java.relative_path(F.col("path"), root).alias("bundle_file"),
        value="line",
        pos="pos",
    )
    equals = F.call_function("locate", F.lit("="), F.col("line"))
    return lines.filter(~F.col("line").startswith("#") & (equals > 0)).select(
        "repo_id",
        "bundle_file",
        (F.col("pos") + 1).alias("line_no"),
        strip_space(F.substr("line", F.lit(1), equals - 1)).alias("key"),
        strip_space(F.substr("line", equals + 1)).alias("raw"),
    )


def latest_key(messages: DataFrame) -> DataFrame:
    """One row per key: the last line of the last file, by path, wins.

    A plain aggregate, so repeats of a key are combined before the shuffle.
    """
    place = F.struct("bundle_file", "line_no")
    last = F.max(F.struct(place.alias("place"), F.col("raw").alias("raw")))
    return (
        messages.groupBy("repo_id", "key")
        .agg(last.alias("last"))
        .select(
            "repo_id",
            "key",
            decode_escapes(F.col("last.raw")).alias("value"),
            F.col("last.place.bundle_file").alias("bundle_file"),
        )
    )


def attach_messages(values: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``meaning``: the message text of the value's key, ``''`` without one."""
    texts = keys.select("repo_id", F.col("key").alias("message_key"), F.col("value"))
    return values.join(texts, ["repo_id", "message_key"], "left").withColumn(
        "meaning", F.coalesce("value", F.lit(""))
    ).drop("value")


def flag_default_meaning(values: DataFrame) -> DataFrame:
    """Add ``is_default`` and a ``warning`` on values that hold for some tenants only."""
    specific = F.coalesce(F.size("aggregators"), F.lit(0)) > 0
    tenants = F.array_join(F.transform("aggregators", lambda a: a.cast("string")), ", ")
    text = F.format_string(
        "code %d means something else for tenants [%s]; filter by tenant", F.col("code"), tenants
    )
    return values.withColumns({"is_default": ~specific, "warning": F.when(specific, text)})
