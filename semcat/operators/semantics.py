"""What columns, tables and enums mean: flags, domains, duplicates, bindings, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.config import CODE_TYPES, DEFAULTS, Settings
from semcat.functions.rows import exploded
from semcat.functions.text import literal_map
from semcat.plans.lineage import sized

TABLE = ["repo_id", "table_name"]


def best_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of every key. Ranking starts before the shuffle, so a key with
    many rows sends one row per task only."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


# -------------------------------------------------------------- table flags


def soft_delete_of(columns: Column, names: tuple[str, ...]) -> Column:
    """First soft-delete column of a table's column array, or null."""
    hits = F.filter(columns, lambda c: c["name"].isin(*names))
    return F.try_element_at(hits, F.lit(1))["name"]


def dimensions_of(columns: Column, names: tuple[str, ...]) -> Column:
    """Tenant columns of a table's column array, in order."""
    names_only = F.transform(columns, lambda c: c["name"])
    return F.filter(names_only, lambda n: n.isin(*names))


def detect_soft_delete(
    columns: DataFrame, names: tuple[str, ...] = DEFAULTS.soft_delete_names
) -> DataFrame:
    """First soft-delete column, by position, of every table that has one."""
    return (
        columns.filter(F.col("name").isin(*names))
        .groupBy(*TABLE)
        .agg(F.min(F.struct("ordinal", "name"))["name"].alias("soft_delete_column"))
    )


def detect_dimensions(
    columns: DataFrame, names: tuple[str, ...] = DEFAULTS.dimension_names
) -> DataFrame:
    """Tenant columns, by position, of every table that has any.

    At most one entry per listed name, so the list stays short.
    """
    hits = columns.filter(F.col("name").isin(*names)).groupBy(*TABLE, "name").agg(
        F.min("ordinal").alias("ordinal")
    )
    return hits.groupBy(*TABLE).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]
        ).alias("dimension_fields")
    )


def domain_of(name: Column, domain_map: dict[str, str], default: str) -> Column:
    """Domain of the longest prefix that fits, without a join."""
    longest_first = sorted(domain_map.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    tests = [F.when(name.startswith(prefix), F.lit(domain)) for prefix, domain in longest_first]
    return F.coalesce(*tests, F.lit(default))


def assign_domain(
    tables: DataFrame, domain_map: dict[str, str] | DataFrame, default: str = "other"
) -> DataFrame:
    """Add ``domain``. A map given as DataFrame ``(prefix, domain)`` may be of any size:
    names are joined by equality on each of their leading parts."""
    if isinstance(domain_map, dict):
        return tables.withColumn("domain", domain_of(F.col("name"), domain_map, default))
    names = tables.select("name").distinct()
    lengths = F.sequence(F.lit(1), F.length("name"))
    parts = exploded(names, lengths, "name", value="n").withColumn("prefix", F.substr("name", F.lit(1), F.col("n")))
    found = (
        parts.join(sized(domain_map.select("prefix", "domain")), "prefix")
        .groupBy("name")
        .agg(F.max(F.struct("n", "domain"))["domain"].alias("domain"))
    )
    return tables.join(found, "name", "left").withColumn(
        "domain", F.coalesce("domain", F.lit(default))
    )


# ---------------------------------------------------------------- duplicates


def dedupe_tables(tables: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity with the most columns per table name, the first file on a tie."""
    key = ["repo_id", "name", "source_file"]
    counts = columns.groupBy(
        "repo_id", F.col("table_name").alias("name"), "source_file"
    ).agg(F.count("*").alias("n_columns"))
    ranked = tables.join(counts, key, "left").withColumn(
        "n_columns", F.coalesce("n_columns", F.lit(0))
    )
    kept = best_per(
        ranked, ["repo_id", "name"], F.desc("n_columns"), F.asc("source_file")
    ).drop("n_columns")
    owners = kept.select("repo_id", F.col("name").alias("table_name"), "source_file")
    return kept, columns.join(owners, ["repo_id", "table_name", "source_file"], "left_semi")


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """As :func:`dedupe_tables`, for rows that hold their columns as an array."""
    return best_per(
        entities, ["repo_id", "name"], F.size("columns").desc(), F.asc("source_file")
    )


def dedupe_enums(enums: DataFrame) -> DataFrame:
    """Per class: tenant-specific before simple, then most values, then first file."""
    return best_per(
        enums,
        ["repo_id", "enum_class"],
        F.desc("paradigm"),
        F.size("values").desc(),
        F.asc("source_file"),
    )


# ------------------------------------------------------------------ bindings

# order of trust of a binding
BINDING_RANK = {"curated": 1, "declared": 2, "inferred": 3}


def bind_enums(
    columns: DataFrame, enums: DataFrame, curated: DataFrame | None = None
) -> DataFrame:
    """Enum class of each column that has one.

    ``curated`` rows ``(repo_id, table_name, name, enum_class)`` come first, then
    a class the column already carries, then a class named like the column or
    like the table's last word and the column. Name matches need an integer
    code type and exactly one class of that name.
    """
    target = ["repo_id", "table_name", "name"]
    layers = []
    if curated is not None:
        layers.append(curated.select(*target, "enum_class", F.lit("curated").alias("confidence")))
    if "enum_class" in columns.columns:
        layers.append(
            columns.filter("enum_class is not null").select(
                *target, "enum_class", F.lit("declared").alias("confidence")
            )
        )
    bare = F.replace(F.col("name"), F.lit("_"), F.lit(""))
    tail = F.substring_index("table_name", "_", -1)
    keys = F.array(
        F.struct(F.lit(1).alias("step"), bare.alias("short_key")),
        F.struct(F.lit(2).alias("step"), F.concat(tail, bare).alias("short_key")),
    )
    code_columns = columns.filter(F.col("type_raw").isin(*CODE_TYPES))
    wanted = exploded(code_columns, keys, *target, value="k").select(*target, "k.*")
    unique = (
        enums.groupBy("repo_id", F.lower("short_name").alias("short_key"))
        .agg(F.min("enum_class").alias("enum_class"), F.max("enum_class").alias("last"))
        .filter("enum_class = last")
        .drop("last")
    )
    layers.append(
        best_per(
            wanted.join(unique, ["repo_id", "short_key"]), target, F.asc("step")
        ).select(*target, "enum_class", F.lit("inferred").alias("confidence"))
    )
    bound = layers[0]
    for layer in layers[1:]:
        bound = bound.unionByName(layer)
    rank = F.try_element_at(literal_map(BINDING_RANK), F.col("confidence"))
    return best_per(bound, target, rank.asc(), F.asc("enum_class"))


def apply_bindings(columns: DataFrame, bindings: DataFrame) -> DataFrame:
    """Columns with their ``enum_class`` filled in."""
    target = ["repo_id", "table_name", "name"]
    return columns.drop("enum_class").join(
        bindings.select(*target, "enum_class"), target, "left"
    )


# ----------------------------------------------------------------- relations


def infer_relations(
    columns: DataFrame,
    tables: DataFrame,
    prefixes: tuple[str, ...] = DEFAULTS.relation_prefixes,
    suffix: str = DEFAULTS.relation_suffix,
    to_column: str = DEFAULTS.relation_to_column,
) -> DataFrame:
    """Foreign keys by naming: ``<x>_id`` points at the first table ``<prefix><x>``."""
    stem = F.substr("name", F.lit(1), F.length("name") - len(suffix))
    wanted = exploded(
        columns.filter(F.col("name").endswith(suffix) & (F.length("name") > len(suffix))),
        F.array(*[F.concat(F.lit(p), stem) for p in prefixes]),
        "repo_id",
        F.col("table_name").alias("from_table"),
        F.col("name").alias("from_column"),
        value="to_table",
        pos="step",
    )
    known = tables.select("repo_id", F.col("name").alias("to_table"))
    hits = wanted.join(known, ["repo_id", "to_table"], "left_semi")
    first = hits.groupBy("repo_id", "from_table", "from_column").agg(
        F.min(F.struct("step", "to_table"))["to_table"].alias("to_table")
    )
    return first.select(
        "repo_id",
        "from_table",
        "from_column",
        "to_table",
        F.lit(to_column).alias("to_column"),
        F.lit("fk").alias("kind"),
        F.lit("inferred").alias("confidence"),
    )


def all_relations(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """Both sets; the more trusted row stands where both name the same relation."""
    rank = F.try_element_at(literal_map(BINDING_RANK), F.col("confidence"))
    key = ["repo_id", "from_table", "from_column", "to_table"]
    return best_per(declared.unionByName(inferred), key, rank.asc(), F.asc("to_column"))
