"""Choosing which source files are read as what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.config import DEFAULTS, Settings
from semcat.functions.java import relative_path


@dataclass(frozen=True)
class Rule:
    """Files with this suffix that hold every marker belong to ``rule_id``."""

    rule_id: str
    suffix: str = ".java"
    markers: tuple[str, ...] = ()
    directory: str | None = None


def default_rules(settings: Settings = DEFAULTS) -> list[Rule]:
    return [
        Rule(settings.rule_id, ".java", settings.markers),
        Rule("enum", ".java", (), settings.enum_dir),
        Rule("bundle", ".properties", ()),
    ]


def _below(root: Column | None) -> Column:
    return relative_path(F.col("path"), root)


def in_build_output(root: Column | None = None) -> Column:
    """True for files in a build output directory below the root."""
    return F.contains(F.concat(F.lit("/"), _below(root)), F.lit("/target/"))


def in_directory(name: str, root: Column | None = None) -> Column:
    """True when a directory of this name, below the root, holds the file."""
    return F.contains(F.concat(F.lit("/"), _below(root)), F.lit(f"/{name}/"))


def _has_all(markers: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for marker in markers:
        test = test & F.col("src").contains(marker)
    return test


def entity_files(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Source files with all entity markers."""
    return files.filter(
        F.col("path").endswith(".java") & _has_all(settings.markers) & ~in_build_output(root)
    )


def enum_files(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Source files inside a dictionary directory."""
    return files.filter(
        F.col("path").endswith(".java")
        & in_directory(settings.enum_dir, root)
        & ~in_build_output(root)
    )


def bundle_files(
    files: DataFrame, settings: Settings = DEFAULTS, root: Column | None = None
) -> DataFrame:
    """Message bundles of the wanted locale."""
    name = F.substring_index("path", "/", -1)
    return files.filter(
        name.startswith(settings.bundle_stem)
        & name.endswith(".properties")
        & ~in_build_output(root)
    )


def route_files(
    files: DataFrame,
    rules: list[Rule] | None = None,
    only: str | None = None,
    root: Column | None = None,
) -> DataFrame:
    """Add ``rule_id``: the first rule a file meets. Files meeting none are left out.

    ``only`` restricts the rules to one id.
    """
    rules = [r for r in (rules or default_rules()) if only in (None, r.rule_id)]
    if not rules:
        raise ValueError(f"no rule named {only!r}")

    def meets(rule: Rule) -> Column:
        test = F.col("path").endswith(rule.suffix) & _has_all(rule.markers)
        return test & in_directory(rule.directory, root) if rule.directory else test

    chosen = F.coalesce(*[F.when(meets(r), F.lit(r.rule_id)) for r in rules])
    return files.filter(~in_build_output(root)).withColumn("rule_id", chosen).filter(
        F.col("rule_id").isNotNull()
    )
