"""Which texts hold which words, as an equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.functions.rows import exploded
from semcat.plans.lineage import side_hint, sized, stored

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _all_grams(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of these numbers of characters; runs of different size never meet."""
    runs = [_grams(text, n) for n in sizes]
    return F.array_distinct(runs[0] if len(runs) == 1 else F.flatten(F.array(*runs)))


def _own_grams(needle: Column) -> Column:
    """Runs of the greatest size a needle has."""
    sizes = [F.when(F.length(needle) == n, _grams(needle, n)) for n in range(1, GRAM)]
    return F.array_distinct(F.coalesce(*sizes, _grams(needle, GRAM)))


def substring_pairs(
    texts: DataFrame, needles: DataFrame, text_col: str, needle_col: str, keys: list[str]
) -> DataFrame:
    """Pairs of rows with equal ``keys`` where the text holds the needle.

    Both columns are compared as they are, so fold case beforehand. A needle is
    looked up by its rarest run of three characters (or by itself when
    shorter), then checked in full: no pair is missed and no cross product is
    formed. Only runs that some needle has leave a text's row, without the text;
    equal texts are looked up once. An empty needle fits nothing.
    """
    texts = texts.withColumn("_text_key", F.xxhash64(text_col))
    wanted = stored(
        needles.filter(F.length(needle_col) > 0)
        .select(*keys, needle_col)
        .distinct()
        .transform(
            lambda d: exploded(
                d, _own_grams(F.col(needle_col)), *keys, needle_col, value="_gram"
            )
        )
    )
    used = sized(wanted.select(*keys, "_gram").distinct())
    # at most GRAM numbers: as a rule no needle is short, and texts are cut into runs of one size only
    sizes = sorted(r.n for r in used.select(F.length("_gram").alias("n")).distinct().collect())
    held = stored(
        exploded(texts, _all_grams(F.col(text_col), sizes or [GRAM]), *keys, "_text_key", value="_gram")
        .join(used, [*keys, "_gram"], "left_semi")
        .groupBy(*keys, "_gram", "_text_key")
        .agg(F.count("*").alias("_copies"))
    )
    frequency = held.groupBy(*keys, "_gram").agg(F.count("*").alias("_n"))
    # a run held by no text has no frequency: then the needle fits nothing
    rarest = (
        wanted.join(frequency, [*keys, "_gram"], "left")
        .groupBy(*keys, needle_col)
        .agg(
            F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias(
                "best"
            )
        )
        .filter("best.n > 0")
        .select(*keys, needle_col, F.col("best.g").alias("_gram"))
    )
    # no more rows than needles
    hint = side_hint(wanted)
    # few of them spare the texts a shuffle
    candidates = stored(
        held.join(rarest.hint(hint), [*keys, "_gram"])
        .select(*keys, "_text_key", needle_col)
        .distinct()
    )
    pairs = texts.join(candidates.hint(side_hint(candidates)), [*keys, "_text_key"]).filter(
        F.contains(F.col(text_col), F.col(needle_col))
    )
    others = [c for c in needles.columns if c not in keys and c != needle_col]
    if others:
        pairs = pairs.join(needles, [*keys, needle_col])
    return pairs.drop("_text_key")
