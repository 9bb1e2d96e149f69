"""Benchmark decontamination by winnowing, in column expressions only.

Texts are words; every run of five words has a hash, and of every six
consecutive hashes the least is kept. Ten shared words hold six shared hashes in
a row, so both sides keep the same least one: no shared passage of ten words is
missed. Kept hashes of test and training texts are joined; each meeting is then
extended to the ten-word windows around it, which are compared word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.plans.lineage import stored, value_bytes

WINDOW = 10
GRAM = 5
# hashes in a row of which the least is kept
ROW = WINDOW - GRAM + 1
# a kept hash is one number: 40 bits of hash above 24 bits of position
PLACE_BITS = 24
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# bytes of benchmark windows sent to every executor in one go; larger sets go in blocks
BLOCK_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _grams(size: int) -> Column:
    """For the column ``words``: hash and place of every run of ``size`` words, as one number each."""
    words = F.col("words")

    def packed(i: Column) -> Column:
        h = F.xxhash64(*[F.get(words, i + j) for j in range(size)])
        place = F.pmod(i, F.lit(1 << PLACE_BITS)).cast("bigint")
        return F.shiftleft(h, PLACE_BITS).bitwiseOR(place)

    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), packed)).otherwise(
        F.array().cast("array<bigint>")
    )


def _least_of_rows(grams: Column) -> Column:
    """The least of every ``ROW`` numbers in a row."""
    last = F.size(grams) - ROW
    return F.when(
        last >= 0,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(grams, i + j) for j in range(ROW)])
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _window(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", start + 1, size), " ")


def _benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, size, words of the item): items without a word are left out."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    return items.filter("item is not null and size(words) > 0").withColumn(
        "size", F.least(F.size("words"), F.lit(WINDOW))
    )


def _kept_hashes(items: DataFrame) -> DataFrame:
    """(fingerprint, size): what a training text must hold to be looked at."""
    long = items.filter(f"size = {WINDOW}").withColumn("grams", _grams(GRAM))
    found = long.select("size", F.explode(_least_of_rows(F.col("grams"))).alias("packed"))
    for size in range(1, WINDOW):
        short = items.filter(f"size = {size}")
        found = found.unionByName(short.select("size", F.explode(_grams(size)).alias("packed")))
    return found.select(F.shiftright("packed", PLACE_BITS).alias("fingerprint"), "size").distinct()


def _sized(size: int):
    return lambda packed: F.struct(F.lit(size).alias("size"), packed.alias("packed"))


def _meetings(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Each text's kept hashes, one a row, and one row (hash null) that stands for the text."""
    parts = [F.array(F.struct(F.lit(None).cast("int").alias("size"), F.lit(None).cast("bigint").alias("packed")))]
    for size in sizes:
        if size == WINDOW:
            kept = _least_of_rows(F.col("grams"))
        else:
            kept = _grams(size)
        parts.append(F.transform(kept, _sized(size)))
    if WINDOW in sizes:
        docs = docs.withColumn("grams", _grams(GRAM))
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    return docs.select("doc_id", "digest", "words", F.explode(every).alias("at")).select(
        "doc_id", "digest", "words", F.col("at.size").alias("size"), F.col("at.packed").alias("packed")
    )


def _starts() -> Column:
    """Where windows of ``size`` words around the place of ``packed`` may start."""
    n = F.size("words")
    place = F.col("packed").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    # texts of more words than places hold the same place again
    places = F.sequence(place, F.greatest(place, n - 1), F.lit(1 << PLACE_BITS))
    before = F.when(F.col("size") == WINDOW, F.lit(ROW - 1)).otherwise(0)
    around = F.transform(
        places,
        lambda p: F.sequence(F.greatest(F.lit(0), p - before), F.greatest(F.lit(0), p)),
    )
    return F.filter(F.flatten(around), lambda s: s + F.col("size") <= n)


def _block(n: int) -> Column:
    """The block of an item."""
    return F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``items``, ``spans``.

    A window is ten consecutive words of an item; an item of fewer words, but not
    none, is one window. Words of a text inside any occurrence of a window are
    hit. ``items`` are the ids, as sorted strings, of the items with a window in
    the text; ``spans`` the windows found as (start, size) in words, sorted.

    Null and wordless texts have no words and no hit, items without a word or id
    are never found, repeated rows give repeated results, and an empty benchmark
    leaves every text clean. Other columns are not looked at, whatever their names.
    """
    items = stored(_benchmark_windows(benchmark, item_col, item_text_col))
    measured = items.groupBy("size").agg(F.sum(F.size("words") * F.lit(1)).alias("n")).collect()
    sizes = sorted(r["size"] for r in measured)
    # every window repeats ten words of its item
    n_blocks = max(1, -(-value_bytes(items) * WINDOW // block_bytes))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("size"))
    windows = (
        items.select("item", "size", "words", F.explode(starts).alias("start"))
        .select("item", "size", _window(F.col("start"), F.col("size")).alias("window"))
        .groupBy("size", "window")
        .agg(
            F.sort_array(F.collect_set("item")).alias("items"),
            F.collect_set(_block(n_blocks)).alias("blocks"),
        )
        .withColumn("set_id", F.xxhash64("items"))
    )
    windows = stored(windows)
    item_sets = windows.groupBy("set_id").agg(F.first("items").alias("items"))
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        # tells rows with one id apart; copies of a row share their result
        F.concat_ws(":", F.xxhash64(text_col), F.length(text_col)).alias("digest"),
        words_of(F.col(text_col)).alias("words"),
    )
    found = None
    for block in range(n_blocks):
        own = items.filter(_block(n_blocks) == block)
        near = _meetings(texts, sizes).withColumn("fingerprint", F.shiftright("packed", PLACE_BITS))
        near = near.join(
            F.broadcast(_kept_hashes(own).withColumn("met", F.lit(True))), ["fingerprint", "size"], "left"
        ).filter("packed is null or met")
        rows = near.select(
            "doc_id",
            "digest",
            F.size("words").alias("n_words"),
            "size",
            F.explode(
                F.when(
                    F.col("packed").isNull(),
                    F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("window"))),
                ).otherwise(
                    F.transform(
                        _starts(),
                        lambda s: F.struct(s.alias("start"), _window(s, F.col("size")).alias("window")),
                    )
                )
            ).alias("at"),
        ).select("doc_id", "digest", "n_words", "size", "at.start", "at.window")
        sides = windows.filter(F.array_contains("blocks", block)).select("size", "window", "set_id")
        hit = rows.join(F.broadcast(sides), ["size", "window"], "left").filter("window is null or set_id is not null")
        hit = hit.withColumn("whole", F.col("window").isNull() & F.lit(block == 0))
        found = hit if found is None else found.unionByName(hit)
    per_text = found.groupBy("doc_id", "digest").agg(
        F.count_if("whole").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.sort_array(
            F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "size")))
        ).alias("spans"),
        F.collect_set("set_id").alias("set_ids"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda got, span: F.struct(
            F.greatest(got["end"], span["start"] + span["size"]).alias("end"),
            (
                got["n"]
                + F.greatest(got["end"], span["start"] + span["size"])
                - F.greatest(got["end"], span["start"])
            ).alias("n"),
        ),
        lambda got: got["n"],
    )
    per_text = stored(per_text.withColumn("n_hit", covered))
    named = (
        per_text.select("doc_id", "digest", F.explode("set_ids").alias("set_id"))
        .join(item_sets, "set_id")
        .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return (
        per_text.join(named, same, "left")
        .select(
            "doc_id",
            F.col("n_words").cast("bigint").alias("n_words"),
            F.col("n_hit").cast("bigint").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            "spans",
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
        )
        .drop("_copy")
    )
