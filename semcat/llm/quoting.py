"""Chat formatting by quotation links, in column expressions only.

Lines of a message that start with ``>`` quote another one, ``>>`` one that is
quoted there, and so on. Every run of quoted lines is cut by level into passages;
a passage and each of its lines is normalised and hashed, as are all messages'
own words. A quotation is linked to the first earlier message of its conversation
that says the same. Links make threads; conversations are given thread by thread,
replies after what they reply to, without the quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.plans.lineage import stored

_QUOTED = r"^\s{0,3}((?:>\s?)+)"


def normalised(text: Column) -> Column:
    """Lower case, with one blank for any white space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Lines as (level, text); level 0 are a message's own."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, _QUOTED, 1), r"\s", "")).alias("level"),
            F.regexp_replace(line, _QUOTED, "").alias("text"),
        ),
    )


def _own(lines: Column) -> Column:
    """The text without its quotations."""
    own = F.filter(lines, lambda x: x["level"] == 0)
    return F.trim(F.array_join(F.transform(own, lambda x: x["text"]), "\n"))


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, without deeper ones between them, as (level, lines)."""
    empty = F.array().cast("array<struct<level:int,lines:array<string>>>")

    def add(got: Column, line: Column) -> Column:
        last = F.try_element_at(got, F.lit(-1))
        new = F.array(F.struct(line["level"].cast("int").alias("level"), F.array(line["text"]).alias("lines")))
        longer = F.array(
            F.struct(last["level"].alias("level"), F.concat(last["lines"], F.array(line["text"])).alias("lines"))
        )
        same = F.coalesce(last["level"] == line["level"], F.lit(False))
        return F.when(same, F.concat(F.slice(got, 1, F.size(got) - 1), longer)).otherwise(F.concat(got, new))

    return F.filter(F.aggregate(lines, empty, add), lambda p: p["level"] > 0)


def _hashes(texts: Column) -> Column:
    """Hashes of normalised texts; empty ones have none."""
    said = F.filter(F.transform(texts, normalised), lambda x: x != "")
    return F.array_distinct(F.transform(said, lambda x: F.xxhash64(x)))


def linked(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """``messages`` with ``body`` (without quotations), ``quotes`` (their number) and ``parent_turn``.

    Of all quotations of a message that are found, the least deep decides, then
    whole passages before single lines, then the latest of the messages found.
    """
    given = [F.col(f"`{c}`") for c in messages.columns if c not in ("body", "quotes", "parent_turn")]
    rows = messages.select(*given)
    rows = rows.withColumn("_lines", _lines(F.col(text_col)))
    rows = rows.withColumn("_passages", _passages(F.col("_lines"))).withColumn("body", _own(F.col("_lines")))
    rows = rows.withColumn("quotes", F.size("_passages")).withColumn(
        # rows that are alike in these are linked alike
        "_key", F.concat_ws(":", F.xxhash64(text_col), F.length(text_col))
    )
    said = rows.select(
        F.col(conv_col).alias("_conv"),
        F.col(turn_col).alias("_turn"),
        F.explode(_hashes(F.concat(F.array("body"), F.split("body", "\n")))).alias("_hash"),
    )
    # the first to say it; partial results before the shuffle, however often it is said
    said = said.groupBy("_conv", "_hash").agg(F.min("_turn").alias("_said"))
    quoted = rows.filter("quotes > 0").select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), "_key", F.explode("_passages").alias("p")
    )
    whole = F.transform(_hashes(F.array(F.array_join("p.lines", "\n"))), lambda h: F.struct(F.lit(1).alias("whole"), h.alias("hash")))
    parts = F.transform(_hashes(F.col("p.lines")), lambda h: F.struct(F.lit(0).alias("whole"), h.alias("hash")))
    asked = quoted.select("_conv", "_turn", "_key", F.col("p.level").alias("level"), F.explode(F.concat(whole, parts)).alias("q")).select(
        "_conv", "_turn", "_key", "level", "q.whole", F.col("q.hash").alias("_hash")
    )
    parents = (
        asked.join(said, ["_conv", "_hash"])
        .filter("_said < _turn")
        .groupBy("_conv", "_turn", "_key")
        .agg(F.max(F.struct((-F.col("level")).alias("near"), "whole", "_said"))["_said"].alias("parent_turn"))
    )
    rows = rows.drop("_lines", "_passages")
    on = (
        (F.col(conv_col) == F.col("_conv"))
        & (F.col(turn_col) == F.col("_turn"))
        & (F.col("_key") == F.col("_other"))
    )
    parents = parents.withColumnRenamed("_key", "_other")
    return rows.join(parents, on, "left").select(*given, "body", "quotes", "parent_turn")


def _with_roots(rows: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """Adds ``root_turn``: where a message's thread begins, by doubling the reach of links."""
    links = rows.filter("parent_turn is not null").select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col("parent_turn").alias("_up")
    )
    # repeated turns of a conversation: the earliest answer stands for all
    links = stored(links.groupBy("_conv", "_turn").agg(F.min("_up").alias("_up")))
    while True:
        above = links.select("_conv", F.col("_turn").alias("_up"), F.col("_up").alias("_over"))
        longer = links.join(above, ["_conv", "_up"], "left")
        if longer.filter("_over is not null").isEmpty():
            break
        links = stored(longer.select("_conv", "_turn", F.coalesce("_over", "_up").alias("_up")))
    on = (F.col(conv_col) == F.col("_conv")) & (F.col("parent_turn") == F.col("_turn"))
    found = rows.join(links, on, "left")
    root = F.coalesce("_up", "parent_turn", F.col(turn_col))
    return found.withColumn("root_turn", root).drop("_conv", "_turn", "_up")


def threads(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """All messages with ``body``, ``quotes``, ``parent_turn``, ``root_turn``, ``position`` and ``chat``.

    ``position`` counts a conversation's messages from 0, thread by thread in the
    order in which threads begin, and by turn within a thread, so that a reply
    follows what it replies to. ``chat`` is the role and the body as one text. A
    conversation is a run of rows, never one row, as it may have any length.

    Null texts are empty; a message without conversation or turn links to nothing
    and stands with its like, null turns first. Repeated rows keep their own
    positions, in no fixed order among each other. Other columns are kept; those
    named as the new ones are replaced.
    """
    new = ("body", "quotes", "parent_turn", "root_turn", "position", "chat")
    kept = F.struct(*[F.col(f"`{c}`") for c in messages.columns if c not in new]).alias("given")
    # no name of the given columns meets one of those used below
    columns = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    rows = messages.select(kept, *[F.col(f"`{c}`").alias(name) for name, c in columns.items()])
    conv_col, turn_col, role_col, text_col = columns
    rows = stored(linked(rows, conv_col, turn_col, text_col))
    rows = _with_roots(rows, conv_col, turn_col)
    # the rank of a row in its conversation, of which one may have any share of all rows:
    # rows are sorted over all partitions, numbered within each and counted by partition
    order = [conv_col, "root_turn", turn_col, text_col]
    rows = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # as many rows as there are partitions
    before = sizes.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    placed = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    placed = placed.withColumn("_at", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(F.col(conv_col).alias("_conv")).agg(F.min("_at").alias("_first"))
    placed = placed.join(first, F.col(conv_col).eqNullSafe(F.col("_conv")))
    chat = F.concat(F.lit("<|"), F.coalesce(role_col, F.lit("")), F.lit("|>\n"), F.col("body"))
    placed = placed.withColumn("position", F.col("_at") - F.col("_first")).withColumn("chat", chat)
    return placed.select("given.*", *new)
