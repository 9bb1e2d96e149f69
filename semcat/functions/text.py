"""Names, types, escapes and word lists as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from semcat.config import TYPE_NAMES


def literal_map(pairs: dict) -> Column:
    """A map literal usable as a lookup."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def strip_space(col: Column) -> Column:
    """Trim every kind of white space at both ends, not blanks only."""
    return F.regexp_replace(col, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def camel_to_snake(col: Column) -> Column:
    """``orderItemID`` to ``order_item_id``."""
    # a word begins at a capital after a small letter or digit, or before a small letter
    border = r"(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])"
    return F.lower(F.regexp_replace(col, F.lit(border), F.lit("_")))


def raw_type(col: Column) -> Column:
    """Source type without its generic parameters."""
    return F.trim(F.split_part(col, F.lit("<"), F.lit(1)))


def normalize_type(col: Column) -> Column:
    """Source type, with or without package, to the catalog's type names.

    ``unknown`` when not listed.
    """
    simple = F.lower(F.substring_index(col, ".", -1))
    return F.coalesce(F.try_element_at(literal_map(TYPE_NAMES), simple), F.lit("unknown"))


def parse_int_list(col: Column) -> Column:
    """``"18325, 7"`` to ``[18325, 7]``; entries that are no digits are dropped."""
    trimmed = F.transform(F.split(col, ","), strip_space)
    digits = F.filter(trimmed, lambda x: x.rlike("^[0-9]+$"))
    return F.filter(F.transform(digits, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


# One-letter escapes of message bundles.
_LETTER_ESCAPES = {
    "\\n": "\n",
    "\\t": "\t",
    "\\r": "\r",
    "\\f": "\f",
    "\\b": "\b",
    "\\a": "\a",
    "\\v": "\v",
    "\\\\": "\\",
    "\\'": "'",
    '\\"': '"',
}

_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_PLAIN = r"\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}"
_LONE = r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"
_PIECES = rf"(?s)(?:{_PAIR}|{_PLAIN})++|{_LONE}|\\x[0-9a-fA-F]{{2}}|\\[^ux]|[^\\]++"
# every backslash must start one of the pieces, else the value stays as it is
_WELL_FORMED = rf"(?s)\A(?:{_PIECES[4:]})*+\z"


def decode_escapes(col: Column) -> Column:
    """Decode backslash escapes; a malformed value is returned unchanged.

    A surrogate pair becomes one character, half a pair the replacement
    character.
    """

    def piece(x: Column) -> Column:
        utf16 = F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        return (
            F.when(~x.startswith("\\"), x)
            .when(x.rlike(r"^" + _LONE + "$"), F.lit("�"))
            .when(x.startswith("\\u"), utf16)
            .when(
                x.startswith("\\x"),
                F.decode(F.unhex(F.concat(F.lit("00"), F.substring(x, 3, 2))), "UTF-16BE"),
            )
            .otherwise(F.coalesce(F.try_element_at(literal_map(_LETTER_ESCAPES), x), x))
        )

    pieces = F.regexp_extract_all(col, F.lit(_PIECES), F.lit(0))
    decoded = F.array_join(F.transform(pieces, piece), "")
    return (
        F.when(~F.contains(col, F.lit("\\")), col)
        .when(col.rlike(_WELL_FORMED), decoded)
        .otherwise(col)
    )


def _fold_table() -> tuple[str, str]:
    """Accented lower-case letters and their base letters, by rule."""
    source, target = [], []
    for point in list(range(0x00C0, 0x0530)) + list(range(0x1E00, 0x2000)):
        char = chr(point)
        base = unicodedata.normalize("NFD", char)
        if len(base) > 1 and unicodedata.category(base[0]).startswith("L"):
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


_ACCENTED, _BASE = _fold_table()


def fold(col: Column) -> Column:
    """Lower case without accents."""
    unmarked = F.regexp_replace(F.lower(col), F.lit(r"\p{M}+"), F.lit(""))
    return F.translate(unmarked, _ACCENTED, _BASE)


def tokenize(col: Column) -> Column:
    """Words of a text: letters and digits, folded; Han runs as character pairs.

    A run of one Han character is kept as it is. ``null`` gives no words.
    """
    words = F.regexp_extract_all(
        fold(F.coalesce(col, F.lit(""))), F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0)
    )

    def pairs(word: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2))
        )

    has_han = col.rlike(r"\p{IsHan}{2}")
    split = F.flatten(
        F.transform(
            words,
            lambda w: F.when(w.rlike(r"^\p{IsHan}{2,}$"), pairs(w)).otherwise(F.array(w)),
        )
    )
    return F.when(has_han, split).otherwise(words)
