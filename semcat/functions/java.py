"""Entity and enum source files as column expressions.

All patterns are for the regular expression engine of the JVM. Repetitions over
groups are possessive, so neither long nor hostile files backtrack or grow the
stack. A file is scanned once for its field or constant blocks; everything else
is read from those short blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semcat.config import (
    COMMENT_WINDOW,
    NOT_A_CONSTANT,
    NOT_A_TENANT_CONSTANT,
    SKIPPED_FIELDS,
    Settings,
)
from semcat.functions.text import (
    camel_to_snake,
    normalize_type,
    parse_int_list,
    raw_type,
    strip_space,
)

_SEP = "\u0001"
# around a match, in a text without these
_OPEN, _SHUT = "\u0002", "\u0003"

# building blocks: string, character, parentheses and braces with nesting
_STR = r'"(?:[^"\\\n]++|\\.)*+"'
_CHR = r"'(?:[^'\\\n]|\\[^\n]{1,6})'"
_GAP = r"(?:\s++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)*+"


def _nested(left: str, right: str, depth: int) -> str:
    inner = ""
    for _ in range(depth):
        body = rf"[^{left}{right}\"']++|{_STR}|{_CHR}|'" + (f"|{inner}" if inner else "")
        inner = rf"\{left}(?:{body})*+\{right}"
    return inner


# patterns cannot recurse: levels of nesting that they see; :func:`flat` hides what lies deeper
_LEVELS = 8
_PAREN = _nested("(", ")", _LEVELS)
_BRACE = _nested("{", "}", _LEVELS)
_GENERIC = _nested("<", ">", _LEVELS)

# brackets, and what stands for those deeper than so many levels: characters that no text may hold
_SEEN = 4
_BRACKETS = "(){}<>"
_HIDDEN = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4\ufdd5"
_PIECE = rf"{_STR}|{_CHR}|[(){{}}<>;]|[^(){{}}<>;\"']++|[\"']"


def _deeper(left: str, right: str, other: str = "") -> str:
    """An open bracket with another one in it that has more levels than the patterns would still see, or no end."""
    inner = _nested(left, right, _LEVELS - 1)
    return rf"\{left}(?:[^{left}{right}{other}\"']++|{_STR}|{_CHR}|'|{inner})*+\{left}"


_DEEP = "(?s)" + "|".join((_deeper("(", ")"), _deeper("{", "}"), _deeper("<", ">", ";(){}")))

_ANNOTATIONS = rf"(?:@[\w.]++(?:\s*+{_PAREN})?+{_GAP})++"
_MODIFIERS = r"(?:(?:static|final|transient|volatile)\s++)*+"
_TYPE = rf"[\w.]++(?:\s*+{_GENERIC})?+(?:\s*+\[\s*+\])*+"

# one annotated private field, from its first annotation to its semicolon
FIELD = (
    rf"(?sU)({_ANNOTATIONS})private\s++({_MODIFIERS})({_TYPE})\s++(\w++)\s*+(?:=[^;]*+)?;"
)

_ATTRIBUTES = rf"(?:(?!NAME\b)\w++\s*+=\s*+(?:[^(){{}}\",]++|{_STR}|{_PAREN}|{_BRACE})++,\s*+)*+"


def _attribute(annotation: str, name: str, bare: bool) -> str:
    """Text of one string attribute of an annotation, at any position."""
    keyed = rf"{_ATTRIBUTES.replace('NAME', name)}{name}\s*+=\s*+"
    return rf'(?sU){annotation}\s*+\(\s*+(?:{keyed}){"?+" if bare else ""}"([^"]+)"'


TABLE_NAME = _attribute("@Table", "name", bare=False)
COLUMN_NAME = _attribute(r"@Column", "name", bare=False)
MODEL_TEXT = _attribute("@ApiModel", "value", bare=True)
PROPERTY_TEXT = _attribute("@ApiModelProperty", "value", bare=True)

_PACKAGE = r"(?m)^\s*+package\s++(\w++(?:\.\w++)*+)\s*+;"
# the first declaration of a type that holds fields, in text without comments
_CLASS = r"(?<![\w.])(?:class|record)\s++([\w$]++)\s*+(?:[<({]|extends\b|implements\b)"
# what the first such declaration extends, type parameters passed over
_PARENT = (
    rf"(?<![\w.])(?:class|record)\s++[\w$]++\s*+(?:{_GENERIC}\s*+)?+"
    r"(?:extends\s++([\w$.]++)|[({]|implements\b)"
)
_ENUM = r"(?U)\benum\s+(\w+)"
# the first line with a word in a documentation comment, which may be its only one
_JAVADOC = r"/\*\*(?:\s|\*(?!/))*+([^\s*][^\n*]*+)"


def first(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, ``''`` if there is none."""
    return F.regexp_extract(col, pattern, group)


def relative_path(path: Column, root: Column | None) -> Column:
    """Path below the root; the whole path when it lies elsewhere."""
    if root is None:
        return path
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        path.startswith(base), F.substr(path, F.length(base) + 1)
    ).otherwise(path)


def file_stem(path: Column) -> Column:
    """File name without directory and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), F.lit(r"(?<=.)\.[^.]*$"), F.lit(""))


def without_comments(src: Column) -> Column:
    """Source text without comments; a comment mark inside a string stays."""
    bare = F.regexp_replace(
        src,
        F.lit(rf"(?s)({_STR}|{_CHR})|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"),
        F.lit("$1"),
    )
    return F.when(src.contains("//") | src.contains("/*"), bare).otherwise(src)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Whether a piece is a bracket deep inside others of its kind (i) or not (o): open parentheses, braces and
# generics are counted from piece to piece. The braces of a type's body do not count. Generics end where a
# statement does, as < may also compare.
_INSIDE = """named_struct(
    'p', CASE x WHEN '(' THEN s.p + 1 WHEN ')' THEN greatest(s.p - 1, 0) ELSE s.p END,
    'd', CASE x WHEN '{' THEN if(s.d > 0, s.d + 1, if(s.t, 0, 1)) WHEN '}' THEN greatest(s.d - 1, 0) ELSE s.d END,
    'g', CASE WHEN x = '<' THEN s.g + 1 WHEN x = '>' THEN greatest(s.g - 1, 0)
        WHEN x IN ('(', ')', '{', '}', ';') THEN 0 ELSE s.g END,
    't', CASE WHEN x IN ('{', '}', ';') THEN false WHEN s.t THEN true ELSE x RLIKE TYPE_WORD END,
    'out', concat(s.out, CASE x
        WHEN '(' THEN if(s.p >= SEEN, 'i', 'o') WHEN ')' THEN if(s.p > SEEN, 'i', 'o')
        WHEN '{' THEN if(s.d >= SEEN, 'i', 'o') WHEN '}' THEN if(s.d > SEEN, 'i', 'o')
        WHEN '<' THEN if(s.g >= SEEN, 'i', 'o') WHEN '>' THEN if(s.g > SEEN, 'i', 'o')
        ELSE 'o' END))""".replace("SEEN", str(_SEEN)).replace("TYPE_WORD", _quoted(r"""(?s)^(?!["']).*?\b(?:class|interface|enum|record)\b"""))


def flat(code: str) -> Column:
    """The text of a column without comments, with inner brackets hidden if they are too deep for the patterns.

    From the fifth level on they become other characters, one for one, whatever the depth.
    :func:`shown` brings them back. Texts inside quotes stay.
    """
    pieces = f"split(regexp_replace({code}, {_quoted(_PIECE)}, '$0{_SEP}'), '{_SEP}')"
    start = "named_struct('p', 0, 'd', 0, 'g', 0, 't', false, 'out', '')"
    marks = f"split(aggregate(pieces, {start}, (s, x) -> {_INSIDE}).out, '')"
    hidden = f"""transform(array({marks}), marks -> array_join(transform(pieces,
        (x, i) -> if(get(marks, i) = 'i', translate(x, '{_BRACKETS}', '{_HIDDEN}'), x)), ''))[0]"""
    return F.expr(f"if({code} RLIKE {_quoted(_DEEP)}, transform(array({pieces}), pieces -> {hidden})[0], {code})")


def shown(text: Column) -> Column:
    """The text with the brackets that :func:`flat` hid."""
    return F.translate(text, _HIDDEN, _BRACKETS)


# ------------------------------------------------------------------ entities


def table_name(src: Column) -> Column:
    return F.lower(first(src, TABLE_NAME))


def purpose(src: Column) -> Column:
    """Model annotation, else the first javadoc line, else ``''``."""
    model = F.nullif(first(src, MODEL_TEXT), F.lit(""))
    return F.coalesce(model, strip_space(first(src, _JAVADOC)))


def qualified_class(src: Column, path: Column) -> Column:
    # null as soon as one is empty, each pattern being looked for once
    package, name = (F.regexp_substr(src, F.lit(p)) for p in (_PACKAGE, _CLASS))
    return F.coalesce(
        F.concat(first(package, _PACKAGE), F.lit("."), first(name, _CLASS)), file_stem(path)
    )


def extends_base(src: Column, base_entity: str) -> Column:
    """Whether the first declared type says that it extends the base entity."""
    return F.substring_index(first(src, _PARENT), ".", -1) == base_entity


def field_blocks(src: Column, compat: bool = False) -> Column:
    """Annotated fields of a file in text order.

    ``array<struct<annotations, modifiers, java_type, java_field, before>>``.
    ``before`` is the text ahead of the column annotation and is filled in
    compatible mode only.
    """

    def block(parts: Column, before: Column) -> Column:
        return F.struct(
            shown(parts[0]).alias("annotations"),
            parts[1].alias("modifiers"),
            shown(parts[2]).alias("java_type"),
            parts[3].alias("java_field"),
            before.alias("before"),
        )

    def parts(match: Column) -> Column:
        marked = F.regexp_replace(
            match, F.lit(FIELD), F.lit(f"$1{_SEP}$2{_SEP}$3{_SEP}$4")
        )
        return F.split(marked, _SEP)

    matches = F.regexp_extract_all(src, F.lit(FIELD), F.lit(0))
    if not compat:
        # marked in one pass; a text that has the marks itself is matched field by field
        text = F.regexp_replace(
            src, F.lit(FIELD), F.lit(f"{_OPEN}$1{_SEP}$2{_SEP}$3{_SEP}$4{_SHUT}")
        )
        pieces = F.filter(F.split(text, _OPEN), lambda x: x.contains(_SHUT))
        at_once = F.transform(pieces, lambda x: F.split(F.substring_index(x, _SHUT, 1), _SEP))
        marked = src.contains(_OPEN) | src.contains(_SHUT)
        return F.transform(
            F.when(marked, F.transform(matches, parts)).otherwise(at_once),
            lambda p: block(p, F.lit(None).cast("string")),
        )

    # running position of every match: search on from the end of the one before
    start = F.struct(
        F.lit(1).alias("next"),
        F.expr("cast(array() as array<struct<match:string,start:int>>)").alias("found"),
    )

    def advance(acc: Column, match: Column) -> Column:
        at = F.call_function("locate", match, src, acc["next"])
        return F.struct(
            (at + F.length(match)).alias("next"),
            F.concat(
                acc["found"], F.array(F.struct(match.alias("match"), at.alias("start")))
            ).alias("found"),
        )

    positioned = F.aggregate(matches, start, advance, lambda acc: acc["found"])

    def with_window(m: Column) -> Column:
        inside = F.call_function("locate", F.lit("@Column"), m["match"]) - 1
        column_at = m["start"] + F.greatest(inside, F.lit(0))
        low = F.greatest(column_at - COMMENT_WINDOW, F.lit(1))
        return F.struct(parts(m["match"]).alias("p"), F.substr(src, low, column_at - low).alias("w"))

    return F.transform(F.transform(positioned, with_window), lambda m: block(m["p"], m["w"]))


def _marks(text: Column) -> Column:
    """Column annotations in a text, those inside quotes left out."""
    return F.size(F.split(F.regexp_replace(text, _STR, "''"), r"@Column\b")) - 1


def unread_columns(code: Column, blocks: Column) -> Column:
    """How many column annotations of a file stand on no field that was read, as on a method."""
    return _marks(code) - F.aggregate(blocks, F.lit(0), lambda n, b: n + _marks(b["annotations"]))


def _column(name, block, comment, is_pk, inferred) -> Column:
    type_raw = raw_type(block["java_type"])
    return F.struct(
        name.alias("name"),
        block["java_field"].alias("java_field"),
        type_raw.alias("type_raw"),
        normalize_type(type_raw).alias("type"),
        is_pk.alias("is_pk"),
        F.lit(True).alias("is_nullable"),
        comment.alias("comment"),
        F.lit(inferred).alias("name_inferred"),
        F.lit(False).alias("from_base_entity"),
    )


def _is_id(block: Column) -> Column:
    return block["annotations"].rlike(r"@Id\b")


def declared_columns(blocks: Column, compat: bool = False) -> Column:
    """Fields with a named column annotation."""

    def build(block: Column) -> Column:
        own = first(block["annotations"], PROPERTY_TEXT)
        comment = own
        if compat:
            seen = F.regexp_extract_all(
                block["before"], F.lit(r'@ApiModelProperty\s*\(\s*"([^"]+)"'), F.lit(1)
            )
            comment = F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(""))
        name = F.lower(first(block["annotations"], COLUMN_NAME))
        return _column(name, block, comment, _is_id(block), False)

    kept = F.filter(
        blocks,
        lambda b: b["annotations"].rlike(r"@Column\b") & ~b["modifiers"].contains("static"),
    )
    return F.filter(F.transform(kept, build), lambda c: c["name"] != "")


def inferred_columns(blocks: Column, declared_fields: Column) -> Column:
    """Commented fields without a column annotation, named after the field."""

    def wanted(block: Column) -> Column:
        return (
            block["annotations"].contains("@ApiModelProperty")
            & ~block["annotations"].rlike(r"@(?:Column|Transient)\b")
            & ~block["modifiers"].rlike("static|transient")
            & ~block["java_field"].isin(*SKIPPED_FIELDS)
        )

    def build(block: Column) -> Column:
        return _column(
            camel_to_snake(block["java_field"]),
            block,
            first(block["annotations"], PROPERTY_TEXT),
            _is_id(block),
            True,
        )

    built = F.filter(F.transform(F.filter(blocks, wanted), build), lambda c: c["comment"] != "")
    return F.filter(built, lambda c: ~F.array_contains(declared_fields, c["java_field"]))


def first_per_name(columns: Column) -> Column:
    """Drop a column whose name came up earlier in the same file."""
    names = F.transform(columns, lambda c: c["name"])
    # hashing tells at once that there is nothing to drop, the usual case
    return F.when(
        F.size(F.array_distinct(names)) == F.size(columns), columns
    ).otherwise(
        F.filter(columns, lambda c, i: F.array_position(names, c["name"]) == i + 1)
    )


def base_columns(settings: Settings) -> Column:
    """The base entity's fields as an array literal."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(java_field).alias("java_field"),
                F.lit(type_raw).alias("type_raw"),
                normalize_type(F.lit(type_raw)).alias("type"),
                F.lit(is_pk).alias("is_pk"),
                F.lit(not is_pk).alias("is_nullable"),
                F.lit(comment).alias("comment"),
                F.lit(False).alias("name_inferred"),
                F.lit(True).alias("from_base_entity"),
            )
            for name, java_field, type_raw, is_pk, comment in settings.base_columns
        ]
    )


def merged_columns(own: Column, extends: Column, settings: Settings) -> Column:
    """Base fields in front of the entity's own, unless it names them itself."""
    if not settings.base_columns:
        return own
    own_names = F.transform(own, lambda c: c["name"])

    def lacking(names: Column) -> Column:
        return F.filter(base_columns(settings), lambda b: ~F.array_contains(names, b["name"]))

    # the names are made once, not for every base field
    added = F.transform(F.array(own_names), lacking)[0]
    return F.when(extends, F.concat(added, own)).otherwise(own)


# --------------------------------------------------------------------- enums

_REST = rf"[^()\"']++|{_STR}|{_CHR}|{_PAREN}"
_SHORT = r"(?:\(\s*+[Ss]hort\s*+\)\s*+)?+"
# one constant: name, code and everything up to its closing parenthesis
CONSTANT = rf"(?sU)(?<![\w.])(\w++)\s*+\(\s*+{_SHORT}(-?+\d++)\s*+,\s*+((?:{_REST})++)\)"
# from the enum's opening brace to the semicolon that ends the constants
_CONSTANTS = rf"(?sU)\benum\s++\w++[^{{]*+\{{((?:[^;{{}}\"']++|{_STR}|{_CHR}|{_BRACE})*+)"

_ONE_STRING = r'(?s)\A"([^"]+)"\s*\z'
_TWO_STRINGS = r'(?s)\A"([^"]*)"(?:\s*,\s*"([^"]*)")?'
_TENANTS = r"\bSets\.newHashSet\(([^)]+)\)"


def enum_name(src: Column) -> Column:
    return first(src, _ENUM)


def qualified_enum(src: Column) -> Column:
    package = first(src, _PACKAGE)
    return F.concat_ws(".", F.nullif(package, F.lit("")), enum_name(src))


def paradigm(text: Column) -> Column:
    """``B`` when codes may depend on a tenant, else ``A``."""
    return F.when(
        text.rlike(r"Set\s*<\s*Integer\s*>") | F.lower(text).contains("aggregator"), F.lit("B")
    ).otherwise(F.lit("A"))


def constant_text(text: Column, compat: bool = False) -> Column:
    """The part of an enum file that lists the constants, without their bodies."""
    if compat:
        return text
    return F.regexp_replace(first(text, _CONSTANTS), F.lit(_BRACE), F.lit(""))


def constants(region: Column) -> Column:
    """``array<struct<name, code, rest>>`` in text order."""
    matches = F.regexp_extract_all(region, F.lit(CONSTANT), F.lit(0))
    marked = F.transform(
        matches,
        lambda m: F.split(
            F.regexp_replace(m, F.lit(CONSTANT), F.lit(f"$1{_SEP}$2{_SEP}$3")), _SEP, 3
        ),
    )
    split = F.transform(
        marked,
        lambda p: F.struct(
            p[0].alias("name"), p[1].try_cast("bigint").alias("code"), shown(p[2]).alias("rest")
        ),
    )
    return F.filter(split, lambda c: c["code"].isNotNull())


def simple_values(found: Column) -> Column:
    """Constants of the form code, message key."""

    def build(c: Column) -> Column:
        return F.struct(
            c["name"].alias("name"),
            c["code"].alias("code"),
            first(c["rest"], _ONE_STRING).alias("message_key"),
            F.lit(None).cast("array<bigint>").alias("aggregators"),
            F.lit(False).alias("unreadable"),
        )

    kept = F.filter(found, lambda c: ~c["name"].isin(*NOT_A_CONSTANT))
    return F.filter(F.transform(kept, build), lambda v: v["message_key"] != "")


def tenant_values(found: Column, short_name: Column) -> Column:
    """Constants with one or two texts and perhaps a set of tenants."""

    def build(c: Column) -> Column:
        second = first(c["rest"], _TWO_STRINGS, 2)
        listed = first(c["rest"], _TENANTS)
        tenants = parse_int_list(listed)
        return F.struct(
            c["name"].alias("name"),
            c["code"].alias("code"),
            F.when(second != "", second)
            .otherwise(first(c["rest"], _TWO_STRINGS, 1))
            .alias("message_key"),
            F.when(F.size(tenants) > 0, tenants).alias("aggregators"),
            ((listed != "") & (F.size(tenants) == 0)).alias("unreadable"),
        )

    kept = F.filter(
        found,
        lambda c: c["rest"].startswith('"')
        & ~c["name"].isin(*NOT_A_TENANT_CONSTANT)
        & (c["name"] != short_name),
    )
    return F.transform(kept, build)


# ------------------------------------------------------------------- bundles


def bundle_lines(src: Column) -> Column:
    """Lines of a bundle, trimmed, in file order."""
    return F.transform(F.split(src, r"\R|[\x1c-\x1e]"), strip_space)
