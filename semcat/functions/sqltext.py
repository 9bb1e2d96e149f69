"""Tables, columns and comparisons named in a SQL text, as column expressions.

A statement is read in two steps. One pattern cuts it into tokens in one pass, without
comments. Then a machine with a stack goes over the tokens once and marks each with what it
is: a table, an alias, a column, a column in a condition, the name of an output, and so on, and
with the subquery it stands in. All else is looked up in the marked tokens.

What a token is depends on the clause it stands in, on its neighbours, and on nothing behind
them, so a statement need not be valid to be read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never a column, table or alias, unless quoted or after a dot.
KEYWORDS = (
    "select from where and or not in is null like rlike regexp between exists any some all"
    " distinct as on using join inner left right full outer cross natural lateral straight_join"
    " group by order having limit fetch asc desc nulls"
    " union intersect except minus with recursive case when then else end cast convert"
    " insert into values update set delete replace ignore duplicate key truncate"
    " true false unknown default interval over partition window range"
    " for of escape binary collate div mod xor sounds explain"
    " both leading trailing separator within filter ilike similar to"
).split()

# keywords that do something, by the letter of their class; all others have K
_CLASSES = {
    "S": ("select",),
    "F": ("from",),
    "J": ("join", "straight_join"),
    "I": ("into",),
    "U": ("update",),
    "Y": ("using",),
    "W": ("where", "having"),
    "X": ("on",),
    "E": ("set",),
    "G": ("by",),
    "Z": ("union", "intersect", "except", "minus"),
    "V": ("values",),
    "B": ("with",),
    "A": ("as",),
    "Q": ("delete",),
    "R": ("limit", "fetch", "for", "window"),
    "H": ("when",),
    # what ends an expression, so that a name behind it is the output's
    "N": ("end", "null", "true", "false"),
}

# letters, digits and marks of names, those of other scripts included; one class of few
# ranges, as the pattern engine's own Unicode mode takes ten times as long
_W = r"[\w\x{aa}-\x{1fff}\x{203f}\x{3005}-\x{d7ff}\x{f900}-\x{faff}]"
_STR = r"""'(?:[^'\\]++|\\.|'')*+'|"(?:[^"\\]++|\\.|"")*+\""""
# words that only count in these phrases, and are names elsewhere
_PHRASES = (
    r"(?:offset\s++[\d?:#$@]\S*+(?:\s++rows?)?+|fetch\s++(?:first|next)\s++(?:\S++\s++)?+rows?\s++only"
    r"|nulls\s++(?:first|last)|for\s++share|lock\s++in\s++share\s++mode"
    r"|(?:rows|range)\s++(?:between\s++(?:unbounded|current|\d++)\s++(?:preceding|following|row)\s++and\s++)?+"
    r"(?:unbounded|current|\d++)\s++(?:preceding|following|row))"
    rf"(?!{_W})"
)
# plain letters first: the wide class is slow
_WORD = rf"(?:\w++(?:{_W}++)?+|{_W}++)"
_PART = rf"(?:`[^`]++`|{_WORD})"
# a name may start with a letter or a mark; dots join its parts
_NAME = rf"(?:`[^`]++`|(?!\d){_WORD})(?:\s*+\.\s*+{_PART})*+(?:\s*+\.\s*+\*)?+"
_TOKEN = (
    r"(?s)--[^\n]*+|\#[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
    rf"|(?=[ofnlrOFNLR])(?i:{_PHRASES})|{_STR}|{_NAME}|\d++(?:\.\d++)?+(?:[eE][+-]?+\d++(?!{_W}))?+"
    rf"|[:@$]{{1,2}}{_WORD}|<=>|[<>!]=|<>|\|\||::|[^\s]"
)

# Clauses, by the letter the machine remembers.
#   x  nothing yet       s  outputs of a SELECT     f  a table is next     a  an alias may be next
#   b  after the alias   n  condition of a join     w  other condition     g  grouping, ordering
#   t  assignments       v  values                  k  target of INTO      l  after that target
#   i  names only        h  common tables           d  after DELETE        o  limits and the like
#   e  inside a function u  columns of USING        q  a function with FROM or FOR inside
#   y  EXTRACT           Q, Y  the same two inside a condition
_CONDITIONS = "('w', 'n', 'Q', 'Y')"
_EXPRESSIONS = "('s', 'g', 't', 'v', 'e', 'w', 'n', 'q', 'u', 'Q', 'y', 'Y')"
_FUNCTIONS = "('e', 'q', 'y', 'Q', 'Y')"

# Roles: T table, A its alias, D alias of a subquery, H common table, O output, C column,
# P column in a condition, M function, F a FROM that counts, K anything else.


def _quote(text: str) -> str:
    """A text as SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_quote(w) for w in words) + ")"


def _with(value: str, name: str, body: str) -> str:
    """``body`` with a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def tokens(sql: Column) -> Column:
    """The statement's tokens as written, without comments."""
    found = F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.rlike(r"^(?:--|#|/\*)"))


def _is_literal(token: str) -> str:
    """Whether a token is a number or a complete text."""
    first = f"substring({token}, 1, 1)"
    return f"if({first} IN ('\\'', '\"'), length({token}) > 1, {first} BETWEEN '0' AND '9')"


def literals(of: str) -> Column:
    return F.expr(f"filter({of}, t -> {_is_literal('t')})")


def template(of: str) -> Column:
    """Tokens in lower case with their literals blanked: what statements of one kind have in common.

    Numbers that are whole are told from others, as only those are codes.
    """
    blank = "CASE WHEN t RLIKE '^[0-9]+$' THEN '0' WHEN t RLIKE '^[0-9]' THEN '0.0' ELSE '\\'\\'' END"
    return F.expr(f"transform({of}, t -> if({_is_literal('t')}, {blank}, lower(t)))")


def _class(word: str) -> str:
    """The letter of a token in lower case: itself for brackets and commas, M names, L literals, O the rest."""
    keyword = " ".join(f"WHEN {word} IN {_list(words)} THEN '{letter}'" for letter, words in _CLASSES.items())
    return f"""CASE
        WHEN {word} IN ('(', ')', ',') THEN {word}
        WHEN {word} IN {_list(KEYWORDS)} THEN CASE {keyword} ELSE 'K' END
        WHEN {_is_literal(word)} THEN 'L'
        -- only a phrase has blanks between words
        WHEN {word} RLIKE {_quote(r"^[^`.]*\s[^.]*$")} THEN 'K'
        WHEN {word} RLIKE {_quote(f"^(?:`.|{_W})")} THEN 'M'
        WHEN {word} RLIKE '^[:@$][^:]' THEN 'L'
        ELSE 'O' END"""


# What a name is, by its clause and neighbours.
_NAME_ROLE = f"""CASE
    WHEN s.c IN {_EXPRESSIONS} THEN CASE
        WHEN t.p IN ('as', '::', 'collate', 'over') OR t.p2 = 'interval'
            THEN if(s.c = 's' AND t.p = 'as', 'O', 'K')
        WHEN t.x = '(' AND NOT (s.c = 's' AND t.pk IN ('M', ')', 'L', 'N')) THEN 'M'
        WHEN t.pk IN ('M', ')', 'L', 'N') THEN if(s.c = 's', 'O', 'K')
        WHEN s.c IN ('y', 'Y') AND t.p = '(' THEN 'K'
        WHEN t.w IN ('date', 'time', 'timestamp') AND startswith(t.x, '\\'') THEN 'K'
        WHEN t.w = 'matched' AND (t.p = 'when' OR t.p = 'not' AND t.p2 = 'when') THEN 'K'
        ELSE if(s.c IN {_CONDITIONS}, 'P', 'C') END
    WHEN s.c = 'f' THEN if(t.x = '(', 'M', 'T')
    WHEN s.c = 'k' THEN if(t.w = 'table' AND t.x RLIKE '^[^(,]', 'K', 'T')
    WHEN s.c = 'a' THEN if(t.p = ')' OR t.p = 'as' AND t.p2 = ')', 'D', 'A')
    WHEN s.c = 'l' THEN 'A'
    WHEN s.c = 'h' THEN 'H'
    ELSE 'K' END"""

_ROLE = f"""CASE
    WHEN t.k = 'M' THEN {_NAME_ROLE}
    WHEN t.k = 'F' AND s.c NOT IN ('q', 'y', 'Q', 'Y') AND NOT (t.p = 'distinct' AND t.p2 <> 'select') THEN 'F'
    ELSE 'K' END"""

# the clause inside a bracket
_INSIDE = f"""CASE
    WHEN t.x IN ('select', 'with') THEN 'x'
    WHEN t.p = 'insert' AND t.p2 = 'then' THEN 'i'
    WHEN t.p = 'extract' THEN if(s.c IN {_CONDITIONS}, 'Y', 'y')
    WHEN t.p IN ('trim', 'substring', 'substr', 'overlay', 'position') THEN if(s.c IN {_CONDITIONS}, 'Q', 'q')
    WHEN s.c IN {_CONDITIONS} THEN 'w'
    WHEN s.c = 'a' AND s.last = 'M' THEN 'e'
    WHEN s.c IN ('k', 'l', 'a', 'b', 'i', 'h') THEN 'i'
    WHEN s.c IN ('f', 'x', 'd') THEN s.c
    ELSE 'e' END"""

# the clause after a token
_CLAUSE = f"""CASE t.k
    WHEN 'M' THEN CASE
        WHEN s.c = 'f' AND r IN ('T', 'M') THEN 'a'
        WHEN s.c = 'k' AND r = 'T' THEN 'l'
        WHEN s.c IN ('a', 'l') THEN 'b'
        ELSE s.c END
    WHEN '(' THEN {_INSIDE}
    WHEN ')' THEN if(s.stack <> '', substring(s.stack, 1, 1), s.c)
    WHEN ',' THEN if(s.c IN ('a', 'b', 'n', 'u'), 'f', s.c)
    WHEN 'F' THEN if(r = 'F', 'f', s.c)
    WHEN 'K' THEN s.c
    WHEN 'L' THEN s.c
    WHEN 'O' THEN s.c
    WHEN 'A' THEN s.c
    WHEN 'S' THEN 's'
    WHEN 'J' THEN if(t.p = 'select', s.c, 'f')
    WHEN 'W' THEN 'w'
    WHEN 'X' THEN CASE WHEN t.x = 'duplicate' THEN 'o' WHEN s.c IN ('a', 'b', 'f', 'l') THEN 'n' ELSE s.c END
    WHEN 'G' THEN 'g'
    WHEN 'I' THEN 'k'
    WHEN 'U' THEN CASE WHEN t.p = 'key' THEN 't' WHEN t.p = 'for' OR t.x = 'set' THEN s.c ELSE 'f' END
    WHEN 'Y' THEN CASE
        WHEN s.c NOT IN ('a', 'b', 'l', 'd') THEN s.c
        WHEN t.x = '(' AND t.x2 NOT IN ('select', 'with', '(') THEN 'u'
        ELSE 'f' END
    WHEN 'E' THEN if(s.c IN {_FUNCTIONS}, s.c, 't')
    WHEN 'Z' THEN 'x'
    WHEN 'V' THEN if(t.x = '(' AND s.c IN ('e', 's', 'w', 't', 'g'), s.c, 'v')
    WHEN 'B' THEN if(s.c = 'x', 'h', s.c)
    WHEN 'Q' THEN if(t.x = '(', s.c, 'd')
    WHEN 'R' THEN if(s.c IN {_FUNCTIONS}, s.c, 'o')
    WHEN 'H' THEN if(t.x = 'matched' OR t.x = 'not' AND t.x2 = 'matched', 'w', s.c)
    ELSE s.c END"""

_OPENS_QUERY = "t.k = '(' AND t.x IN ('select', 'with')"

# The state after a token. `at` is the query, `stack` has the clause and query to go back to of every open
# bracket, `n` counts queries. What follows UNION is a query of its own beside the one before.
_STEP = _with(
    _ROLE,
    "r",
    f"""named_struct(
    'c', {_CLAUSE},
    'at', CASE
        WHEN {_OPENS_QUERY} THEN concat(s.at, s.n + 1, '.')
        WHEN t.k = ')' AND s.stack <> '' THEN substr(substring_index(s.stack, '/', 1), 2)
        WHEN t.k = 'Z' THEN concat(regexp_replace(s.at, '[0-9]+[.]$', ''), s.n + 1, '.')
        ELSE s.at END,
    'stack', CASE
        WHEN t.k = '(' THEN concat(CASE s.c WHEN 'f' THEN 'a' WHEN 'k' THEN 'l' ELSE s.c END, s.at, '/', s.stack)
        WHEN t.k = ')' THEN substr(s.stack, locate('/', s.stack) + 1)
        ELSE s.stack END,
    'n', if({_OPENS_QUERY} OR t.k = 'Z', s.n + 1, s.n),
    'last', r,
    'out', if(r IN ('T', 'D', 'C', 'P'), concat(s.out, r, s.at, ' '), concat(s.out, r, ' ')))""",
)


def _marks(classed: str) -> str:
    """Role and query of each token ``struct<w, k>``: ``array<string>``, the role first."""

    def near(step: int, field: str) -> str:
        return f"coalesce(get({classed}, i + {step}).{field}, '')"

    placed = f"""transform({classed}, (x, i) -> named_struct('w', x.w, 'k', x.k, 'p', {near(-1, "w")},
        'pk', {near(-1, "k")}, 'p2', {near(-2, "w")}, 'x', {near(1, "w")}, 'x2', {near(2, "w")}))"""
    start = "named_struct('c', 'x', 'at', '0.', 'stack', '', 'n', 0, 'last', 'K', 'out', '')"
    return f"split(rtrim(aggregate({placed}, {start}, (s, t) -> {_STEP}).out), ' ')"


def units(of: str) -> Column:
    """Tokens with what they are: ``array<struct<text, word, kind, role, at>>``.

    ``at`` names the query a token stands in by the way to it: ``"0."`` is the statement itself, ``"0.2."``
    a subquery, ``"0.2.3."`` a subquery of that, ``"4."`` what a UNION adds to the statement.
    """
    word = f"if({_is_literal('v')}, v, lower(v))"
    classed = f"transform(transform({of}, v -> {word}), u -> named_struct('w', u, 'k', {_class('u')}))"
    made = f"""transform(classed, (x, i) -> named_struct('text', get({of}, i), 'word', x.w, 'kind', x.k,
        'role', substring(get(marks, i), 1, 1), 'at', substr(get(marks, i), 2)))"""
    return F.expr(_with(classed, "classed", _with(_marks("classed"), "marks", made)))


_PARTS = _quote(rf"`[^`]++`|{_W}++|\*")


def _last(name: str) -> str:
    """The last part of a dotted name, quotes gone."""
    return (
        f"if({name} RLIKE '^[a-z0-9_]+$', {name},"
        f" replace(element_at(regexp_extract_all({name}, {_PARTS}, 0), -1), '`', ''))"
    )


def _before_last(name: str) -> str:
    """The part before it, or nothing."""
    return (
        f"if({name} RLIKE '^[a-z0-9_]+$', '',"
        f" replace(coalesce(try_element_at(regexp_extract_all({name}, {_PARTS}, 0), -2), ''), '`', ''))"
    )


def _named(of: str, role: str) -> str:
    return f"transform(filter({of}, u -> u.role = '{role}'), u -> {_last('u.word')})"


def derived_aliases(of: str) -> Column:
    """``array<struct<alias, at>>``: names given to subqueries, and where."""
    made = f"named_struct('alias', {_last('u.word')}, 'at', u.at)"
    return F.expr(f"transform(filter({of}, u -> u.role = 'D'), u -> {made})")


def sources(of: str) -> Column:
    """``array<struct<table, alias, derived, at>>`` in text order, repeats included."""
    alias = f"""coalesce(
        if(get({of}, i + 1).role = 'A', {_last(f"get({of}, i + 1).word")}, null),
        if(get({of}, i + 1).kind = 'A' AND get({of}, i + 2).role = 'A', {_last(f"get({of}, i + 2).word")}, null),
        {_last('u.word')})"""
    name = _last("u.word")
    made = f"named_struct('table', {name}, 'alias', {alias}, 'derived', array_contains(ctes, {name}), 'at', u.at)"
    every = f"filter(transform({of}, (u, i) -> if(u.role = 'T', {made}, null)), s -> s IS NOT NULL)"
    return F.expr(_with(_named(of, "H"), "ctes", every))


def _ref(unit: str) -> str:
    """``struct<qualifier, column, at>``; no qualifier is ``''``."""
    word = f"{unit}.word"
    return f"named_struct('qualifier', {_before_last(word)}, 'column', {_last(word)}, 'at', {unit}.at)"


def _named_in(ref: str) -> str:
    """Sources that a qualifier may mean where it stands."""
    return (
        f"filter(sources, src -> startswith({ref}.at, src.at)"
        f" AND (src.alias = {ref}.qualifier OR src.table = {ref}.qualifier))"
    )


def _settled(ref: str) -> str:
    """A reference with the query its source stands in instead of its own, so that equal ones are equal."""
    own = f"array_max(transform({_named_in(ref)}, src -> src.at))"
    return (
        f"named_struct('qualifier', {ref}.qualifier, 'column', {ref}.column,"
        f" 'at', if({ref}.qualifier = '', {ref}.at, coalesce({own}, {ref}.at)))"
    )


def _is_column(unit: str) -> str:
    return f"coalesce({unit}.role IN ('C', 'P'), false)"


def column_refs(of: str) -> Column:
    """Distinct ``struct<qualifier, column, at>`` of all columns named anywhere; needs ``sources``."""
    refs = f"transform(filter({of}, u -> {_is_column('u')}), u -> {_ref('u')})"
    named = f"filter({refs}, r -> r.qualifier <> '' OR NOT array_contains(outputs, r.column))"
    return F.expr(f"array_distinct(transform({_with(_named(of, 'O'), 'outputs', named)}, r -> {_settled('r')}))")


_COMPARE = _list(("<=>", "<>", "!=", "<=", ">=", "=", "<", ">"))


def _compared(of: str, i: str) -> str:
    """Whether the token at ``i`` is a comparison of two columns."""
    return (
        f"(coalesce(get({of}, {i}).word IN {_COMPARE}, false)"
        f" AND {_is_column(f'get({of}, {i} - 1)')} AND {_is_column(f'get({of}, {i} + 1)')})"
    )


def predicate_refs(of: str) -> Column:
    """Distinct references inside conditions on one column; needs ``sources``.

    A column compared to another one, as in a join, is not filtered by it.
    """
    alone = f"u.role = 'P' AND NOT {_compared(of, 'i + 1')} AND NOT {_compared(of, 'i - 1')}"
    found = f"filter({of}, (u, i) -> {alone})"
    return F.expr(f"array_distinct(transform(transform({found}, u -> {_ref('u')}), r -> {_settled('r')}))")


def equal_columns(of: str) -> Column:
    """Distinct ``struct<left, right>`` of columns that a condition sets equal; needs ``sources``."""
    is_pair = f"get({of}, i - 1).role = 'P' AND u.word IN ('=', '<=>') AND {_compared(of, 'i')}"
    pairs = f"""transform({of}, (u, i) -> if({is_pair},
        transform(array(get({of}, i - 1), get({of}, i + 1)), v -> {_with(_ref('v'), 'r', _settled('r'))}), null))"""
    made = "named_struct('left', get(p, 0), 'right', get(p, 1))"
    return F.expr(f"array_distinct(transform(filter({pairs}, p -> p IS NOT NULL), p -> {made}))")


def carried(refs: str, equal: str) -> str:
    """``refs`` and all columns set equal to one of them, also by way of others."""
    touched = "(array_contains(g, pair.left) OR array_contains(g, pair.right))"
    none = f"slice(array(slice({refs}, 1, 0)), 1, 0)"
    merged = f"array_union(array(pair.left, pair.right), flatten(filter(groups, g -> {touched})))"
    step = f"concat(filter(groups, g -> NOT {touched}), array({merged}))"
    groups = f"aggregate({equal}, {none}, (groups, pair) -> {step})"
    met = f"flatten(filter({groups}, g -> arrays_overlap(g, {refs})))"
    return f"if(size({equal}) = 0, {refs}, array_union({refs}, {met}))"


def equalities(of: str) -> Column:
    """Distinct ``struct<qualifier, column, at, nth>`` of columns compared to literals; needs ``sources``.

    ``nth`` says which of the statement's literals it is, from 0. Only whole numbers and texts count.
    """

    def counts(unit: str) -> str:
        return f"coalesce({unit}.kind = 'L' AND {unit}.word RLIKE {_quote(chr(94) + '(?:[0-9]+$|[' + chr(39) + chr(34) + '])')}, false)"

    def pair(at: str) -> str:
        nth = f"size(filter(slice({of}, 1, {at}), y -> {_is_literal('y.word')}))"
        return f"named_struct('r', {_ref('u')}, 'nth', {nth})"

    rest = f"slice({of}, i + 4, size({of}))"
    among = _with(
        f"cast(array_position(transform({rest}, y -> y.kind), ')') as int)",
        "close",
        f"""if(close > 1 AND forall(slice({of}, i + 4, close - 1), y -> {counts('y')} OR y.kind = ','),
        transform(filter(sequence(i + 3, i + 1 + close), j -> {counts(f'get({of}, j)')}), j -> {pair('j')}), null)""",
    )
    found = f"""filter(transform({of}, (u, i) -> CASE
        WHEN NOT {_is_column('u')} THEN null
        WHEN get({of}, i + 1).word = '=' AND {counts(f'get({of}, i + 2)')} THEN array({pair('i + 2')})
        WHEN get({of}, i - 1).word = '=' AND {counts(f'get({of}, i - 2)')} THEN array({pair('i - 2')})
        WHEN get({of}, i + 1).word = 'in' AND get({of}, i + 2).word = '(' THEN {among}
        END), p -> p IS NOT NULL)"""
    made = _with(
        _settled("e.r"), "r", "named_struct('qualifier', r.qualifier, 'column', r.column, 'at', r.at, 'nth', e.nth)"
    )
    return F.expr(f"array_distinct(transform(flatten({found}), e -> {made}))")


def own_equalities(of: str, literals_: str) -> Column:
    """:func:`equalities` of a template with a statement's own literals: their text, and as integer."""
    text = f"regexp_replace(get({literals_}, e.nth), {_quote(chr(94) + '[' + chr(39) + chr(34) + ']|[' + chr(39) + chr(34) + ']$')}, '')"
    made = _with(
        text,
        "v",
        "named_struct('qualifier', e.qualifier, 'column', e.column, 'at', e.at, 'literal', v,"
        " 'code', try_cast(trim(v) as bigint))",
    )
    return F.expr(f"array_distinct(transform({of}, e -> {made}))")


def candidates(ref: str) -> str:
    """Tables a reference may belong to, those of the innermost query first.

    A qualifier means a table or alias of its own query, else of the next one around it. Without one,
    the tables of all these queries may be meant; if they have none, those of the whole statement. Needs
    ``sources``, ``tables`` and ``derived_aliases``.
    """

    def ordered(found: str) -> str:
        ranked = f"transform({found}, (src, i) -> named_struct('far', -length(src.at), 'i', i, 'table', src.table))"
        return f"array_distinct(transform(sort_array({ranked}), src -> src.table))"

    seen = f"filter(sources, src -> startswith({ref}.at, src.at))"
    derived = f"exists(derived_aliases, d -> d.alias = {ref}.qualifier AND startswith({ref}.at, d.at))"
    every = "transform(tables, y -> y.table)"
    named = f"slice({ordered(_named_in(ref))}, 1, 1)"
    return f"""CASE
        WHEN {ref}.qualifier <> '' THEN {_with(named, "named", f"CASE WHEN size(named) > 0 THEN named WHEN {derived} THEN slice(named, 1, 0) ELSE {every} END")}
        ELSE {_with(ordered(seen), "near", f"if(size(near) > 0, near, {every})")} END"""


def may_be_derived(ref: str) -> str:
    """Whether a reference without a qualifier may belong to a subquery of its query's FROM."""
    return f"({ref}.qualifier = '' AND exists(derived_aliases, d -> startswith({ref}.at, d.at)))"


def unreadable_reason(of: str) -> Column:
    """Why a statement cannot be read; null when it can. Needs ``sources``."""

    def count(mark: str) -> str:
        return f"size(filter({of}, u -> u.word = '{mark}'))"

    return F.expr(f"""CASE
        WHEN size({of}) = 0 THEN 'empty statement'
        WHEN exists({of}, u -> u.word IN ('\\'', '"')) THEN 'unbalanced quotes'
        WHEN {count('(')} <> {count(')')} THEN 'unbalanced parentheses'
        WHEN size(sources) = 0 AND (get({of}, 0).word <> 'select' OR exists({of}, u -> u.role = 'F'))
            THEN 'no table reference' END""")
