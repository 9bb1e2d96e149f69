"""Quality rules with risk-controlled cutoffs, in column expressions only.

Every rule is a share of a text that is high for bad texts. Its cutoff is not
set by hand: labelled holdout rows of good quality show how many of them each
candidate cutoff would reject. Candidates are tried from the laxest to the
strictest, and a cutoff is taken while the exact binomial bound on its false
rejections still lies under the allowed rate (fixed-sequence testing). The error
level is divided by the number of strata and rules (Bonferroni), and the allowed
rate by the number of rules, so that with the stated confidence no stratum loses
more than the allowed share of good texts to all rules together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.plans.lineage import stored

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5
# a rule's name and its value, from the counts of `measured`
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
}
# candidate cutoffs: a text is rejected above them; from the laxest to the strictest
GRID = 100


def _count(text: Column, characters: str) -> Column:
    """How many of these characters (a class of a regular expression) a text holds."""
    return F.size(F.split(text, f"[{characters}]", -1)) - 1


def _windows(words: str) -> Column:
    """Hash and place of every three-word window, as one number each, sorted.

    The place takes as few bits as the text's length asks for; the hash has the rest.
    """
    i = f"transform(sequence(0, size({words}) - 3), i -> " \
        f"shiftleft(xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)), _bits) | i)"
    return F.expr(f"if(size({words}) >= 3, sort_array({i}), cast(array() as array<bigint>))")


def _next_to(windows: str, same: str) -> str:
    """The elements that equal the one before or after by ``same``, which says when ``{0}`` equals ``{1}``."""
    before = same.format(f"get({windows}, i - 1)", "x")
    after = same.format(f"get({windows}, i + 1)", "x")
    return f"filter({windows}, (x, i) -> coalesce({before}, false) or coalesce({after}, false))"


def _suspects(windows: str, words: str) -> Column:
    """Words and place of the windows whose hash meets another one's, sorted."""
    met = _next_to(windows, "shiftright({0}, _bits) = shiftright({1}, _bits)")
    at = "cast(x & (shiftleft(1L, _bits) - 1) as int)"
    text = f"concat_ws(' ', get({words}, at), get({words}, at + 1), get({words}, at + 2))"
    return F.expr(f"sort_array(transform(transform({met}, x -> {at}), at -> named_struct('w', {text}, 'at', at)))")


def _repeated(suspects: str) -> Column:
    """Places of the windows whose words are found twice: hashes alone may meet by chance in long texts."""
    return F.expr(f"sort_array(transform({_next_to(suspects, '{0}.w = {1}.w')}, x -> x.at))")


def _covered(starts: str) -> Column:
    """Words in the windows that start at these places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda got, at: F.struct(
            (at + 3).alias("end"), (got["n"] + at + 3 - F.greatest(got["end"], at)).alias("n")
        ),
        lambda got: got["n"],
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and, in a struct ``_m``, the counts of each whole text; null texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.select(*given, text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words"))
    docs = docs.withColumn("_bits", F.length(F.bin(F.size("_words"))))
    docs = docs.withColumn("_windows", _windows("_words")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: F.ltrim(x, F.lit(SPACE_CHARS)) != "")
    )
    docs = docs.withColumn("_suspects", _suspects("_windows", "_words")).withColumn("_starts", _repeated("_suspects"))
    counts = F.struct(
        F.size("_words").alias("n_words"),
        F.length(F.array_join("_words", "")).alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _covered("_starts").alias("n_repeat_words"),
        _count(F.col("_text"), "A-Z").alias("n_capitals"),
    )
    return docs.select(*given, counts.alias("_m"))


def _chance_of_so_few(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed in logarithms from its largest term down."""
    # log of the term at k by a recursion from 0; the sum is carried relative to the last term
    odds = rate / (1 - rate)
    steps = F.aggregate(
        F.sequence(F.lit(0), k),
        F.struct((n * F.log(F.lit(1 - rate))).alias("term"), F.lit(0.0).alias("rest")),
        lambda got, i: F.when(
            i == 0, F.struct(got["term"].alias("term"), F.lit(1.0).alias("rest"))
        ).otherwise(
            F.struct(
                (got["term"] + F.log((n - i + 1) / i * odds)).alias("term"),
                (F.lit(1.0) + got["rest"] / ((n - i + 1) / i * odds)).alias("rest"),
            )
        ),
        lambda got: got["term"] + F.log(got["rest"]),
    )
    return F.when(k >= n, F.lit(1.0)).otherwise(F.exp(steps))


def cutoffs(
    measured_docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    stratum: Column,
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    allowed: float = 0.02,
    error: float = 0.05,
) -> DataFrame:
    """(stratum, rule, cutoff): the strictest cutoff that is safe; rules without one have no row.

    The holdout is every labelled row of good quality that the base rules keep.
    """
    good = labels.filter(F.col(quality_col) == 1).select(F.col(label_id_col).alias("_id")).distinct()
    rows = (
        measured_docs.filter(~_base_failed())
        .select(F.col(id_col).alias("_id"), stratum.alias("stratum"), "_m")
        .join(good, "_id", "left_semi")
        .select("stratum", "_m.*")
    )
    values = rows.select(
        "stratum",
        F.explode(
            F.array(
                *[F.struct(F.lit(name).alias("rule"), F.expr(value).alias("value")) for name, value in RULES.items()]
            )
        ).alias("r"),
    ).select("stratum", "r.*")
    # a value is over the first so many cutoffs 1, 0.99, ... ; counts by that number are small
    over = F.greatest(F.lit(0), F.lit(GRID) - F.ceil(F.round(F.col("value") * GRID, 9))).cast("int")
    counts = values.groupBy("stratum", "rule", over.alias("first")).agg(F.count("*").alias("n"))
    per_rule = counts.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("at")
    )
    per_rule = stored(per_rule)
    n_strata = per_rule.select("stratum").distinct().count()
    level = error / (max(n_strata, 1) * len(RULES))
    rejected = F.aggregate(
        F.sequence(F.lit(0), F.col("step") - 1), F.lit(0).cast("bigint"),
        lambda got, i: got + F.coalesce(F.try_element_at("at", i), F.lit(0).cast("bigint")),
    )
    tried = (
        per_rule.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
        .withColumn("k", F.when(F.col("step") == 0, F.lit(0).cast("bigint")).otherwise(rejected))
        .withColumn("safe", _chance_of_so_few(F.col("k"), F.col("n"), allowed / len(RULES)) <= level)
    )
    first_unsafe = F.min(F.when(~F.col("safe"), F.col("step")))
    best = tried.groupBy("stratum", "rule").agg((F.coalesce(first_unsafe, F.lit(GRID)) - 1).alias("step"))
    return best.filter("step >= 0").select(
        "stratum", "rule", ((F.lit(GRID) - F.col("step")) / GRID).alias("cutoff")
    )


def _base_failed() -> Column:
    words, repeated = F.col("_m.n_words"), F.col("_m.n_repeat_words")
    return (words < MIN_WORDS) | (repeated > MAX_REPEATED * words)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    allowed: float = 0.02,
    error: float = 0.05,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with a struct ``quality_rules``: the counts, ``base_failed``, ``failed`` (rules), ``kept``.

    A text is kept if the base rules keep it (50 words or more, at most half of
    them in repeated three-word windows) and it lies above no rule's cutoff of its
    stratum. A stratum without enough labelled rows has no cutoffs and loses only
    what the base rules reject. Null strata form one of their own, as do all rows
    where ``docs`` has no such column.

    Null and empty texts have no words and fail. Labels without an id or quality
    count for nothing; without any labels only the base rules judge. Repeated rows
    are judged alike. Other columns are kept; one named ``quality_rules`` is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "quality_rules"]
    given = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given")
    named = F.col(stratum_col).cast("string") if stratum_col in docs.columns else F.lit("")
    rows = docs.select(
        given, F.col(id_col).alias("_id"), F.coalesce(named, F.lit("")).alias("_stratum"), F.col(text_col).alias("text")
    )
    rows = stored(measured(rows).select("given", "_id", "_stratum", "_m"))
    safe = cutoffs(rows, labels, "_id", F.col("_stratum"), allowed=allowed, error=error)
    by_stratum = safe.groupBy(F.col("stratum").alias("_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs")
    )
    failed = F.array_compact(
        F.array(
            *[
                F.when(
                    F.round(_value(value), 9) > F.try_element_at("_cutoffs", F.lit(name)), F.lit(name)
                )
                for name, value in RULES.items()
            ]
        )
    )
    # one row a stratum: small, and the planner may send it to all
    judged = rows.join(by_stratum, "_stratum", "left")
    judged = judged.withColumn("_failed", failed).withColumn("_base", _base_failed())
    rules = F.struct(
        "_m.*",
        F.col("_base").alias("base_failed"),
        F.col("_failed").alias("failed"),
        (~F.col("_base") & (F.size("_failed") == 0)).alias("kept"),
    )
    return judged.withColumn("quality_rules", rules).select("given.*", "quality_rules")


def _value(value: str) -> Column:
    """A rule's value over the counts in ``_m``."""
    for name in ("n_symbols", "word_chars", "n_dup_lines", "n_lines", "n_repeat_words", "n_words", "n_capitals"):
        value = value.replace(name, f"_m.{name}")
    return F.expr(value)
