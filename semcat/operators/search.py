"""Full-text search: inverted index, BM25 ranking and substring fallback.

Queries are rows ``(repo_id, query_id, text)``; any number is ranked in one
job. Statistics are kept per repo.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.config import SEARCH_LIMIT
from semcat.functions.rows import exploded
from semcat.functions.text import tokenize
from semcat.operators.substring import substring_pairs
from semcat.plans.lineage import side_hint, sized, stored

# Fixed values of the ranking formula.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6

# scores are added up as decimals: the sum does not depend on the order of its parts,
# so equal docs tie and the least difference decides
EXACT = "decimal(28,15)"

# scores are summed up as whole numbers of this unit, in two halves that cannot overflow
UNITS, HALF = 1e15, 10**6

# rows of hits that one task sums up
TASK_HITS = 250_000

DOC = ["repo_id", "doc_id"]
MODES = ("all", "any", "prefix", "phrase")


@dataclass(frozen=True)
class Index:
    """``occurrences`` has one row per word (doc, field, position), ``postings`` one per
    doc, field and word; both carry the doc's length. ``corpus`` has one row per repo.
    ``whole``, if there, is stored and has one row per doc and word of all fields."""

    occurrences: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    fields: tuple[str, ...]
    whole: DataFrame | None = None


def build_index(
    docs: DataFrame, text_cols: list[str], doc_id: str = "doc_id", store: bool = False
) -> Index:
    """Index ``text_cols`` of ``docs`` ``(repo_id, <doc_id>, ...)``.

    With ``store`` the word lists are written once to the checkpoint folder.
    """
    words = docs.select(
        "repo_id",
        F.col(doc_id).alias("doc_id"),
        F.array(
            *[
                F.struct(F.lit(c).alias("field"), tokenize(F.col(c)).alias("terms"))
                for c in text_cols
            ]
        ).alias("fields"),
    ).withColumn(
        "length",
        F.aggregate("fields", F.lit(0), lambda acc, f: acc + F.size(f["terms"])),
    )
    if store:
        words = stored(words)
    occurrences = (
        exploded(words, "fields", *DOC, "length", value="f")
        .select(*DOC, "length", "f.*")
        .transform(lambda d: exploded(d, "terms", *DOC, "length", "field", value="term", pos="pos"))
    )
    # words of one doc sit in one task: counting there leaves distinct words to shuffle
    postings = occurrences.groupBy(*DOC, "field", "term", "length").agg(
        F.count("*").alias("tf")
    )
    doc_stats = words.select(*DOC, "length")
    term_stats = (
        postings.groupBy(*DOC, "term")
        .agg(F.sum("tf").alias("tf"))
        .groupBy("repo_id", "term")
        .agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_total"))
    )
    corpus = doc_stats.groupBy("repo_id").agg(
        F.count("*").alias("n_docs"), F.avg("length").alias("avg_length")
    )
    return Index(occurrences, postings, doc_stats, term_stats, corpus, tuple(text_cols))


def idf(n_docs: Column, n_with: Column) -> Column:
    return F.greatest(F.log((n_docs - n_with + 0.5) / (n_with + 0.5)), F.lit(MIN_IDF))


def term_score(tf: Column, length: Column, avg_length: Column) -> Column:
    norm = F.when(avg_length > 0, length / avg_length).otherwise(F.lit(1.0))
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * norm))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct word of a query, with the number of words."""
    words = queries.select(
        "repo_id", "query_id", F.array_distinct(tokenize(F.col(text))).alias("words")
    ).withColumn("n_terms", F.size("words"))
    return exploded(words, "words", "repo_id", "query_id", "n_terms", value="slot")


def _restricted(rows: DataFrame, terms: DataFrame, column: str | None) -> DataFrame:
    """Rows of the wanted words only; pushed below the counting when it can be."""
    if column is not None:
        rows = rows.filter(F.col("field") == column)
    return rows.join(sized(terms), ["repo_id", "term"], "left_semi")


def _slots_all(index: Index, wanted: DataFrame, column: str | None) -> DataFrame:
    """``(doc, slot, tf, length)`` where every slot is one word."""
    terms = wanted.select("repo_id", F.col("slot").alias("term")).distinct()
    if column is None and index.whole is not None:
        return _restricted(index.whole, terms, None).select(*DOC, F.col("term").alias("slot"), "tf", "length")
    rows = _restricted(index.postings, terms, column)
    if len(index.fields) > 1 and column is None:
        rows = rows.groupBy(*DOC, "term", "length").agg(F.sum("tf").alias("tf"))
    return rows.withColumnRenamed("term", "slot").select(*DOC, "slot", "tf", "length")


def _slots_prefix(index: Index, wanted: DataFrame, column: str | None) -> DataFrame:
    """As above, where a slot stands for all words that start with it."""
    prefixes = wanted.select("repo_id", "slot").distinct()
    vocabulary = index.occurrences.select("repo_id", "term").distinct()
    starts = F.transform(
        F.sequence(F.lit(1), F.length("term")), lambda n: F.substr("term", F.lit(1), n)
    )
    expanded = exploded(vocabulary, starts, "repo_id", "term", value="slot").join(
        sized(prefixes), ["repo_id", "slot"], "left_semi"
    )
    rows = index.occurrences if column is None else index.occurrences.filter(F.col("field") == column)
    # counted once, after all other words are gone
    return (
        rows.join(sized(expanded), ["repo_id", "term"])
        .groupBy(*DOC, "slot", "length")
        .agg(F.count("*").alias("tf"))
    )


def _phrase_hits(index: Index, queries: DataFrame, column: str | None) -> DataFrame:
    """``(query_id, doc, tf, length)``: how often a doc holds a query's words in a row.

    A query's rarest word names the places the phrase may start at; each word found
    where such a start wants it is a vote, and a place with all votes is a hit.
    """
    words = queries.select(
        "repo_id", "query_id", tokenize(F.col("text")).alias("words")
    ).withColumn("n_terms", F.size("words"))
    parts = exploded(
        words, "words", "repo_id", "query_id", "n_terms", value="term", pos="place"
    )
    parts = stored(parts)
    terms = parts.select("repo_id", "term").distinct()
    rows = _restricted(index.occurrences, terms, column)
    # common words are in most docs and in many queries, so only places around a query's rarest word vote
    counts = stored(rows.groupBy("repo_id", "term").agg(F.count("*").alias("n")))
    rarest = (
        parts.join(counts.hint(side_hint(counts)), ["repo_id", "term"], "left")
        .groupBy("repo_id", "query_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term")).alias("best"))
        .select("repo_id", "query_id", F.col("best.place").alias("place"), F.col("best.term").alias("term"))
    )
    starts = (
        index.occurrences.join(sized(rarest), ["repo_id", "term"])
        .transform(lambda d: d if column is None else d.filter(F.col("field") == column))
        .select(*DOC, "length", "field", "query_id", (F.col("pos") - F.col("place")).alias("at"))
        .distinct()
    )
    asked = sized(
        starts.join(parts.hint(side_hint(parts)), ["repo_id", "query_id"]).select(
            "repo_id", F.col("doc_id").alias("_doc"), "length", "field", "term",
            (F.col("at") + F.col("place")).alias("pos"), "query_id", "n_terms", "at",
        )
    )
    same = [rows[c] == asked[c] for c in ("repo_id", "length", "field", "term", "pos")]
    met = rows.join(asked, [*same, rows["doc_id"].eqNullSafe(asked["_doc"])])
    votes = met.groupBy(
        *[rows[c] for c in DOC], "query_id", "n_terms", asked["length"], asked["field"], "at"
    ).agg(F.count("*").alias("votes"))
    return (
        votes.filter(F.col("votes") == F.col("n_terms"))
        .groupBy(*DOC, "query_id", "length")
        .agg(F.count("*").alias("tf"))
    )


def _with_every_word(hits: DataFrame, weighted: DataFrame, hint: str) -> DataFrame:
    """Hits of the docs that can hold every word of a query.

    Such a doc holds the query's rarest word, so only the docs with that word
    are looked at for the others: common words are not joined to all queries.
    """
    query = ["repo_id", "query_id"]
    # counted once, not for both joins
    weighted = stored(weighted)
    complete = (
        weighted.groupBy(*query, "n_terms")
        .agg(
            F.count("*").alias("n_known"),
            F.min(F.struct("n_with", "slot"))["slot"].alias("slot"),
        )
        .filter(F.col("n_known") == F.col("n_terms"))
        .select(*query, "slot")
    )
    candidates = stored(
        hits.select(*DOC, "slot").join(complete.hint(hint), ["repo_id", "slot"]).drop("slot")
    )
    # written down, so that counting it is free: as a rule it is short
    asked = stored(candidates.join(weighted.hint(hint), query))
    side = side_hint(asked)
    if side == "merge":
        # all other docs' hits are dropped where they are read, and not shuffled
        hits = hits.join(sized(candidates.select(*DOC).distinct()), DOC, "left_semi")
    return hits.join(asked.hint(side), [*DOC, "slot"])


def _unwanted(index: Index, queries: DataFrame) -> DataFrame:
    """``(doc, query_id)`` where any field of the doc has a word that the query does not want."""
    unwanted = stored(query_terms(queries, "not_text"))
    hits = _slots_all(index, unwanted, None).select(*DOC, "slot")
    return hits.join(unwanted.select("repo_id", "query_id", "slot").hint(side_hint(unwanted)), ["repo_id", "slot"])


def _sum_of_any(
    hits: DataFrame, index: Index, queries: DataFrame, weighted: DataFrame, hint: str, part: Column, column: str | None
) -> DataFrame:
    """Scores of docs with any word of a query, without the docs that have an unwanted one.

    A doc's hits are brought together before they meet the queries, a few at a time: pairs of docs and
    queries, of which there are many more, are summed up where they arise and never shuffled.
    """
    with_not = "not_text" in queries.columns
    if with_not:
        hits = hits.withColumn("wanted", F.lit(True))
        words = stored(query_terms(queries, "not_text"))
        banning = _slots_all(index, words, None).withColumn("wanted", F.lit(False))
        hits = stored(hits.unionByName(banning))
        weighted = weighted.withColumn("wanted", F.lit(True)).unionByName(
            words.withColumn("wanted", F.lit(False)), allowMissingColumns=True
        )
    n_tasks = max(
        int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), hits.count() // TASK_HITS + 1
    )
    on = ["repo_id", "slot", "wanted"] if with_not else ["repo_id", "slot"]
    met = hits.repartition(n_tasks, *DOC).join(weighted.hint(hint), on)
    # floor and not round, which goes through text
    units = F.floor(part * F.lit(UNITS) + F.lit(0.5))
    met = met.select(*DOC, "query_id", units.alias("units"), *(["wanted"] if with_not else []))
    sums = [
        F.sum(F.expr(f"units div {HALF}")).alias("high"),
        F.sum(F.pmod("units", F.lit(HALF))).alias("low"),
    ]
    if with_not:
        # a doc without an id is banned by nothing, as it equals no other
        sums.append(F.max(~F.col("wanted") & F.col("doc_id").isNotNull()).alias("banned"))
    summed = met.groupBy("repo_id", "query_id", "doc_id").agg(*sums)
    if with_not:
        summed = summed.filter(~F.col("banned") & F.col("high").isNotNull())
    # two products, as one would not hold all digits
    high = F.col("high").cast("decimal(19,0)") * F.lit(Decimal("1E-9"))
    low = F.col("low").cast("decimal(19,0)") * F.lit(Decimal("1E-15"))
    return summed.select("repo_id", "query_id", "doc_id", (high + low).cast(EXACT).alias("score"))


def score_bm25(
    index: Index, queries: DataFrame, mode: str = "all", column: str | None = None
) -> DataFrame:
    """Score of every matching doc: ``(repo_id, query_id, doc_id, score)``, not rounded.

    ``mode``: ``all`` words must occur, ``any`` of them, every word as a
    ``prefix``, or all in a row as a ``phrase``. ``column`` looks at one field
    only. If queries have a ``not_text``, docs with any of its words are out.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "phrase":
        hits = _phrase_hits(index, queries, column)
        n_with = hits.groupBy("repo_id", "query_id").agg(F.count("*").alias("n_with"))
        weights = n_with.join(index.corpus, "repo_id").withColumn(
            "idf", idf(F.col("n_docs"), F.col("n_with"))
        )
        scored = hits.join(
            weights.select("repo_id", "query_id", "idf", "avg_length").hint("merge"),
            ["repo_id", "query_id"],
        ).select(
            "repo_id",
            "query_id",
            "doc_id",
            (F.col("idf") * term_score(F.col("tf"), F.col("length"), F.col("avg_length")))
            .cast(EXACT)
            .alias("score"),
        )
    else:
        wanted = stored(query_terms(queries))
        hint = side_hint(wanted)
        find = _slots_prefix if mode == "prefix" else _slots_all
        hits = find(index, wanted, column)
        if mode == "prefix" or column is not None or index.whole is None:
            # read several times below; the texts are gone through once
            hits = stored(hits)
        n_with = hits.groupBy("repo_id", "slot").agg(F.count("*").alias("n_with"))
        # everything that hangs on the word alone is joined to the short side
        weighted = (
            wanted.join(n_with, ["repo_id", "slot"])
            .join(index.corpus, "repo_id")
            .select(
                "repo_id",
                "query_id",
                "n_terms",
                "slot",
                "n_with",
                "avg_length",
                idf(F.col("n_docs"), F.col("n_with")).alias("idf"),
            )
        )
        part = F.col("idf") * term_score(F.col("tf"), F.col("length"), F.col("avg_length"))
        if mode == "any":
            return _sum_of_any(hits, index, queries, weighted, hint, part, column)
        met = _with_every_word(hits, weighted, hint)
        scored = met.groupBy("repo_id", "query_id", "doc_id", "n_terms").agg(
            F.sum(part.cast(EXACT)).alias("score"), F.count("*").alias("n_found")
        )
        scored = scored.filter(F.col("n_found") == F.col("n_terms"))
        scored = scored.select("repo_id", "query_id", "doc_id", "score")
    if "not_text" in queries.columns:
        banned = _unwanted(index, queries).select("repo_id", "query_id", "doc_id")
        scored = scored.join(banned, ["repo_id", "query_id", "doc_id"], "left_anti")
    return scored


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` docs per query; each task first cuts its own rows down to ``k``."""
    window = Window.partitionBy("repo_id", "query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def shown(ranked: DataFrame) -> DataFrame:
    """Ranked docs with a score to read, of six digits."""
    return ranked.withColumn("score", F.round(F.col("score").cast("double"), 6))


def rank_bm25(
    index: Index,
    queries: DataFrame,
    k: int = SEARCH_LIMIT,
    mode: str = "all",
    column: str | None = None,
) -> DataFrame:
    """The ``k`` best docs of each query."""
    return shown(top_k(score_bm25(index, queries, mode, column), k))


def match_like(
    docs: DataFrame, text_cols: list[str], queries: DataFrame, doc_id: str = "doc_id"
) -> DataFrame:
    """``(repo_id, query_id, doc_id)`` where a field holds the query text, ignoring case.

    ``%`` and ``_`` in a query stand for themselves.
    """
    texts = F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in text_cols])
    fields = exploded(docs, texts, "repo_id", F.col(doc_id).alias("doc_id"), value="hay")
    needles = queries.select("repo_id", "query_id", F.lower("text").alias("needle"))
    return substring_pairs(fields, needles, "hay", "needle", ["repo_id"]).select(
        "repo_id", "query_id", "doc_id"
    ).distinct()


def search_like(
    docs: DataFrame,
    text_cols: list[str],
    queries: DataFrame,
    k: int = SEARCH_LIMIT,
    doc_id: str = "doc_id",
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Substring search for the queries that ``ranked`` has no hit for."""
    if ranked is not None:
        queries = queries.join(
            ranked.select("repo_id", "query_id").distinct(), ["repo_id", "query_id"], "left_anti"
        )
    found = match_like(docs, text_cols, queries, doc_id)
    return top_k(found.withColumn("score", F.lit(0.0)), k)


def search_tables(
    catalog: dict[str, DataFrame],
    queries: DataFrame,
    domain: str | None = None,
    k: int = SEARCH_LIMIT,
    store: bool = False,
    index: Index | None = None,
) -> DataFrame:
    """Tables for each query, ranked; by substring where ranking finds none.

    ``domain`` narrows the tables before the best ``k`` are taken. ``index`` is one that is kept; without
    it the tables' texts are indexed for this call.
    """
    tables = catalog["tables"]
    facts = tables.select(
        "repo_id",
        F.col("name").alias("doc_id"),
        "purpose",
        "domain",
        "soft_delete_column",
        "dimension_fields",
    )
    if domain is not None:
        facts = facts.filter(F.col("domain") == domain)
    index = index or build_index(tables, ["name", "purpose", "domain"], "name", store)
    scored = score_bm25(index, queries)
    if domain is not None:
        scored = scored.join(facts.select(*DOC), DOC, "left_semi")
    ranked = stored(shown(top_k(scored, k)).withColumn("found_by", F.lit("rank")))
    allowed = tables if domain is None else tables.filter(F.col("domain") == domain)
    fallback = search_like(allowed, ["name", "purpose"], queries, k, "name", ranked).withColumn(
        "found_by", F.lit("substring")
    )
    return ranked.unionByName(fallback).join(facts, DOC).withColumnRenamed("doc_id", "table_name")


def search_columns(
    catalog: dict[str, DataFrame], queries: DataFrame, k: int = SEARCH_LIMIT, index: Index | None = None
) -> DataFrame:
    """Columns for each query by name, comment and type; ``index`` is one that is kept."""
    columns = catalog["columns"].withColumn(
        "doc_id", F.concat_ws(".", "table_name", "name")
    )
    index = index or build_index(columns, ["name", "comment", "type"])
    return rank_bm25(index, queries, k).withColumnRenamed("doc_id", "column_name")


def search_enums(
    catalog: dict[str, DataFrame], queries: DataFrame, k: int = SEARCH_LIMIT, index: Index | None = None
) -> DataFrame:
    """Enums for each query by short name and class; ``index`` is one that is kept."""
    index = index or build_index(catalog["enums"], ["short_name", "enum_class"], "enum_class")
    return rank_bm25(index, queries, k).withColumnRenamed("doc_id", "enum_class")
