"""A kept full-text index: built once, added to, and only read when asked.

Below its folder lie

* ``postings/gen=G/bucket=B``: one row per doc and word, with its spots in the fields; a word's bucket is a hash
* ``docs/gen=G``: the length of every doc; ``dropped/gen=G``: docs whose older rows no longer count
* ``words/gen=G``: distinct words in order, for searches by prefix
* ``versions/N``: which generations make up version N of the index, and its settings

Every change writes a generation of its own and then, last, a version that names it. Readers take the newest
version and stay with the generations it names, so they never see half a change; what a killed write left
behind is named by no version. A doc that is added again, or removed, hides its rows of older generations.
Ranking reads the buckets of the queries' words and nothing else of the postings.

Neither texts nor postings are shuffled. The task that cuts a doc's text writes all its postings, one doc after the
other, so what they repeat costs next to nothing; the docs of one task are a segment, numbered in it. Which docs of
a segment still count is one row of booleans, looked up by the doc's number.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semcat.config import SEARCH_LIMIT
from semcat.functions.rows import computed_once, exploded
from semcat.functions.text import tokenize
from semcat.operators import search
from semcat.plans.lineage import side_hint, sized, stored
from semcat.sources import versions

BUCKETS = 64
# generations that are read together before they are merged into one
GENERATIONS = 8
# what the folders hold; an index of another layout is not read
LAYOUT = 2

# bytes of texts: tasks that would write less are joined, and one that would write more is no reason for others
LEAST_TEXT, MOST_TEXT = 8 << 20, 64 << 20

DOC = ["repo_id", "doc_id"]
DOCS = "repo_id string, doc_id {id}, length int, seg bigint, ord int"
# a spot is place * number of fields + number of the field
POSTINGS = DOCS + ", term string, tf bigint, spots array<int>"
# the folder of the docs' own rows beside the words' buckets
OWN_ROWS = -1


@dataclass(frozen=True)
class KeptIndex:
    """One version of an index; ``generations`` are oldest first."""

    path: str
    fields: tuple[str, ...]
    id_type: str
    n_buckets: int
    version: int
    generations: tuple[str, ...]

    def table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """A table's rows in all generations, with the generation's number in ``age``."""
        parts = [
            spark.read.schema(schema).parquet(f"{self.path}/{name}/gen={gen}").withColumn("age", F.lit(age))
            for age, gen in enumerate(self.generations)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


# ----------------------------------------------------------------- the versions


def _publish(spark: SparkSession, index: KeptIndex) -> KeptIndex:
    """Write the version after ``index.version``; two writers of one version: the second one fails."""
    made = replace(index, version=index.version + 1)
    content = {"layout": LAYOUT, "fields": made.fields, "id_type": made.id_type, "n_buckets": made.n_buckets, "generations": made.generations}
    versions.publish(spark, made.path, made.version, content)
    return made


def open_index(spark: SparkSession, path: str, version: int | None = None) -> KeptIndex:
    """The newest version of the index, or the one asked for."""
    known = versions.known(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no such index: {path}, version {version or 'any'}")
    number = known[-1] if version is None else version
    held = versions.read(spark, path, number)
    if held.get("layout") != LAYOUT:
        raise ValueError(f"{path} was written in another layout: create it anew")
    return KeptIndex(path, tuple(held["fields"]), held["id_type"], held["n_buckets"], number, tuple(held["generations"]))


def create_index(
    docs: DataFrame, path: str, text_cols: list[str], doc_id: str = "doc_id", n_buckets: int = BUCKETS
) -> KeptIndex:
    """A new index of ``docs`` ``(repo_id, <doc_id>, ...)``; its folder must not hold one."""
    if versions.known(docs.sparkSession, path):
        raise FileExistsError(f"{path} holds an index: add to it")
    kind = docs.schema[doc_id].dataType.simpleString()
    return add_docs(KeptIndex(path, tuple(text_cols), kind, n_buckets, 0, ()), docs, doc_id)


# ------------------------------------------------------------------- the changes


def _bucket(index: KeptIndex) -> Column:
    return F.pmod(F.xxhash64("repo_id", "term"), F.lit(index.n_buckets)).cast("int")


def _write_postings(index: KeptIndex, rows: DataFrame, gen: str) -> None:
    """Postings, docs and words of a generation; ``rows`` without a word are the docs' own."""
    spark, folder = rows.sparkSession, f"{index.path}/postings/gen={gen}"
    bucket = F.when(F.col("term").isNull(), F.lit(OWN_ROWS)).otherwise(_bucket(index))
    rows.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(folder)
    written = spark.read.schema(f"{_postings_schema(index)}, bucket int").parquet(folder)
    docs = written.filter(F.col("bucket") == OWN_ROWS)
    docs.select(*DOC, "length", "seg", "ord").write.parquet(f"{index.path}/docs/gen={gen}")
    kept = written.filter(F.col("bucket") != OWN_ROWS).select("repo_id", "term").distinct()
    kept.repartitionByRange("repo_id", "term").sortWithinPartitions("repo_id", "term").write.parquet(f"{index.path}/words/gen={gen}")


def _grouped(*lists: Column | str) -> Column:
    """Distinct words of lists with their places, in time that follows sorting the lists.

    With more than one list a place is the place in the list times their number, plus the list's number.
    """
    once = lambda column, body: F.flatten(F.transform(F.array(column), body))

    def numbered(terms: Column | str, n: int) -> Column:
        return F.transform(terms, lambda t, i: F.struct(t.alias("term"), (i * len(lists) + n).cast("int").alias("pos")))

    placed = F.sort_array(F.concat(*[numbered(terms, n) for n, terms in enumerate(lists)]))

    def cut(words: Column) -> Column:
        n = F.size(words)
        # where a word differs from the one before it, and the end
        borders = F.filter(
            F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(words, i)["term"] != F.get(words, i - 1)["term"])
        )
        return once(borders, lambda at: F.transform(
            F.slice(at, F.lit(1), F.size(at) - 1),
            lambda start, i: F.struct(
                F.get(words, start)["term"].alias("term"),
                F.transform(F.slice(words, start + 1, F.get(at, i + 1) - start), lambda w: w["pos"]).alias("places"),
            ),
        ))

    return once(placed, cut)


def _distinct_docs(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per doc, of those that share an id the one of the greatest texts, in tasks of a fit size.

    Only ids are shuffled to find the ids that come twice, and only the texts of these.
    """
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in fields), F.lit(0)).cast("bigint")
    ids = stored(
        rows.select(*DOC, size.alias("size"), F.spark_partition_id().alias("part"))
        .groupBy(*DOC)
        .agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("part").alias("part"))
    )
    several = ids.filter("n > 1").select(*DOC)
    best = rows
    if not several.isEmpty():
        several = sized(several)
        best = rows.join(several, DOC, "left_semi").groupBy(*DOC).agg(F.max(F.struct(*fields)).alias("texts"))
        best = rows.join(several, DOC, "left_anti").unionByName(best.select(*DOC, "texts.*"))
    parts = ids.groupBy("part").agg(F.sum("size").alias("size"))
    n_parts, most, total = parts.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // LEAST_TEXT + 1)
    n_tasks = max(n_tasks, total // MOST_TEXT + 1)
    if most > MOST_TEXT and most > 8 * (total // n_tasks):
        # a few tasks would cut nearly all texts
        return best.repartition(n_tasks, *DOC)
    return best.coalesce(n_tasks) if n_parts > 4 * n_tasks else best


def add_docs(index: KeptIndex, docs: DataFrame, doc_id: str = "doc_id") -> KeptIndex:
    """The index with these docs; docs that it has already are replaced.

    A null text has no words, and a doc without words counts for the average length alone. Rows with a null
    repo or id are left out; of rows that share an id the one of the greatest texts counts.
    """
    texts = [F.col(c).cast("string").alias(c) for c in index.fields]
    rows = docs.select("repo_id", F.col(doc_id).alias("doc_id"), *texts).dropna(subset=DOC)
    lists = F.array(*[tokenize(F.col(c)) for c in index.fields])
    words = computed_once(_distinct_docs(rows, index.fields).select(*DOC, lists.alias("lists")), "lists")
    # numbers that no other published generation has, as no other has its version
    seg = F.lit((index.version + 1) << 32) + F.spark_partition_id()
    own = F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("array<int>").alias("places"))
    grouped = _grouped(*[F.col("lists")[n] for n in range(len(index.fields))])
    numbered = words.select(
        *DOC,
        F.aggregate("lists", F.lit(0), lambda n, terms: n + F.size(terms)).alias("length"),
        seg.alias("seg"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("ord"),
        F.concat(F.array(own), grouped).alias("terms"),
    )
    # a doc's words are counted in its own row: no occurrence is shuffled
    postings = exploded(numbered, "terms", *DOC, "length", "seg", "ord", value="t").select(
        *DOC, "length", "seg", "ord", "t.term", F.size("t.places").cast("bigint").alias("tf"), F.col("t.places").alias("spots")
    )
    gen = uuid.uuid4().hex[:12]
    _write_postings(index, postings, gen)
    spark = docs.sparkSession
    written = spark.read.schema(_docs_schema(index)).parquet(f"{index.path}/docs/gen={gen}")
    written.select(*DOC).write.parquet(f"{index.path}/dropped/gen={gen}")
    return _grown(index, spark, gen)


def remove_docs(index: KeptIndex, docs: DataFrame, doc_id: str = "doc_id") -> KeptIndex:
    """The index without these docs ``(repo_id, <doc_id>)``; those it does not have are no fault."""
    gone = docs.select("repo_id", F.col(doc_id).cast(index.id_type).alias("doc_id")).dropna().distinct()
    spark, gen = docs.sparkSession, uuid.uuid4().hex[:12]
    gone.write.parquet(f"{index.path}/dropped/gen={gen}")
    none = spark.createDataFrame([], f"{_postings_schema(index)}, bucket int")
    none.drop("bucket").write.parquet(f"{index.path}/postings/gen={gen}")
    none.select("repo_id", "term").write.parquet(f"{index.path}/words/gen={gen}")
    none.select(*DOC, "length", "seg", "ord").write.parquet(f"{index.path}/docs/gen={gen}")
    return _grown(index, spark, gen)


def remove_repo(index: KeptIndex, spark: SparkSession, repo_id: str) -> KeptIndex:
    """The index without one repo."""
    return remove_docs(index, live_docs(index, spark).filter(F.col("repo_id") == repo_id))


def _grown(index: KeptIndex, spark: SparkSession, gen: str) -> KeptIndex:
    made = _publish(spark, replace(index, generations=(*index.generations, gen)))
    return merge(made, spark) if len(made.generations) > GENERATIONS else made


def merge(index: KeptIndex, spark: SparkSession) -> KeptIndex:
    """The same index in one generation, without what no longer counts."""
    gen = uuid.uuid4().hex[:12]
    own = _marked(index, spark).filter("live").drop("live")
    _write_postings(index, live_postings(index, spark).unionByName(own, allowMissingColumns=True), gen)
    spark.createDataFrame([], f"repo_id string, doc_id {index.id_type}").write.parquet(f"{index.path}/dropped/gen={gen}")
    return _publish(spark, replace(index, generations=(gen,)))


def sweep(spark: SparkSession, path: str, keep_versions: int = 1) -> list[str]:
    """Delete generations that none of the newest versions names, and older versions; returns the generations.

    Readers of older versions, and writers that are not done, must be gone.
    """
    known = versions.known(spark, path)
    named = {g for n in known[-keep_versions:] for g in open_index(spark, path, n).generations}
    gone = set()
    for table in ("postings", "docs", "dropped", "words"):
        for folder in versions.folders(spark, f"{path}/{table}"):
            if folder.removeprefix("gen=") not in named:
                gone.add(folder.removeprefix("gen="))
                versions.delete(spark, f"{path}/{table}/{folder}")
    versions.forget(spark, path, keep_versions)
    return sorted(gone)


# -------------------------------------------------------------------- the reading


def _postings_schema(index: KeptIndex) -> str:
    return POSTINGS.format(id=index.id_type)


def _docs_schema(index: KeptIndex) -> str:
    return DOCS.format(id=index.id_type)


def _marked(index: KeptIndex, spark: SparkSession) -> DataFrame:
    """Every doc's row in every generation, ``live`` if no younger generation drops it."""
    docs = index.table(spark, "docs", _docs_schema(index))
    if len(index.generations) == 1:
        return docs.drop("age").withColumn("live", F.lit(True))
    dropped = index.table(spark, "dropped", f"repo_id string, doc_id {index.id_type}")
    last = dropped.filter("age > 0").groupBy(*DOC).agg(F.max("age").alias("_dropped"))
    live = F.expr("_dropped is null or age >= _dropped")
    return docs.join(sized(last), DOC, "left").withColumn("live", live).drop("age", "_dropped")


def live_docs(index: KeptIndex, spark: SparkSession) -> DataFrame:
    """``(repo_id, doc_id, length)`` of every doc of the index."""
    return _marked(index, spark).filter("live").select(*DOC, "length")


def _segments(docs: DataFrame) -> DataFrame:
    """``(seg, live)``: for each segment with docs that no longer count, which docs do, by their numbers."""
    found = (
        docs.groupBy("seg")
        .agg(F.min("live").alias("all"), F.collect_list(F.struct("ord", "live")).alias("docs"))
        .filter(~F.col("all"))
        .select("seg", F.sort_array("docs").alias("docs"))
    )

    def upto(doc: Column, i: Column) -> Column:
        # numbers that no doc has, as a merge left it out, are filled up
        before = F.coalesce(F.get("docs", i - 1)["ord"], F.lit(-1))
        return F.array_append(F.array_repeat(F.lit(False), doc["ord"] - before - 1), doc["live"])

    return found.select("seg", F.flatten(F.transform("docs", upto)).alias("live"))


def _postings(index: KeptIndex, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
    """The postings of some buckets or all, those that count no longer too."""
    rows = index.table(spark, "postings", f"{_postings_schema(index)}, bucket int")
    if buckets is None:
        rows = rows.filter(F.col("bucket") != OWN_ROWS)
    else:
        rows = rows.filter(F.col("bucket").isin(buckets)) if buckets else rows.filter("false")
    return rows.drop("bucket", "age")


def _counting(rows: DataFrame, index: KeptIndex, docs: DataFrame) -> DataFrame:
    """Those postings whose docs count, given the marked docs."""
    if len(index.generations) == 1:
        return rows
    met = rows.join(sized(_segments(docs)), "seg", "left")
    return met.filter(F.coalesce(F.get("live", F.col("ord")), F.lit(True))).drop("live")


def live_postings(index: KeptIndex, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
    """The postings that count, of some buckets or all; buckets are folders, others are not opened."""
    return _counting(_postings(index, spark, buckets), index, _marked(index, spark))


def _asked_words(index: KeptIndex, queries: DataFrame, mode: str) -> DataFrame:
    """``(repo_id, term)``: the words that queries ask for."""
    texts = [c for c in ("text", "not_text") if c in queries.columns]
    asked = [search.query_terms(queries, c).select("repo_id", "slot", F.lit(c).alias("of")) for c in texts]
    words = asked[0].unionByName(asked[1]) if len(asked) > 1 else asked[0]
    whole = words.filter("of = 'not_text'") if mode == "prefix" else words
    terms = whole.select("repo_id", F.col("slot").alias("term"))
    if mode == "prefix":
        known = index.table(queries.sparkSession, "words", "repo_id string, term string").select("repo_id", "term").distinct()
        starts = F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substr("term", F.lit(1), n))
        expanded = exploded(known, starts, "repo_id", "term", value="slot")
        prefixes = words.filter("of = 'text'").select("repo_id", "slot").distinct()
        terms = terms.unionByName(expanded.join(sized(prefixes), ["repo_id", "slot"], "left_semi").select("repo_id", "term"))
    return terms.distinct()


def _occurrences(postings: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per place of a word, from its spots."""
    spots = exploded(postings, "spots", *DOC, "length", "term", value="spot")
    field = F.get(F.array(*map(F.lit, fields)), F.col("spot") % len(fields))
    return spots.select(*DOC, "length", field.alias("field"), "term", F.expr(f"int(spot div {len(fields)})").alias("pos"))


def _by_field(postings: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per doc, field and word, counted from its spots."""

    def within(n: int, field: str) -> Column:
        spots = F.filter("spots", lambda s: s % len(fields) == n)
        return F.struct(F.lit(field).alias("field"), F.size(spots).cast("bigint").alias("tf"))

    counts = F.array(*[within(n, field) for n, field in enumerate(fields)])
    rows = exploded(postings, counts, *DOC, "length", "term", value="f")
    return rows.filter("f.tf > 0").select(*DOC, "length", "f.field", "term", "f.tf")


def index_for(
    index: KeptIndex, queries: DataFrame, mode: str = "all", column: str | None = None
) -> search.Index:
    """What ranking ``queries`` needs of the index: the postings of their words, and the corpus statistics."""
    spark = queries.sparkSession
    words = stored(_asked_words(index, queries, mode))
    buckets = sorted(r.b for r in words.select(_bucket(index).alias("b")).distinct().collect())  # n_buckets at most
    docs = stored(_marked(index, spark))
    found = _postings(index, spark, buckets).join(words.hint(side_hint(words)), ["repo_id", "term"], "left_semi")
    found = _counting(found, index, docs).select(*DOC, "length", "term", "tf", "spots")
    # read several times while ranking, and short beside the index; spots, which are most of it, only where they are looked at
    placed = mode in ("prefix", "phrase") or column is not None
    whole = stored(found if placed else found.drop("spots"))
    spots = whole if placed else found
    docs = docs.filter("live").select(*DOC, "length")
    corpus = stored(docs.groupBy("repo_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length")))
    terms = whole.groupBy("repo_id", "term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_total"))
    return search.Index(
        _occurrences(spots, index.fields), _by_field(spots, index.fields), docs, terms, corpus, index.fields, whole.drop("spots")
    )


def rank(
    index: KeptIndex, queries: DataFrame, k: int = SEARCH_LIMIT, mode: str = "all", column: str | None = None
) -> DataFrame:
    """The ``k`` best docs of each query, as :func:`semcat.operators.search.rank_bm25` gives them."""
    return search.rank_bm25(index_for(index, queries, mode, column), queries, k, mode, column)


# --------------------------------------------------------------- catalogs by search

# catalog table: its texts and its key
CATALOG = {
    "tables": (["name", "purpose", "domain"], "name"),
    "columns": (["name", "comment", "type"], "column_id"),
    "enums": (["short_name", "enum_class"], "enum_class"),
}


def keep_catalog(catalog: dict[str, DataFrame], path: str) -> dict[str, KeptIndex]:
    """Indexes of a catalog's tables, columns and enums below ``path``; repos that are there are replaced."""
    made = {}
    for name, (texts, key) in CATALOG.items():
        rows = catalog[name]
        spark = rows.sparkSession
        if name == "columns":
            rows = rows.withColumn(key, F.concat_ws(".", "table_name", "name"))
        if not versions.known(spark, f"{path}/{name}"):
            made[name] = create_index(rows, f"{path}/{name}", texts, key)
            continue
        kept = open_index(spark, f"{path}/{name}")
        repos = rows.select("repo_id").distinct()
        old = live_docs(kept, spark).join(sized(repos), "repo_id", "left_semi")
        stale = old.join(rows.select("repo_id", F.col(key).alias("doc_id")), DOC, "left_anti")
        made[name] = add_docs(remove_docs(kept, stale), rows, key)
    return made


def open_catalog(spark: SparkSession, path: str) -> dict[str, KeptIndex]:
    """The indexes that :func:`keep_catalog` wrote, each in its newest version."""
    return {name: open_index(spark, f"{path}/{name}") for name in CATALOG}
