"""One query per operator, over inputs made from the given tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semcat.config import BASE_ENTITY_COLUMNS, DEFAULTS
from semcat.functions.rows import exploded
from semcat.functions.text import camel_to_snake, decode_escapes, normalize_type, parse_int_list, tokenize
from semcat.operators import compare, entities, enums, grounding, lookup, routing, search, semantics
from semcat.plans import build
from semcat.plans.lineage import shared_folder, stored
from semcat.sources import catalog_store, files as source_files, index_store
from workloads import corpus as C

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def joined(col: str | Column) -> Column:
    """A list as text; ``''`` when there is none."""
    values = F.transform(col, lambda x: x.cast("string"))
    return F.coalesce(F.array_join(values, ","), F.lit(""))


def part_files(spark, sf_dir) -> DataFrame:
    return C.entity_sources(C.load(spark, sf_dir, "part"))


def enum_source(spark, sf_dir) -> DataFrame:
    return C.enum_sources(C.load(spark, sf_dir, "customer"))


def message_files(spark, sf_dir) -> DataFrame:
    return C.bundle_sources(C.load(spark, sf_dir, "customer"))


def catalog(spark, sf_dir, **kw) -> dict[str, DataFrame]:
    return build.build_catalog(C.source_tree(spark, sf_dir), **kw)


def bound_catalog(spark, sf_dir, *names: str) -> dict[str, DataFrame]:
    """The whole catalog, or the tables of it that are named; no others are built."""
    part = C.load(spark, sf_dir, "part")
    built = catalog(
        spark, sf_dir, curated_bindings=C.bindings(part), table_meta=C.notes(part), store=True, names=names or None
    )
    # the bindings are stored already
    return build.store_catalog(built, "tables", "columns", "enum_values")


# what checks of statements look at: names alone, or codes and their meanings too
NAMES = ("tables", "columns")
CODES = (*NAMES, "enums", "enum_values", "bindings")


def log(spark, sf_dir) -> DataFrame:
    return C.query_log(C.load(spark, sf_dir, "events"))


# ------------------------------------------------------------------- sources


@query
def q_read_source_files(spark, sf_dir):
    docs = C.load(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    one_line = F.regexp_replace("text", F.lit(r"\R"), F.lit(" "))
    docs.select("source", one_line.alias("value")).write.partitionBy("source").text(folder)
    read = source_files.read_source_files(spark, folder, "docs", "*.txt")
    lines = read.select(
        "repo_id",
        F.regexp_extract("path", "^source=([^/]+)/", 1).alias("source"),
        F.explode(F.split(F.rtrim("src", F.lit("\n")), "\n")).alias("line"),
    )
    return lines.groupBy("repo_id", "source").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


@query
def q_entity_files(spark, sf_dir):
    return routing.entity_files(part_files(spark, sf_dir)).select("path")


@query
def q_enum_files(spark, sf_dir):
    return routing.enum_files(enum_source(spark, sf_dir)).select("path")


@query
def q_bundle_files(spark, sf_dir):
    return routing.bundle_files(message_files(spark, sf_dir)).select("path")


@query
def q_route_files(spark, sf_dir):
    tree = C.source_tree(spark, sf_dir)
    routed = routing.route_files(tree)
    return routed.groupBy("rule_id").agg(F.count("*").alias("n_files"))


@query
def q_route_files_one_rule(spark, sf_dir):
    tree = C.source_tree(spark, sf_dir)
    return routing.route_files(tree, only=DEFAULTS.rule_id).select("path", "rule_id")


def nation_domains(nation: DataFrame) -> DataFrame:
    """One prefix per nation, and a shorter one for all of them."""
    rows = F.array(
        F.struct(
            F.concat(F.lit("pcl_part_"), F.col("n_nationkey").cast("string")).alias("prefix"),
            F.col("n_name").alias("domain"),
        ),
        F.struct(F.lit("pcl_").alias("prefix"), F.lit("short").alias("domain")),
    )
    return nation.select(F.explode(rows).alias("r")).select("r.*").distinct()


@query
def q_read_domain_map(spark, sf_dir):
    """Tables under a domain map kept in a JSON file (one entry per nation, a fixed number)."""
    folder = shared_folder(spark)
    entries = F.map_from_entries(F.collect_list(F.struct("prefix", "domain")))
    nation_domains(C.load(spark, sf_dir, "nation")).agg(F.to_json(entries)).write.text(folder)
    domain_map = source_files.read_domain_map(spark, folder)
    tables = entities.extract_tables(part_files(spark, sf_dir))
    return semantics.assign_domain(tables, domain_map, "none").select("name", "source_file", "domain")


@query
def q_write_catalog(spark, sf_dir):
    folder = shared_folder(spark)
    built = catalog(spark, sf_dir, store=True)
    catalog_store.write_catalog(built, folder)
    # the second write replaces the first
    catalog_store.write_catalog(catalog_store.read_catalog(spark, folder), folder + "-again")
    catalog_store.write_catalog(built, folder + "-again")
    stored = catalog_store.read_catalog(spark, folder + "-again", C.REPO)
    return count_tables(stored, ("tables", "columns", "enums", "enum_values", "relations", "i18n_keys"))


def count_tables(stored: dict[str, DataFrame], names) -> DataFrame:
    parts = [
        stored[n].groupBy("repo_id").agg(F.count("*").alias("n_rows")).select(
            F.lit(n).alias("catalog_table"), "repo_id", "n_rows"
        )
        for n in names
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def two_repos(spark, sf_dir) -> DataFrame:
    """The entities under two repo names; the fork lacks some and words others differently."""
    part = C.load(spark, sf_dir, "part")
    changed = part.filter("p_partkey % 11 != 0").withColumn(
        "p_name", F.when(F.col("p_partkey") % 13 == 0, F.lit("renamed")).otherwise(F.col("p_name"))
    )
    return C.entity_sources(part).unionByName(C.entity_sources(changed, C.FORK))


def two_repo_catalog(spark, sf_dir) -> dict[str, DataFrame]:
    kept = semantics.dedupe_entities(
        build.annotate_entities(entities.parse_entities(two_repos(spark, sf_dir)))
    )
    kept = stored(kept)
    return {
        "tables": build.tables_of(kept),
        "columns": entities.explode_columns(kept).drop("source_file"),
    }


@query
def q_remove_repo(spark, sf_dir):
    left = catalog_store.remove_repo(two_repo_catalog(spark, sf_dir), C.FORK)
    return count_tables(left, ("tables", "columns"))


@query
def q_read_catalog(spark, sf_dir):
    folder = shared_folder(spark)
    both = two_repo_catalog(spark, sf_dir)
    both["columns"] = both["columns"].withColumn("enum_class", F.lit(None).cast("string"))
    catalog_store.write_catalog(both, folder)
    fork = catalog_store.read_catalog(spark, folder, C.FORK)
    return fork["tables"].select("repo_id", "name", "purpose", joined("dimension_fields").alias("dims"))


# ---------------------------------------------------------------- extraction


@query
def q_extract_tables(spark, sf_dir):
    return entities.extract_tables(part_files(spark, sf_dir))


@query
def q_table_purpose(spark, sf_dir):
    return entities.extract_tables(part_files(spark, sf_dir)).select("source_file", "purpose")


@query
def q_entity_class(spark, sf_dir):
    return entities.extract_tables(part_files(spark, sf_dir)).select("source_file", "entity_class")


@query
def q_extends_base(spark, sf_dir):
    tables = entities.extract_tables(part_files(spark, sf_dir))
    return tables.groupBy("extends_base").agg(F.count("*").alias("n_tables"))


@query
def q_source_file(spark, sf_dir):
    moved = part_files(spark, sf_dir).withColumn("path", F.concat(F.lit("/data/repo/"), "path"))
    found = entities.extract_tables(moved, root=F.lit("/data/repo"))
    return found.select("name", "source_file")


@query
def q_extract_declared_columns(spark, sf_dir):
    found = entities.extract_declared_columns(part_files(spark, sf_dir))
    return found.select("source_file", "table_name", "name", "java_field", "type_raw")


@query
def q_attach_preceding_comment(spark, sf_dir):
    found = entities.attach_preceding_comment(part_files(spark, sf_dir))
    return found.select("source_file", "name", "comment")


@query
def q_attach_preceding_comment_compat(spark, sf_dir):
    found = entities.attach_preceding_comment(
        part_files(spark, sf_dir), DEFAULTS.with_(compat=True)
    )
    return found.select("source_file", "name", "comment")


@query
def q_extract_inferred_columns(spark, sf_dir):
    found = entities.extract_inferred_columns(part_files(spark, sf_dir))
    return found.select("table_name", "name", "java_field", "type_raw", "comment")


@query
def q_camel_to_snake(spark, sf_dir):
    customer = C.load(spark, sf_dir, "customer")
    made = F.concat(F.initcap("c_mktsegment"), F.lit("HTTPKey"), F.col("c_nationkey").cast("string"), F.lit("Id"))
    return customer.select("c_custkey", camel_to_snake(made).alias("snake"))


@query
def q_normalize_type(spark, sf_dir):
    found = entities.extract_columns(part_files(spark, sf_dir))
    return found.groupBy("type_raw", normalize_type(F.col("type_raw")).alias("type")).agg(
        F.count("*").alias("n_columns")
    )


@query
def q_mark_primary_keys(spark, sf_dir):
    found = entities.mark_primary_keys(part_files(spark, sf_dir))
    return found.select("table_name", "name", "is_pk", "is_nullable")


@query
def q_merge_base_columns(spark, sf_dir):
    found = entities.merge_base_columns(part_files(spark, sf_dir))
    return found.select("table_name", "name", "java_field", "type", "is_pk", "is_nullable", "comment")


@query
def q_number_columns(spark, sf_dir):
    found = entities.number_columns(part_files(spark, sf_dir))
    return found.select("source_file", "name", "ordinal")


@query
def q_extract_enums(spark, sf_dir):
    return enums.extract_enums(enum_source(spark, sf_dir))


@query
def q_classify_paradigm(spark, sf_dir):
    found = enums.classify_paradigm(enum_source(spark, sf_dir))
    return found.groupBy("paradigm").agg(F.count("*").alias("n_enums"))


@query
def q_extract_simple_values(spark, sf_dir):
    return enums.extract_simple_values(enum_source(spark, sf_dir))


@query
def q_extract_tenant_values(spark, sf_dir):
    found = enums.extract_tenant_values(enum_source(spark, sf_dir))
    return found.withColumn("aggregators", joined("aggregators"))


@query
def q_parse_int_list(spark, sf_dir):
    customer = C.load(spark, sf_dir, "customer")
    text = F.concat_ws(" , ", "c_custkey", "c_mktsegment", "c_nationkey", F.lit("-3"))
    return customer.select("c_custkey", joined(parse_int_list(text)).alias("numbers"))


@query
def q_parse_bundles(spark, sf_dir):
    found = enums.parse_bundles(message_files(spark, sf_dir))
    return found.select("bundle_file", "line_no", "key", "raw")


@query
def q_decode_escapes(spark, sf_dir):
    found = enums.parse_bundles(C.document_bundles(C.load(spark, sf_dir, "documents")))
    return found.select("key", decode_escapes(F.col("raw")).alias("value"))


@query
def q_latest_key(spark, sf_dir):
    return enums.latest_key(enums.parse_bundles(message_files(spark, sf_dir)))


@query
def q_attach_messages(spark, sf_dir):
    keys = enums.latest_key(enums.parse_bundles(message_files(spark, sf_dir)))
    values = enums.explode_values(enums.parse_enums(enum_source(spark, sf_dir)))
    found = enums.attach_messages(values, keys)
    return found.select("enum_class", "name", "code", "message_key", "meaning")


@query
def q_rejects(spark, sf_dir):
    return build.rejects(C.source_tree(spark, sf_dir)).select("source_file", "reason")


# ----------------------------------------------------------------- semantics


@query
def q_detect_soft_delete(spark, sf_dir):
    return semantics.detect_soft_delete(entities.extract_columns(part_files(spark, sf_dir)))


@query
def q_detect_dimensions(spark, sf_dir):
    found = semantics.detect_dimensions(entities.extract_columns(part_files(spark, sf_dir)))
    return found.select("table_name", joined("dimension_fields").alias("dims"))


@query
def q_assign_domain(spark, sf_dir):
    tables = entities.extract_tables(part_files(spark, sf_dir))
    found = semantics.assign_domain(tables, DEFAULTS.domain_map, DEFAULTS.default_domain)
    return found.select("source_file", "name", "domain")


@query
def q_assign_domain_by_join(spark, sf_dir):
    """The map is a table and is joined."""
    tables = entities.extract_tables(part_files(spark, sf_dir))
    domain_map = nation_domains(C.load(spark, sf_dir, "nation"))
    return semantics.assign_domain(tables, domain_map, "none").select("source_file", "domain")


@query
def q_flag_default_meaning(spark, sf_dir):
    values = enums.explode_values(enums.parse_enums(enum_source(spark, sf_dir)))
    found = enums.flag_default_meaning(values)
    return found.select(
        "enum_class", "name", "is_default", F.coalesce("warning", F.lit("")).alias("warning")
    )


@query
def q_dedupe_tables(spark, sf_dir):
    files = part_files(spark, sf_dir)
    tables, columns = semantics.dedupe_tables(
        entities.extract_tables(files), entities.extract_columns(files)
    )
    counts = columns.groupBy("table_name").agg(F.count("*").alias("n_columns"))
    return tables.select(F.col("name").alias("table_name"), "source_file").join(counts, "table_name")


@query
def q_dedupe_enums(spark, sf_dir):
    kept = semantics.dedupe_enums(enums.with_values(enums.parse_enums(enum_source(spark, sf_dir))))
    return kept.select("enum_class", "paradigm", "source_file", F.size("values").alias("n_values"))


@query
def q_bind_enums(spark, sf_dir):
    """Curated bindings for some tables; other names are matched to enums."""
    files = part_files(spark, sf_dir)
    columns = entities.extract_columns(files)
    supplier = C.load(spark, sf_dir, "supplier")
    # classes named like a table's last word and the column: "7status" fits pcl_part_7
    named = supplier.select(
        F.lit(C.REPO).alias("repo_id"),
        F.concat(F.lit("com.shop.dict.S"), F.col("s_suppkey").cast("string")).alias("enum_class"),
        F.concat(F.col("s_suppkey").cast("string"), F.lit("Status")).alias("short_name"),
    )
    curated = C.bindings(C.load(spark, sf_dir, "part").filter("p_size % 4 = 0"))
    found = semantics.bind_enums(columns, named, curated)
    return found.select("table_name", "name", "enum_class", "confidence")


@query
def q_infer_relations(spark, sf_dir):
    files = part_files(spark, sf_dir)
    found = semantics.infer_relations(entities.extract_columns(files), entities.extract_tables(files))
    return found.drop("repo_id")


@query
def q_all_relations(spark, sf_dir):
    files = part_files(spark, sf_dir)
    inferred = semantics.infer_relations(
        entities.extract_columns(files), entities.extract_tables(files)
    )
    key = F.col("p_partkey")
    declared = C.load(spark, sf_dir, "part").filter("p_partkey > 0 and p_size % 3 = 0").select(
        F.lit(C.REPO).alias("repo_id"),
        C.table_of(key).alias("from_table"),
        F.concat(F.lit("part_"), (key - 1).cast("string"), F.lit("_id")).alias("from_column"),
        C.table_of(key - 1).alias("to_table"),
        F.lit("part_key").alias("to_column"),
        F.lit("fk").alias("kind"),
        F.lit("declared").alias("confidence"),
    )
    return semantics.all_relations(declared, inferred).drop("repo_id")


@query
def q_build_catalog(spark, sf_dir):
    built = catalog(spark, sf_dir, store=True)
    names = ("tables", "columns", "enums", "enum_values", "relations", "i18n_keys", "rejects")
    return count_tables(built, names)


@query
def q_catalog_columns(spark, sf_dir):
    return catalog(spark, sf_dir)["columns"].drop("repo_id", "enum_class")


@query
def q_catalog_values(spark, sf_dir):
    found = catalog(spark, sf_dir)["enum_values"]
    return found.drop("repo_id").withColumns(
        {"aggregators": joined("aggregators"), "warning": F.coalesce("warning", F.lit(""))}
    )


@query
def q_soft_delete_by_domain(spark, sf_dir):
    """How many tables of each domain have a soft-delete column."""
    kept = build.tables_of(
        semantics.dedupe_entities(
            build.annotate_entities(entities.parse_entities(part_files(spark, sf_dir)))
        )
    )
    return kept.groupBy("domain").agg(
        F.count("*").alias("n_tables"), F.count("soft_delete_column").alias("n_soft_delete")
    )


@query
def q_extraction_report(spark, sf_dir):
    return build.extraction_report(catalog(spark, sf_dir, store=True))


@query
def q_repo_registry(spark, sf_dir):
    found = build.repo_registry(two_repo_catalog(spark, sf_dir), root="/src")
    return found.select(
        "repo_id", "root_path", "rule_id", "table_count", "enum_count", "base_entity",
        F.size("domain_map").alias("n_prefixes"),
    )


# -------------------------------------------------------------------- search


@query
def q_tokenize(spark, sf_dir):
    docs = C.load(spark, sf_dir, "documents")
    terms = exploded(docs, tokenize(F.col("text")), "doc_id", value="term")
    return terms.groupBy("term").agg(F.count("*").alias("n"))


@query
def q_build_index(spark, sf_dir):
    index = search.build_index(C.search_docs(C.load(spark, sf_dir, "documents"), True), ["text"])
    terms = index.term_stats.groupBy("repo_id").agg(
        F.count("*").alias("n_terms"), F.sum("n_docs").alias("n_postings"), F.sum("n_total").alias("n_words")
    )
    return terms.join(
        index.corpus.select("repo_id", "n_docs", F.round("avg_length", 6).alias("avg_length")), "repo_id"
    )


def _benchmark(spark, sf_dir) -> DataFrame:
    return C.search_queries(C.load(spark, sf_dir, "benchmark"))


def _docs_index(spark, sf_dir) -> search.Index:
    # ranking reads the words more than once
    return search.build_index(C.search_docs(C.load(spark, sf_dir, "documents")), ["text", "lang"], store=True)


RANKED = ("query_id", "doc_id", "score", "rank")


@query
def q_rank_bm25(spark, sf_dir):
    """Docs that hold every word of a benchmark text."""
    return search.rank_bm25(_docs_index(spark, sf_dir), _benchmark(spark, sf_dir)).select(*RANKED)


def _kept_index(spark, sf_dir) -> index_store.KeptIndex:
    """A kept index of all documents after some changes: old texts replaced, copies added and removed again."""
    docs = C.search_docs(C.load(spark, sf_dir, "documents"))
    even = F.col("doc_id") % 2 == 0
    old = docs.withColumn("text", F.when(even, F.reverse("text")).otherwise(F.col("text")))
    copies = docs.filter("doc_id % 5 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    kept = index_store.create_index(old.unionByName(copies), shared_folder(spark), ["text", "lang"], n_buckets=16)
    kept = index_store.add_docs(kept, docs.filter(even))
    index_store.remove_docs(kept, copies.unionByName(copies))
    return index_store.open_index(spark, kept.path)


@query
def q_rank_bm25_kept(spark, sf_dir):
    """Ranking from a kept index that was changed twice; it reads the postings of the queries' words."""
    return index_store.rank(_kept_index(spark, sf_dir), _benchmark(spark, sf_dir)).select(*RANKED)


@query
def q_rank_bm25_kept_phrase(spark, sf_dir):
    found = index_store.rank(_kept_index(spark, sf_dir), _benchmark(spark, sf_dir), mode="phrase")
    return found.select(*RANKED)


@query
def q_rank_bm25_any(spark, sf_dir):
    found = search.rank_bm25(_docs_index(spark, sf_dir), _benchmark(spark, sf_dir), mode="any")
    return found.select(*RANKED)


@query
def q_rank_bm25_not(spark, sf_dir):
    """Any word of the text, without docs in one language."""
    wanted = _benchmark(spark, sf_dir).withColumn("not_text", F.lit("FR de"))
    return search.rank_bm25(_docs_index(spark, sf_dir), wanted, mode="any").select(*RANKED)


def _starts(spark, sf_dir) -> DataFrame:
    words = tokenize(F.col("text"))
    start = F.concat_ws(" ", F.substring(words[0], 1, 4), F.substring(words[2], 1, 3))
    return _benchmark(spark, sf_dir).withColumn("text", start)


@query
def q_rank_bm25_prefix(spark, sf_dir):
    found = search.rank_bm25(_docs_index(spark, sf_dir), _starts(spark, sf_dir), mode="prefix")
    return found.select(*RANKED)


@query
def q_rank_bm25_phrase(spark, sf_dir):
    """Docs that hold a benchmark text word by word."""
    found = search.rank_bm25(_docs_index(spark, sf_dir), _benchmark(spark, sf_dir), mode="phrase")
    return found.select(*RANKED)


@query
def q_rank_bm25_column(spark, sf_dir):
    """Words looked up in the language field only."""
    docs = C.load(spark, sf_dir, "benchmark").withColumn("text", F.lit("en de"))
    found = search.rank_bm25(
        _docs_index(spark, sf_dir), C.search_queries(docs), mode="any", column="lang"
    )
    return found.select(*RANKED)


@query
def q_rank_bm25_column_text(spark, sf_dir):
    """Words of a benchmark text looked up in the text field only."""
    found = search.rank_bm25(
        _docs_index(spark, sf_dir), _benchmark(spark, sf_dir), mode="any", column="text"
    )
    return found.select(*RANKED)


@query
def q_rank_bm25_column_lang(spark, sf_dir):
    """Words of a benchmark text looked up in the language field only."""
    found = search.rank_bm25(
        _docs_index(spark, sf_dir), _benchmark(spark, sf_dir), mode="any", column="lang"
    )
    return found.select(*RANKED)


@query
def q_search_like_whole(spark, sf_dir):
    """Docs that hold a whole benchmark text as a plain string."""
    docs = C.search_docs(C.load(spark, sf_dir, "documents"))
    return search.match_like(docs, ["text"], _benchmark(spark, sf_dir)).select("query_id", "doc_id")


@query
def q_search_like(spark, sf_dir):
    """Docs that hold the end of a benchmark text, upper case, as a plain string."""
    queries = _benchmark(spark, sf_dir).withColumn("text", F.upper(F.expr("right(text, 24)")))
    docs = C.search_docs(C.load(spark, sf_dir, "documents"))
    return search.match_like(docs, ["text"], queries).select("query_id", "doc_id")


def _names(spark, sf_dir) -> DataFrame:
    """Searches for part names, and for pieces of words that only a substring search finds."""
    part = C.load(spark, sf_dir, "part")
    names = part.select("p_name").distinct()
    rows = F.array(
        F.struct(F.lit("name ").alias("tag"), F.col("p_name").alias("text")),
        F.struct(F.lit("piece ").alias("tag"), F.expr("substr(p_name, 2, 6)").alias("text")),
    )
    return names.select("p_name", F.explode(rows).alias("r")).select(
        F.lit(C.REPO).alias("repo_id"), F.concat("r.tag", "p_name").alias("query_id"), "r.text"
    )


def _name_catalog(spark, sf_dir) -> dict[str, DataFrame]:
    kept = semantics.dedupe_entities(
        build.annotate_entities(entities.parse_entities(part_files(spark, sf_dir)))
    )
    kept = stored(kept)
    columns = entities.explode_columns(kept).drop("source_file")
    return {"tables": build.tables_of(kept), "columns": columns}


@query
def q_search_tables(spark, sf_dir):
    found = search.search_tables(_name_catalog(spark, sf_dir), _names(spark, sf_dir))
    return found.select(
        "query_id", "table_name", "rank", "found_by", "purpose", "domain",
        F.coalesce("soft_delete_column", F.lit("")).alias("soft_delete_column"),
        joined("dimension_fields").alias("dims"),
    )


@query
def q_search_tables_kept(spark, sf_dir):
    """As search_tables, from the index that is kept with the catalog."""
    held = _name_catalog(spark, sf_dir)
    held["enums"] = spark.createDataFrame([], "repo_id string, enum_class string, short_name string")
    folder = shared_folder(spark)
    index_store.keep_catalog(held, folder)
    names = _names(spark, sf_dir)
    kept = index_store.open_catalog(spark, folder)["tables"]
    found = search.search_tables(held, names, index=index_store.index_for(kept, names))
    return found.select("query_id", "table_name", "rank", "found_by")


@query
def q_search_tables_in_domain(spark, sf_dir):
    found = search.search_tables(
        _name_catalog(spark, sf_dir), _names(spark, sf_dir), domain="02-act"
    )
    return found.select("query_id", "table_name", "rank", "found_by")


@query
def q_search_columns(spark, sf_dir):
    queries = _names(spark, sf_dir).filter("query_id like 'name %'").withColumn(
        "text", F.concat(F.lit("made "), "text")
    )
    found = search.search_columns(_name_catalog(spark, sf_dir), queries)
    return found.select("query_id", "column_name", "score", "rank")


@query
def q_search_enums(spark, sf_dir):
    found = enums.extract_enums(enum_source(spark, sf_dir))
    queries = C.load(spark, sf_dir, "nation").select(
        F.lit(C.REPO).alias("repo_id"),
        F.col("n_nationkey").alias("query_id"),
        F.concat(F.lit("status"), F.col("n_nationkey").cast("string"), F.lit(" DICT")).alias("text"),
    )
    kept = found.dropDuplicates(["repo_id", "enum_class"])
    return search.search_enums({"enums": kept}, queries).select("query_id", "enum_class", "score", "rank")


# -------------------------------------------------------------------- lookup


@query
def q_default_repo(spark, sf_dir):
    return lookup.default_repo(C.registry(C.load(spark, sf_dir, "documents")))


@query
def q_list_repos(spark, sf_dir):
    found = lookup.list_repos(C.registry(C.load(spark, sf_dir, "documents")))
    return found.withColumn("extracted_at", F.unix_seconds("extracted_at"))


@query
def q_repo_status(spark, sf_dir):
    found = lookup.repo_status(C.registry(C.load(spark, sf_dir, "documents")), "src7")
    return found.withColumn("extracted_at", F.unix_seconds("extracted_at"))


@query
def q_table_detail(spark, sf_dir):
    """Every part's table by name and, for each supplier, a table that does not exist."""
    asked = C.load(spark, sf_dir, "part").select(
        F.lit(C.REPO).alias("repo_id"), C.table_of(F.col("p_partkey")).alias("table_name")
    )
    absent = C.load(spark, sf_dir, "supplier").select(
        F.lit(C.REPO).alias("repo_id"),
        F.concat(F.lit("absent_"), F.col("s_suppkey").cast("string")).alias("table_name"),
    )
    return _shown_detail(lookup.table_detail(bound_catalog(spark, sf_dir), asked.unionByName(absent)))


def _shown_detail(found: DataFrame) -> DataFrame:
    return found.select(
        "table_name",
        F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("purpose", F.lit("")).alias("purpose"),
        joined(F.transform("columns", lambda c: c["name"])).alias("column_names"),
        joined(
            F.transform("enum_bindings", lambda b: F.concat_ws(":", b["name"], b["enums"][0]))
        ).alias("bindings"),
        joined(F.transform("relations", lambda r: r["to_table"])).alias("points_at"),
        joined("traps").alias("traps"),
        joined("query_templates").alias("templates"),
        F.coalesce("coverage", F.lit("")).alias("coverage"),
    )


@query
def q_table_detail_whole(spark, sf_dir):
    """Every table of the catalog, none asked for by name, and requests for tables that do not exist."""
    known = bound_catalog(spark, sf_dir)
    absent = C.load(spark, sf_dir, "supplier").select(
        F.lit(C.REPO).alias("repo_id"),
        F.concat(F.lit("absent_"), F.col("s_suppkey").cast("string")).alias("table_name"),
    )
    found = lookup.table_detail(known).unionByName(lookup.table_detail(known, absent))
    return _shown_detail(found)


@query
def q_enum_candidates(spark, sf_dir):
    files = part_files(spark, sf_dir)
    columns = entities.extract_columns(files).withColumn("enum_class", F.lit(None).cast("string"))
    found = lookup.enum_candidates(columns, enums.extract_enums(enum_source(spark, sf_dir)).dropDuplicates(["enum_class"]))
    return found.select("table_name", "name", "enum_class", "rank", "confidence").distinct()


@query
def q_bound_enums(spark, sf_dir):
    bound = bound_catalog(spark, sf_dir)
    found = lookup.bound_enums(bound["columns"], bound["bindings"])
    return found.select("table_name", "name", "enum_class", "bound", "confidence")


@query
def q_relations_of(spark, sf_dir):
    """Outgoing relations of customers: their orders, as if these were tables."""
    orders = C.load(spark, sf_dir, "orders")
    relations = orders.select(
        F.lit(C.REPO).alias("repo_id"),
        F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("from_table"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit("_id")).alias("from_column"),
        F.concat(F.lit("pcl_order_"), F.col("o_orderkey").cast("string")).alias("to_table"),
        F.lit("id").alias("to_column"),
        F.lit("fk").alias("kind"),
        F.lit("inferred").alias("confidence"),
    )
    return lookup.relations_of(relations).select("from_table", "from_column", "to_table", "rank")


@query
def q_curated_notes(spark, sf_dir):
    tables = entities.extract_tables(part_files(spark, sf_dir))
    found = lookup.curated_notes(tables, C.notes(C.load(spark, sf_dir, "part")))
    return found.select(
        "table_name", joined("traps").alias("traps"), joined("query_templates").alias("templates"), "coverage"
    )


@query
def q_guidance(spark, sf_dir):
    parsed = build.annotate_entities(entities.parse_entities(part_files(spark, sf_dir)))
    found = lookup.guidance(build.tables_of(parsed))
    return found.drop("repo_id")


@query
def q_resolve_enum(spark, sf_dir):
    """Enums asked for by class, by short name, and by a name that does not exist."""
    b = F.expr(f"c_custkey div {C.BUCKET}").cast("string")
    asked = F.array(
        F.concat(F.lit("com.shop.dict.Status"), b), F.concat(F.lit("Status"), b), F.concat(F.lit("No"), b)
    )
    requests = C.load(spark, sf_dir, "customer").select(
        F.lit(C.REPO).alias("repo_id"), F.explode(asked).alias("request")
    ).distinct()
    found = lookup.resolve_enum(catalog(spark, sf_dir, store=True), requests)
    return found.select(
        "request",
        F.coalesce("enum_class", F.lit("")).alias("enum_class"),
        F.coalesce("code", F.lit(-1)).alias("code"),
        F.coalesce("value_name", F.lit("")).alias("value_name"),
        F.coalesce("meaning", F.lit("")).alias("meaning"),
        joined("aggregators").alias("aggregators"),
        (F.coalesce("dimension_warning", F.lit("")) != "").alias("warned"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def q_resolve_column(spark, sf_dir):
    part = C.load(spark, sf_dir, "part")
    bound = bound_catalog(spark, sf_dir)
    name = F.element_at(
        F.array(F.lit("status"), F.lit("brand_name"), F.lit(None)), (F.col("p_size") % 3 + 1).cast("int")
    )
    requests = part.select(
        F.lit(C.REPO).alias("repo_id"), C.table_of(F.col("p_partkey")).alias("table_name"), name.alias("name")
    )
    found = lookup.resolve_column(bound, requests)
    return found.select(
        "table_name",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("enum_class", F.lit("")).alias("enum_class"),
        F.coalesce("code", F.lit(-1)).alias("code"),
        F.coalesce("value_name", F.lit("")).alias("value_name"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def q_decode_codes(spark, sf_dir):
    facts = C.coded_facts(C.load(spark, sf_dir, "orders"), C.load(spark, sf_dir, "customer"))
    values = C.coded_values(C.load(spark, sf_dir, "nation"))
    return lookup.decode_codes(facts, "code", "tenant", values).select(
        "o_orderkey", "code", "tenant", "meaning", "is_divergent"
    )


@query
def q_divergent_codes(spark, sf_dir):
    return lookup.divergent_codes(catalog(spark, sf_dir, store=True)["enum_values"]).drop("repo_id")


# --------------------------------------------------------------------- audit


@query
def q_extract_table_refs(spark, sf_dir):
    found = grounding.extract_table_refs(log(spark, sf_dir))
    # first table of the statement first
    return found.select("query_id", "table_name", (F.rank().over(Window.partitionBy("query_id").orderBy("pos"))).alias("no"))


@query
def q_extract_column_refs(spark, sf_dir):
    return grounding.extract_column_refs(log(spark, sf_dir)).drop("repo_id")


@query
def q_extract_equalities(spark, sf_dir):
    return grounding.extract_equalities(log(spark, sf_dir)).select(
        "query_id", "qualifier", "column_name", "literal", F.coalesce("code", F.lit(-1)).alias("code")
    )


@query
def q_resolve_refs(spark, sf_dir):
    found = grounding.resolve_refs(log(spark, sf_dir), bound_catalog(spark, sf_dir, *NAMES))
    return found.filter("reason is null").select(
        "query_id", "kind", "qualifier", "column_name", "table_name", "known_table", "known_column"
    )


def _checks(found: DataFrame) -> DataFrame:
    return found.select("query_id", *grounding.CHECK_FIELDS)


@query
def q_check_missing_columns(spark, sf_dir):
    return _checks(grounding.check_missing_columns(log(spark, sf_dir), bound_catalog(spark, sf_dir, *NAMES)))


@query
def q_check_soft_delete(spark, sf_dir):
    return _checks(grounding.check_soft_delete(log(spark, sf_dir), bound_catalog(spark, sf_dir, *NAMES)))


@query
def q_check_ambiguous_codes(spark, sf_dir):
    return _checks(grounding.check_ambiguous_codes(log(spark, sf_dir), bound_catalog(spark, sf_dir, *CODES)))


@query
def q_check_tenant_filter(spark, sf_dir):
    return _checks(grounding.check_tenant_filter(log(spark, sf_dir), bound_catalog(spark, sf_dir, *NAMES)))


@query
def q_verdicts(spark, sf_dir):
    bound = bound_catalog(spark, sf_dir, *NAMES)
    statements = log(spark, sf_dir)
    checks = grounding.check_missing_columns(statements, bound).unionByName(
        grounding.check_tenant_filter(statements, bound)
    )
    return grounding.verdicts(statements, checks).drop("repo_id")


@query
def q_unreadable(spark, sf_dir):
    return _checks(grounding.unreadable(log(spark, sf_dir)))


@query
def q_unknown_tables(spark, sf_dir):
    return grounding.unknown_tables(log(spark, sf_dir), bound_catalog(spark, sf_dir, "tables")).drop("repo_id")


@query
def q_audit_log(spark, sf_dir):
    found = grounding.audit_log(log(spark, sf_dir), bound_catalog(spark, sf_dir, *CODES))

    def n(kind: str) -> Column:
        return F.size(F.filter("checks", lambda c: c["kind"] == kind)).cast("bigint")

    return found.select(
        "query_id",
        "verdict",
        "n_checks",
        joined("parsed_tables").alias("parsed_tables"),
        n("column_missing").alias("n_missing"),
        n("soft_delete_misuse").alias("n_soft_delete"),
        n("enum_ambiguous").alias("n_ambiguous"),
        n("dimension_missing").alias("n_dimension"),
        n("parse_error").alias("n_unreadable"),
    )


@query
def q_audit_checks(spark, sf_dir):
    """Every check of the audit with its message and advice."""
    found = grounding.audit_log(log(spark, sf_dir), bound_catalog(spark, sf_dir, *CODES))
    return _checks(grounding.audit_checks(found))


# ------------------------------------------------------------------- compare


@query
def q_drift_check(spark, sf_dir):
    """Mined columns against a schema that lacks, adds and retypes some columns."""
    columns = two_repo_catalog(spark, sf_dir)["columns"].filter(F.col("repo_id") == C.REPO)
    key, size = F.col("p_partkey"), F.col("p_size")
    part = C.load(spark, sf_dir, "part")

    def column(name, data_type):
        return F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), F.lit(data_type).alias("data_type"))

    always = F.array(
        column("part_key", "bigint"), column("status", "smallint"), column("brand_name", "varchar(30)"),
        column("retail_price", "decimal(12,2)"), column("made_of", "array<string>"), column("extra", "int"),
    )
    actual = part.select(
        F.lit(C.REPO).alias("repo_id"),
        C.table_of(key).alias("table_name"),
        F.explode(
            F.concat(
                always,
                F.array(
                    F.when(size % 9 == 0, column("last_ship_date", "string")).otherwise(
                        column("last_ship_date", "date")
                    )
                ),
            )
        ).alias("c"),
    ).select("repo_id", "table_name", "c.*")
    return compare.drift_check(columns, actual).select("table_name", "name", "change")


def real_schema(spark, sf_dir) -> DataFrame:
    """A schema of all tables that lacks, adds and retypes some columns."""
    key, size = F.col("p_partkey"), F.col("p_size")
    real = {"Long": "bigint", "Integer": "int", "String": "varchar(64)", "Date": "date"}
    even = size % 2 == 0

    def column(there: Column, name: str | Column, data_type: str | Column) -> Column:
        name, data_type = (F.lit(x) if isinstance(x, str) else x for x in (name, data_type))
        return F.when(there, F.struct(name.alias("name"), data_type.alias("data_type")))

    of_base = [
        column(
            # the second and third are lacking in some
            even & ~(size % 10 == 0) if name == "operation" else even & (key % 4 != 1) if i in (1, 2) else even,
            name,
            F.when(size % 6 == 0, "string").otherwise("int") if name == "aggregator" else real[kind],
        )
        for i, (name, _, kind, _, _) in enumerate(BASE_ENTITY_COLUMNS)
    ]
    own = [
        column(F.lit(True), "part_key", "bigint"),
        column(key % 3 != 0, "status", "smallint"),
        column(F.lit(True), "brand_name", F.when(key % 7 == 0, "int").otherwise("varchar(30)")),
        column(F.lit(True), "retail_price", "decimal(12,2)"),
        column((size % 7 == 0) & (size % 14 != 0), "deleted", "int"),
        column(size % 3 == 0, "shipper", F.when(size % 9 == 0, "bigint").otherwise("int")),
        column(size % 10 == 0, "operation", "string"),
        column(key > 0, F.concat(F.lit("part_"), (key - 1).cast("string"), F.lit("_id")), "bigint"),
        column(F.lit(True), "made_of", "array<string>"),
        column(F.lit(True), "last_ship_date", F.when(size % 9 == 0, "string").otherwise("date")),
        column(key % 5 != 0, "extra", "int"),
    ]
    return C.load(spark, sf_dir, "part").select(
        F.lit(C.REPO).alias("repo_id"),
        C.table_of(key).alias("table_name"),
        F.explode(F.array_compact(F.array(*of_base, *own))).alias("c"),
    ).select("repo_id", "table_name", "c.*")


@query
def q_drift_check_whole(spark, sf_dir):
    """All mined columns against a schema of all tables that lacks, adds and retypes some columns."""
    columns = two_repo_catalog(spark, sf_dir)["columns"].filter(F.col("repo_id") == C.REPO)
    found = compare.drift_check(columns, real_schema(spark, sf_dir))
    return found.select("table_name", "name", "change")


@query
def q_drift_trend(spark, sf_dir):
    """Two checks put into the history with an extraction between them, and what changed from one to the other."""
    folder = shared_folder(spark)
    built = build.store_catalog(two_repo_catalog(spark, sf_dir))
    built["columns"] = built["columns"].withColumn("enum_class", F.lit(None).cast("string"))
    mined = built["columns"].filter(F.col("repo_id") == C.REPO)
    catalog_store.write_catalog(built, folder)
    found = real_schema(spark, sf_dir)
    # by the second check the schema has lost one column of all tables and got another right
    mended = found.filter("name != 'extra'").withColumn(
        "data_type", F.when(F.col("name") == "brand_name", "varchar(30)").otherwise(F.col("data_type"))
    )
    for schema in (found, mended):
        report = compare.drift_report(compare.drift_check(mined, schema), "nightly")
        catalog_store.append_rows(report, folder, "drift_reports")
        catalog_store.write_catalog(built, folder)
    kept = catalog_store.read_catalog(spark, folder, C.REPO)["drift_reports"]
    return compare.drift_trend(kept).drop("checked_at")


@query
def q_repo_diff(spark, sf_dir):
    found = compare.repo_diff(two_repo_catalog(spark, sf_dir), C.REPO, C.FORK)
    return found.select("catalog_table", "item", "change")


@query
def q_repo_diff_whole(spark, sf_dir):
    """Two whole catalogs in every field: the fork lacks, renames and rewords things."""
    part, customer = C.load(spark, sf_dir, "part"), C.load(spark, sf_dir, "customer")
    forked_part = part.filter("p_partkey % 11 != 0").withColumn(
        "p_name", F.when(F.col("p_partkey") % 13 == 0, F.lit("renamed")).otherwise(F.col("p_name"))
    )
    forked_customer = customer.withColumn(
        "c_name", F.when(F.col("c_custkey") % 13 == 0, F.lit("renamed")).otherwise(F.col("c_name"))
    )
    # entities and constants whose number ends with 0 call a column and themselves differently
    renamed = (
        F.when(F.col("path").rlike(r"/Part[0-9]*0\.java$"), F.replace(F.col("src"), F.lit('"shipper"'), F.lit('"carrier"')))
        .otherwise(F.regexp_replace("src", r"CUST_([0-9]*0)\(", r"FORK_$1("))
    )
    forked = (
        C.entity_sources(forked_part, C.FORK)
        .unionByName(C.enum_sources(forked_customer, C.FORK))
        .unionByName(C.bundle_sources(forked_customer, C.FORK))
        .withColumn("src", renamed)
    )
    bound = C.bindings(part).unionByName(
        C.bindings(forked_part.filter("p_partkey % 9 != 0"), C.FORK)
    ).unionByName(C.bindings(forked_part.filter("p_partkey % 9 = 0"), C.FORK).withColumn("enum_class", F.lit("com.shop.dict.Other")))
    built = build.build_catalog(
        C.source_tree(spark, sf_dir).unionByName(forked),
        curated_bindings=bound,
        table_meta=C.notes(part).unionByName(C.notes(forked_part, C.FORK)),
        store=True,
        # all that is compared
        names=("tables", "columns", "enums", "enum_values", "relations", "i18n_keys", "bindings", "table_meta"),
    )
    # each is read for both sides
    built = build.store_catalog(built, "columns", "enum_values", "relations", "i18n_keys")
    found = compare.pair_renames(compare.repo_diff(built, C.REPO, C.FORK))
    return found.select(
        "catalog_table", "item", "change", joined("fields").alias("fields"),
        F.coalesce("renamed_to", F.lit("")).alias("renamed_to"),
    )
