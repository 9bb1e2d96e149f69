"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcat.llm import (
    chosenpath,
    factorisation,
    hardneg,
    infilling,
    langid,
    licenses,
    linedup,
    packing,
    quoting,
    recurrent,
    thresholds,
    urlrules,
    winnowing,
)
from semcat.llm.rows import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.similarity_join(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    found = packing.pack(docs)
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(table(spark, sf_dir, "documents"), fold("doc_id", 7, 2))


SITE_RULES = [
    urlrules.site_rule("net/", "block"),
    urlrules.site_rule("example.net/en/", "allow"),
    urlrules.site_rule("example.com/de/", "block"),
    urlrules.site_rule("org/fr/", "allow"),
]
# what decides where no site rule fits: URLs of the kinds that are seldom worth reading
UNWANTED = ["*spam*", "*casino*", "*pills*", "*viagra*", "*porn*", "*xxx*", "*gambling*", "*betting*", "*warez*"]
UNWANTED += ["ads-*", "*.ads-*"]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = [urlrules.url_globs(g, "block", g) for g in UNWANTED]
    judged = urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), SITE_RULES + globs, "allow")
    named = [rule.name for rule in SITE_RULES]
    return judged.select(
        "page_id", "host", "path", F.when(F.col("rule").isin(named), F.col("rule")).alias("rule"), "verdict"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = thresholds.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id",
        *[F.col(f"quality_rules.{c}").cast("bigint").alias(c) for c in counts],
        "quality_rules.base_failed",
        "quality_rules.kept",
    )


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.array_sort(F.array_distinct(F.filter("licenses", lambda x: x["license"].isNotNull())["license"]))
    exact = F.filter("licenses", lambda x: (x["missing"] == 0) & (x["other"] == 0))
    return found.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_blocks"),
        F.array_join(named, ",").alias("licenses"),
        F.size(exact).cast("bigint").alias("n_exact"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~fold("doc_id", 4, 2)))
    rows = docs.select("doc_id", "text", fold("doc_id", 4, 2).alias("held_out"))
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = factorisation.train(docs, table(spark, sf_dir, "labels"))
    scored = factorisation.classify(docs.withColumn("held_out", fold("doc_id", 3, 1)), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quoting.threads(table(spark, sf_dir, "conversations"))
    return found.select(
        "conv_id", "turn", "role", "position", "parent_turn", "root_turn", F.col("quotes").cast("bigint").alias("quotes"), "chat"
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(F.col("fim.text"), 256).alias("output_sha256"),
        F.sha2(infilling.restored(F.col("fim.form"), F.col("fim.text")), 256).alias("restored_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = linedup.insert(linedup.empty(spark, min_docs=10), docs)
    found = linedup.keep(store, docs.select("doc_id", "text"), known=True)
    return found.select(
        "doc_id",
        "line_dedup.n_lines",
        "line_dedup.n_dropped",
        F.sha2(F.col("line_dedup.text"), 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scans": op5_license_scans,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_line_dedup": op13_line_dedup,
}
