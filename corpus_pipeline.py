"""From raw documents to packed training sequences.

Each stage works on all rows its predecessor kept: texts that the quality
classifier rejects go, then those that the quality rules reject; of each group of
near-duplicates the row of the least id stays, texts that hold a benchmark
passage go, and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semcat.llm import chosenpath, factorisation, thresholds, winnowing
from semcat.llm.queries import packed, table
from semcat.plans.lineage import side_hint, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine takes for good ones.

    Every row is scored by its whole text, null and empty texts as empty ones; rows that repeat an id or a
    text are scored alike. An empty table gives no rows; other columns stay as they are.
    """
    model = factorisation.train(docs, table(spark, sf_dir, "labels"))
    return factorisation.classify(docs, model).filter("predicted = 1").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and every risk-controlled cutoff of their language.

    Null and empty texts have no words and go; a null language is one of its own. Every row is judged by
    its whole text, repeated or not. An empty table gives no rows; other columns stay as they are.
    """
    judged = thresholds.judge(docs, table(spark, sf_dir, "labels"))
    return judged.filter("quality_rules.kept").select(*docs.columns)


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of their own, and its name: the id with a hash and the length of the text.

    Ids may be null or stand on several texts, and what is found of one text says nothing of another. Keys
    are ordered as ids are, null ones last.
    """
    name = "_key"
    while name in docs.columns:
        name = f"_{name}"
    doc_id, text = F.col("doc_id"), F.col("text")
    key = F.struct(
        doc_id.isNull().alias("unnamed"),
        doc_id.alias("id"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("hash"),
        F.coalesce(F.length(text), F.lit(-1)).alias("length"),
    )
    return docs.withColumn(name, key), name


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id, of rows alike in id and text one.

    Rows that share an id are judged by their own texts, and so are rows with a null id, which come after
    all others. Texts without a word are nobody's copy and stay, repeated or not. Very long texts are
    compared whole. An empty table gives no rows; other columns stay as they are, whatever their names.
    """
    keyed, key = _with_key(docs)
    classes = chosenpath.similarity_join(keyed, id_col=key).filter("n_links > 0")
    per_key = classes.groupBy("doc_id").agg(F.min("class_id").alias("first"), F.count("*").alias("n"))
    verdicts = per_key.select(
        F.col("doc_id").alias("k"), (F.col("first") < F.col("doc_id")).alias("gone"), (F.col("n") > 1).alias("again")
    )
    verdicts = stored(verdicts.filter("gone or again"))
    copies = verdicts.filter("gone").select(F.col("k").alias(key))
    left = keyed.join(copies.hint(side_hint(verdicts)), key, "left_anti")
    repeats = verdicts.filter("again and not gone").select(F.col("k").alias(key))
    if not repeats.isEmpty():
        same = repeats.hint(side_hint(verdicts))
        one = left.join(same, key, "left_semi").dropDuplicates([key])
        left = left.join(same, key, "left_anti").unionByName(one)
    return left.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Every row is judged by its own text, also where an id is null or stands on several rows. Null and empty
    texts hold no passage and stay; very long ones are searched whole. An empty table gives no rows, an
    empty benchmark takes none; other columns stay as they are.
    """
    keyed, key = _with_key(docs)
    found = winnowing.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    gone = stored(found.filter("n_hit > 0").select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(gone.hint(side_hint(gone)), key, "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in sequences of 1024 tokens.

    Null and empty texts are an end mark alone; every row is packed, repeated or not, long ones in pieces.
    An empty table gives no rows.
    """
    return packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# a trained model decides in the first stage, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
