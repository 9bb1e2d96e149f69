"""Every stage of the pipeline on the rows its predecessor kept, and the registered queries."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from semcat.llm import factorisation, thresholds
from semcat.llm.oracles import ORACLES
from semcat.llm.queries import QUERIES, table
from semcat.plans.lineage import stored
from tests.llm.test_pairs import expected_classes, expected_hits

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_do_what_they_say(spark):
    read = lambda name: table(spark, SF_DIR, name)
    docs, kept = read("documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF_DIR))
        assert docs.columns == before.columns
        kept.append((before, docs))
    ids = [{r.doc_id for r in after.collect()} for _, after in kept]
    model = factorisation.train(read("documents"), read("labels"))
    good = factorisation.classify(read("documents"), model).filter("predicted = 1")
    assert ids[0] == {r.doc_id for r in good.collect()}
    judged = thresholds.judge(kept[1][0], read("labels")).filter("quality_rules.kept")
    assert ids[1] == {r.doc_id for r in judged.collect()}
    rows = [(r.doc_id, r.text) for r in kept[2][0].collect()]
    assert ids[2] == {first for first, _ in expected_classes(rows).values()}
    rows = [(r.doc_id, r.text) for r in kept[3][0].collect()]
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    assert ids[3] == {doc for doc, _, n_hit, _ in expected_hits(rows, items) if not n_hit}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in packed} == ids[3] and all(r.length <= 1024 for r in packed)


def odd(spark, rows):
    """Documents whose other columns have the names that stages use."""
    full = [(i, t, "en", None, len(t or ""), f"k{n}", True, "x") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, _gone boolean, quality_rules string")


def test_decisions_are_by_row(spark, tmp_path):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    passage = "benchmark " + " ".join(f"item{i}" for i in range(30))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    # one id on two texts: the copy goes, the other text stays; null ids come last
    rows = [(1, words[0]), (2, words[0] + " more"), (2, words[1]), (None, words[1]), (None, words[2]), (3, words[3]), (3, words[3])]
    rows += [(4, None), (4, ""), (4, ""), (None, "...")]
    docs = odd(spark, rows)
    got = stages["ngram_jaccard_join"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(1, words[0]), (2, words[1]), (None, words[2]), (3, words[3]), (4, None), (4, ""), (4, ""), (None, "...")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    rows = [(7, words[0]), (7, f"{words[1]} {passage}"), (None, f"{passage} {words[2]}"), (None, words[2]), (8, None), (8, passage), (8, passage)]
    rows += [(9, "long " * 40000 + passage), (10, "long " * 40000)]
    docs = odd(spark, rows)
    got = stages["benchmark_decontamination"](spark, docs, str(tmp_path))
    want = [(7, words[0]), (None, words[2]), (8, None), (10, "long " * 40000)]
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = odd(spark, [])
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    some = odd(spark, [(1, "a b c"), (None, None)])
    assert corpus_pipeline.benchmark_decontamination(spark, some, str(tmp_path)).count() == 2


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    got = con.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert rows == sorted(got.fetchall(), key=repr)
