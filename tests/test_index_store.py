"""The kept index: equal to one made for the occasion, after any change, and never half changed."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from semcat.operators import search
from semcat.sources import index_store as kept

WORDS = ["order", "bill", "status", "Über", "x1", "part", "订单状态", "shipper", "a", "box", "boxes", "ordered"]


def rows_of(seed, ids, repos=("r", "s")):
    rng = random.Random(seed)
    return [(rng.choice(repos), f"d{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(14))), rng.choice(["en", None, "de"])) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, doc_id string, text string, lang string")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [("r", "q1", "order status", "de"), ("r", "q2", "bo a", ""), ("s", "q3", "订单状态", None), ("s", "q4", "never here", "x1"), ("r", "q5", "a", "en bill")]
    return spark.createDataFrame(rows, "repo_id string, query_id string, text string, not_text string")


def answers(ranked):
    return sorted(map(tuple, ranked.select("repo_id", "query_id", "doc_id", "score", "rank").collect()))


def same_as_fresh(spark, index, rows, queries, modes=("all", "any", "prefix", "phrase")):
    fresh = search.build_index(frame(spark, rows), ["text", "lang"])
    for mode in modes:
        # words to leave out, and one field alone, where they matter most
        asked = queries if mode == "any" else queries.drop("not_text")
        column = "text" if mode == "prefix" else None
        want = answers(search.rank_bm25(fresh, asked, 5, mode, column))
        assert answers(kept.rank(index, asked, 5, mode, column)) == want, (mode, column)


def test_changes_read_as_a_fresh_index(spark, queries, tmp_path):
    path = f"{tmp_path}/index"
    first, more = rows_of(1, range(40), ("r",)), rows_of(2, range(30, 60), ("r",))
    other = rows_of(3, range(20), ("s",)) + [("s", "empty", None, None)]
    index = kept.create_index(frame(spark, first + other), path, ["text", "lang"], n_buckets=8)
    same_as_fresh(spark, index, first + other, queries)
    index = kept.add_docs(index, frame(spark, more))
    now = {r[:2]: r for r in first + other + more}
    gone = [("r", "d3", "", ""), ("r", "d35", "", ""), ("r", "nobody", "", "")]
    before = kept.open_index(spark, path)
    index = kept.remove_docs(index, frame(spark, gone))
    for r in gone:
        now.pop(r[:2], None)
    same_as_fresh(spark, kept.open_index(spark, path), list(now.values()), queries, ("all",))
    # a reader keeps to its version; a removed doc may come back
    assert kept.live_docs(before, spark).count() == kept.live_docs(index, spark).count() + 2
    again = [("r", "d3", "order order status", "de")]
    index = kept.add_docs(index, frame(spark, again))
    now[("r", "d3")] = again[0]
    merged = kept.merge(index, spark)
    assert len(merged.generations) == 1
    same_as_fresh(spark, merged, list(now.values()), queries, ("any",))
    left = kept.remove_repo(merged, spark, "s")
    assert {r.repo_id for r in kept.live_docs(left, spark).collect()} == {"r"}
    assert kept.sweep(spark, path) and kept.open_index(spark, path) == left
    same_as_fresh(spark, left, [r for r in now.values() if r[0] == "r"], queries, ("all",))


def test_ranking_opens_only_the_buckets_of_the_words(spark, queries, tmp_path):
    path = f"{tmp_path}/index"
    index = kept.create_index(frame(spark, rows_of(5, range(200))), path, ["text", "lang"], n_buckets=64)
    one = queries.filter("query_id = 'q5'").drop("not_text")
    words = kept._asked_words(index, one, "all")
    buckets = [r.b for r in words.select(kept._bucket(index).alias("b")).collect()]
    plan = kept.live_postings(index, spark, buckets)._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) == 1 and "PartitionFilters" in plan
    opened = {r.f for r in kept.live_postings(index, spark, buckets).select(F.input_file_name().alias("f")).distinct().collect()}
    assert opened and all(f"bucket={buckets[0]}/" in f for f in opened)


def test_an_unfinished_write_is_not_seen(spark, queries, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    rows = rows_of(6, range(30))
    index = kept.create_index(frame(spark, rows), path, ["text", "lang"], n_buckets=4)
    with monkeypatch.context() as m:
        m.setattr(kept, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            kept.add_docs(index, frame(spark, rows_of(7, range(90))))
    assert kept.open_index(spark, path) == index
    same_as_fresh(spark, kept.open_index(spark, path), rows, queries, ("all",))
    assert len(kept.sweep(spark, path)) == 1
    # of two writers that start from one version the second one fails
    kept.add_docs(index, frame(spark, rows[:2]))
    with pytest.raises(Exception, match="(?i)exist"):
        kept.add_docs(index, frame(spark, rows[2:4]))
    with pytest.raises(FileExistsError):
        kept.create_index(frame(spark, rows), path, ["text", "lang"])
    with pytest.raises(FileNotFoundError):
        kept.open_index(spark, f"{tmp_path}/none")


def test_odd_rows(spark, queries, tmp_path):
    rows = [("r", "d", "order", "en"), ("r", "d", "status", "de"), (None, "e", "order", ""), ("r", None, "order", ""), ("r", "f", "order " * 20000, None)]
    index = kept.create_index(frame(spark, rows), f"{tmp_path}/i", ["text", "lang"], n_buckets=2)
    assert sorted((r.doc_id, r.length) for r in kept.live_docs(index, spark).collect()) == [("d", 2), ("f", 20000)]
    none = kept.create_index(frame(spark, []), f"{tmp_path}/n", ["text", "lang"])
    assert kept.rank(none, queries.drop("not_text")).count() == 0
    index = kept.add_docs(none, frame(spark, rows[:1]))
    assert kept.rank(index, queries.drop("not_text"), mode="any").count() == 1


def test_catalog_indexes_replace_a_repo(spark, tmp_path):
    tables = spark.createDataFrame([("r", "t_order", "orders", "x"), ("r", "t_gone", "bills", "x"), ("s", "t_order", "other", "y")], "repo_id string, name string, purpose string, domain string")
    columns = spark.createDataFrame([("r", "t_order", "id", "key", "bigint")], "repo_id string, table_name string, name string, comment string, type string")
    enums = spark.createDataFrame([("r", "OrderState", "p.OrderState")], "repo_id string, short_name string, enum_class string")
    path = f"{tmp_path}/search"
    kept.keep_catalog({"tables": tables, "columns": columns, "enums": enums}, path)
    newer = spark.createDataFrame([("r", "t_order", "orders of shops", "x"), ("r", "t_new", "new", "x")], tables.schema)
    kept.keep_catalog({"tables": newer, "columns": columns, "enums": enums}, path)
    opened = kept.open_catalog(spark, path)
    names = {(r.repo_id, r.doc_id) for r in kept.live_docs(opened["tables"], spark).collect()}
    assert names == {("r", "t_order"), ("r", "t_new"), ("s", "t_order")}
    asked = spark.createDataFrame([("r", "q", "shops")], "repo_id string, query_id string, text string")
    assert [r.doc_id for r in kept.rank(opened["tables"], asked).collect()] == ["t_order"]
    found = search.search_columns({"columns": columns}, asked.withColumn("text", F.lit("key")), index=kept.index_for(opened["columns"], asked.withColumn("text", F.lit("key"))))
    assert [r.column_name for r in found.collect()] == ["t_order.id"]


def test_words_are_grouped_with_their_places_in_their_own_row(spark):
    lists = [["b", "a", "b", "c", "a", "b"], ["x"], ["x", "x"], [], ["é", "e", "é"]]
    frame = spark.createDataFrame([(i, words) for i, words in enumerate(lists)], "i int, terms array<string>")
    grouped = frame.select("i", kept._grouped("terms").alias("g"))
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    for i, found in grouped.collect():
        want = {}
        for place, word in enumerate(lists[i]):
            want.setdefault(word, []).append(place)
        assert {g.term: g.places for g in found or ()} == want and len(found or ()) == len(want)


def test_neither_texts_nor_postings_are_shuffled_or_kept_twice(spark, tmp_path, monkeypatch):
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (written.append((path, self._df)), write(self, path, *a, **b))[1])
    index = kept.create_index(frame(spark, rows_of(8, range(60))), f"{tmp_path}/i", ["text", "lang"], n_buckets=2)
    long = {"text", "texts", "fields", "lists", "terms", "places", "spots"}
    plans = {path: df._jdf.queryExecution().executedPlan().toString() for path, df in written if long & set(df.columns)}
    assert [path for path in plans if f"{tmp_path}" not in path] == []
    assert [path for path, plan in plans.items() if "Exchange" in plan] == []
    assert any("/postings/" in path for path in plans) and len(index.generations) == 1


def test_segments_tell_which_docs_count(spark, queries, tmp_path):
    rows = rows_of(9, range(40))
    index = kept.create_index(frame(spark, rows).repartition(3), f"{tmp_path}/i", ["text", "lang"], n_buckets=2)
    assert kept._segments(kept._marked(index, spark)).count() == 0
    ids = {r[:2] for r in rows}
    # the second time the numbers of docs that a merge left out are missing
    for removed in (rows[5:15], rows[20:25]):
        index = kept.remove_docs(index, frame(spark, removed))
        ids -= {r[:2] for r in removed}
        marked = kept._marked(index, spark)
        live = {r.seg: r.live for r in kept._segments(marked).collect()}
        assert live and all(live[r.seg][r.ord] == r.live for r in marked.collect() if r.seg in live)
        assert {(r.repo_id, r.doc_id) for r in marked.filter("live").collect()} == ids
        assert {(r.repo_id, r.doc_id) for r in kept.live_postings(index, spark).select("repo_id", "doc_id").distinct().collect()} <= ids
        index = kept.merge(index, spark)
    same_as_fresh(spark, index, [r for r in rows if r[:2] in ids], queries, ("all",))


def test_tasks_are_joined_or_dealt_out_by_their_texts(spark, monkeypatch):
    docs = frame(spark, [("r", f"d{i}", "word " * 50, None) for i in range(80)])
    n_tasks = lambda d: kept._distinct_docs(d, ("text", "lang")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert n_tasks(docs.repartition(40)) == 1
    monkeypatch.setattr(kept, "LEAST_TEXT", 100)
    assert n_tasks(docs.repartition(10)) == 10
    assert n_tasks(docs.repartition(80)) == 4
    monkeypatch.setattr(kept, "MOST_TEXT", 1000)
    assert n_tasks(docs.coalesce(1)) > 10


def test_docs_of_large_lists_are_found_before_their_words_are_joined(spark, queries, tmp_path, monkeypatch):
    rows = rows_of(10, range(60))
    index = kept.create_index(frame(spark, rows), f"{tmp_path}/i", ["text", "lang"], n_buckets=2)
    asked = queries.drop("not_text")
    want = answers(kept.rank(index, asked))
    monkeypatch.setattr(search, "side_hint", lambda df: "merge")
    ranked = kept.rank(index, asked)
    assert "LeftSemi" in ranked._jdf.queryExecution().optimizedPlan().toString() and want
    assert answers(ranked) == want


def test_an_index_of_another_layout_is_not_read(spark, tmp_path, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(kept, "LAYOUT", 1)
        kept.create_index(frame(spark, rows_of(11, range(3))), f"{tmp_path}/i", ["text", "lang"])
    with pytest.raises(ValueError, match="layout"):
        kept.open_index(spark, f"{tmp_path}/i")
