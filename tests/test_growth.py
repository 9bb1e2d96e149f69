"""Work that must not grow faster than its input: rows that joins make, counted after a run."""

from pyspark.sql import functions as F

from semcat.operators import grounding, search, substring
from semcat.plans import build


def counted(df, kind_wanted, metric):
    """A metric of every node of the kind, of the plan that ran."""
    df.collect()
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in kind:
            todo.append(node.plan())
            continue
        if kind_wanted in kind and node.metrics().contains(metric):
            made.append(node.metrics().apply(metric).value())
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return made


def test_phrases_vote_around_their_rarest_word_only(spark):
    # 60 docs and 60 phrases of the same five common words, each with one word of its own
    common = "the of and to in"
    docs = spark.createDataFrame([("r", i, f"{common} own{i} {common}") for i in range(60)], "repo_id string, doc_id int, text string")
    asked = spark.createDataFrame([("r", i, f"{common} own{i} the") for i in range(60)], "repo_id string, query_id int, text string")
    found = search.score_bm25(search.build_index(docs, ["text"]), asked, "phrase")
    made = counted(found, "Join", "numOutputRows")
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(i, i) for i in range(60)]
    # 60 phrases of 7 words have 420 places; word by word it would be 60 x 60 x 13
    assert made and max(made) <= 11 * 60


def test_pairs_of_any_word_are_summed_where_they_arise(spark):
    # 400 docs and 40 queries share three words: 16,000 pairs, of which ten a query are wanted
    docs = spark.createDataFrame([("r", i, f"big red box own{i % 40}", "de" if i % 2 else "en") for i in range(400)], "repo_id string, doc_id int, text string, lang string")
    asked = spark.createDataFrame([("r", i, f"big red box own{i}", "de") for i in range(40)], "repo_id string, query_id int, text string, not_text string")
    index = search.build_index(docs, ["text", "lang"])
    for queries, step in ((asked.drop("not_text"), 40), (asked, 80)):
        ranked = search.rank_bm25(index, queries, 5, "any")
        assert max(counted(ranked, "Exchange", "shuffleRecordsWritten")) <= 400 * 5
        best = {(r.query_id, r.rank): r.doc_id for r in ranked.collect()}
        assert len(best) == 200
        # the docs with the query's own word, those in one language left out
        evens = [q for q in range(40) if step == 40 or q % 2 == 0]
        assert all(best[q, n] == q + 40 * (n - 1) for q in evens for n in range(1, 6))
        if step == 80:
            assert all(d % 2 == 0 for d in best.values())


def test_checks_join_only_the_probes_they_look_at(spark):
    # 100 statements on one table: one table, two column references and one comparison each
    log = spark.createDataFrame(
        [("r", i, f"select status, bogus from t where status = {i % 2}", None) for i in range(100)],
        "repo_id string, query_id int, sql string, tenant_context int",
    )
    known = {
        "tables": spark.createDataFrame([("r", "t", None, ["shipper"])], "repo_id string, name string, soft_delete_column string, dimension_fields array<string>"),
        "columns": spark.createDataFrame([("r", "t", "status", "E"), ("r", "t", "shipper", None)], "repo_id string, table_name string, name string, enum_class string"),
        "enums": spark.createDataFrame([("r", "E", "B")], "repo_id string, enum_class string, paradigm string"),
        "enum_values": spark.createDataFrame(
            [("r", "E", 1, "A", "one", None), ("r", "E", 1, "B", "own one", [7])],
            "repo_id string, enum_class string, code bigint, name string, meaning string, aggregators array<bigint>",
        ),
    }
    # the templates' join gives 100 rows; then come the probes of the kind alone
    for check, probes, found in (
        (grounding.check_missing_columns, 200, 100),
        (grounding.check_tenant_filter, 100, 100),
        (grounding.check_ambiguous_codes, 100, 50),
    ):
        rows = check(log, known)
        assert max(counted(rows, "Join", "numOutputRows")) <= probes, check.__name__
        assert rows.count() == found, check.__name__


def test_texts_are_cut_into_runs_of_the_needles_sizes(spark, monkeypatch):
    cut, runs = [], substring._all_grams
    monkeypatch.setattr(substring, "_all_grams", lambda text, sizes: cut.append(sizes) or runs(text, sizes))
    texts = spark.createDataFrame([("r", 1, "abcdef"), ("r", 2, "xbx"), ("r", 3, None)], "repo_id string, id int, hay string")

    def met(*needles):
        asked = spark.createDataFrame([("r", n) for n in needles], "repo_id string, needle string")
        found = substring.substring_pairs(texts, asked, "hay", "needle", ["repo_id"]).collect()
        return {(r.id, r.needle) for r in found}

    assert met("bcde", "def", "abd") == {(1, "bcde"), (1, "def")} and cut.pop() == [3]
    assert met("b", "ef", "xbx") == {(1, "b"), (2, "b"), (1, "ef"), (2, "xbx")} and cut.pop() == [1, 2, 3]
    assert met("") == set()


def test_prefixes_count_only_words_that_start_with_them(spark):
    docs = spark.createDataFrame([("r", i, " ".join(f"w{i}x{j}" for j in range(50)) + " redone redone redo") for i in range(40)], "repo_id string, doc_id int, text string")
    wanted = spark.createDataFrame([("r", "red")], "repo_id string, slot string")
    hits = search._slots_prefix(search.build_index(docs, ["text"]), wanted, None)
    made = counted(hits, "Aggregate", "numOutputRows")
    assert {r.tf for r in hits.collect()} == {3}
    # 40 docs; counted word by word it would be 40 x 52
    assert made and max(made) <= 40 * 2


def test_fields_of_a_text_with_the_marks_in_it(files):
    from semcat.operators import entities

    src = '@Table(name = "t")\n// import javax.persistence.Table; %s\npublic class T {\n@Column(name = "x")\nprivate Long x;\n@Column(name = "y%s")\nprivate Long y;\n}\n'
    tree = files({f"a/entity/T{i}.java": "import javax.persistence.Table;\nimport javax.persistence.Column;\n" + src % (m, m) for i, m in enumerate(("", "\u0002", "\u0003"))})
    read = entities.parse_entities(tree).select("source_file", F.transform("columns", lambda c: c["name"]).alias("n"))
    assert sorted(tuple(r.n) for r in read.collect()) == [("x", "y"), ("x", "y\u0002"), ("x", "y\u0003")]



def test_statements_are_cut_once(spark):
    log = spark.createDataFrame([(i, "r", f"select a from t where b = {i}") for i in range(20)], "query_id int, repo_id string, sql string")
    read = grounding.read_statements(log)
    plan = read._jdf.queryExecution().executedPlan().toString()
    # the log itself is not read again for the join with its templates
    assert "Scan parquet" in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan
    assert {(r.query_id, r.equalities[0].code) for r in read.collect()} == {(i, i) for i in range(20)}


def test_only_named_tables_are_built(files, monkeypatch):
    tree = files({"a/entity/T.java": 'import javax.persistence.Table;\n@Table(name = "t")\npublic class T {\n@Column(name = "x")\nprivate Long x;\n}\n'})
    written, stored = [], build.stored
    monkeypatch.setattr(build, "stored", lambda df: written.append(df) or stored(df))
    known = build.build_catalog(tree, store=True, names=("tables",))
    assert list(known) == ["tables"] and len(written) == 1
    assert [r.name for r in known["tables"].collect()] == ["t"]
    both = build.build_catalog(tree, store=True, names=("tables", "columns"))
    assert len(written) == 2 and "enum_class" not in both["columns"].columns
    # bindings are found once, for themselves and for the columns
    bound = build.build_catalog(tree, store=True)
    assert len(written) == 7 and "enum_class" in bound["columns"].columns
