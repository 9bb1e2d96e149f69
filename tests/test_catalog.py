"""Stored catalogs, reading of source trees, search, detail and comparison."""

import pytest
from pyspark.sql import functions as F

from semcat.plans import lineage
from semcat.operators import compare, lookup, search
from semcat.operators.substring import substring_pairs
from semcat.plans import build
from semcat.sources import catalog_store as store
from semcat.sources import files as src_files
from tests.test_entities import ORDER
from tests.test_enums import tree


@pytest.fixture(scope="module")
def catalog(files):
    both = files({"a/Order.java": ORDER, **tree()}).unionByName(files({"a/Order.java": ORDER}, "other"))
    return build.build_catalog(both, store=True)


def test_report_and_registry(catalog):
    report = {r.repo_id: r for r in build.extraction_report(catalog).collect()}
    assert (report["r"].tables, report["r"].enums, report["r"].i18n_keys, report["r"].warnings) == (1, 2, 2, 1)
    assert (report["other"].tables, report["other"].enums) == (1, 0)
    registry = build.repo_registry(catalog, root="/x")
    assert {r.repo_id: r.table_count for r in lookup.list_repos(registry).collect()} == {"r": 1, "other": 1}
    assert lookup.repo_status(registry, "r").count() == 1


def test_write_replace_and_remove(catalog, spark, tmp_path):
    path = str(tmp_path / "cat")
    full = {**catalog, "repos": build.repo_registry(catalog)}
    store.write_catalog(full, path)
    store.append_rows(build.no_meta(catalog["tables"]), path, "table_meta")
    first = store.read_catalog(spark, path, "r")
    assert first["enum_values"].count() == 6 and first["columns"].count() == 17
    # a second run in which the repo lost its enums
    again = {k: (v.filter("repo_id <> 'r'") if k.startswith("enum") else v) for k, v in full.items()}
    store.write_catalog(again, path)
    second = store.read_catalog(spark, path)
    assert second["tables"].count() == 2 and second["enum_values"].count() == 0
    left = store.remove_repo(second, "r")
    assert {r.repo_id for r in left["columns"].select("repo_id").collect()} == {"other"}
    store.delete_repo(spark, path, "r")
    third = store.read_catalog(spark, path)
    assert all(df.filter("repo_id = 'r'").count() == 0 for df in third.values())
    assert third["tables"].count() == 1


def test_numeric_repo_names_stay_text(spark, files, tmp_path):
    path = str(tmp_path / "cat")
    built = build.build_catalog(files({"a/Order.java": ORDER}, "007"))
    store.write_catalog({"tables": built["tables"]}, path)
    assert store.read_catalog(spark, path, "007")["tables"].first().repo_id == "007"


def test_read_source_tree(spark, tmp_path):
    (tmp_path / "dict" / "in" / "target").mkdir(parents=True)
    root = tmp_path / "dict"
    (root / "in" / "A.java").write_bytes(b"class A { } // \xff bad")
    (root / "in" / "target" / "B.java").write_text("class B {}")
    (root / "m.properties").write_text("a=b")
    (root / "n.txt").write_text("no")
    rows = {r.path: r.src for r in src_files.read_source_files(spark, str(root), "r").collect()}
    assert rows == {"in/A.java": "class A { } // � bad", "m.properties": "a=b"}


def test_read_domain_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "a_": "one",\n "b_": "two"\n}')
    rows = src_files.read_domain_map(spark, str(tmp_path / "m.json")).collect()
    assert {r.prefix: r.domain for r in rows} == {"a_": "one", "b_": "two"}


def queries(spark, *texts):
    rows = [("r", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "repo_id string, query_id int, text string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("r", 1, "red fish blue fish"), ("r", 2, "blue whale"), ("r", 3, "the redfish and a blue sky"),
        ("r", 4, "订单主表"), ("s", 1, "red"), ("r", 5, ""),
    ]
    return spark.createDataFrame(rows, "repo_id string, doc_id int, text string")


def hits(df):
    return {q: [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])] for q, rows in _by(df).items()}


def _by(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_search_modes(spark, docs):
    index = search.build_index(docs, ["text"], store=True)
    assert hits(search.rank_bm25(index, queries(spark, "Blue FISH", "sky absent", "主表"))) == {0: [1], 2: [4]}
    assert set(hits(search.rank_bm25(index, queries(spark, "fish whale"), mode="any"))[0]) == {1, 2}
    assert hits(search.rank_bm25(index, queries(spark, "blue fish", "fish fish"), mode="phrase")) == {0: [1]}
    assert set(hits(search.rank_bm25(index, queries(spark, "red bl"), mode="prefix"))[0]) == {1, 3}
    without = queries(spark, "blue").withColumn("not_text", F.lit("whale sky"))
    assert hits(search.rank_bm25(index, without)) == {0: [1]}
    assert len(hits(search.rank_bm25(index, queries(spark, "blue"), k=2))[0]) == 2
    with pytest.raises(ValueError):
        search.rank_bm25(index, queries(spark, "x"), mode="near")


def test_common_words_are_ranked_before_rounding(spark):
    # in every doc: the weight of the word is the least there is, only the length decides
    lengths = {1: 9, 2: 3, 3: 7, 4: 5}
    docs = spark.createDataFrame(
        [("r", d, " ".join(["common"] + ["x"] * n)) for d, n in lengths.items()],
        "repo_id string, doc_id int, text string",
    )
    asked = spark.createDataFrame([("r", "q", "common")], "repo_id string, query_id string, text string")
    ranked = search.rank_bm25(search.build_index(docs, ["text"]), asked)
    assert [r.doc_id for r in sorted(ranked.collect(), key=lambda r: r.rank)] == [2, 4, 3, 1]


def test_substring_against_brute_force(spark, docs):
    needles = ["ed", "e", "red", "blue fish", "", "absent", "主", "fish blue", "d f", "%", "a blue s"]
    given = spark.createDataFrame([("r", n) for n in needles], "repo_id string, needle string")
    found = substring_pairs(docs, given, "text", "needle", ["repo_id"])
    rows = docs.filter("repo_id = 'r'").collect()
    expected = {(r.doc_id, n) for r in rows for n in needles if n and n in r.text}
    assert {(r.doc_id, r.needle) for r in found.collect()} == expected


def test_search_tables_falls_back_and_filters_domain(spark, catalog):
    asked = queries(spark, "orders shops", "ders of sh", "100%")
    found = search.search_tables(catalog, asked)
    assert {(r.query_id, r.table_name, r.found_by) for r in found.collect()} == {
        (0, "shop_order", "rank"), (1, "shop_order", "substring"),
    }
    assert search.search_tables(catalog, asked, domain="02-act").count() == 0
    columns = search.search_columns(catalog, queries(spark, "who sends"))
    assert [r.column_name for r in columns.collect()] == ["shop_order.shipper"]
    enums = search.search_enums(catalog, queries(spark, "orderstate"))
    assert [r.enum_class for r in enums.collect()] == ["com.acme.dict.OrderState"]


def test_table_detail(spark, catalog):
    asked = spark.createDataFrame([("r", "shop_order"), ("r", "nope")], "repo_id string, table_name string")
    meta = spark.createDataFrame(
        [("r", "shop_order", "trap", "careful", "me", None)],
        "repo_id string, table_name string, kind string, content string, source string, updated_at timestamp",
    )
    rows = {r.table_name: r for r in lookup.table_detail({**catalog, "table_meta": meta}, asked).collect()}
    assert rows["nope"].error == "table nope not found"
    order = rows["shop_order"]
    assert [c["name"] for c in order["columns"]][13:] == ["status", "deleted", "shipper", "plain"]
    assert order.soft_delete_guidance == "live rows have deleted = 0"
    assert order.traps == ["careful"] and order.query_templates == [] and order.coverage == "human_curated"
    assert lookup.table_detail(catalog).count() == 2


def test_active_flag_advice(spark):
    tables = spark.createDataFrame(
        [("r", "t", "is_active", ["org_id"])],
        "repo_id string, name string, soft_delete_column string, dimension_fields array<string>",
    )
    row = lookup.guidance(tables).first()
    assert row.soft_delete_guidance == "live rows have is_active = 1"
    assert "org_id" in row.dimension_guidance


def test_enum_candidates(spark):
    columns = spark.createDataFrame(
        [("r", "t", "order_status", "Short", None), ("r", "t", "status", "Integer", "bound.Class"), ("r", "t", "kind", "Short", None), ("r", "u", "state", "int", None)],
        "repo_id string, table_name string, name string, type_raw string, enum_class string",
    )
    enums = spark.createDataFrame(
        [("r", f"p{i}.MyOrderStatus{i}", f"MyOrderStatus{i}") for i in range(5)] + [("r", "p.BillState", "BillState")],
        "repo_id string, enum_class string, short_name string",
    )
    found = lookup.enum_candidates(columns, enums).collect()
    assert sorted(r.enum_class for r in found if r.table_name == "t") == [f"p{i}.MyOrderStatus{i}" for i in range(3)]
    assert [r.enum_class for r in found if r.table_name == "u"] == ["p.BillState"]


def test_drift_and_diff(spark, catalog):
    actual = spark.createDataFrame(
        [("r", "shop_order", "status", "smallint"), ("r", "shop_order", "deleted", "string"), ("r", "shop_order", "fresh", "int")],
        "repo_id string, table_name string, name string, data_type string",
    )
    mined = catalog["columns"].filter("repo_id = 'r' and not from_base_entity")
    drift = compare.drift_check(mined, actual)
    assert {(r.name, r.change) for r in drift.collect()} == {
        ("deleted", "type_changed"), ("fresh", "added"), ("shipper", "removed"), ("plain", "removed"),
    }
    report = compare.drift_report(drift, "test").first()
    assert (report.added, report.removed, report.type_changed) == (1, 2, 1)
    rows = compare.schema_rows(spark.range(1).withColumn("Name", F.lit("x")), "r", "t").collect()
    assert [(r.name, r.data_type) for r in rows] == [("id", "bigint"), ("name", "string")]
    diff = {(r.catalog_table, r.change) for r in compare.repo_diff(catalog, "r", "other").collect()}
    assert diff == {("enums", "only_left"), ("enum_values", "only_left"), ("i18n_keys", "only_left")}


def test_diff_names_fields_and_pairs_renames(spark):
    value = "repo_id string, enum_class string, code bigint, name string, meaning string, aggregators array<bigint>"
    rows = [
        ("a", "E", 1, "ONE", "one", [2, 1]), ("b", "E", 1, "ONE", "one", [1, 2]),  # the order of a set
        ("a", "E", 2, "TWO", "two", None), ("b", "E", 2, "TWO", "pair", [7]),
        ("a", "E", 3, "OLD", "three", None), ("b", "E", 3, "NEW", "three", None),
        ("a", "E", 4, "P", "p", None), ("a", "E", 4, "Q", "q", None), ("b", "E", 4, "R", "r", None),
        ("a", "E", None, "NONE", "none", None), ("b", "E", None, "NONE", "none", None),  # null keys are equal
        ("a", "E", None, "GONE", None, None), ("b", None, None, "HERE", None, None),
    ]
    diff = compare.repo_diff({"enum_values": spark.createDataFrame(rows, value)}, "a", "b")
    found = {(r.item, r.change, tuple(r.fields or ()), r.renamed_to) for r in compare.pair_renames(diff).collect()}
    assert found == {
        ("E.2.TWO", "changed", ("meaning", "aggregators"), None),
        ("E.3.OLD", "renamed", (), "E.3.NEW"),
        ("E.4.P", "only_left", (), None), ("E.4.Q", "only_left", (), None), ("E.4.R", "only_right", (), None),
        ("E.GONE", "only_left", (), None), ("HERE", "only_right", (), None),
    }
    assert compare.pair_renames(diff.limit(0)).collect() == []


def test_drift_trend_follows_each_repo(spark):
    reports = spark.createDataFrame(
        [("r", "x", 2, 5, 1, 0), ("r", "x", 1, 3, 1, 2), ("r", "y", 1, 9, 9, 9), ("s", "x", 1, 0, 0, 0)],
        "repo_id string, source string, at int, added bigint, removed bigint, type_changed bigint",
    ).selectExpr("*", "timestamp_seconds(at) as checked_at").drop("at")
    rows = {(r.repo_id, r.source, r.check_no): (r.added_since, r.removed_since, r.type_changed_since)
            for r in compare.drift_trend(reports).collect()}
    none = (None, None, None)
    assert rows == {("r", "x", 1): none, ("r", "x", 2): (2, 0, -2), ("r", "y", 1): none, ("s", "x", 1): none}


def test_repo_without_rows_is_replaced_by_name(catalog, spark, tmp_path):
    path = str(tmp_path / "named")
    store.write_catalog(catalog, path)
    repo = catalog["tables"].first().repo_id
    none = {name: df.limit(0) for name, df in catalog.items()}
    store.write_catalog(none, path, [repo])
    left = store.read_catalog(spark, path, repo)
    assert left["tables"].count() == 0 and left["columns"].count() == 0


def test_run_folder_is_shared_and_removed(spark, monkeypatch):
    kept = lineage.stored(spark.range(3))
    assert kept.count() == 3
    folder = lineage.run_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    # a second run folder, so that results of other tests stay
    monkeypatch.setattr(lineage, "_RUNS", {})
    lineage.stored(spark.range(2))
    other = lineage.run_folder(spark)
    lineage.close(spark)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path) and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(other))


def test_detail_is_whole_and_says_what_was_guessed(spark):
    columns = spark.createDataFrame(
        [("r", "t", "status", "Short", "c.A"), ("r", "t", "kind", "Short", "c.B"), ("r", "t", "type", "Short", None)],
        "repo_id string, table_name string, name string, type_raw string, enum_class string",
    )
    bindings = spark.createDataFrame(
        [("r", "t", "status", "c.A", "curated"), ("r", "t", "kind", "c.B", "inferred")],
        "repo_id string, table_name string, name string, enum_class string, confidence string",
    )
    found = {r.name: r.confidence for r in lookup.bound_enums(columns, bindings).collect()}
    assert found == {"status": "declared", "kind": "inferred"}
    assert {r.confidence for r in lookup.bound_enums(columns).collect()} == {"declared"}
    many = spark.createDataFrame([("r", "a", f"c{i}", f"t{i}", "id", "fk", "inferred") for i in range(30)], "repo_id string, from_table string, from_column string, to_table string, to_column string, kind string, confidence string")
    enums = spark.createDataFrame([("r", f"c.OrderType{i}", f"OrderType{i}") for i in range(5)], "repo_id string, enum_class string, short_name string")
    catalog = {
        "tables": spark.createDataFrame([("r", "a", "p", None, [], "d")], "repo_id string, name string, purpose string, soft_delete_column string, dimension_fields array<string>, domain string"),
        "columns": spark.createDataFrame([("r", "a", "type", "Short", None, 1, False, True, "", False, False)], "repo_id string, table_name string, name string, type_raw string, enum_class string, ordinal int, is_pk boolean, is_nullable boolean, comment string, from_base_entity boolean, name_inferred boolean"),
        "enums": enums, "relations": many, "bindings": bindings,
        "table_meta": spark.createDataFrame([], "repo_id string, table_name string, kind string, content string, source string"),
    }
    row = lookup.table_detail(catalog).first()
    assert len(row.relations) == 30 and len(row.enum_bindings[0].enums) == 5
    row = lookup.table_detail(catalog, k_relations=20, k_candidates=3).first()
    assert len(row.relations) == 20 and len(row.enum_bindings[0].enums) == 3


def test_a_write_is_seen_whole_or_not_at_all(catalog, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "versions")
    store.write_catalog(catalog, path)
    before = store.read_catalog(spark, path)
    counts = {name: df.count() for name, df in before.items()}
    shorter = {name: df.filter("repo_id = 'other'") if name == "tables" else df for name, df in catalog.items()}
    written, real = [], store._written

    def killed(df, folder):
        if written:
            raise RuntimeError("killed between two tables")
        written.append(folder)
        return real(df, folder)

    with monkeypatch.context() as m:
        m.setattr(store, "_written", killed)
        with pytest.raises(RuntimeError):
            store.write_catalog(shorter, path)
    assert {name: df.count() for name, df in store.read_catalog(spark, path).items()} == counts
    # started again it succeeds, and readers of the old version are not disturbed
    store.write_catalog(shorter, path)
    assert store.read_catalog(spark, path)["tables"].count() == 1
    assert {name: df.count() for name, df in before.items()} == counts
    assert store.read_catalog(spark, path, version=1)["tables"].count() == counts["tables"]
    assert store.sweep(spark, path) > 0 and store.sweep(spark, path) == 0
    assert store.read_catalog(spark, path)["tables"].count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_catalog(spark, path, version=1)


def test_of_two_writers_one_fails(catalog, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "two")
    store.write_catalog({"tables": catalog["tables"]}, path)
    latest, stale = store._latest, store._latest(spark, path)
    store.append_rows(build.no_meta(catalog["tables"]), path, "table_meta")
    monkeypatch.setattr(store, "_latest", lambda *a: stale)
    with pytest.raises(Exception, match="(?i)exist"):
        store.write_catalog({"tables": catalog["tables"].limit(0)}, path)
    monkeypatch.setattr(store, "_latest", latest)
    assert store.read_catalog(spark, path)["tables"].count() == 2
