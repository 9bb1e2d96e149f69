"""Enums and message bundles."""

import pytest
from pyspark.sql import functions as F

from semcat.config import DEFAULTS
from semcat.functions.text import decode_escapes, parse_int_list, tokenize
from semcat.operators import enums as enu
from semcat.operators import lookup
from semcat.plans import build

SIMPLE = '''package com.acme.dict;
public enum BillState {
    OPEN((short) 1, "bill.open"),
    PAID(-7, "bill.paid") { int f() { return g(3, "no"); } },
    // OLD((short) 9, "bill.old"), aggregator
    LAST((Short)8, "bill.last");
    BillState(short s, String k) { this(4, "never"); }
}
'''
TENANT = '''package com.acme.dict;
public enum OrderState {
    NEW((short) 0, "new", "o.new", true, "s;x", null),
    STORED((short) 133, "STORED", "o.stored", true, "s", null),
    STORED_9((short) 133, "STORED", "o.stored9", true, "s", Sets.newHashSet(18325, 7)),
    ODD((short) 5, "only", Sets.newHashSet(A.B));
    private Set<Integer> aggregator;
}
'''
BUNDLE_A = "# c\n\nbill.open = Open\\u4e2d\nbill.paid=Paid\nno line\nbill.open=Opened"
BUNDLE_B = "bill.paid=Late\n"


def tree():
    return {
        "src/dict/BillState.java": SIMPLE,
        "src/dict/OrderState.java": TENANT,
        "src/other/BillState.java": SIMPLE,
        "res/messages_zh_CN_a.properties": BUNDLE_A,
        "res/messages_zh_CN_b.properties": BUNDLE_B,
        "res/messages_en.properties": "bill.paid=English",
    }


def test_simple_values(files):
    found = enu.extract_simple_values(files(tree())).orderBy("value_no").collect()
    assert [(r.name, r.code, r.message_key) for r in found] == [
        ("OPEN", 1, "bill.open"), ("PAID", -7, "bill.paid"), ("LAST", 8, "bill.last"),
    ]


def test_tenant_values(files):
    found = enu.extract_tenant_values(files(tree())).orderBy("value_no").collect()
    assert [(r.code, r.message_key, r.aggregators) for r in found] == [
        (0, "o.new", None), (133, "o.stored", None), (133, "o.stored9", [18325, 7]),
    ]


def test_comments_do_not_decide_the_kind(files):
    kinds = {r.enum_class: r.paradigm for r in enu.classify_paradigm(files(tree())).collect()}
    assert kinds == {"com.acme.dict.BillState": "A", "com.acme.dict.OrderState": "B"}
    compat = enu.parse_enums(files(tree()), DEFAULTS.with_(compat=True)).collect()
    assert {r.paradigm for r in compat} == {"B"}


def test_unreadable_tenants_are_reported(files):
    found = {(r.source_file, r.reason) for r in build.rejects(files(tree())).collect()}
    assert found == {("src/dict/OrderState.java", "unreadable tenant set")}


def test_last_message_wins(files):
    keys = {r.key: (r.value, r.bundle_file) for r in enu.latest_key(enu.parse_bundles(files(tree()))).collect()}
    assert keys == {
        "bill.open": ("Opened", "res/messages_zh_CN_a.properties"),
        "bill.paid": ("Late", "res/messages_zh_CN_b.properties"),
    }


def test_escapes(spark):
    cases = {
        r"a\u4e2d\u6587b": "a\u4e2d\u6587b",
        r"\ud83d\ude00!": "\U0001f600!",
        r"x\ud83dy": "x\ufffdy",
        r"a\tb\nc\\u0041": "a\tb\nc\\u0041",
        r"\x41": "A",
        r"bad \u12": r"bad \u12",
        "end\\": "end\\",
        "plain é": "plain é",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    found = {r.raw: r.value for r in rows.select("raw", decode_escapes(F.col("raw")).alias("value")).collect()}
    assert found == cases


def test_int_list(spark):
    row = spark.sql("select ' 18325, 7,x,-1, ,99999999999' as s").select(parse_int_list(F.col("s")).alias("v")).first()
    assert row.v == [18325, 7, 99999999999]


def test_tokens(spark):
    row = spark.sql("select '订单主表 Pcl_Order ÉTÉ naïve 9x 中' as s").select(tokenize(F.col("s")).alias("t")).first()
    assert row.t == ["订单", "单主", "主表", "pcl", "order", "ete", "naive", "9x", "中"]


def test_catalog_values_and_resolution(files, spark):
    catalog = build.build_catalog(files(tree()))
    requests = spark.createDataFrame([("r", "OrderState"), ("r", "com.acme.dict.BillState"), ("r", "Nope")], "repo_id string, request string")
    rows = lookup.resolve_enum(catalog, requests).collect()
    order = [r for r in rows if r.request == "OrderState"]
    assert [(r.code, r.aggregators, r.is_default) for r in order] == [(0, None, True), (133, None, True), (133, [18325, 7], False)]
    assert all(r.dimension_warning for r in order) and order[2].warning
    bill = [r for r in rows if r.request.endswith("BillState")]
    assert [(r.code, r.meaning) for r in bill] == [(-7, "Late"), (1, "Opened"), (8, "")]
    assert [r.error for r in rows if r.request == "Nope"] == ["enum Nope not found"]
    assert [(r.code, r.n_default, r.n_tenant) for r in lookup.divergent_codes(catalog["enum_values"]).collect()] == [(133, 1, 1)]


def test_dedupe_prefers_tenant_enums_then_more_values(files):
    small = "package p;\nenum E { A((short) 1, \"k\"); }"
    big = "package p;\nenum E { A((short) 1, \"k\"), B((short) 2, \"l\"); }"
    tenant = "package p;\nenum E { A((short) 1, \"n\", \"k\", null); Set<Integer> s; }"
    from semcat.operators.semantics import dedupe_enums

    def kept(tree):
        return dedupe_enums(enu.with_values(enu.parse_enums(files(tree)))).first().source_file

    assert kept({"a/dict/E.java": small, "b/dict/E.java": big}) == "b/dict/E.java"
    assert kept({"a/dict/E.java": big, "b/dict/E.java": tenant}) == "b/dict/E.java"
    assert kept({"b/dict/E.java": big, "a/dict/E.java": big}) == "a/dict/E.java"


def test_decode_codes(spark):
    values = spark.createDataFrame(
        [("r", "E", 1, "A", "plain", None), ("r", "E", 1, "B", "own", [5, 6]), ("r", "E", 2, "C", "two", None)],
        "repo_id string, enum_class string, code int, name string, meaning string, aggregators array<int>",
    )
    facts = spark.createDataFrame([(1, 1, 5), (2, 1, 9), (3, 2, 5), (4, 7, 5), (5, 1, None)], "id int, code int, tenant int")
    found = lookup.decode_codes(facts, "code", "tenant", values, "E").orderBy("id").collect()
    assert [(r.meaning, r.is_divergent) for r in found] == [
        ("own", True), ("plain", False), ("two", False), (None, False), ("plain", False),
    ]


def test_codes_are_met_within_repo_and_enum(spark):
    values = spark.createDataFrame(
        [("saas", "E", 1, "A", "open", None), ("fork", "E", 1, "A", "closed", None), ("saas", "F", 1, "A", "other", None)],
        "repo_id string, enum_class string, code bigint, name string, meaning string, aggregators array<bigint>",
    )
    facts = spark.createDataFrame(
        [("saas", "E", 1, 5), ("fork", "E", 1, 5), ("saas", "F", 1, 5), ("fork", "F", 1, 5)],
        "repo_id string, enum_class string, code bigint, tenant bigint",
    )
    found = lookup.decode_codes(facts, "code", "tenant", values).collect()
    assert {(r.repo_id, r.enum_class): r.meaning for r in found} == {
        ("saas", "E"): "open", ("fork", "E"): "closed", ("saas", "F"): "other", ("fork", "F"): None,
    }


def test_large_ids_are_kept(spark):
    row = spark.range(1).select(parse_int_list(F.lit("18325, 9000000000, x")).alias("ids")).first()
    assert row.ids == [18325, 9000000000]


@pytest.mark.parametrize("depth", [9, 50])
def test_constants_of_any_depth(files, depth):
    body = "{" * depth + " return 1; " + "}" * depth
    calls = "f(" * depth + "1" + ")" * depth
    src = f"""package com.acme.dict;
public enum DeepState {{
    A((short) 1, "a.a") {{ void f() {body} }},
    B((short) 2, "b.b", {calls}, Sets.newHashSet(7, 8)),
    C((short) 3, "c.c");
    private Set<Integer> aggregator;
    DeepState(int a) {{ this(9, "no"); }}
}}
"""
    found = enu.extract_tenant_values(files({"a/dict/DeepState.java": src})).collect()
    assert sorted((r.name, r.code, r.aggregators) for r in found) == [("A", 1, None), ("B", 2, [7, 8]), ("C", 3, None)]
