"""Extraction of tables and columns; one test per decision on odd sources."""

import pytest
from pyspark.sql import functions as F

from semcat.config import DEFAULTS
from semcat.operators import entities as ent
from semcat.operators import semantics as sem
from semcat.plans import build

HEAD = "package com.acme.shop;\nimport javax.persistence.Table;\n"
ORDER = HEAD + '''
@ApiModel("Orders of shops")
@Table(name = "Shop_Order")
public class ShopOrder extends BaseEntity {
    @ApiModelProperty("state of it")
    @Column(name = "status")
    private Short status;

    @ApiModelProperty("gone")
    @Column(name = "deleted")
    private Integer deleted;

    @ApiModelProperty("who sends")
    @Column(name = "shipper")
    private Integer shipper;

    @Column(name = "plain")
    private String plain;
}
'''


def entity(body, head='@Table(name = "t")\n', cls="class T"):
    return HEAD + head + f"public {cls} {{\n{body}\n}}\n"


def columns(files, body, settings=DEFAULTS, **kw):
    found = ent.extract_columns(files({"a/T.java": entity(body, **kw)}), settings)
    return {r.name: r for r in found.collect()}


def test_markers_and_build_output(files):
    tree = {"a/Order.java": ORDER, "x/target/Order.java": ORDER, "a/Foo.java": "class Foo {}", "a/o.txt": ORDER}
    assert [r.source_file for r in ent.extract_tables(files(tree)).collect()] == ["a/Order.java"]


def test_table_row(files):
    row = build.tables_of(build.annotate_entities(ent.parse_entities(files({"a/Order.java": ORDER})))).first()
    assert row.name == "shop_order"
    assert row.purpose == "Orders of shops"
    assert row.entity_class == "com.acme.shop.ShopOrder"
    assert row.extends_base is True
    assert row.soft_delete_column == "deleted"
    assert row.dimension_fields == ["aggregator", "shipper"]
    assert row.domain == "other"


def test_base_columns_come_first_and_ordinals_run(files):
    rows = ent.extract_columns(files({"a/Order.java": ORDER})).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, 18))
    assert [r.name for r in rows[:2]] == ["id", "site_id"]
    assert [r.name for r in rows[13:]] == ["status", "deleted", "shipper", "plain"]
    assert rows[0].is_pk and not rows[0].is_nullable and rows[0].from_base_entity


def test_comment_stays_with_its_field(files):
    rows = {r.name: r.comment for r in ent.extract_columns(files({"a/Order.java": ORDER})).collect()}
    assert rows["plain"] == ""
    leaky = ent.extract_columns(files({"a/Order.java": ORDER}), DEFAULTS.with_(compat=True))
    assert {r.name: r.comment for r in leaky.collect()}["plain"] == "who sends"


def test_own_column_hides_base_column(files):
    src = entity('@Column(name="operation")\nprivate String op;', cls="class T extends BaseEntity")
    rows = [r for r in ent.extract_columns(files({"a/T.java": src})).collect() if r.name == "operation"]
    assert len(rows) == 1 and not rows[0].from_base_entity


def test_table_name_at_any_attribute(files):
    src = entity("", head='@Table(uniqueConstraints = {@UniqueConstraint(name = "uk", columnNames = {"a", "b"})}, name = "T9")\n')
    assert ent.extract_tables(files({"a/T.java": src})).first().name == "t9"


def test_base_name_needs_a_word_end(files):
    src = entity("", cls="class T extends BaseEntityList")
    assert ent.extract_tables(files({"a/T.java": src})).first().extends_base is False


def test_comment_with_attribute_name(files):
    found = columns(files, '@ApiModelProperty(value = "a (b) c", hidden = true)\n@Column(name="x")\nprivate int x;')
    assert found["x"].comment == "a (b) c"


def test_modifiers_initialisers_and_packages(files):
    found = columns(
        files,
        '@Column(name="a")\nprivate final String a = "x;";\n'
        '@Column(name="b")\nprivate java.util.Map<String, List<Long>> b = new HashMap<>();\n'
        '@Column(name="c")\nprivate static int c;\n'
        '@Column(name="d")\nprivate byte[] d;\n'
        '@Column(name="e")\nprivate java.time.LocalDateTime e;',
    )
    assert set(found) == {"a", "b", "d", "e"}
    assert (found["a"].type_raw, found["a"].type) == ("String", "string")
    assert (found["b"].type_raw, found["b"].type) == ("java.util.Map", "unknown")
    assert found["d"].type == "blob" and found["e"].type == "datetime"


def test_inferred_columns(files):
    found = columns(
        files,
        '@ApiModelProperty("one")\nprivate Integer orderHTTPId2;\n'
        '@Transient\n@ApiModelProperty("no")\nprivate String scratch;\n'
        '@ApiModelProperty("no")\nprivate transient String gone;\n'
        'private String silent;\n'
        '@ApiModelProperty("dup")\n@Column(name="known")\nprivate String known;',
    )
    assert set(found) == {"order_http_id2", "known"}
    assert found["order_http_id2"].name_inferred and not found["known"].name_inferred


def test_primary_key_and_annotations_between(files):
    found = columns(files, '@Id\n@Column(name="k")\n@GeneratedValue(strategy = X, gen = "a)b")\n// note\nprivate Long k;')
    assert found["k"].is_pk and found["k"].is_nullable


def test_repeated_name_is_kept_once_and_reported(files):
    src = entity('@Column(name="x")\nprivate int a;\n@Column(name="X")\nprivate int b;')
    made = files({"a/T.java": src, "a/N.java": HEAD + '@Table(catalog="c")\nclass N {}'})
    assert [r.java_field for r in ent.extract_columns(made).collect()] == ["a"]
    assert {(r.source_file, r.reason) for r in build.rejects(made).collect()} == {
        ("a/T.java", "repeated column name"),
        ("a/N.java", "no table name"),
    }


def test_javadoc_purpose_and_class_fallback(files):
    src = "import javax.persistence.*;\n/**\n *  Line one \n * two\n */\n@Table(name=\"t\")\npublic interface X {}"
    row = ent.extract_tables(files({"d/My.File.java": src})).first()
    assert row.purpose == "Line one" and row.entity_class == "My.File"


def test_long_file_does_not_overflow(files):
    body = "\n".join(f'@ApiModelProperty("c{i}")\n@Column(name = "c{i}")\nprivate String f{i};' for i in range(4000))
    junk = "@X(" + "a" * 200_000
    assert ent.extract_columns(files({"a/T.java": entity(body + junk)})).count() == 4000


def test_dedupe_keeps_the_widest_then_the_first_file(files):
    one = entity('@Column(name="a")\nprivate int a;')
    two = entity('@Column(name="a")\nprivate int a;\n@Column(name="b")\nprivate int b;')
    made = files({"a/A.java": one, "b/B.java": two, "c/C.java": two})
    tables, cols = sem.dedupe_tables(ent.extract_tables(made), ent.extract_columns(made))
    assert [r.source_file for r in tables.collect()] == ["b/B.java"]
    assert cols.count() == 2


def test_longest_prefix_wins_in_both_forms(spark):
    tables = spark.createDataFrame([("pcl_packet_x",), ("pcl_x",), ("eto_kr_y",), ("q",)], "name string")
    expected = {"pcl_packet_x": "p", "pcl_x": "01", "eto_kr_y": "none", "q": "none"}
    domains = {"pcl_": "01", "pcl_packet_": "p"}
    as_table = spark.createDataFrame(list(domains.items()), "prefix string, domain string")
    for given in (domains, as_table):
        found = sem.assign_domain(tables, given, "none").collect()
        assert {r.name: r.domain for r in found} == expected


def test_flags_take_the_first_by_position(spark):
    cols = spark.createDataFrame(
        [("r", "t", "is_active", 3), ("r", "t", "deleted", 2), ("r", "t", "org_id", 5), ("r", "t", "shipper", 4), ("r", "u", "x", 1)],
        "repo_id string, table_name string, name string, ordinal int",
    )
    assert sem.detect_soft_delete(cols).first().soft_delete_column == "deleted"
    assert sem.detect_dimensions(cols).first().dimension_fields == ["shipper", "org_id"]


def test_relations_try_prefixes_in_order(spark):
    cols = spark.createDataFrame(
        [("r", "a", "order_id"), ("r", "a", "_id"), ("r", "a", "id"), ("r", "b", "none_id")],
        "repo_id string, table_name string, name string",
    )
    tables = spark.createDataFrame([("r", "sys_order"), ("r", "act_order"), ("s", "pcl_order")], "repo_id string, name string")
    found = sem.infer_relations(cols, tables).collect()
    assert [(r.from_table, r.from_column, r.to_table, r.to_column) for r in found] == [("a", "order_id", "act_order", "id")]


def test_bindings_by_trust(spark):
    cols = spark.createDataFrame(
        [("r", "pcl_order", "status", "Short"), ("r", "pcl_order", "pay_type", "Integer"), ("r", "pcl_order", "note", "String"), ("r", "x", "state", "int")],
        "repo_id string, table_name string, name string, type_raw string",
    )
    enums = spark.createDataFrame(
        [("r", "c.OrderStatus", "OrderStatus"), ("r", "c.PayType", "PayType"), ("r", "c.Note", "Note"), ("r", "a.State", "State"), ("r", "b.State", "State")],
        "repo_id string, enum_class string, short_name string",
    )
    curated = spark.createDataFrame([("r", "pcl_order", "pay_type", "c.Mine")], "repo_id string, table_name string, name string, enum_class string")
    found = {(r.table_name, r.name): (r.enum_class, r.confidence) for r in sem.bind_enums(cols, enums, curated).collect()}
    assert found == {
        ("pcl_order", "status"): ("c.OrderStatus", "inferred"),
        ("pcl_order", "pay_type"): ("c.Mine", "curated"),
    }


def test_no_shuffle_before_the_rows_are_there(files):
    plan = ent.extract_columns(files({"a/Order.java": ORDER}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_hidden_pushdown_does_not_repeat_the_extraction(files):
    found = ent.extract_columns(files({"a/Order.java": ORDER})).filter(F.col("type") == "string")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 1


def test_commented_out_code_names_nothing(files):
    body = """
    // @Column(name = "old_col")
    // private String oldCol;
    /* @Id */
    @Column(name = "new_col")
    private String newCol;
"""
    head = '// @Table(name = "dead")\n/** Entity class for orders */\n@Table(name = "live")\n'
    found = ent.extract_columns(files({"a/T.java": entity(body, head=head)})).collect()
    assert [(r.table_name, r.name, r.is_pk) for r in found] == [("live", "new_col", False)]
    row = ent.extract_tables(files({"a/T.java": entity(body, head=head)})).first()
    assert row.entity_class == "com.acme.shop.T" and row.purpose == "Entity class for orders"


def test_deep_nesting_is_read(files):
    body = """
    @Check(a(b(c(d(e("x"))))))
    @Column(name = "deep")
    private String deep;

    @ApiModelProperty("many levels")
    private Map<String, List<Map<String, List<Set<Long>>>>> wide;
"""
    assert set(columns(files, body)) == {"deep", "wide"}


@pytest.mark.parametrize("depth", [9, 50])
def test_any_depth_is_read(spark, files, depth):
    calls = "(" * depth + "1 + 2" + ")" * depth
    generics = "Map<String, " * depth + "Long" + ">" * depth
    braces = "{" * depth + '"}"' + "}" * depth
    body = f"""
    @Check(value = {calls}, text = "(((")
    @Column(name = "deep")
    private String deep;

    @ApiModelProperty("many levels")
    private {generics} wide;

    @Names({braces})
    @Column(name = "listed")
    private String listed;

    void method() {{ {"if (a) {" * depth} b(); {"}" * depth} }}

    @Column(name = "last")
    private Long last;
"""
    got = columns(files, body)
    assert set(got) == {"deep", "wide", "listed", "last"}
    assert got["wide"].type_raw.count("<") == got["wide"].type_raw.count(">") and "\ufdd0" not in str(got)


def test_unread_column_annotations_are_reported(spark, files):
    src = entity('@Column(name = "a") private Long a;\n @Column(name = "b") public Long getB() { return b; }\n String s = "@Column(";')
    found = build.rejects(files({"x/entity/A.java": src})).collect()
    assert [r.reason for r in found] == ["column annotation on no field"]
    assert build.rejects(files({"x/entity/A.java": entity('@Column(name = "a") private Long a;')})).count() == 0


def test_parent_is_read_from_the_declaration(spark, files):
    def extends(declaration):
        src = HEAD + f'@Table(name = "t")\npublic {declaration} {{ }}\n'
        return ent.extract_tables(files({"x/entity/A.java": src})).first().extends_base

    base = DEFAULTS.base_entity
    assert extends(f"class A extends {base}") and extends(f"class A<T extends Comparable<T>> extends com.x.{base}<T>")
    assert not extends("class A extends Other") and not extends(f"class A<T extends {base}> implements B")
    assert not extends(f"class A {{ class B extends {base} {{ }}")
