"""Reading and checking statements."""

import pytest

from semcat.config import DEFAULTS
from semcat.operators import grounding as g


@pytest.fixture(scope="module")
def catalog(spark):
    tables = spark.createDataFrame(
        [("r", "pcl_order", None, ["shipper", "aggregator"]), ("r", "act_bill", "deleted", []), ("r", "pcl_box", None, ["org_id"])],
        "repo_id string, name string, soft_delete_column string, dimension_fields array<string>",
    )
    named = {
        "pcl_order": ["id", "status", "shipper", "aggregator", "date_created"],
        "act_bill": ["id", "status", "deleted", "order_id", "amount"],
        "pcl_box": ["id", "org_id", "box_state"],
    }
    columns = spark.createDataFrame(
        [("r", t, c, "c.OrderStatus" if (t, c) == ("pcl_order", "status") else None) for t, cs in named.items() for c in cs],
        "repo_id string, table_name string, name string, enum_class string",
    )
    enums = spark.createDataFrame([("r", "c.OrderStatus", "B")], "repo_id string, enum_class string, paradigm string")
    values = spark.createDataFrame(
        [("r", "c.OrderStatus", 133, "A", "stored", None), ("r", "c.OrderStatus", 133, "B", "ordered", [18325]), ("r", "c.OrderStatus", 1, "C", "new", None)],
        "repo_id string, enum_class string, code int, name string, meaning string, aggregators array<int>",
    )
    return {"tables": tables, "columns": columns, "enums": enums, "enum_values": values}


def log(spark, *statements, context=None):
    rows = [(i, s, context) for i, s in enumerate(statements)]
    return spark.createDataFrame(rows, "query_id int, sql string, tenant_context int")


def audit(spark, catalog, sql, context=None, settings=DEFAULTS):
    row = g.audit_log(log(spark, sql, context=context), catalog, "r", settings).first()
    return row.verdict, sorted((c.kind, c.table_name, c.column_name) for c in row.checks), row


def refs(spark, sql):
    one = log(spark, sql)
    tables = [r.table_name for r in sorted(g.extract_table_refs(one).collect(), key=lambda r: r.pos)]
    columns = sorted((r.qualifier, r.column_name) for r in g.extract_column_refs(one).collect())
    return tables, columns


def test_worked_example(spark, catalog):
    verdict, checks, row = audit(spark, catalog, "SELECT status FROM pcl_order WHERE status = 133 AND deleted = 0")
    assert verdict == "FAIL"
    assert checks == [
        ("dimension_missing", "pcl_order", ""),
        ("enum_ambiguous", "pcl_order", "status"),
        ("soft_delete_misuse", "pcl_order", "deleted"),
    ]
    text = next(c for c in row.checks if c.kind == "enum_ambiguous")
    assert "'stored' by default and 'ordered' for tenants [18325]" in text.message
    assert text.fix.startswith("add AND aggregator = 18325")


def test_references(spark):
    assert refs(spark, "select a.x, `B`.`y` as z, count(*) n, c.* from `db`.`T1` a, t2 AS b left join t3 c on a.id = c.t_id where f(q) in (select w from t4 where k like '%from t9%') order by z, n -- from t8") == (
        ["t1", "t2", "t3", "t4"],
        [("", "k"), ("", "q"), ("", "w"), ("a", "id"), ("a", "x"), ("b", "y"), ("c", "*"), ("c", "t_id")],
    )
    assert refs(spark, "with w as (select a1 from base), v(x) as (select 2) select w.a1, y from w join v on w.a1 = v.x") == (
        ["base"], [("", "a1"), ("", "y"), ("v", "x"), ("w", "a1")],
    )
    assert refs(spark, "select extract(year from d), case when a then b else c end e1 from t where d > date '2020-01-01' and g is distinct from h") == (
        ["t"], [("", "a"), ("", "b"), ("", "c"), ("", "d"), ("", "g"), ("", "h")],
    )
    assert refs(spark, "update t set a = 1 where b = 2")[0] == ["t"]
    assert refs(spark, "insert into t (a, b) select c, d from u") == (["t", "u"], [("", "c"), ("", "d")])
    assert refs(spark, "delete from t where a = 'it''s -- not /* a comment'") == (["t"], [("", "a")])


def test_equalities(spark):
    one = log(spark, "select 1 from t where A = 5 and 6 = t.b and c in (7, '8') and d = 'x = 9' and e = 1.5 and f != 3 and g >= 4 and h not in (2) and j = '12'")
    found = sorted((r.qualifier, r.column_name, r.literal, r.code) for r in g.extract_equalities(one).collect())
    assert found == [
        ("", "a", "5", 5), ("", "c", "7", 7), ("", "c", "8", 8), ("", "d", "x = 9", None), ("", "j", "12", 12), ("t", "b", "6", 6),
    ]


def test_aliases_are_resolved(spark, catalog):
    sql = "select o.status, b.nope from pcl_order o join act_bill b on b.order_id = o.id where o.shipper = 1"
    assert audit(spark, catalog, sql)[:2] == ("FAIL", [("column_missing", "act_bill", "nope")])


def test_only_table_and_first_holder(spark, catalog):
    found = g.resolve_refs(log(spark, "select amount, status, nope from pcl_order, act_bill where box_state = 1"), catalog, "r")
    assert {(r.kind, r.column_name): r.table_name for r in found.collect()} == {
        ("column", "amount"): "act_bill", ("column", "status"): "pcl_order",
    }


def test_unqualified_code_belongs_to_the_first_holder(spark, catalog):
    first = audit(spark, catalog, "select 1 from pcl_order, act_bill where status = 133 and date_created > 1")
    assert ("enum_ambiguous", "pcl_order", "status") in first[1]
    second = audit(spark, catalog, "select 1 from act_bill, pcl_order where status = 133 and date_created > 1")
    assert ("enum_ambiguous", "pcl_order", "status") not in second[1]
    one_by_one = g.check_ambiguous_codes(log(spark, "select 1 from act_bill, pcl_order where status = 133"), catalog, "r")
    assert one_by_one.count() == 0


def test_pinned_tenant_is_silent_unless_compatible(spark, catalog):
    sql = "select id from pcl_order where status = 133 and aggregator = 18325"
    assert audit(spark, catalog, sql)[:2] == ("PASS", [])
    verdict, checks, _ = audit(spark, catalog, sql, settings=DEFAULTS.with_(compat=True))
    assert checks == [("dimension_missing", "pcl_order", ""), ("enum_ambiguous", "pcl_order", "status")]


def test_tenant_context_in_the_message(spark, catalog):
    sql = "select id from pcl_order where status in (1, 133) and shipper > 0"
    for context, meaning in ((18325, "ordered"), (0, "stored")):
        _, checks, row = audit(spark, catalog, sql, context)
        assert checks == [("enum_ambiguous", "pcl_order", "status")]
        assert row.checks[0].message.endswith(f"for tenant {context} it means '{meaning}'")


def test_tenant_filter_modes(spark, catalog):
    selected = "select shipper, aggregator from pcl_order where id = 1"
    assert audit(spark, catalog, selected)[1] == [("dimension_missing", "pcl_order", "")]
    assert audit(spark, catalog, selected, settings=DEFAULTS.with_(compat=True))[1] == []
    star = "select * from pcl_order"
    assert audit(spark, catalog, star)[1] == [("dimension_missing", "pcl_order", "")]
    assert audit(spark, catalog, star, settings=DEFAULTS.with_(compat=True))[1] == []
    wrong = "select o.id from pcl_order o join pcl_box x on o.id = x.id where x.org_id = 4"
    assert audit(spark, catalog, wrong)[1] == [("dimension_missing", "pcl_order", "")]


def test_soft_delete_advice(spark, catalog):
    _, checks, row = audit(spark, catalog, "select id from act_bill where is_deleted = 0")
    assert checks == [("soft_delete_misuse", "act_bill", "is_deleted")]
    assert row.checks[0].fix == "filter by deleted = 0"


def test_unknown_tables_and_repeats(spark, catalog):
    one = log(spark, "select x, x from gone where x = 1")
    assert [r.table_name for r in g.unknown_tables(one, catalog, "r").collect()] == ["gone"]
    assert audit(spark, catalog, "select nope, nope from act_bill where nope > 1")[1] == [("column_missing", "act_bill", "nope")]
    assert audit(spark, catalog, "select x from gone")[:2] == ("PASS", [])


def test_derived_tables_do_not_mislead(spark, catalog):
    sql = "select s.total from (select sum(amount) as total from act_bill) s where s.total > 3"
    assert audit(spark, catalog, sql)[:2] == ("PASS", [])
    cte = "with s as (select sum(amount) total from act_bill) select total from s"
    assert audit(spark, catalog, cte)[:2] == ("PASS", [])


@pytest.mark.parametrize("sql", ["select (a from t", "select 'a from t", "", None, "drop everything"])
def test_unreadable(spark, catalog, sql):
    verdict, checks, _ = audit(spark, catalog, sql)
    assert verdict == "WARN" and [c[0] for c in checks] == ["parse_error"]


def test_select_without_table_passes(spark, catalog):
    assert audit(spark, catalog, "select 1 + 1")[:2] == ("PASS", [])


def test_parts_agree_with_the_whole(spark, catalog):
    one = log(
        spark,
        "select nope from pcl_order where status = 133",
        "select id from act_bill where deleted = 0",
        "select deleted from pcl_box where org_id = 1",
        "select (",
    )
    parts = [f(one, catalog, "r") for f in (g.check_missing_columns, g.check_soft_delete, g.check_ambiguous_codes, g.check_tenant_filter)]
    union = parts[0]
    for part in [*parts[1:], g.unreadable(one, "r")]:
        union = union.unionByName(part)
    whole = g.audit_log(one, catalog, "r")
    assert sorted(map(tuple, union.collect())) == sorted(map(tuple, g.audit_checks(whole).collect()))
    assert {r.query_id: r.verdict for r in g.verdicts(one, union).collect()} == {
        r.query_id: r.verdict for r in whole.collect()
    } == {0: "FAIL", 1: "PASS", 2: "FAIL", 3: "WARN"}


def test_log_without_repo_needs_one(spark, catalog):
    with pytest.raises(ValueError):
        g.audit_log(log(spark, "select 1"), catalog)


def test_quoted_and_soft_words_are_names(spark):
    assert refs(spark, "select `key`, t.`order`, `offset` from `order` t where `key` = 3") == (
        ["order"], [("", "key"), ("", "offset"), ("t", "order")],
    )
    assert refs(spark, "select t.offset, t.share, first from orders t where t.next = 1 order by t.key nulls last limit 5 offset 10") == (
        ["orders"], [("", "first"), ("t", "key"), ("t", "next"), ("t", "offset"), ("t", "share")],
    )
    one = log(spark, "select `key` from `order` t where `key` = 3 and t.next = 1 and 状态 = 2")
    assert sorted((r.qualifier, r.column_name, r.code) for r in g.extract_equalities(one).collect()) == [
        ("", "key", 3), ("", "状态", 2), ("t", "next", 1),
    ]
    assert g.unreadable(one).count() == 0
    assert refs(spark, "select 名称, b.状态 from 订单 b where 状态 = 1") == (["订单"], [("", "名称"), ("", "状态"), ("b", "状态")])


def test_tables_after_a_subquery(spark):
    assert refs(spark, "select * from (select id from a) x, secret where secret.q = 1") == (
        ["a", "secret"], [("", "id"), ("secret", "q")],
    )
    nested = "select f(a, b), c from (select id, n from (select 1 from d) y, e z where g in (1, 2)) x, h, i j order by k, l"
    assert refs(spark, nested)[0] == ["d", "e", "h", "i"]
    assert refs(spark, "select 1 from a join b on a.x = b.x, c where c.y = 1")[0] == ["a", "b", "c"]
    assert refs(spark, "select (a is distinct from b), c, d from t")[0] == ["t"]


def test_a_pin_belongs_to_its_table(spark, catalog):
    pinned = "select o.id from pcl_order o join act_bill b on o.id = b.id where o.status = 133 and {}"
    assert ("enum_ambiguous", "pcl_order", "status") in audit(spark, catalog, pinned.format("b.aggregator = 7"))[1]
    assert audit(spark, catalog, pinned.format("o.aggregator = 7"))[:2] == ("PASS", [])
    assert audit(spark, catalog, pinned.format("aggregator = 7"))[1] == []


def test_a_join_carries_a_pin_but_makes_none(spark, catalog):
    joined = "select o.id from pcl_order o join pcl_order p on o.aggregator = p.aggregator join pcl_box x on x.org_id = p.aggregator{}"
    assert audit(spark, catalog, joined.format(""))[1] == [("dimension_missing", "pcl_box", ""), ("dimension_missing", "pcl_order", "")]
    assert audit(spark, catalog, joined.format(" where o.aggregator = 7"))[:2] == ("PASS", [])


def test_ids_belong_to_their_repo_and_text(spark, catalog):
    one = spark.createDataFrame(
        [("r", 1, "select nope from act_bill"), ("s", 1, "select nope from act_bill"), ("r", 1, "select id from act_bill"), ("r", 1, "select nope from act_bill")],
        "repo_id string, query_id int, sql string",
    )
    found = g.audit_log(one, catalog)
    assert sorted((r.repo_id, r.query_id, r.verdict, r.n_checks) for r in found.collect()) == [
        ("r", 1, "FAIL", 1), ("r", 1, "FAIL", 1), ("r", 1, "PASS", 0), ("s", 1, "PASS", 0),
    ]
    assert g.resolve_refs(one, catalog).count() == 4


def test_no_join_meets_a_null_key(spark, catalog):
    one = log(spark, *["select (", "select status from pcl_order where status = 133 and id = 'x'"])
    probes = g.probe_statements(g.read_statements(one, "r"), False)
    keyed = probes.select(g._met_or_spread("table_name").alias("t"), g._met_or_spread("column_name").alias("c"))
    assert keyed.filter("t is null or c is null").count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = g.audit_log(one, catalog, "r")._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Join LeftOuter" in line for line in plan.splitlines() if "_table" in line or "_class" in line) >= 3
        assert g.audit_log(one, catalog, "r").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_any_quoted_name(spark):
    assert refs(spark, "select * from `my-table` where `a b` = 3") == (["my-table"], [("", "a b")])
    assert refs(spark, "select `x.y`.`select`, `t 1` . `from` from `db`.`x.y` join `t 1` on `x.y`.`id` = `t 1`.`id`") == (
        ["x.y", "t 1"], [("t 1", "from"), ("t 1", "id"), ("x.y", "id"), ("x.y", "select")],
    )
    found = g.extract_equalities(log(spark, "select 1 from `t-1` where `a b` = 3 and `t-1`.`in` in (4, '5')")).collect()
    assert sorted((r.qualifier, r.column_name, r.code) for r in found) == [("", "a b", 3), ("t-1", "in", 4), ("t-1", "in", 5)]


def test_merge(spark, catalog):
    merge = "merge into t using u on t.id=u.id when matched then update set t.a=u.a"
    assert refs(spark, merge) == (["t", "u"], [("t", "a"), ("t", "id"), ("u", "a"), ("u", "id")])
    longer = (
        "MERGE INTO act_bill AS b USING (select id, status from pcl_order where shipper = 3) s ON (b.order_id = s.id) "
        "WHEN MATCHED AND b.amount > 5 THEN DELETE WHEN NOT MATCHED THEN INSERT (id, amount) VALUES (s.id, s.status)"
    )
    assert refs(spark, longer) == (
        ["act_bill", "pcl_order"],
        [("", "id"), ("", "shipper"), ("", "status"), ("b", "amount"), ("b", "order_id"), ("s", "id"), ("s", "status")],
    )
    assert audit(spark, catalog, longer)[:2] == ("PASS", [])
    assert audit(spark, catalog, "merge into act_bill using pcl_box x on act_bill.id = x.id and x.org_id = 3 when matched then update set amount = 1")[0] == "PASS"
    # a column may be named so
    assert refs(spark, "select matched, merge from t where matched = 1")[1] == [("", "matched"), ("", "merge")]


def test_delete_and_update_forms(spark):
    assert refs(spark, "delete a from a join b on a.id = b.a_id where b.x = 1") == (
        ["a", "b"], [("a", "id"), ("b", "a_id"), ("b", "x")],
    )
    assert refs(spark, "delete from a using a, b where a.id = b.id")[0] == ["a", "b"]
    assert refs(spark, "update a join b on a.id = b.id set a.x = b.y where b.z = 1") == (
        ["a", "b"], [("a", "id"), ("a", "x"), ("b", "id"), ("b", "y"), ("b", "z")],
    )
    assert refs(spark, "insert into t (a, b) values (1, 2) on duplicate key update a = values(a), c = c + 1") == (
        ["t"], [("", "a"), ("", "c")],
    )
    assert refs(spark, "select a from t where x = :a and y = @b and z = ? for update") == (
        ["t"], [("", "a"), ("", "x"), ("", "y"), ("", "z")],
    )


def test_aliases_belong_to_their_query(spark, catalog):
    # the inner o is another table
    sql = "select o.status from pcl_order o where o.shipper = 1 and exists (select 1 from act_bill o where o.amount > 3 and o.status = 2)"
    assert audit(spark, catalog, sql)[:2] == ("PASS", [])
    wrong = "select o.status from pcl_order o where o.shipper = 1 and exists (select 1 from act_bill o where o.shipper > 3)"
    assert audit(spark, catalog, wrong)[:2] == ("FAIL", [("column_missing", "act_bill", "shipper")])
    # an outer column without a qualifier cannot be the inner table's
    outer = "select amount from pcl_order where shipper = 1 and id in (select order_id from act_bill)"
    assert audit(spark, catalog, outer)[:2] == ("FAIL", [("column_missing", "pcl_order", "amount")])
    inner = "select id from pcl_order where shipper = 1 and id in (select order_id from act_bill where status = 1)"
    assert audit(spark, catalog, inner)[:2] == ("PASS", [])
    union = "select date_created from pcl_order where shipper = 2 union all select amount from act_bill union select org_id from pcl_box where org_id = 1"
    assert audit(spark, catalog, union)[:2] == ("PASS", [])
    # a pin inside an exists belongs to the table there
    pin = "select id from pcl_order where exists (select 1 from pcl_box where org_id = 3)"
    assert audit(spark, catalog, pin)[1] == [("dimension_missing", "pcl_order", "")]


def test_a_column_may_come_from_a_subquery(spark, catalog):
    sql = "select b.id, total from act_bill b join (select * from gone) s on s.id = b.id"
    assert audit(spark, catalog, sql)[:2] == ("PASS", [])


def test_templates_read_as_each_statement_does(spark, catalog):
    rows = [
        "select id from pcl_order where status = 133 and shipper = 1",
        "SELECT id  FROM pcl_order -- the same\nWHERE status = 1 AND shipper = 'x''y'",
        "select id from pcl_order where status = '133' and shipper = 2",
        "select id from pcl_order where status = 133.5 and shipper = 2",
        "select id from pcl_order where status in (1, 133) and shipper = 2",
        "select id from pcl_order where status in (133, 133, '1') and shipper = 2",
        "select id from pcl_order where status in (133, 133, '1') and shipper = 2",
        "select 'from t9', 1e5 from act_bill where 7 = status and amount = \"it\"",
        "", None, "select (", "select 'a",
    ]
    one = log(spark, *rows)
    parts = ("tables", "columns", "predicates", "equal", "equalities", "reason")
    apart = g.read_statements(one, "r", parts, by_template=False)
    both = [sorted(map(repr, g.read_statements(one, "r", parts).select(apart.columns).collect())), sorted(map(repr, apart.collect()))]
    assert both[0] == both[1] and len(both[0]) == len(rows)
    codes = {r.query_id: sorted(e.literal for e in r.equalities) for r in apart.collect()}
    assert codes[1] == ["1", "x''y"] and codes[3] == ["2"] and codes[5] == ["1", "133", "2"] and codes[7] == ["7", "it"]


def test_deep_statements_are_read_in_one_pass(spark):
    deep = "select a from t where " + "(" * 200 + "b = 1" + ")" * 200 + " and c in (select d from u where " + "f(" * 60 + "e" + ")" * 60 + " = 2)"
    assert refs(spark, deep) == (["t", "u"], [("", "a"), ("", "b"), ("", "c"), ("", "d"), ("", "e")])
    wide = "select " + ", ".join(f"c{i}" for i in range(600)) + " from t where " + " and ".join(f"a{i} = b{i}" for i in range(150))
    tables, columns = refs(spark, wide)
    assert tables == ["t"] and len(columns) == 900
