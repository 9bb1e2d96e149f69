"""Source files, messages, query logs and facts, made from the given tables.

Everything is a column expression over a given table, so inputs grow with the
tables and the same rows state the expected result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semcat.functions.rows import exploded

REPO = "saas"
FORK = "fork"
BUCKET = 40
# tables whose rows become source files, messages, statements and search texts
COSTLY = ("part", "customer", "events", "documents", "benchmark")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; texts and the like are made from its rows, so few large splits are dealt over all cores."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in COSTLY and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores)
    return table


def prefix_of(key: Column) -> Column:
    """Table prefix of a part; the last one belongs to no domain."""
    return F.element_at(
        F.array(*[F.lit(p) for p in ("pcl_", "act_", "sys_", "trk_", "zz_")]),
        (key % 5 + 1).cast("int"),
    )


def table_of(key: Column) -> Column:
    return F.concat(prefix_of(key), F.lit("part_"), key.cast("string"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def entity_sources(part: DataFrame, repo_id: str = REPO) -> DataFrame:
    """One entity file per part, plus a smaller twin, a build copy and a helper for some."""
    key, size = F.col("p_partkey"), F.col("p_size")

    def only(test: Column, text: Column) -> Column:
        return F.when(test, text).otherwise("")

    def column(name: str | Column, java_type: str, java_field: str, comment=None) -> Column:
        note = (
            _text('    @ApiModelProperty("', comment, '")\n') if comment is not None else F.lit("")
        )
        return _text(note, '    @Column(name = "', name, f'")\n    private {java_type} {java_field};\n\n')

    head = _text(
        "package com.shop.m", key % 10, ".entity;\n\n",
        "import javax.persistence.Table;\nimport javax.persistence.Column;\n\n",
        only(size % 4 == 0, _text("/**\n * ", F.col("p_brand"), " made by hand\n * second line\n */\n")),
        only(size % 5 != 0, _text('@ApiModel("', F.col("p_name"), '")\n')),
    )
    table = F.when(
        key % 4 == 0, _text('@Table(catalog = "main", name = "', F.initcap(table_of(key)), '")\n')
    ).otherwise(_text('@Table(name = "', F.upper(table_of(key)), '")\n'))
    opening = _text(
        "public class Part", key, only(size % 2 == 0, F.lit(" extends BaseEntity")), " {\n\n",
        "    private static final long serialVersionUID = 1L;\n\n",
    )
    body = _text(
        '    @Id\n    @Column(name = "part_key")\n    private Long partKey;\n\n',
        column("status", "Short", "status", F.col("p_type")),
        _text(
            '    @ApiModelProperty(value = "', F.col("p_brand"), '", required = true)\n',
            '    @Column(nullable = false, name = "BRAND_NAME")\n    @Size(max = 30)\n',
            '    private final String brandName = "none";\n\n',
        ),
        column("retail_price", "java.math.BigDecimal", "retailPrice"),
        only(size % 7 == 0, column("deleted", "Integer", "deleted", "is it gone")),
        only(size % 3 == 0, column("shipper", "Integer", "shipper", "who ships")),
        only(size % 10 == 0, column("operation", "String", "operation", "own operation")),
        only(
            key > 0,
            column(_text("part_", key - 1, "_id"), "Long", "previousId", "the part before"),
        ),
        _text('    @ApiModelProperty("made of ', F.col("p_name"), '")\n    private List<String> madeOf;\n\n'),
        '    @ApiModelProperty("last shipped")\n    @JsonFormat(pattern = "yyyy")\n    private Date lastShipDate;\n\n',
        '    @Transient\n    @ApiModelProperty("scratch")\n    private String scratch;\n}\n',
    )
    small = _text(
        "package com.shop.vo;\n\nimport javax.persistence.Table;\n\n",
        table, "public class Part", key, 'Vo {\n    @Column(name = "status")\n    private Short status;\n}\n',
    )
    place = _text("src/main/java/com/shop/m", key % 10, "/entity/Part", key, ".java")
    main = F.struct(place.alias("path"), _text(head, table, opening, body).alias("src"))
    twin = F.struct(
        _text("src/main/java/com/shop/vo/Part", key, "Vo.java").alias("path"), small.alias("src")
    )
    built = F.struct(
        _text("mod/target/gen/Part", key, ".java").alias("path"),
        _text(head, table, opening, body).alias("src"),
    )
    helper = F.struct(
        _text("src/main/java/com/shop/util/Helper", key, ".java").alias("path"),
        _text("package com.shop.util;\n\npublic class Helper", key, " {}\n").alias("src"),
    )
    nameless = F.struct(
        _text("src/main/java/com/shop/raw/Raw", key, ".java").alias("path"),
        _text(
            "package com.shop.raw;\nimport javax.persistence.Table;\n@Table(catalog = \"x\")\n",
            "public class Raw", key, " {}\n",
        ).alias("src"),
    )
    none = F.expr("cast(array() as array<struct<path:string,src:string>>)")
    files = F.concat(
        F.array(main),
        F.when(size == 1, F.array(twin)).otherwise(none),
        F.when(size == 2, F.array(built)).otherwise(none),
        F.when(size == 3, F.array(helper)).otherwise(none),
        F.when(size == 4, F.array(nameless)).otherwise(none),
    )
    return exploded(part, files, F.lit(repo_id).alias("repo_id"), value="f").select(
        "repo_id", "f.path", "f.src"
    )


def _bucketed(customer: DataFrame) -> DataFrame:
    """Customers in runs of ``BUCKET``; a run is never larger than that."""
    return customer.withColumn("b", F.expr(f"c_custkey div {BUCKET}"))


def enum_sources(customer: DataFrame, repo_id: str = REPO) -> DataFrame:
    """One enum per run of customers, a constant per customer; old copies for some.

    Every third enum has one meaning per code; in the others customers of one
    segment have a tenant set of two nations.
    """
    key = F.col("c_custkey")
    simple = _text("    CUST_", key, "((short) ", key % 200, ', "cust.', key, '")')
    tenant_set = F.when(
        F.col("c_mktsegment") == "BUILDING",
        _text("Sets.newHashSet(", F.col("c_nationkey"), ", ", F.col("c_nationkey") + 1000, ")"),
    ).otherwise(F.lit("null"))
    tenant = _text(
        "    CUST_", key, "((short) ", key % 20, ', "', F.col("c_name"), '", "cust.', key,
        '", true, "stat;x", ', tenant_set, ")",
    )
    line = F.when(F.col("b") % 3 == 0, simple).otherwise(tenant)
    runs = (
        _bucketed(customer)
        .groupBy("b")
        .agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), line.alias("line")))).alias("ls"))
    )
    b = F.col("b")
    constants = F.array_join(F.transform("ls", lambda x: x["line"]), ",\n")
    head = F.lit("package com.shop.dict;\n\n")
    fields = F.when(
        b % 3 == 0,
        F.when(b % 2 == 0, F.lit("    // no aggregator here: Set<Integer>\n"))
        .otherwise("")
    ).otherwise("    private Set<Integer> aggregator;\n")
    source = _text(
        head, "public enum Status", b, " {\n", constants, ";\n\n    private Short status;\n",
        fields, "    Status", b, '(Short status, String key) {\n        call(7, "x");\n    }\n}\n',
    )
    files = F.concat(
        F.array(
            F.struct(_text("src/main/java/com/shop/dict/Status", b, ".java").alias("path"), source.alias("src"))
        ),
        F.transform(
            F.filter(F.array(b), lambda x: x % 5 == 0),
            lambda x: F.struct(
                _text("old/dict/Status", x, ".java").alias("path"),
                _text(head, "public enum Status", x, ' {\n    OLD((short) 1, "old.key");\n}\n').alias("src"),
            ),
        ),
        F.transform(
            F.filter(F.array(b), lambda x: x % 4 == 0),
            lambda x: F.struct(
                _text("src/main/java/com/shop/dict/Empty", x, ".java").alias("path"),
                _text(head, "public enum Empty", x, " {\n    A, B;\n}\n").alias("src"),
            ),
        ),
    )
    return exploded(runs, files, F.lit(repo_id).alias("repo_id"), value="f").select(
        "repo_id", "f.path", "f.src"
    )


def bundle_sources(customer: DataFrame, repo_id: str = REPO) -> DataFrame:
    """Messages of the enum constants, with repeats in the same and in a later file."""
    key, name = F.col("c_custkey"), F.col("c_name")
    plain = _text("cust.", key, " = ", name, " \\u00e9\\ud83d\\ude00")
    again = _text("cust.", key, "=", name, " second")
    later = _text("cust.", key, "=", name, " third")
    runs = (
        _bucketed(customer)
        .groupBy("b")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        key.alias("k"),
                        plain.alias("plain"),
                        F.when(key % 10 == 0, again).alias("again"),
                        F.when(key % 25 == 0, later).alias("later"),
                    )
                )
            ).alias("ls")
        )
    )
    lines = F.concat(
        F.array(F.lit("# messages"), F.lit(""), F.lit("not a message")),
        F.transform("ls", lambda x: x["plain"]),
        F.filter(F.transform("ls", lambda x: x["again"]), lambda x: x.isNotNull()),
    )
    late = F.filter(F.transform("ls", lambda x: x["later"]), lambda x: x.isNotNull())
    files = F.array(
        F.struct(
            _text("res/messages_zh_CN_", F.col("b"), ".properties").alias("path"),
            F.array_join(lines, "\r\n").alias("src"),
        ),
        F.struct(
            _text("res/messages_zh_CN_late_", F.col("b"), ".properties").alias("path"),
            F.array_join(late, "\n").alias("src"),
        ),
    )
    return exploded(runs, files, F.lit(repo_id).alias("repo_id"), value="f").select(
        "repo_id", "f.path", "f.src"
    )


def document_bundles(documents: DataFrame, repo_id: str = REPO) -> DataFrame:
    """One bundle per document; its whole text escaped into one value."""
    text = F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    runs = F.regexp_extract_all(text, F.lit(r"(?s)[^\x00-\x7f]+|[\x00-\x7f]+"), F.lit(0))
    escaped = F.array_join(
        F.transform(
            runs,
            lambda r: F.when(r.rlike(r"^[\x00-\x7f]"), r).otherwise(
                F.regexp_replace(F.hex(F.encode(r, "UTF-16BE")), F.lit("(....)"), F.lit(r"\\u$1"))
            ),
        ),
        "",
    )
    return documents.select(
        F.lit(repo_id).alias("repo_id"),
        _text("res/messages_zh_CN_doc", F.col("doc_id"), ".properties").alias("path"),
        _text("! old style\ndoc.", F.col("doc_id"), ".", F.col("lang"), " = ", escaped, "\n").alias("src"),
    )


def source_tree(spark: SparkSession, sf_dir: str, repo_id: str = REPO) -> DataFrame:
    """Entities, enums and bundles of one repo."""
    customer = load(spark, sf_dir, "customer")
    return (
        entity_sources(load(spark, sf_dir, "part"), repo_id)
        .unionByName(enum_sources(customer, repo_id))
        .unionByName(bundle_sources(customer, repo_id))
    )


def bindings(part: DataFrame, repo_id: str = REPO) -> DataFrame:
    """Curated enum of each part table's status column."""
    key = F.col("p_partkey")
    return part.select(
        F.lit(repo_id).alias("repo_id"),
        table_of(key).alias("table_name"),
        F.lit("status").alias("name"),
        _text("com.shop.dict.Status", F.expr(f"p_partkey div {BUCKET}")).alias("enum_class"),
    )


def notes(part: DataFrame, repo_id: str = REPO) -> DataFrame:
    """Curated notes on some tables."""
    key = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 2 == 0, "trap").otherwise("query_template")
    return part.filter(F.col("p_size") % 6 < 2).select(
        F.lit(repo_id).alias("repo_id"),
        table_of(key).alias("table_name"),
        kind.alias("kind"),
        _text("note on ", F.col("p_name")).alias("content"),
        F.lit("team").alias("source"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def query_log(events: DataFrame, repo_id: str = REPO) -> DataFrame:
    """One statement per event; its shape follows the event's type."""
    user, kind = F.col("user_id"), F.col("event_type")
    table = table_of(user)
    sql = (
        F.when(
            kind == "view",
            _text(
                "SELECT t.status, t.brand_name FROM `", F.upper(table), "` AS t\n",
                "WHERE t.status = 1 AND t.shipper = ", F.col("event_id") % 7, " -- from nowhere\n",
            ),
        )
        .when(
            kind == "click",
            _text(
                "select retail_price, bogus_", user, ", retail_price * 2 twice from ", table,
                " /* join x */ where deleted = 0 order by twice limit 10",
            ),
        )
        .when(
            kind == "error",
            _text(
                "SELECT count(*) AS n FROM ", table, " WHERE status = ", user % 20,
                " AND brand_name = 'it''s -- status = 3' GROUP BY brand_name HAVING n > 1",
            ),
        )
        .when(
            kind == "purchase",
            _text(
                "SELECT a.status, b.part_key, last_ship_date FROM ", table, " a JOIN main.",
                table_of(user + 1), " AS b ON b.part_", user, "_id = a.part_key",
                " WHERE a.status IN (", user % 20, ", ", user % 20 + 20, ") AND b.aggregator = 7",
            ),
        )
        .when(user % 4 == 0, _text("select (status from ", table))
        .otherwise(_text("with w as (select 1 from dual) SELECT x FROM nowhere_", user, " WHERE 5 = y"))
    )
    return events.select(
        F.col("event_id").alias("query_id"),
        F.lit(repo_id).alias("repo_id"),
        sql.alias("sql"),
        F.when(F.col("event_id") % 2 == 0, (user % 25).cast("int")).alias("tenant_context"),
    )


def coded_values(nation: DataFrame) -> DataFrame:
    """Three default meanings, and one of their own for every nation."""
    own = F.struct(
        (F.col("n_nationkey") % 3).alias("code"),
        _text("OWN_", F.col("n_nationkey")).alias("name"),
        _text("own ", F.col("n_name")).alias("meaning"),
        F.array("n_nationkey").alias("aggregators"),
    )

    def default(code: int) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            F.lit(f"DEFAULT_{code}").alias("name"),
            F.lit(f"default {code}").alias("meaning"),
            F.lit(None).cast("array<bigint>").alias("aggregators"),
        )

    rows = F.when(
        F.col("n_nationkey") == 0, F.array(own, default(0), default(1), default(2))
    ).otherwise(F.array(own))
    return nation.select(F.explode(rows).alias("v")).select(
        F.lit(REPO).alias("repo_id"), F.lit("com.shop.dict.OrderState").alias("enum_class"), "v.*"
    )


def coded_facts(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders with a status code and the customer's nation as tenant."""
    code = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", code.alias("code"), F.col("c_nationkey").alias("tenant"), "o_totalprice"
    )


def registry(documents: DataFrame) -> DataFrame:
    """A repo registry with one repo per document source."""
    return documents.groupBy(F.col("source").alias("repo_id")).agg(
        F.lit("/src").alias("root_path"),
        F.lit("tkmybatis").alias("rule_id"),
        F.timestamp_seconds(F.max("doc_id")).alias("extracted_at"),
        F.count("*").alias("table_count"),
        F.count(F.when(F.col("lang") == "en", 1)).alias("enum_count"),
    )


def search_docs(documents: DataFrame, by_source: bool = False) -> DataFrame:
    repo = F.col("source") if by_source else F.lit("docs")
    return documents.select(repo.alias("repo_id"), "doc_id", "text", "lang")


def search_queries(benchmark: DataFrame) -> DataFrame:
    """Whole benchmark texts as queries."""
    return benchmark.select(
        F.lit("docs").alias("repo_id"), F.col("item_id").alias("query_id"), "text"
    )
