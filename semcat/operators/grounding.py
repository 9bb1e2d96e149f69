"""Checking a whole log of SQL statements against the catalog.

The log is ``(query_id, sql, tenant_context)``, optionally with ``repo_id``; ids
belong to their repo, and a repeated id with another text is a statement of its
own. Each statement is read once, row by row, into *probes*: one row per table, per
column reference and per comparison. Probes meet the catalog in plain equality
joins, and only what a check found is grouped by statement in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semcat.config import ACTIVE_FLAG_NAMES, DEFAULTS, Settings
from semcat.functions import sqltext
from semcat.functions.rows import computed_once, exploded
from semcat.plans.lineage import sized, stored

CHECK_FIELDS = ("kind", "severity", "table_name", "column_name", "message", "fix")


_READ = ("sources", "tables", "derived_aliases", "columns", "predicates", "equal", "equalities", "reason")
# one statement of the log
STATEMENT = ("repo_id", "query_id", "statement")
# what statements of one kind have in common: 128 bits of their template
_TEMPLATE = ("_t1", "_t2")


def read_templates(templates: DataFrame, tokens_col: str = "tokens", parts: tuple[str, ...] = _READ) -> DataFrame:
    """What each row's tokens say: sources, tables, column references, comparisons, or why they are unreadable.

    Only ``parts`` of it are worked out, each exactly once.
    """
    given = [c for c in templates.columns if c != tokens_col]
    # all below is read from the marked tokens
    marked = computed_once(templates.select(*given, sqltext.units(tokens_col).alias("units")), "units")
    named = computed_once(marked.withColumn("sources", sqltext.sources("units")), "units", "sources")
    # distinct tables in text order
    tables = """transform(array_distinct(transform(sources, s -> s.table)), (t, i) -> named_struct(
        'pos', i, 'table', t, 'derived', exists(sources, s -> s.table = t AND s.derived)))"""
    every = {
        "sources": lambda: F.col("sources"),
        "tables": lambda: F.expr(tables),
        "derived_aliases": lambda: sqltext.derived_aliases("units"),
        "columns": lambda: sqltext.column_refs("units"),
        "predicates": lambda: sqltext.predicate_refs("units"),
        "equal": lambda: sqltext.equal_columns("units"),
        "equalities": lambda: sqltext.equalities("units"),
        "reason": lambda: sqltext.unreadable_reason("units"),
    }
    return computed_once(named.select(*given, *[every[c]().alias(c) for c in parts]), *parts)


def read_statements(
    log: DataFrame,
    repo_id: str | None = None,
    parts: tuple[str, ...] = _READ,
    by_template: bool = True,
) -> DataFrame:
    """Per statement: its tables, column references, comparisons, or why it is unreadable.

    Logs repeat: statements that differ in literals, comments, case and blanks only have one template.
    Each distinct template is read once, and a statement's own literals are put in afterwards. Without
    ``by_template`` every statement is read by itself, with the same result. Only ``parts`` are read.
    """
    if "repo_id" not in log.columns:
        if repo_id is None:
            raise ValueError("the log has no repo_id column: name the repo to check against")
        log = log.withColumn("repo_id", F.lit(repo_id))
    if "tenant_context" not in log.columns:
        log = log.withColumn("tenant_context", F.lit(None).cast("int"))
    cut = computed_once(
        log.select(
            "query_id",
            "repo_id",
            "tenant_context",
            F.xxhash64("sql", "tenant_context").alias("statement"),
            sqltext.tokens(F.coalesce("sql", F.lit(""))).alias("tokens"),
        ),
        "tokens",
    )
    keyed = computed_once(
        cut.select(
            "query_id",
            "repo_id",
            "tenant_context",
            "statement",
            # put in again with what is compared to them only
            (sqltext.literals("tokens") if "equalities" in parts else F.lit(None).cast("array<string>")).alias("_literals"),
            sqltext.template("tokens").alias("_template"),
        ),
        "_literals",
        "_template",
    ).withColumns({"_t1": F.xxhash64("_template"), "_t2": F.xxhash64(F.lit(1), "_template")})
    statement = [*STATEMENT, "tenant_context"]
    if by_template:
        # read twice below; the statements are cut into tokens once
        keyed = stored(keyed)
        templates = keyed.groupBy(*_TEMPLATE).agg(F.first("_template").alias("tokens"))
        read = sized(read_templates(templates, parts=parts))
        met = keyed.select(*statement, *_TEMPLATE, "_literals").join(read, [*_TEMPLATE])
    else:
        met = read_templates(keyed.select(*statement, "_literals", F.col("_template").alias("tokens")), parts=parts)

    own = sqltext.own_equalities("equalities", "_literals").alias("equalities")
    return met.select(*statement, *[own if c == "equalities" else F.col(c) for c in parts])


def extract_table_refs(log: DataFrame, repo_id: str | None = "") -> DataFrame:
    """Distinct tables of each statement, in order of appearance."""
    statements = read_statements(log, repo_id, ("tables",))
    return exploded(statements, "tables", "repo_id", "query_id", value="t").filter(
        ~F.col("t.derived")
    ).select("repo_id", "query_id", F.col("t.table").alias("table_name"), F.col("t.pos").alias("pos"))


def _apart(refs: str, *fields: str) -> Column:
    """References that differ in these fields."""
    made = ", ".join(f"'{f}', r.{f}" for f in fields)
    return F.expr(f"array_distinct(transform({refs}, r -> named_struct({made})))")


def extract_column_refs(log: DataFrame, repo_id: str | None = "") -> DataFrame:
    """Distinct ``(qualifier, column_name)`` of each statement."""
    statements = read_statements(log, repo_id, ("columns",))
    refs = _apart("columns", "qualifier", "column")
    return exploded(statements, refs, "repo_id", "query_id", value="c").select(
        "repo_id", "query_id", "c.qualifier", F.col("c.column").alias("column_name")
    )


def extract_equalities(log: DataFrame, repo_id: str | None = "") -> DataFrame:
    """Distinct columns compared to literals, as written between quotes, and as integer if it is one."""
    statements = read_statements(log, repo_id, ("equalities",))
    pairs = _apart("equalities", "qualifier", "column", "literal", "code")
    return exploded(statements, pairs, "repo_id", "query_id", value="e").select(
        "repo_id",
        "query_id",
        "e.qualifier",
        F.col("e.column").alias("column_name"),
        "e.literal",
        "e.code",
    )


def unreadable(log: DataFrame, repo_id: str | None = "") -> DataFrame:
    """Statements that cannot be read, each with one check."""
    found = read_statements(log, repo_id, ("reason",)).filter("reason is not null")
    return found.select("repo_id", "query_id", _unreadable().alias("check")).select(
        "repo_id", "query_id", "check.*"
    )


# -------------------------------------------------------------------- probes


def _of_table(refs: str, table: str) -> str:
    """Names of the columns in ``refs``, with their candidates, that may be the table's."""
    return f"array_distinct(transform(filter({refs}, f -> array_contains(f.fits, {table})), f -> f.column))"


def probe_statements(
    statements: DataFrame, ambiguous_columns: bool = True, compat: bool = False
) -> DataFrame:
    """One row per statement, per table, and per reference and table it may belong to.

    ``fixed`` has the columns that the statement filters (of a table) or compares to
    literals (with a comparison) and that may be this table's; with ``compat`` a table
    has all columns the statement names. Without ``ambiguous_columns`` references that
    fit several tables are left out: the first table that has the column is theirs, so
    nothing is missing.
    """

    def fitted(refs: str, *fields: str) -> Column:
        """References, each once, with their candidates."""
        own = "".join(f"'{f}', r.{f}, " for f in ("qualifier", "column", *fields))
        made = f"named_struct({own}'fits', {sqltext.candidates('r')}, 'unsure', {sqltext.may_be_derived('r')})"
        return F.expr(f"array_distinct(transform({refs}, r -> {made}))")

    # refs without their literals
    bare = "transform(equalities, e -> named_struct('qualifier', e.qualifier, 'column', e.column, 'at', e.at))"
    filtered = "columns" if compat else sqltext.carried("predicates", "equal")
    met = computed_once(
        statements.select(
            *STATEMENT,
            "tenant_context",
            "reason",
            "tables",
            fitted("columns").alias("named"),
            fitted("equalities", "code").alias("compared"),
            fitted(filtered).alias("filtered"),
            fitted(sqltext.carried(f"array_distinct({bare})", "equal")).alias("pinned"),
        ),
        "named",
        "compared",
        "filtered",
        "pinned",
    )

    def probe(kind: str, **fields: str) -> str:
        kinds = {
            "no": "int", "pos": "int", "table_name": "string", "qualifier": "string", "column_name": "string",
            "code": "bigint", "ambiguous": "boolean", "fixed": "array<string>", "parsed_tables": "array<string>",
        }
        made = ", ".join(f"'{f}', cast({fields.get(f, 'null')} as {t})" for f, t in kinds.items())
        return f"named_struct('kind', '{kind}', {made})"

    def refs(kind: str, array: str, **fields: str) -> str:
        several = "(size(r.fits) > 1 OR r.unsure)"
        fits = "r.fits" if kind == "equality" or ambiguous_columns else f"if({several}, slice(r.fits, 1, 0), r.fits)"
        one = probe(
            kind, no="no", pos="pos", table_name="t", qualifier="r.qualifier", column_name="r.column", ambiguous=several, **fields
        )
        return f"flatten(transform({array}, (r, no) -> transform({fits}, (t, pos) -> {one})))"

    read = _of_table("filtered", "t.table") if not compat else "array_distinct(transform(filtered, f -> f.column))"
    parsed = "transform(filter(tables, t -> NOT t.derived), t -> t.table)"
    probes = f"""concat(
        array({probe("statement", no="0", ambiguous="false", parsed_tables=parsed)}),
        transform(tables, t -> {probe("table", no="t.pos", pos="t.pos", table_name="t.table", ambiguous="false", fixed=read)}),
        {refs("column", "named")},
        {refs("equality", "compared", code="r.code", fixed=_of_table("pinned", "t"))})"""
    with_probes = met.withColumn("probes", F.expr(probes))
    return exploded(with_probes, "probes", *STATEMENT, "tenant_context", "reason", value="p").select(
        *STATEMENT, "tenant_context", "reason", "p.*"
    )


def _met_or_spread(key: str, spread: Column | None = None) -> Column:
    """The key; where it is null, one of many that nothing has, so that such rows do not meet in one task."""
    none = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*STATEMENT, "no", "pos"), F.lit(65536)).cast("string"))
    return F.coalesce(F.col(key) if spread is None else spread, none)


def _with_catalog(probes: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Add what the catalog knows about a probe's table and column."""
    known = tables.select(
        "repo_id",
        F.col("name").alias("_table"),
        "soft_delete_column",
        "dimension_fields",
        F.lit(True).alias("known_table"),
    )
    has_enum = "enum_class" in columns.columns
    held = columns.select(
        "repo_id",
        F.col("table_name").alias("_table"),
        F.col("name").alias("_column"),
        (F.col("enum_class") if has_enum else F.lit(None).cast("string")).alias("enum_class"),
        F.lit(True).alias("known_column"),
    )
    keyed = probes.withColumns(
        {"_table": _met_or_spread("table_name"), "_column": _met_or_spread("column_name")}
    )
    return (
        keyed.join(known, ["repo_id", "_table"], "left")
        .join(held, ["repo_id", "_table", "_column"], "left")
        .withColumns(
            {
                "known_table": F.coalesce("known_table", F.lit(False)),
                "known_column": F.coalesce("known_column", F.lit(False)),
            }
        )
        .drop("_table", "_column")
    )


def resolve_refs(log: DataFrame, catalog: dict[str, DataFrame], repo_id: str | None = None) -> DataFrame:
    """Every reference with the one table it belongs to; those that fit none are left out.

    The qualifier decides, else the only table, else the first used table that
    has the column.
    """
    probes = probe_statements(read_statements(log, repo_id)).filter(
        F.col("kind").isin("column", "equality")
    )
    return _resolved(probes, catalog)


def _resolved(probes: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    met = _with_catalog(probes, catalog["tables"], catalog["columns"])
    # rank, not row number: rows that repeat a statement all stay
    window = Window.partitionBy(*STATEMENT, "kind", "no").orderBy("pos")
    return (
        met.filter(~F.col("ambiguous") | F.col("known_column"))
        .withColumn("_rank", F.rank().over(window))
        .filter("_rank = 1")
        .drop("_rank")
    )


# -------------------------------------------------------------------- checks


def _check(kind, severity: str, table, column, message, fix) -> Column:
    return F.struct(
        kind.alias("kind"),
        F.lit(severity).alias("severity"),
        table.alias("table_name"),
        column.alias("column_name"),
        message.alias("message"),
        fix.alias("fix"),
    )


def _unreadable() -> Column:
    return _check(
        F.lit("parse_error"),
        "warn",
        F.lit(""),
        F.lit(""),
        F.concat(F.lit("the statement cannot be read: "), F.col("reason")),
        F.lit(""),
    )


def _missing(settings: Settings) -> Column:
    """Check of a column probe whose table lacks the column, else null."""
    table, column, soft = F.col("table_name"), F.col("column_name"), F.col("soft_delete_column")
    is_soft = column.isin(*settings.soft_delete_names)
    live = F.when(soft.isin(*ACTIVE_FLAG_NAMES), F.lit(1)).otherwise(F.lit(0))
    message = F.when(
        is_soft,
        F.format_string(
            "column %s does not exist in %s; %s",
            column,
            table,
            F.when(soft.isNull(), "the table has no soft-delete column").otherwise(
                F.concat(F.lit("its soft-delete column is "), soft)
            ),
        ),
    ).otherwise(F.format_string("column %s does not exist in %s", column, table))
    fix = (
        F.when(is_soft & soft.isNotNull(), F.format_string("filter by %s = %d", soft, live))
        .when(is_soft, F.format_string("drop the filter on %s", column))
        .otherwise("check the spelling against the table's columns")
    )
    found = (
        (F.col("kind") == "column")
        & ~F.col("ambiguous")
        & F.col("known_table")
        & ~F.col("known_column")
        & (column != "*")
    )
    kind = F.when(is_soft, "soft_delete_misuse").otherwise("column_missing")
    return F.when(found, _check(kind, "error", table, column, message, fix))


def _tenant_missing(settings: Settings) -> Column:
    """Check of a table probe read without its tenant, else null."""
    dims, table = F.col("dimension_fields"), F.col("table_name")
    if settings.compat:
        missing = F.array_except(dims, F.col("fixed"))
        found = (F.size(missing) > 0) & (F.size("fixed") > 0)
    else:
        missing = dims
        found = ~F.arrays_overlap(dims, F.col("fixed"))
    message = F.format_string(
        "%s has tenant columns [%s] and none is filtered; tenants may mix",
        table,
        F.array_join(dims, ", "),
    )
    fix = F.format_string("add AND %s = <value>", F.try_element_at(missing, F.lit(1)))
    return F.when(
        (F.col("kind") == "table") & F.col("known_table") & (F.size(dims) > 0) & found,
        _check(F.lit("dimension_missing"), "warn", table, F.lit(""), message, fix),
    )


def _with_divergence(met: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """Add the tenant meanings of the code a comparison probe asks for."""
    values = catalog["enum_values"]
    specific = F.coalesce(F.size("aggregators"), F.lit(0)) > 0
    tenant_enums = catalog["enums"].filter(F.col("paradigm") == "B").select("repo_id", "enum_class")
    key = ["repo_id", "enum_class", "code"]
    defaults = values.filter(~specific).groupBy(*key).agg(
        F.min_by("meaning", "name").alias("default_meaning")
    )
    divergent = (
        values.filter(specific)
        .join(tenant_enums, ["repo_id", "enum_class"], "left_semi")
        .select(*key, "aggregators", F.col("meaning").alias("tenant_meaning"))
        .join(defaults, key, "left")
    )
    # only comparisons with a code and an enum can meet a value
    asks = (F.col("kind") == "equality") & F.col("code").isNotNull()
    keyed = met.withColumns(
        {
            "_class": _met_or_spread("enum_class", F.when(asks, F.col("enum_class"))),
            "_code": F.coalesce("code", F.lit(0)),
        }
    )
    named = divergent.withColumnsRenamed({"enum_class": "_class", "code": "_code"})
    return keyed.join(named, ["repo_id", "_class", "_code"], "left").drop("_class", "_code")


def _ambiguous(settings: Settings) -> Column:
    """Check of a comparison probe with a code that depends on the tenant, else null."""
    table, column, context = F.col("table_name"), F.col("column_name"), F.col("tenant_context")
    tenants = F.array_join(F.transform("aggregators", lambda a: a.cast("string")), ", ")
    default = F.coalesce("default_meaning", F.lit("?"))
    first_tenant = F.try_element_at("aggregators", F.lit(1))
    message = F.concat(
        F.format_string(
            "%s.%s = %d means '%s' by default and '%s' for tenants [%s]",
            table,
            column,
            F.col("code"),
            default,
            F.col("tenant_meaning"),
            tenants,
        ),
        F.when(
            context.isNotNull(),
            F.format_string(
                "; for tenant %d it means '%s'",
                context,
                F.when(
                    F.array_contains("aggregators", context), F.col("tenant_meaning")
                ).otherwise(default),
            ),
        ).otherwise(""),
    )
    fix = F.format_string(
        "add AND aggregator = %d for '%s', or AND aggregator != %d for '%s'",
        first_tenant,
        F.col("tenant_meaning"),
        first_tenant,
        default,
    )
    found = (F.col("kind") == "equality") & F.col("aggregators").isNotNull()
    if not settings.compat:
        pinned = F.arrays_overlap("fixed", "dimension_fields")
        found = found & ~F.coalesce(pinned, F.lit(False))
    return F.when(found, _check(F.lit("enum_ambiguous"), "warn", table, column, message, fix))


def _rows(df: DataFrame, check: Column) -> DataFrame:
    return (
        df.select("repo_id", "query_id", check.alias("check"))
        .filter(F.col("check").isNotNull())
        .select("repo_id", "query_id", *[F.col("check")[f].alias(f) for f in CHECK_FIELDS])
    )


def _met(
    log: DataFrame, catalog: dict[str, DataFrame], repo_id: str | None, wanted: Column, compat: bool = False
) -> DataFrame:
    """The probes that a check looks at, with the catalog; all others stay out of the joins."""
    probes = probe_statements(read_statements(log, repo_id), False, compat)
    return _with_catalog(
        probes.filter("reason is null").filter(wanted).drop("reason", "parsed_tables"),
        catalog["tables"],
        catalog["columns"],
    )


def _own_columns() -> Column:
    """Column references that belong to one table, without any doubt."""
    return (F.col("kind") == "column") & ~F.col("ambiguous")


def check_missing_columns(
    log: DataFrame,
    catalog: dict[str, DataFrame],
    repo_id: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Columns that a known table does not have."""
    checks = _rows(_met(log, catalog, repo_id, _own_columns()), _missing(settings))
    return checks.filter(F.col("kind") == "column_missing")


def check_soft_delete(
    log: DataFrame,
    catalog: dict[str, DataFrame],
    repo_id: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Soft-delete columns used on tables that do not have them."""
    checks = _rows(_met(log, catalog, repo_id, _own_columns()), _missing(settings))
    return checks.filter(F.col("kind") == "soft_delete_misuse")


def check_ambiguous_codes(
    log: DataFrame,
    catalog: dict[str, DataFrame],
    repo_id: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Compared codes whose meaning depends on a tenant the statement does not fix."""
    # a comparison without a code meets no value
    asks = (F.col("kind") == "equality") & F.col("code").isNotNull() & F.col("reason").isNull()
    probes = probe_statements(read_statements(log, repo_id)).filter(asks).drop("reason", "parsed_tables")
    resolved = _resolved(probes, catalog)
    return _rows(_with_divergence(resolved, catalog), _ambiguous(settings))


def check_tenant_filter(
    log: DataFrame,
    catalog: dict[str, DataFrame],
    repo_id: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Tables read without a condition on any of their tenant columns."""
    met = _met(log, catalog, repo_id, F.col("kind") == "table", settings.compat)
    return _rows(met, _tenant_missing(settings))


def unknown_tables(
    log: DataFrame, catalog: dict[str, DataFrame], repo_id: str | None = None
) -> DataFrame:
    """Tables of the log that the catalog does not have; they are not checked."""
    statements = read_statements(log, repo_id, ("tables",))
    refs = exploded(statements, "tables", "query_id", "repo_id", value="t").filter(
        ~F.col("t.derived")
    ).select(
        "query_id", "repo_id", F.col("t.table").alias("table_name")
    )
    known = catalog["tables"].select("repo_id", F.col("name").alias("table_name"))
    return refs.join(known, ["repo_id", "table_name"], "left_anti").select(
        "repo_id", "query_id", "table_name"
    )


def verdict_of(errors: Column, checks: Column) -> Column:
    return F.when(errors > 0, "FAIL").when(checks > 0, "WARN").otherwise("PASS")


def verdicts(log: DataFrame, checks: DataFrame) -> DataFrame:
    """``FAIL`` with any error, ``WARN`` with any other check, else ``PASS``."""
    # a log of one repo need not name it
    key = [c for c in ("repo_id", "query_id") if c in log.columns and c in checks.columns]
    counts = checks.groupBy(*key).agg(
        F.count("*").alias("n_checks"),
        F.count(F.when(F.col("severity") == "error", 1)).alias("n_errors"),
    )
    n = F.coalesce("n_checks", F.lit(0))
    return (
        log.select(*key)
        .join(counts, key, "left")
        .select(
            *key,
            verdict_of(F.coalesce("n_errors", F.lit(0)), n).alias("verdict"),
            n.alias("n_checks"),
        )
    )


def audit_log(
    log: DataFrame,
    catalog: dict[str, DataFrame],
    repo_id: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """All checks of every statement in one pass over the log.

    One row per row of the log: ``repo_id``, ``query_id``, ``verdict``, ``n_checks``, ``parsed_tables`` and the
    ``checks`` themselves. Rows without a finding are dropped before the shuffle
    that gathers each statement's few findings.
    """
    probes = probe_statements(read_statements(log, repo_id), False, settings.compat)
    wanted = probes.filter(F.col("reason").isNull() | (F.col("kind") == "statement"))
    met = _with_divergence(
        _with_catalog(wanted, catalog["tables"], catalog["columns"]), catalog
    )
    is_statement = F.col("kind") == "statement"
    check = F.coalesce(
        F.when(is_statement & F.col("reason").isNotNull(), _unreadable()),
        _missing(settings),
        _tenant_missing(settings),
        _ambiguous(settings),
    )
    # a comparison that fits several tables also needs the first one that has the column
    decides = F.col("ambiguous") & F.col("known_column")
    found = (
        met.withColumn("check", check)
        .filter(
            is_statement
            | decides
            | (F.col("check").isNotNull() & ~F.col("ambiguous"))
        )
        .select(
            *STATEMENT,
            "parsed_tables",
            F.struct("kind", "no", "pos", "ambiguous", "check").alias("row"),
        )
    )
    # rows that repeat a statement are checked as one
    gathered = found.groupBy(*STATEMENT).agg(
        F.first("parsed_tables", ignorenulls=True).alias("parsed_tables"),
        F.count(F.when(F.col("row.kind") == "statement", 1)).cast("int").alias("n"),
        F.collect_set("row").alias("rows"),
    )
    own = F.filter(
        "rows",
        lambda r: r["check"].isNotNull()
        & (
            ~r["ambiguous"]
            | ~F.exists(
                "rows",
                lambda s: s["ambiguous"] & (s["no"] == r["no"]) & (s["pos"] < r["pos"]),
            )
        ),
    )
    checks = gathered.select(
        "repo_id",
        "query_id",
        "parsed_tables",
        F.sequence(F.lit(1), F.col("n")).alias("copies"),
        F.sort_array(F.transform(own, lambda r: r["check"])).alias("checks"),
    )
    errors = F.size(F.filter("checks", lambda c: c["severity"] == "error"))
    every = exploded(checks, "copies", "repo_id", "query_id", "parsed_tables", "checks", value="copy")
    return every.select(
        "repo_id",
        "query_id",
        verdict_of(errors, F.size("checks")).alias("verdict"),
        F.size("checks").cast("bigint").alias("n_checks"),
        "parsed_tables",
        "checks",
    )


def audit_checks(audited: DataFrame) -> DataFrame:
    """The checks of an audit, one per row."""
    return exploded(audited, "checks", "repo_id", "query_id", value="c").select(
        "repo_id", "query_id", "c.*"
    )
