"""Expected results in SQL, stated from the given tables.

None of these texts repeats a pattern of the library: each says from the rows
what the made inputs contain.
"""

from __future__ import annotations

from semcat.config import BASE_ENTITY_COLUMNS, DEFAULTS

TYPES = {"Long": "long", "Integer": "integer", "String": "string", "Date": "date"}


def t_of(k: str) -> str:
    return (
        f"(CASE ({k}) % 5 WHEN 0 THEN 'pcl_' WHEN 1 THEN 'act_' WHEN 2 THEN 'sys_'"
        f" WHEN 3 THEN 'trk_' ELSE 'zz_' END || 'part_' || ({k}))"
    )


PARTS = f"""parts AS (
  SELECT p_partkey AS k, p_size AS s, p_name, p_brand, p_type, {t_of("p_partkey")} AS t,
    'src/main/java/com/shop/m' || (p_partkey % 10) || '/entity/Part' || p_partkey || '.java' AS f,
    'src/main/java/com/shop/vo/Part' || p_partkey || 'Vo.java' AS vo
  FROM part)"""

_BASE = ", ".join(
    f"({i}, '{n}', '{f}', '{ty}', '{TYPES[ty]}', {str(pk).lower()}, '{c}')"
    for i, (n, f, ty, pk, c) in enumerate(BASE_ENTITY_COLUMNS, 1)
)

# every column of every entity file; sect orders base, declared, inferred
COLS = f"""{PARTS},
base(pos, name, jf, raw, ty, pk, cm) AS (VALUES {_BASE}),
own AS (
  SELECT k, 1 AS pos, 'part_key' AS name, 'partKey' AS jf, 'Long' AS raw, 'long' AS ty, true AS pk, '' AS cm, false AS inf FROM parts
  UNION ALL SELECT k, 2, 'status', 'status', 'Short', 'integer', false, p_type, false FROM parts
  UNION ALL SELECT k, 3, 'brand_name', 'brandName', 'String', 'string', false, p_brand, false FROM parts
  UNION ALL SELECT k, 4, 'retail_price', 'retailPrice', 'java.math.BigDecimal', 'decimal', false, '', false FROM parts
  UNION ALL SELECT k, 5, 'deleted', 'deleted', 'Integer', 'integer', false, 'is it gone', false FROM parts WHERE s % 7 = 0
  UNION ALL SELECT k, 6, 'shipper', 'shipper', 'Integer', 'integer', false, 'who ships', false FROM parts WHERE s % 3 = 0
  UNION ALL SELECT k, 7, 'operation', 'operation', 'String', 'string', false, 'own operation', false FROM parts WHERE s % 10 = 0
  UNION ALL SELECT k, 8, 'part_' || (k - 1) || '_id', 'previousId', 'Long', 'long', false, 'the part before', false FROM parts WHERE k > 0
  UNION ALL SELECT k, 9, 'made_of', 'madeOf', 'List', 'unknown', false, 'made of ' || p_name, true FROM parts
  UNION ALL SELECT k, 10, 'last_ship_date', 'lastShipDate', 'Date', 'date', false, 'last shipped', true FROM parts),
full_cols AS (
  SELECT p.k, p.t, p.f, o.pos + 100 AS pos, name, jf, raw, ty, pk, true AS nullable, cm, inf, false AS is_base
  FROM own o JOIN parts p USING (k)
  UNION ALL
  SELECT p.k, p.t, p.f, b.pos, name, jf, raw, ty, pk, NOT pk, cm, false, true
  FROM parts p, base b WHERE p.s % 2 = 0 AND NOT (p.s % 10 = 0 AND b.name = 'operation')),
main_cols AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY pos) AS INTEGER) AS ordinal FROM full_cols),
cols AS (
  SELECT * FROM main_cols
  UNION ALL
  SELECT k, t, vo, 101, 'status', 'status', 'Short', 'integer', false, true, '', false, false, 1 FROM parts WHERE s = 1)"""

PURPOSE = (
    "CASE WHEN s % 5 <> 0 THEN p_name WHEN s % 4 = 0 THEN p_brand || ' made by hand' ELSE '' END"
)
# files: main and smaller twin
FILES = f"""{PARTS},
files AS (
  SELECT k, s, t, f, 'com.shop.m' || (k % 10) || '.entity.Part' || k AS cls, {PURPOSE} AS purpose, s % 2 = 0 AS ext, p_name FROM parts
  UNION ALL SELECT k, s, t, vo, 'com.shop.vo.Part' || k || 'Vo', '', false, p_name FROM parts WHERE s = 1)"""

SOFT = "CASE WHEN s % 7 = 0 THEN 'deleted' END"
DIMS = (
    "CASE WHEN s % 2 = 0 AND s % 3 = 0 THEN 'aggregator,shipper' WHEN s % 2 = 0 THEN 'aggregator'"
    " WHEN s % 3 = 0 THEN 'shipper' ELSE '' END"
)
DOMAIN = (
    "CASE k % 5 WHEN 0 THEN '01-pcl' WHEN 1 THEN '02-act' WHEN 2 THEN '03-sys'"
    " WHEN 3 THEN '06-trk' ELSE 'other' END"
)

VALS = """cust AS (
  SELECT c_custkey AS k, c_custkey // 40 AS b, c_name, c_nationkey AS n, c_mktsegment = 'BUILDING' AS own FROM customer),
vals AS (
  SELECT b, k, c_name, 'com.shop.dict.Status' || b AS cls, 'CUST_' || k AS name,
    CAST(CASE WHEN b % 3 = 0 THEN k % 200 ELSE k % 20 END AS INTEGER) AS code,
    'cust.' || k AS mk, CASE WHEN b % 3 <> 0 AND own THEN n || ',' || (n + 1000) ELSE '' END AS tenants,
    CAST(row_number() OVER (PARTITION BY b ORDER BY k) - 1 AS INTEGER) AS no,
    CASE WHEN k % 25 = 0 THEN c_name || ' third' WHEN k % 10 = 0 THEN c_name || ' second'
      ELSE c_name || ' é😀' END AS meaning
  FROM cust),
kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b, code, tenants ORDER BY k) AS r FROM vals) WHERE r = 1),
buckets AS (SELECT DISTINCT b FROM cust)"""

WARNING = (
    "CASE WHEN tenants <> '' THEN 'code ' || code || ' means something else for tenants ['"
    " || replace(tenants, ',', ', ') || ']; filter by tenant' ELSE '' END"
)

WORDS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
# as above, and runs of Han characters as overlapping pairs
HAN_WORDS = (
    r"flatten([CASE WHEN regexp_matches(w, '^\p{Han}{2,}$')"
    r" THEN [substr(w, i, 2) for i in range(1, length(w))] ELSE [w] END"
    r" for w in regexp_extract_all(lower(cm), '\p{Han}+|[\p{Latin}\p{N}]+')])"
)


def words(text: str) -> str:
    return WORDS.format(text)


# documents of one repo, fields text and lang
TOKENS = f"""toks AS (
  SELECT doc_id, 'text' AS field, {words("text")} AS ws FROM documents
  UNION ALL SELECT doc_id, 'lang', {words("lang")} FROM documents),
docs AS (SELECT doc_id, sum(len(ws)) AS dl FROM toks GROUP BY 1),
corpus AS (SELECT count(*) AS nd, avg(dl) AS al FROM docs),
occ AS (SELECT doc_id, field, unnest(ws) AS term FROM toks),
tf AS (SELECT doc_id, field, term, count(*) AS tf FROM occ GROUP BY ALL)"""

_IDF = "greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6)"
_PART = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))"

_SHOWN = "round(CAST(score AS DOUBLE), 6) AS score"


def ranked(query_terms: str, tf: str = "tf", having: str = "", banned: str = "", k: int = 10) -> str:
    """BM25 over (query_id, slot, n_terms) and slot counts."""
    return f"""WITH {TOKENS},
qt AS ({query_terms}),
hit AS ({tf}),
df AS (SELECT slot, count(*) AS n FROM hit GROUP BY 1),
scored AS (
  SELECT query_id, doc_id, sum(CAST({_IDF} * {_PART} AS DECIMAL(28, 15))) AS score
  FROM qt JOIN hit USING (slot) JOIN df USING (slot) JOIN docs USING (doc_id), corpus
  {banned}
  GROUP BY query_id, doc_id, n_terms {having}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, doc_id, {_SHOWN}, rank FROM r WHERE rank <= {k}"""


def query_words(text: str = "text", source: str = "benchmark") -> str:
    return (
        f"SELECT item_id AS query_id, unnest(list_distinct(ws)) AS slot, len(list_distinct(ws)) AS n_terms"
        f" FROM (SELECT item_id, {words(text)} AS ws FROM {source})"
    )


_TF_ALL = "SELECT doc_id, term AS slot, sum(tf) AS tf FROM tf WHERE term IN (SELECT slot FROM qt) GROUP BY 1, 2"
_ALL = "HAVING count(*) = n_terms"

LOG = f"""{VALS}, {PARTS},
ev AS (SELECT event_id AS q, event_id % 7 AS e7, user_id AS u, event_type AS ty, {t_of("user_id")} AS t,
  {t_of("user_id + 1")} AS t2 FROM events),
x AS (SELECT ev.*, a.s, b.s AS s2 FROM ev LEFT JOIN parts a ON a.k = u LEFT JOIN parts b ON b.k = u + 1),
div AS (SELECT b, code, count(*) AS n FROM kept WHERE tenants <> '' GROUP BY 1, 2),
missing AS (
  SELECT q, t AS tn, 'shipper' AS c FROM x WHERE ty = 'view' AND s % 3 <> 0
  UNION ALL SELECT q, t, 'bogus_' || u FROM x WHERE ty = 'click' AND s IS NOT NULL
  UNION ALL SELECT q, t2, 'aggregator' FROM x WHERE ty = 'purchase' AND s2 % 2 <> 0),
soft AS (SELECT q, t AS tn, 'deleted' AS c FROM x WHERE ty = 'click' AND s % 7 <> 0),
dims AS (
  SELECT q, t AS tn, s AS size FROM x WHERE ty = 'view' AND s % 2 = 0 AND s % 3 <> 0
  UNION ALL SELECT q, t, s FROM x WHERE ty IN ('click', 'error', 'purchase') AND (s % 2 = 0 OR s % 3 = 0)
  UNION ALL SELECT q, t2, s2 FROM x WHERE ty = 'purchase' AND s2 % 2 <> 0 AND s2 % 3 = 0),
amb AS (
  SELECT q, t AS tn, n FROM x JOIN div ON div.b = u // 40 AND code = CASE ty WHEN 'view' THEN 1 ELSE u % 20 END
  WHERE s IS NOT NULL AND ((ty = 'view' AND s % 3 <> 0) OR ty IN ('error', 'purchase'))),
met AS (
  SELECT q, t AS tn, own.code, own.meaning, CAST(split_part(own.tenants, ',', 1) AS BIGINT) AS first, replace(own.tenants, ',', ', ') AS tenants,
    coalesce(plain.meaning, '?') AS plain, CASE WHEN q % 2 = 0 THEN u % 25 END AS ctx
  FROM x JOIN kept own ON own.b = u // 40 AND own.tenants <> '' AND own.code = CASE ty WHEN 'view' THEN 1 ELSE u % 20 END
  LEFT JOIN kept plain ON plain.b = own.b AND plain.code = own.code AND plain.tenants = ''
  WHERE s IS NOT NULL AND ((ty = 'view' AND s % 3 <> 0) OR ty IN ('error', 'purchase'))),
bad AS (SELECT q FROM x WHERE ty = 'signup' AND u % 4 = 0)"""

REFS = """refs AS (
  SELECT q, 't' AS qu, unnest(['status', 'brand_name', 'shipper']) AS c, t AS tn FROM x WHERE ty = 'view'
  UNION ALL SELECT q, '', unnest(['retail_price', 'bogus_' || u, 'deleted']), t FROM x WHERE ty = 'click'
  UNION ALL SELECT q, '', unnest(['status', 'brand_name']), t FROM x WHERE ty = 'error'
  UNION ALL SELECT q, 'a', unnest(['status', 'part_key']), t FROM x WHERE ty = 'purchase'
  UNION ALL SELECT q, 'b', unnest(['part_key', 'part_' || u || '_id', 'aggregator']), t2 FROM x WHERE ty = 'purchase'
  UNION ALL SELECT q, '', 'last_ship_date', t FROM x WHERE ty = 'purchase'
  UNION ALL SELECT q, '', 'status', NULL FROM x WHERE ty = 'signup' AND u % 4 = 0
  UNION ALL SELECT q, '', unnest(['x', 'y']), 'nowhere_' || u FROM x WHERE ty = 'signup' AND u % 4 <> 0)"""

_N_COLS = "(SELECT count(*) FROM main_cols)"
_RELS = f"""rels AS (
  SELECT a.t AS from_table, 'part_' || b.k || '_id' AS from_column, b.t AS to_table
  FROM parts a JOIN parts b ON b.k = a.k - 1 WHERE b.k % 5 IN (0, 1, 2))"""

REGISTRY = """SELECT source AS repo_id, '/src' AS root_path, 'tkmybatis' AS rule_id, max(doc_id) AS extracted_at,
  count(*) AS table_count, count(*) FILTER (WHERE lang = 'en') AS enum_count FROM documents GROUP BY source"""

# two repos of the same parts; the fork lacks some parts and renames others
FORKED = f"""{COLS},
both_parts AS (
  SELECT 'saas' AS repo_id, * FROM parts
  UNION ALL
  SELECT 'fork', * REPLACE (CASE WHEN k % 13 = 0 THEN 'renamed' ELSE p_name END AS p_name)
  FROM parts WHERE k % 11 <> 0)"""


# part name and piece searches
NAMES = f"""{FILES},
tabs AS (SELECT * FROM files WHERE NOT contains(f, '/vo/')),
names AS (SELECT DISTINCT p_name AS nm FROM part),
toks AS (
  SELECT k, {words("t")} AS a, {words("purpose")} AS b, {words("dom")} AS c
  FROM (SELECT *, {DOMAIN} AS dom FROM tabs)),
docs AS (SELECT k, len(a) + len(b) + len(c) AS dl FROM toks),
corpus AS (SELECT count(*) AS nd, avg(dl) AS al FROM docs),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(list_concat(a, b, c)) AS term FROM toks) GROUP BY 1, 2),
qs AS (
  SELECT 'name ' || nm AS query_id, nm AS text FROM names
  UNION ALL SELECT 'piece ' || nm, substr(nm, 2, 6) FROM names),
qt AS (
  SELECT query_id, unnest(list_distinct(ws)) AS term, len(list_distinct(ws)) AS n_terms
  FROM (SELECT query_id, {words("text")} AS ws FROM qs)),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
scored AS (
  SELECT query_id, k, sum(CAST({_IDF} * {_PART} AS DECIMAL(28, 15))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN docs USING (k), corpus
  GROUP BY query_id, k, n_terms HAVING count(*) = n_terms),
hits AS (SELECT query_id, t, score, tabs.k FROM scored JOIN tabs USING (k) WHERE DOMFILTER),
ranked AS (
  SELECT query_id, t, k, 'rank' AS found_by, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t) AS r FROM hits),
liked AS (
  SELECT query_id, t, k, 'substring' AS found_by, row_number() OVER (PARTITION BY query_id ORDER BY t) AS r
  FROM qs, tabs
  WHERE DOMFILTER AND query_id NOT IN (SELECT query_id FROM hits)
    AND (contains(lower(t), lower(text)) OR contains(lower(purpose), lower(text)))),
found AS (SELECT * FROM ranked WHERE r <= 10 UNION ALL SELECT * FROM liked WHERE r <= 10)"""


# kind of check: severity, where from, table, column, message, advice
_FOUND = {
    "column_missing": (
        "error", "missing", "tn", "c", "'column ' || c || ' does not exist in ' || tn",
        "'check the spelling against the table''s columns'",
    ),
    "soft_delete_misuse": (
        "error", "soft", "tn", "c",
        "'column ' || c || ' does not exist in ' || tn || '; the table has no soft-delete column'",
        "'drop the filter on ' || c",
    ),
    "enum_ambiguous": (
        "warn", "met", "tn", "'status'",
        "tn || '.status = ' || code || ' means ''' || plain || ''' by default and ''' || meaning || ''' for tenants ['"
        " || tenants || ']' || CASE WHEN ctx IS NULL THEN '' ELSE '; for tenant ' || ctx || ' it means '''"
        " || CASE WHEN ctx IN (first, first + 1000) THEN meaning ELSE plain END || '''' END",
        "'add AND aggregator = ' || first || ' for ''' || meaning || ''', or AND aggregator != ' || first"
        " || ' for ''' || plain || ''''",
    ),
    "dimension_missing": (
        "warn", "dims", "tn", "''",
        "tn || ' has tenant columns [' || CASE WHEN size % 6 = 0 THEN 'aggregator, shipper' WHEN size % 2 = 0"
        " THEN 'aggregator' ELSE 'shipper' END || '] and none is filtered; tenants may mix'",
        "'add AND ' || CASE WHEN size % 2 = 0 THEN 'aggregator' ELSE 'shipper' END || ' = <value>'",
    ),
    "parse_error": (
        "warn", "bad", "''", "''", "'the statement cannot be read: unbalanced parentheses'", "''",
    ),
}


def _found(kind: str) -> str:
    severity, source, table, column, message, fix = _FOUND[kind]
    return (
        f"SELECT q AS query_id, '{kind}' AS kind, '{severity}' AS severity, {table} AS table_name,"
        f" {column} AS column_name, {message} AS message, {fix} AS fix FROM {source}"
    )


def _checks(*kinds: str) -> str:
    return f"WITH {LOG} " + " UNION ALL ".join(_found(kind) for kind in kinds)


ORACLES: dict[str, str] = {
    "read_source_files": r"""SELECT 'docs' AS repo_id, source, count(*) AS n_lines,
        CAST(sum(length(regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]', ' ', 'g'))) AS BIGINT) AS n_chars
        FROM documents GROUP BY source""",
    "entity_files": f"""WITH {PARTS} SELECT f AS path FROM parts UNION ALL SELECT vo FROM parts WHERE s = 1
        UNION ALL SELECT 'src/main/java/com/shop/raw/Raw' || k || '.java' FROM parts WHERE s = 4""",
    "enum_files": f"""WITH {VALS} SELECT 'src/main/java/com/shop/dict/Status' || b || '.java' AS path FROM buckets
        UNION ALL SELECT 'old/dict/Status' || b || '.java' FROM buckets WHERE b % 5 = 0
        UNION ALL SELECT 'src/main/java/com/shop/dict/Empty' || b || '.java' FROM buckets WHERE b % 4 = 0""",
    "bundle_files": f"""WITH {VALS} SELECT 'res/messages_zh_CN_' || b || '.properties' AS path FROM buckets
        UNION ALL SELECT 'res/messages_zh_CN_late_' || b || '.properties' FROM buckets""",
    "route_files": f"""WITH {VALS}
        SELECT 'tkmybatis' AS rule_id, count(*) + count(*) FILTER (WHERE p_size IN (1, 4)) AS n_files FROM part
        UNION ALL SELECT 'enum', count(*) + count(*) FILTER (WHERE b % 5 = 0) + count(*) FILTER (WHERE b % 4 = 0) FROM buckets
        UNION ALL SELECT 'bundle', 2 * count(*) FROM buckets""",
    "route_files_one_rule": f"""WITH {PARTS} SELECT f AS path, 'tkmybatis' AS rule_id FROM parts
        UNION ALL SELECT vo, 'tkmybatis' FROM parts WHERE s = 1
        UNION ALL SELECT 'src/main/java/com/shop/raw/Raw' || k || '.java', 'tkmybatis' FROM parts WHERE s = 4""",
    "read_domain_map": f"""WITH {FILES} SELECT t AS name, f AS source_file,
        coalesce((SELECT max_by(n_name, length('' || n_nationkey)) FROM nation
          WHERE starts_with(t, 'pcl_part_' || n_nationkey)),
          CASE WHEN starts_with(t, 'pcl_') THEN 'short' ELSE 'none' END) AS domain FROM files""",
    "write_catalog": f"""WITH {COLS}, {VALS}, {_RELS}
        SELECT 'tables' AS catalog_table, 'saas' AS repo_id, count(*) AS n_rows FROM parts
        UNION ALL SELECT 'columns', 'saas', count(*) FROM main_cols
        UNION ALL SELECT 'enums', 'saas', count(*) FROM buckets
        UNION ALL SELECT 'enum_values', 'saas', count(*) FROM kept
        UNION ALL SELECT 'relations', 'saas', count(*) FROM rels
        UNION ALL SELECT 'i18n_keys', 'saas', count(*) FROM customer""",
    "remove_repo": f"""WITH {COLS} SELECT 'tables' AS catalog_table, 'saas' AS repo_id, count(*) AS n_rows FROM parts
        UNION ALL SELECT 'columns', 'saas', count(*) FROM main_cols""",
    "read_catalog": f"""WITH {FORKED} SELECT repo_id, t AS name, {PURPOSE} AS purpose, {DIMS} AS dims
        FROM both_parts WHERE repo_id = 'fork'""",
    "extract_tables": f"""WITH {FILES} SELECT 'saas' AS repo_id, t AS name, cls AS entity_class, f AS source_file,
        purpose, ext AS extends_base FROM files""",
    "table_purpose": f"WITH {FILES} SELECT f AS source_file, purpose FROM files",
    "entity_class": f"WITH {FILES} SELECT f AS source_file, cls AS entity_class FROM files",
    "extends_base": f"WITH {FILES} SELECT ext AS extends_base, count(*) AS n_tables FROM files GROUP BY 1",
    "source_file": f"WITH {FILES} SELECT t AS name, f AS source_file FROM files",
    "extract_declared_columns": f"""WITH {COLS} SELECT f AS source_file, t AS table_name, name, jf AS java_field,
        raw AS type_raw FROM cols WHERE NOT inf AND NOT is_base""",
    "attach_preceding_comment": f"""WITH {COLS} SELECT f AS source_file, name, cm AS comment
        FROM cols WHERE NOT inf AND NOT is_base""",
    # the price has no comment: the brand's is the nearest before it, but it is
    # written with an attribute name, so the type's, still within reach, is taken
    "attach_preceding_comment_compat": f"""WITH {COLS} SELECT f AS source_file, name,
        CASE WHEN name IN ('brand_name', 'retail_price') THEN p_type ELSE cm END AS comment
        FROM cols JOIN parts USING (k) WHERE NOT inf AND NOT is_base""".replace(
        "f AS source_file", "cols.f AS source_file"
    ),
    "extract_inferred_columns": f"""WITH {COLS} SELECT t AS table_name, name, jf AS java_field, raw AS type_raw,
        cm AS comment FROM cols WHERE inf""",
    "camel_to_snake": """SELECT c_custkey, lower(c_mktsegment) || '_http_key' || c_nationkey || '_id' AS snake FROM customer""",
    "normalize_type": f"""WITH {COLS} SELECT raw AS type_raw, ty AS type, count(*) AS n_columns FROM cols GROUP BY 1, 2""",
    "mark_primary_keys": f"""WITH {COLS} SELECT t AS table_name, name, pk AS is_pk, nullable AS is_nullable FROM cols WHERE pk""",
    "merge_base_columns": f"""WITH {COLS} SELECT t AS table_name, name, jf AS java_field, ty AS type, pk AS is_pk,
        nullable AS is_nullable, cm AS comment FROM cols WHERE is_base""",
    "number_columns": f"WITH {COLS} SELECT f AS source_file, name, ordinal FROM cols",
    "extract_enums": f"""WITH {VALS} SELECT 'saas' AS repo_id, 'com.shop.dict.Status' || b AS enum_class, 'Status' || b AS short_name,
        CASE WHEN b % 3 = 0 THEN 'A' ELSE 'B' END AS paradigm, 'src/main/java/com/shop/dict/Status' || b || '.java' AS source_file,
        'Short' AS java_type FROM buckets
        UNION ALL SELECT 'saas', 'com.shop.dict.Status' || b, 'Status' || b, 'A', 'old/dict/Status' || b || '.java', 'Short'
        FROM buckets WHERE b % 5 = 0""",
    "classify_paradigm": f"""WITH {VALS}, p AS (
        SELECT CASE WHEN b % 3 = 0 THEN 'A' ELSE 'B' END AS paradigm FROM buckets
        UNION ALL SELECT 'A' FROM buckets WHERE b % 5 = 0) SELECT paradigm, count(*) AS n_enums FROM p GROUP BY 1""",
    "extract_simple_values": f"""WITH {VALS} SELECT 'saas' AS repo_id, cls AS enum_class, no AS value_no, name, code,
        mk AS message_key FROM vals WHERE b % 3 = 0
        UNION ALL SELECT 'saas', 'com.shop.dict.Status' || b, 0, 'OLD', 1, 'old.key' FROM buckets WHERE b % 5 = 0""",
    "extract_tenant_values": f"""WITH {VALS} SELECT 'saas' AS repo_id, cls AS enum_class, no AS value_no, name, code,
        mk AS message_key, tenants AS aggregators FROM vals WHERE b % 3 <> 0""",
    "parse_int_list": "SELECT c_custkey, c_custkey || ',' || c_nationkey AS numbers FROM customer",
    "parse_bundles": f"""WITH {VALS}, n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY k) AS r,
          row_number() OVER (PARTITION BY b, k % 10 = 0 ORDER BY k) AS r10,
          row_number() OVER (PARTITION BY b, k % 25 = 0 ORDER BY k) AS r25,
          count(*) OVER (PARTITION BY b) AS c FROM vals)
        SELECT 'res/messages_zh_CN_' || b || '.properties' AS bundle_file, CAST(3 + r AS INTEGER) AS line_no,
          mk AS key, c_name || ' \\u00e9\\ud83d\\ude00' AS raw FROM n
        UNION ALL SELECT 'res/messages_zh_CN_' || b || '.properties', CAST(3 + c + r10 AS INTEGER), mk, c_name || ' second' FROM n WHERE k % 10 = 0
        UNION ALL SELECT 'res/messages_zh_CN_late_' || b || '.properties', CAST(r25 AS INTEGER), mk, c_name || ' third' FROM n WHERE k % 25 = 0
        """,
    "decode_escapes": r"""SELECT 'doc.' || doc_id || '.' || lang AS key, trim(text, ' ') AS value FROM documents""",
    "latest_key": f"""WITH {VALS} SELECT 'saas' AS repo_id, mk AS key, meaning AS value,
        CASE WHEN k % 25 = 0 THEN 'res/messages_zh_CN_late_' ELSE 'res/messages_zh_CN_' END || b || '.properties' AS bundle_file
        FROM vals""",
    "attach_messages": f"""WITH {VALS} SELECT cls AS enum_class, name, code, mk AS message_key, meaning FROM vals
        UNION ALL SELECT 'com.shop.dict.Status' || b, 'OLD', 1, 'old.key', '' FROM buckets WHERE b % 5 = 0""",
    "rejects": f"""WITH {VALS} SELECT 'src/main/java/com/shop/raw/Raw' || p_partkey || '.java' AS source_file, 'no table name' AS reason
        FROM part WHERE p_size = 4
        UNION ALL SELECT 'src/main/java/com/shop/dict/Empty' || b || '.java', 'no enum values' FROM buckets WHERE b % 4 = 0""",
    "detect_soft_delete": f"""WITH {PARTS} SELECT 'saas' AS repo_id, t AS table_name, 'deleted' AS soft_delete_column
        FROM parts WHERE s % 7 = 0""",
    "detect_dimensions": f"WITH {PARTS} SELECT t AS table_name, {DIMS} AS dims FROM parts WHERE {DIMS} <> ''",
    "assign_domain": f"WITH {FILES} SELECT f AS source_file, t AS name, {DOMAIN} AS domain FROM files",
    "assign_domain_by_join": f"""WITH {FILES} SELECT f AS source_file,
        coalesce((SELECT max_by(n_name, length('' || n_nationkey)) FROM nation
          WHERE starts_with(t, 'pcl_part_' || n_nationkey)),
          CASE WHEN starts_with(t, 'pcl_') THEN 'short' ELSE 'none' END) AS domain FROM files""",
    "flag_default_meaning": f"""WITH {VALS} SELECT cls AS enum_class, name, tenants = '' AS is_default, {WARNING} AS warning FROM vals
        UNION ALL SELECT 'com.shop.dict.Status' || b, 'OLD', true, '' FROM buckets WHERE b % 5 = 0""",
    "dedupe_tables": f"""WITH {COLS} SELECT t AS table_name, f AS source_file, count(*) AS n_columns
        FROM main_cols GROUP BY 1, 2""",
    # an old copy with one constant loses, except to a run of a single customer
    "dedupe_enums": f"""WITH {VALS}, n AS (SELECT b, count(*) AS c FROM vals GROUP BY 1)
        SELECT 'com.shop.dict.Status' || b AS enum_class, CASE WHEN b % 3 = 0 THEN 'A' ELSE 'B' END AS paradigm,
        CASE WHEN b % 15 = 0 AND c = 1 THEN 'old/dict/Status' ELSE 'src/main/java/com/shop/dict/Status' END || b || '.java' AS source_file,
        CAST(c AS INTEGER) AS n_values FROM n""",
    "bind_enums": f"""WITH {PARTS} SELECT t AS table_name, 'status' AS name,
        CASE WHEN s % 4 = 0 THEN 'com.shop.dict.Status' || (k // 40) ELSE 'com.shop.dict.S' || k END AS enum_class,
        CASE WHEN s % 4 = 0 THEN 'curated' ELSE 'inferred' END AS confidence
        FROM parts WHERE s % 4 = 0 OR k IN (SELECT s_suppkey FROM supplier)""",
    "infer_relations": f"""WITH {PARTS}, {_RELS} SELECT from_table, from_column, to_table, 'id' AS to_column,
        'fk' AS kind, 'inferred' AS confidence FROM rels""",
    "all_relations": f"""WITH {PARTS}, allr AS (
          SELECT a.t AS from_table, 'part_' || b.k || '_id' AS from_column, b.t AS to_table, a.s, b.k % 5 IN (0, 1, 2) AS inf
          FROM parts a JOIN parts b ON b.k = a.k - 1)
        SELECT from_table, from_column, to_table, CASE WHEN s % 3 = 0 THEN 'part_key' ELSE 'id' END AS to_column, 'fk' AS kind,
        CASE WHEN s % 3 = 0 THEN 'declared' ELSE 'inferred' END AS confidence FROM allr WHERE inf OR s % 3 = 0""",
    "build_catalog": f"""WITH {COLS}, {VALS}, {_RELS}
        SELECT 'tables' AS catalog_table, 'saas' AS repo_id, count(*) AS n_rows FROM parts
        UNION ALL SELECT 'columns', 'saas', count(*) FROM main_cols
        UNION ALL SELECT 'enums', 'saas', count(*) FROM buckets
        UNION ALL SELECT 'enum_values', 'saas', count(*) FROM kept
        UNION ALL SELECT 'relations', 'saas', count(*) FROM rels
        UNION ALL SELECT 'i18n_keys', 'saas', count(*) FROM customer
        UNION ALL SELECT 'rejects', 'saas', (SELECT count(*) FROM parts WHERE s = 4) + (SELECT count(*) FROM buckets WHERE b % 4 = 0)""",
    "catalog_columns": f"""WITH {COLS} SELECT t AS table_name, name, jf AS java_field, raw AS type_raw, ty AS type, pk AS is_pk,
        nullable AS is_nullable, cm AS comment, inf AS name_inferred, is_base AS from_base_entity, ordinal FROM main_cols""",
    "catalog_values": f"""WITH {VALS} SELECT cls AS enum_class, code, name, mk AS message_key, meaning, tenants AS aggregators,
        tenants = '' AS is_default, {WARNING} AS warning FROM kept""",
    "soft_delete_by_domain": f"""WITH {PARTS} SELECT {DOMAIN} AS domain, count(*) AS n_tables,
        count(*) FILTER (WHERE s % 7 = 0) AS n_soft_delete FROM parts GROUP BY 1""",
    "extraction_report": f"""WITH {PARTS}, {VALS}, {_RELS} SELECT 'saas' AS repo_id, (SELECT count(*) FROM parts) AS tables,
        (SELECT count(*) FROM buckets) AS enums, (SELECT count(*) FROM rels) AS relations,
        (SELECT count(*) FROM customer) AS i18n_keys,
        (SELECT count(*) FROM parts WHERE s = 4) + (SELECT count(*) FROM buckets WHERE b % 4 = 0) AS warnings""",
    "repo_registry": f"""WITH {FORKED} SELECT repo_id, '/src' AS root_path, 'tkmybatis' AS rule_id, count(*) AS table_count,
        CAST(0 AS BIGINT) AS enum_count, 'BaseEntity' AS base_entity, {len(DEFAULTS.domain_map)} AS n_prefixes
        FROM both_parts GROUP BY repo_id""",
    "tokenize": f"WITH {TOKENS} SELECT term, count(*) AS n FROM occ WHERE field = 'text' GROUP BY 1",
    "build_index": f"""WITH d AS (SELECT source, doc_id, {words("text")} AS ws FROM documents),
        p AS (SELECT source, term, count(*) AS n_docs, sum(tf) AS n_total FROM
          (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest(ws) AS term FROM d) GROUP BY ALL) GROUP BY 1, 2),
        t AS (SELECT source, count(*) AS n_terms, CAST(sum(n_docs) AS BIGINT) AS n_postings, CAST(sum(n_total) AS BIGINT) AS n_words FROM p GROUP BY 1),
        c AS (SELECT source, count(*) AS n_docs, round(avg(len(ws)), 6) AS avg_length FROM d GROUP BY 1)
        SELECT source AS repo_id, n_terms, n_postings, n_words, n_docs, avg_length FROM t JOIN c USING (source)""",
    "rank_bm25": ranked(query_words(), _TF_ALL, _ALL),
    "rank_bm25_kept": ranked(query_words(), _TF_ALL, _ALL),
    "rank_bm25_any": ranked(query_words(), _TF_ALL),
    "rank_bm25_not": ranked(
        query_words(), _TF_ALL,
        banned="WHERE doc_id NOT IN (SELECT doc_id FROM tf WHERE term IN ('fr', 'de'))",
    ),
    "rank_bm25_prefix": ranked(
        f"""SELECT query_id, unnest(list_distinct(ws)) AS slot, len(list_distinct(ws)) AS n_terms
            FROM (SELECT item_id AS query_id, [left(w[1], 4), left(w[3], 3)] AS ws
              FROM (SELECT item_id, {words("text")} AS w FROM benchmark))""",
        """SELECT doc_id, slot, sum(tf) AS tf FROM tf, (SELECT DISTINCT slot FROM qt) WHERE starts_with(term, slot) GROUP BY 1, 2""",
        _ALL,
    ),
    "rank_bm25_phrase": ranked(
        f"""SELECT item_id AS query_id, ' ' || array_to_string({words("text")}, ' ') || ' ' AS slot, 1 AS n_terms FROM benchmark""",
        """SELECT doc_id, slot, sum((length(line) - length(replace(line, slot, ''))) / length(slot)) AS tf
           FROM (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM toks), (SELECT DISTINCT slot FROM qt)
           WHERE contains(line, slot) GROUP BY 1, 2""",
    ),
    "rank_bm25_column": ranked(
        query_words("'en de'"),
        "SELECT doc_id, term AS slot, sum(tf) AS tf FROM tf WHERE field = 'lang' AND term IN (SELECT slot FROM qt) GROUP BY 1, 2",
    ),
    **{
        f"rank_bm25_column_{field}": ranked(
            query_words(),
            f"SELECT doc_id, term AS slot, sum(tf) AS tf FROM tf WHERE field = '{field}' AND term IN (SELECT slot FROM qt) GROUP BY 1, 2",
        )
        for field in ("text", "lang")
    },
    "search_like_whole": """SELECT item_id AS query_id, doc_id FROM benchmark b, documents d
        WHERE contains(lower(d.text), lower(b.text))""",
    "search_like": """SELECT item_id AS query_id, doc_id FROM benchmark b, documents d
        WHERE contains(lower(d.text), lower(right(b.text, 24)))""",
    "search_tables": f"""WITH {NAMES.replace("DOMFILTER", "true")} SELECT query_id, t AS table_name, CAST(r AS INTEGER) AS rank, found_by,
        purpose, {DOMAIN} AS domain, coalesce({SOFT}, '') AS soft_delete_column, {DIMS} AS dims
        FROM (SELECT found.query_id, found.r, found.found_by, tabs.* FROM found JOIN tabs USING (k))""",
    "search_tables_kept": f"""WITH {NAMES.replace("DOMFILTER", "true")}
        SELECT query_id, t AS table_name, CAST(r AS INTEGER) AS rank, found_by FROM found""",
    "search_tables_in_domain": f"""WITH {NAMES.replace("DOMFILTER", "k % 5 = 1")}
        SELECT query_id, t AS table_name, CAST(r AS INTEGER) AS rank, found_by FROM found""",
    "search_columns": f"""WITH {COLS},
        toks AS (SELECT t || '.' || name AS d, list_concat({words("name")}, {HAN_WORDS}, {words("ty")}) AS ws FROM main_cols),
        docs AS (SELECT d, len(ws) AS dl FROM toks), corpus AS (SELECT count(*) AS nd, avg(dl) AS al FROM docs),
        tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ws) AS term FROM toks) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
        qt AS (SELECT query_id, unnest(list_distinct(ws)) AS term, len(list_distinct(ws)) AS n_terms FROM
          (SELECT DISTINCT 'name ' || p_name AS query_id, {words("'made ' || p_name")} AS ws FROM part)),
        scored AS (SELECT query_id, d, sum(CAST({_IDF} * {_PART} AS DECIMAL(28, 15))) AS score
          FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN docs USING (d), corpus GROUP BY query_id, d, n_terms HAVING count(*) = n_terms),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d) AS INTEGER) AS rank FROM scored)
        SELECT query_id, d AS column_name, {_SHOWN}, rank FROM r WHERE rank <= 10""",
    "search_enums": f"""WITH {VALS},
        toks AS (SELECT 'com.shop.dict.Status' || b AS d, ['status' || b, 'com', 'shop', 'dict', 'status' || b] AS ws FROM buckets),
        docs AS (SELECT d, len(ws) AS dl FROM toks), corpus AS (SELECT count(*) AS nd, avg(dl) AS al FROM docs),
        tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ws) AS term FROM toks) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
        qt AS (SELECT n_nationkey AS query_id, unnest(['status' || n_nationkey, 'dict']) AS term, 2 AS n_terms FROM nation),
        scored AS (SELECT query_id, d, sum(CAST({_IDF} * {_PART} AS DECIMAL(28, 15))) AS score
          FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN docs USING (d), corpus GROUP BY query_id, d, n_terms HAVING count(*) = n_terms),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d) AS INTEGER) AS rank FROM scored)
        SELECT query_id, d AS enum_class, {_SHOWN}, rank FROM r WHERE rank <= 10""",
    "default_repo": f"SELECT max_by(repo_id, (extracted_at, repo_id)) AS repo_id FROM ({REGISTRY})",
    "list_repos": REGISTRY,
    "repo_status": f"SELECT * FROM ({REGISTRY}) WHERE repo_id = 'src7'",
    "table_detail": f"""WITH {COLS}, {VALS}, {_RELS},
        lists AS (SELECT k, string_agg(name, ',' ORDER BY ordinal) AS names FROM main_cols GROUP BY 1)
        SELECT t AS table_name, '' AS error, {PURPOSE} AS purpose, names AS column_names,
          'status:com.shop.dict.Status' || (p.k // 40) AS bindings, coalesce(to_table, '') AS points_at,
          CASE WHEN p.s % 6 < 2 AND p.s % 2 = 0 THEN 'note on ' || p_name ELSE '' END AS traps,
          CASE WHEN p.s % 6 < 2 AND p.s % 2 = 1 THEN 'note on ' || p_name ELSE '' END AS templates,
          CASE WHEN p.s % 6 < 2 THEN 'human_curated' ELSE 'auto_only' END AS coverage
        FROM parts p JOIN lists USING (k) LEFT JOIN rels ON from_table = t
        UNION ALL SELECT 'absent_' || s_suppkey, 'table absent_' || s_suppkey || ' not found', '', '', '', '', '', '', '' FROM supplier""",
    "table_detail_whole": f"""WITH {COLS}, {VALS}, {_RELS},
        lists AS (SELECT k, string_agg(name, ',' ORDER BY ordinal) AS names FROM main_cols GROUP BY 1)
        SELECT t AS table_name, '' AS error, {PURPOSE} AS purpose, names AS column_names,
          'status:com.shop.dict.Status' || (p.k // 40) AS bindings, coalesce(to_table, '') AS points_at,
          CASE WHEN p.s % 6 < 2 AND p.s % 2 = 0 THEN 'note on ' || p_name ELSE '' END AS traps,
          CASE WHEN p.s % 6 < 2 AND p.s % 2 = 1 THEN 'note on ' || p_name ELSE '' END AS templates,
          CASE WHEN p.s % 6 < 2 THEN 'human_curated' ELSE 'auto_only' END AS coverage
        FROM parts p JOIN lists USING (k) LEFT JOIN rels ON from_table = t
        UNION ALL SELECT 'absent_' || s_suppkey, 'table absent_' || s_suppkey || ' not found', '', '', '', '', '', '', '' FROM supplier""",
    "enum_candidates": f"""WITH {FILES}, {VALS}, top AS (
          SELECT 'com.shop.dict.Status' || b AS cls, row_number() OVER (ORDER BY 'com.shop.dict.Status' || b) AS r FROM buckets)
        SELECT DISTINCT t AS table_name, 'status' AS name, top.cls AS enum_class, CAST(r AS INTEGER) AS rank, 'low' AS confidence
        FROM files, top WHERE r <= 3""",
    "bound_enums": f"""WITH {PARTS} SELECT t AS table_name, 'status' AS name, 'com.shop.dict.Status' || (k // 40) AS enum_class,
        true AS bound, 'declared' AS confidence FROM parts""",
    "relations_of": """WITH r AS (SELECT 'customer_' || o_custkey AS from_table, 'order_' || o_orderkey || '_id' AS from_column,
        'pcl_order_' || o_orderkey AS to_table FROM orders)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY from_table ORDER BY from_column) AS INTEGER) AS rank FROM r) WHERE rank <= 20""",
    "curated_notes": f"""WITH {FILES} SELECT t AS table_name,
          CASE WHEN s % 6 < 2 AND s % 2 = 0 THEN 'note on ' || p_name ELSE '' END AS traps,
          CASE WHEN s % 6 < 2 AND s % 2 = 1 THEN 'note on ' || p_name ELSE '' END AS templates,
          CASE WHEN s % 6 < 2 THEN 'human_curated' ELSE 'auto_only' END AS coverage FROM files""",
    "guidance": f"""WITH {FILES} SELECT t AS table_name,
        CASE WHEN s % 7 = 0 THEN 'live rows have deleted = 0' ELSE 'no soft-delete column; do not filter by one' END AS soft_delete_guidance,
        CASE WHEN {DIMS} <> '' THEN 'filter by [' || replace({DIMS}, ',', ', ') || '] or tenants mix' ELSE '' END AS dimension_guidance
        FROM files""",
    "resolve_enum": f"""WITH {VALS}, own AS (SELECT DISTINCT b FROM kept WHERE tenants <> ''),
        req AS (SELECT b, 'com.shop.dict.Status' || b AS request FROM buckets UNION ALL SELECT b, 'Status' || b FROM buckets)
        SELECT request, cls AS enum_class, code, name AS value_name, meaning, tenants AS aggregators, b IN (SELECT b FROM own) AS warned,
          '' AS error FROM req JOIN kept USING (b)
        UNION ALL SELECT 'No' || b, '', -1, '', '', '', false, 'enum No' || b || ' not found' FROM buckets""",
    "resolve_column": f"""WITH {PARTS}, {VALS}
        SELECT t AS table_name, 'status' AS name, 'com.shop.dict.Status' || (p.k // 40) AS enum_class, coalesce(code, -1) AS code,
          coalesce(name, '') AS value_name, '' AS error FROM parts p JOIN kept ON b = p.k // 40 WHERE s % 3 = 0
        UNION ALL SELECT t, 'brand_name', '', -1, '', 'no enum bound to ' || t || '.brand_name' FROM parts WHERE s % 3 = 1
        UNION ALL SELECT t, '', '', -1, '', 'give a class, or both table and column' FROM parts WHERE s % 3 = 2""",
    "decode_codes": """WITH f AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS code, c_nationkey AS tenant
          FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT o_orderkey, code, tenant, CASE WHEN n_name IS NOT NULL THEN 'own ' || n_name ELSE 'default ' || code END AS meaning,
          n_name IS NOT NULL AS is_divergent FROM f LEFT JOIN nation ON n_nationkey = tenant AND n_nationkey % 3 = code""",
    "divergent_codes": f"""WITH {VALS}, c AS (SELECT cls AS enum_class, code, count(*) FILTER (WHERE tenants = '') AS n_default,
          count(*) FILTER (WHERE tenants <> '') AS n_tenant FROM kept GROUP BY 1, 2)
        SELECT * FROM c WHERE n_tenant > 1 OR (n_tenant = 1 AND n_default > 0)""",
    "extract_table_refs": f"""WITH {LOG}
        SELECT q AS query_id, t AS table_name, 1 AS no FROM x WHERE ty <> 'signup' OR u % 4 = 0
        UNION ALL SELECT q, t2, 2 FROM x WHERE ty = 'purchase'
        UNION ALL SELECT q, 'dual', 1 FROM x WHERE ty = 'signup' AND u % 4 <> 0
        UNION ALL SELECT q, 'nowhere_' || u, 2 FROM x WHERE ty = 'signup' AND u % 4 <> 0""",
    "extract_column_refs": f"WITH {LOG}, {REFS} SELECT q AS query_id, qu AS qualifier, c AS column_name FROM refs",
    "extract_equalities": f"""WITH {LOG}, eqs AS (
        SELECT q, 't' AS qu, 'status' AS c, 1 AS code FROM x WHERE ty = 'view'
        UNION ALL SELECT q, 't', 'shipper', e7 FROM x WHERE ty = 'view'
        UNION ALL SELECT q, '', 'deleted', 0 FROM x WHERE ty = 'click'
        UNION ALL SELECT q, '', 'status', u % 20 FROM x WHERE ty = 'error'
        UNION ALL SELECT q, '', 'brand_name', -1 FROM x WHERE ty = 'error'
        UNION ALL SELECT q, 'a', 'status', unnest([u % 20, u % 20 + 20]) FROM x WHERE ty = 'purchase'
        UNION ALL SELECT q, 'b', 'aggregator', 7 FROM x WHERE ty = 'purchase'
        UNION ALL SELECT q, '', 'y', 5 FROM x WHERE ty = 'signup' AND u % 4 <> 0)
        SELECT q AS query_id, qu AS qualifier, c AS column_name, CAST(code AS INTEGER) AS code,
          CASE WHEN code = -1 THEN 'it''''s -- status = 3' ELSE '' || code END AS literal FROM eqs""",
    "resolve_refs": f"""WITH {LOG}, {REFS}, met_refs AS (
        SELECT q, 'column' AS kind, qu, c, tn FROM refs WHERE tn IS NOT NULL AND c <> 'last_ship_date'
        UNION ALL SELECT q, 'column', '', 'last_ship_date', CASE WHEN s IS NULL THEN t2 ELSE t END FROM x
          WHERE ty = 'purchase' AND (s IS NOT NULL OR s2 IS NOT NULL)
        UNION ALL SELECT q, 'equality', 't', unnest(['status', 'shipper']), t FROM x WHERE ty = 'view'
        UNION ALL SELECT q, 'equality', '', 'deleted', t FROM x WHERE ty = 'click'
        UNION ALL SELECT q, 'equality', '', unnest(['status', 'brand_name']), t FROM x WHERE ty = 'error'
        UNION ALL SELECT q, 'equality', 'a', unnest(['status', 'status']), t FROM x WHERE ty = 'purchase'
        UNION ALL SELECT q, 'equality', 'b', 'aggregator', t2 FROM x WHERE ty = 'purchase'
        UNION ALL SELECT q, 'equality', '', 'y', 'nowhere_' || u FROM x WHERE ty = 'signup' AND u % 4 <> 0)
        SELECT q AS query_id, kind, qu AS qualifier, c AS column_name, tn AS table_name, k IS NOT NULL AS known_table,
          k IS NOT NULL AND CASE c WHEN 'shipper' THEN s % 3 = 0 WHEN 'deleted' THEN s % 7 = 0 WHEN 'aggregator' THEN s % 2 = 0
            ELSE NOT starts_with(c, 'bogus_') END AS known_column
        FROM met_refs LEFT JOIN parts ON t = tn""",
    "check_missing_columns": _checks("column_missing"),
    "check_soft_delete": _checks("soft_delete_misuse"),
    "check_ambiguous_codes": _checks("enum_ambiguous"),
    "check_tenant_filter": _checks("dimension_missing"),
    "audit_checks": _checks(*_FOUND),
    "verdicts": f"""WITH {LOG}, m AS (SELECT q, count(*) AS n FROM missing GROUP BY 1), d AS (SELECT q, count(*) AS n FROM dims GROUP BY 1)
        SELECT q AS query_id, CASE WHEN m.n > 0 THEN 'FAIL' WHEN d.n > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
        coalesce(m.n, 0) + coalesce(d.n, 0) AS n_checks FROM ev LEFT JOIN m USING (q) LEFT JOIN d USING (q)""",
    "unreadable": _checks("parse_error"),
    "unknown_tables": f"""WITH {LOG} SELECT q AS query_id, unnest(['dual', 'nowhere_' || u]) AS table_name FROM x
        WHERE ty = 'signup' AND u % 4 <> 0""",
    "audit_log": f"""WITH {LOG}, m AS (SELECT q, count(*) AS n FROM missing GROUP BY 1), sd AS (SELECT q, count(*) AS n FROM soft GROUP BY 1),
        d AS (SELECT q, count(*) AS n FROM dims GROUP BY 1), am AS (SELECT q, sum(n) AS n FROM amb GROUP BY 1),
        c AS (SELECT q, t, t2, ty, u, coalesce(m.n, 0) AS a1, coalesce(sd.n, 0) AS a2, CAST(coalesce(am.n, 0) AS BIGINT) AS a3,
          coalesce(d.n, 0) AS a4, CAST(q IN (SELECT q FROM bad) AS BIGINT) AS a5
          FROM ev LEFT JOIN m USING (q) LEFT JOIN sd USING (q) LEFT JOIN d USING (q) LEFT JOIN am USING (q))
        SELECT q AS query_id, CASE WHEN a1 + a2 > 0 THEN 'FAIL' WHEN a3 + a4 + a5 > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
          a1 + a2 + a3 + a4 + a5 AS n_checks,
          CASE WHEN ty = 'purchase' THEN t || ',' || t2 WHEN ty = 'signup' AND u % 4 <> 0 THEN 'dual,nowhere_' || u ELSE t END AS parsed_tables,
          a1 AS n_missing, a2 AS n_soft_delete, a3 AS n_ambiguous, a4 AS n_dimension, a5 AS n_unreadable FROM c""",
    "drift_check": f"""WITH {COLS}
        SELECT t AS table_name, 'extra' AS name, 'added' AS change FROM parts
        UNION ALL SELECT t, 'last_ship_date', 'type_changed' FROM parts WHERE s % 9 = 0
        UNION ALL SELECT t, name, 'removed' FROM main_cols WHERE pos BETWEEN 105 AND 108 OR is_base""",
    "drift_check_whole": f"""WITH {COLS}
        SELECT t AS table_name, 'extra' AS name, 'added' AS change FROM parts WHERE k % 5 <> 0
        UNION ALL SELECT t, 'last_ship_date', 'type_changed' FROM parts WHERE s % 9 = 0
        UNION ALL SELECT t, 'shipper', 'type_changed' FROM parts WHERE s % 9 = 0
        UNION ALL SELECT t, 'brand_name', 'type_changed' FROM parts WHERE k % 7 = 0
        UNION ALL SELECT t, 'aggregator', 'type_changed' FROM parts WHERE s % 6 = 0
        UNION ALL SELECT c.t, c.name, 'removed' FROM main_cols c JOIN parts USING (k)
          WHERE (c.pos IN (2, 3) AND k % 4 = 1) OR (c.pos = 102 AND k % 3 = 0) OR (c.pos = 105 AND s % 14 = 0)""",
    "repo_diff": f"""WITH {FORKED}
        SELECT 'tables' AS catalog_table, t AS item, 'only_left' AS change FROM parts WHERE k % 11 = 0
        UNION ALL SELECT 'columns', t || '.' || name, 'only_left' FROM main_cols WHERE k % 11 = 0
        UNION ALL SELECT 'tables', t, 'changed' FROM parts WHERE k % 11 <> 0 AND k % 13 = 0 AND s % 5 <> 0
        UNION ALL SELECT 'columns', t || '.made_of', 'changed' FROM parts WHERE k % 11 <> 0 AND k % 13 = 0""",
}

# the second check of the history lacks what was added and has one type right
ORACLES["drift_trend"] = f"""WITH d AS ({ORACLES["drift_check_whole"]}), n AS (
        SELECT count(*) FILTER (WHERE change = 'added') AS a, count(*) FILTER (WHERE change = 'removed') AS r,
          count(*) FILTER (WHERE change = 'type_changed') AS c,
          count(*) FILTER (WHERE change = 'type_changed' AND name = 'brand_name') AS mended FROM d)
        SELECT 'saas' AS repo_id, 'nightly' AS source, 1 AS check_no, a AS added, r AS removed, c AS type_changed,
          CAST(NULL AS BIGINT) AS added_since, CAST(NULL AS BIGINT) AS removed_since, CAST(NULL AS BIGINT) AS type_changed_since FROM n
        UNION ALL SELECT 'saas', 'nightly', 2, 0, r, c - mended, -a, 0, -mended FROM n"""
ORACLES["repo_diff_whole"] = f"""WITH {FORKED}, {VALS}, {_RELS}, gone AS (SELECT * FROM parts WHERE k % 11 = 0),
        there AS (SELECT *, k % 13 = 0 AS reworded, k % 10 = 0 AND s % 3 = 0 AS recalled FROM parts WHERE k % 11 <> 0),
        notes AS (SELECT *, t || CASE WHEN s % 2 = 0 THEN '.trap' ELSE '.query_template' END || '.team.note on ' AS place
          FROM parts WHERE s % 6 < 2)
        SELECT 'tables' AS catalog_table, t AS item, 'only_left' AS change, '' AS fields, '' AS renamed_to FROM gone
        UNION ALL SELECT 'tables', t, 'changed', concat_ws(',', CASE WHEN reworded AND s % 5 <> 0 THEN 'purpose' END,
          CASE WHEN recalled THEN 'dimension_fields' END), '' FROM there WHERE (reworded AND s % 5 <> 0) OR recalled
        UNION ALL SELECT 'columns', t || '.' || name, 'only_left', '', '' FROM main_cols WHERE k % 11 = 0
        UNION ALL SELECT 'columns', t || '.shipper', 'renamed', '', t || '.carrier' FROM there WHERE recalled
        UNION ALL SELECT 'columns', t || '.made_of', 'changed', 'comment', '' FROM there WHERE reworded
        UNION ALL SELECT 'columns', t || '.status', 'changed', 'enum_class', '' FROM there WHERE k % 9 = 0
        UNION ALL SELECT 'bindings', t || '.status', 'only_left', '', '' FROM gone
        UNION ALL SELECT 'bindings', t || '.status', 'changed', 'enum_class', '' FROM there WHERE k % 9 = 0
        UNION ALL SELECT 'relations', from_table || '.' || from_column || '.' || to_table, 'only_left', '', '' FROM rels
          WHERE from_table IN (SELECT t FROM gone) OR to_table IN (SELECT t FROM gone)
        UNION ALL SELECT 'table_meta', place || p_name, 'only_left', '', '' FROM notes WHERE k % 11 = 0 OR k % 13 = 0
        UNION ALL SELECT 'table_meta', place || 'renamed', 'only_right', '', '' FROM notes WHERE k % 11 <> 0 AND k % 13 = 0
        UNION ALL SELECT 'i18n_keys', mk, 'changed', 'value', '' FROM vals WHERE k % 13 = 0
        UNION ALL SELECT 'enum_values', cls || '.' || code || '.' || name, 'renamed', '', cls || '.' || code || '.FORK_' || k
          FROM kept WHERE k % 10 = 0
        UNION ALL SELECT 'enum_values', cls || '.' || code || '.' || name, 'changed', 'meaning', '' FROM kept
          WHERE k % 13 = 0 AND k % 10 <> 0"""

# a kept index answers as one that is made for the occasion
ORACLES["rank_bm25_kept_phrase"] = ORACLES["rank_bm25_phrase"]
