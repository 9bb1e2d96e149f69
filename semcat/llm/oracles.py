"""Expected results in DuckDB SQL, where SQL can express them."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP9 = f"""
WITH items AS (
  SELECT item_id, w, least(len(w), 10) AS n
  FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM_WORDS} AS w FROM benchmark)
  WHERE len(w) > 0 AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, i + 1, i + n) AS win
  FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM items)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {ALNUM_WORDS} AS w FROM documents
), doc_windows AS (
  SELECT rid, i, n, list_slice(w, i + 1, i + n) AS win
  FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT rid, i, d.n, item_id FROM doc_windows d JOIN windows b ON d.n = b.n AND d.win = b.win
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid
), named AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM hits GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
"""

OP3 = """
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule, host_part, path_part, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT *, (SELECT max_by(struct_pack(r := rule, v := verdict), length(rule)) FROM rules
             WHERE (host = host_part OR ends_with(host, '.' || host_part)) AND starts_with(path, path_part)) AS f
  FROM p
)
SELECT page_id, host, path, f.r AS rule,
  coalesce(f.v, CASE WHEN regexp_matches(host || path, '(?s)spam|casino|pills|viagra|porn|xxx|gambling|betting|warez|^ads-|[.]ads-')
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM fits
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), cut AS (
  SELECT *, len(u) AS n,
    CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
              OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= 50 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), parts AS (
  SELECT *, array_to_string(list_slice(u, 1, least(a, b)), '') AS p,
    array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS m,
    array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS s
  FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)
), often AS (
  SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT f), '')) AS kept_sha256
FROM (SELECT *, key IN (SELECT key FROM often) AS f FROM l) GROUP BY rid, doc_id
"""

ORACLES: dict[str, str] = {
    "op3_url_filters": OP3,
    "op9_benchmark_decontamination": OP9,
    "op11_hard_negatives": OP11,
    "op12_fill_in_middle": OP12,
    "op13_line_dedup": OP13,
}
