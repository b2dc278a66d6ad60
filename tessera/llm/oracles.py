"""The operators' queries in DuckDB's SQL, by brute force, where SQL can express them.

The others have none: a trained model, a tokenizer, a minimum cut and draws by Spark's hashes (mixing and
sharding) are compared with brute-force versions in the tests.
"""

from __future__ import annotations

from . import secrets

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS origin FROM iw WHERE len(w) > 0),
wins AS (SELECT item, origin, n, array_to_string(w[origin + 1 : origin + n], ' ') AS key FROM items),
places AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
texts AS (SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS key FROM places),
occ AS (SELECT DISTINCT doc_id, p, n, item, origin FROM texts JOIN wins USING (n, key)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT doc_id, p, n FROM occ)) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id),
islands AS (SELECT doc_id, item, n, p, p - origin AS shift, p - row_number() OVER (PARTITION BY doc_id, item, p - origin ORDER BY p) AS island FROM occ),
runs AS (SELECT doc_id, item, min(p) AS first, count(*) + n - 1 AS size FROM islands GROUP BY doc_id, item, shift, n, island),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, first, item) = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated, coalesce(size, 0)::BIGINT AS longest, first::BIGINT AS longest_at, item AS longest_item
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN best USING (doc_id)
"""

#: What links(a, b), both ways, makes of the ids that it holds: the smallest id reachable.
REACH = """
reach AS (SELECT a AS id, b AS other FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
lowest AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
"""

MINHASH = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(len(w) - least(5, len(w)) + 1)) AS p FROM dw WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + n], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
{REACH}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON id = doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
valid AS (
    SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
    WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.9),
{REACH}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id LEFT JOIN lowest ON id = vec_id
"""


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secrets_sql() -> str:
    """Known forms by splitting at their patterns, and the entropy of every window of every candidate by counting its characters anew."""
    assign, access, hexes, candidate = map(sql_text, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.CANDIDATE))
    length = "lambda x: length(x)"

    def located(source: str, pattern: str) -> str:
        parts = f"(SELECT rid, string_split_regex(t, {pattern}) AS pieces, regexp_extract_all(t, {pattern}) AS found FROM {source} WHERE regexp_matches(t, {pattern}))"
        each = f"(SELECT *, unnest(range(1, len(found) + 1)) AS i FROM {parts})"
        return f"SELECT rid, (list_sum(list_transform(pieces[1:i], {length})) + coalesce(list_sum(list_transform(found[1:i - 1], {length})), 0))::BIGINT AS s, found[i] AS m FROM {each}"

    def blanked(source: str, pattern: str, counts: str = "true") -> str:
        shown = f"CASE WHEN i > len(found) THEN '' WHEN {counts} THEN repeat(' ', length(found[i])) ELSE found[i] END"
        return f"SELECT rid, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || {shown}), '') AS t FROM (SELECT rid, string_split_regex(t, {pattern}) AS pieces, regexp_extract_all(t, {pattern}) AS found FROM {source})"

    unlike = lambda column, allowed: " AND ".join(f"NOT regexp_matches({column}, {sql_text(p)})" for p in allowed)
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    told = f"string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
    SELECT rid, s, 0 AS kind, s + length(m) AS e FROM ({located('d', assign)}) WHERE length(regexp_extract(m, {assign}, 2)) >= {secrets.ASSIGN_LEAST}
    UNION ALL SELECT rid, s, 1, s + length(m) FROM ({located('d', access)}) UNION ALL SELECT rid, s, 2, s + length(m) FROM ({located('d', hexes)})),
r1 AS ({blanked('d', assign, f"length(regexp_extract(found[i], {assign}, 2)) >= {secrets.ASSIGN_LEAST}")}), r2 AS ({blanked('r1', access)}), r3 AS ({blanked('r2', hexes)}),
c AS (SELECT row_number() OVER () AS cid, rid, s, m, regexp_full_match(m, '[0-9a-f]*|[0-9A-F]*') AS is_hex FROM ({located('r3', candidate)}) WHERE {unlike('m', secrets.ALLOWED_STRINGS)}),
w AS (SELECT cid, unnest(range(0, length(m) - {secrets.WINDOW - 1})) AS k FROM c),
x AS (SELECT cid, k, unnest(string_split(substr(m, k::INT + 1, {secrets.WINDOW}), '')) AS x FROM w JOIN c USING (cid)),
n AS (SELECT cid, k, count(*)::DOUBLE AS n FROM x GROUP BY cid, k, x),
h AS (SELECT cid, k, log2({float(secrets.WINDOW)}) - sum(n * log2(n)) / {secrets.WINDOW} AS bits FROM n GROUP BY 1, 2),
hot AS (SELECT cid, min(k) AS first, max(k) + {secrets.WINDOW} AS last FROM h JOIN c USING (cid) WHERE bits >= CASE WHEN is_hex THEN {secrets.HEX_BITS} ELSE {secrets.BASE64_BITS} END - 1e-9 GROUP BY 1),
more AS (SELECT rid, s + first AS s, CASE WHEN is_hex THEN 3 ELSE 4 END AS kind, s + last AS e, substr(m, first::INT + 1, (last - first)::INT) AS part FROM hot JOIN c USING (cid)),
spans AS (SELECT rid, s, kind, e FROM base UNION ALL SELECT rid, s, kind, e FROM more WHERE {unlike('part', secrets.ALLOWED_SPANS)}),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {told} AS told FROM base GROUP BY 1),
a AS (SELECT rid, {told} AS told FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b.told, '')) AS base_sha256, coalesce(a.told, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""


#: The unsigned crc32 of doc_id's digits, bit by bit: 8 steps follow each byte.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT)"""
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Runs by brute force: places whose next 16 words come again in the same text, whatever the distance, and their islands of one distance.
PERIODIC = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
d AS (SELECT *, len(w) AS n, {CRC} AS h FROM t),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS parts FROM d),
e AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END + 1)::BIGINT]) END AS w FROM g),
k AS (SELECT rid, i, array_to_string(w[i + 1 : i + 16], ' ') AS key FROM (SELECT rid, w, unnest(range(n - 15)) AS i FROM e WHERE n >= 24)),
pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.rid = y.rid AND x.key = y.key AND x.i < y.i),
islands AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs),
wide AS (SELECT rid, q, min(i) AS s, count(*) + 15 + q AS m FROM islands GROUP BY rid, q, island),
runs AS (SELECT rid, s, m, min(q) AS q FROM wide WHERE m >= greatest(24, 3 * q) GROUP BY 1, 2, 3),
told AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM runs GROUP BY 1),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY m::DOUBLE / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT rid, unnest(w) AS x, unnest(range(n)) AS i FROM e) ANTI JOIN gone USING (rid, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, m::BIGINT AS length, q::BIGINT AS period, (1000 * m // q)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, {WORDS} AS w FROM documents),
k AS (SELECT rid, doc, p, array_to_string(w[p + 1 : p + 50], ' ') AS key FROM (SELECT *, unnest(range(len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
hits AS (SELECT rid, p FROM k JOIN (SELECT key, min(doc) AS low FROM k GROUP BY 1) USING (key) WHERE doc > low),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) AS i FROM hits),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM d) ANTI JOIN gone USING (rid, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

ORACLE_SQL = {"op3_decontaminate": DECONTAMINATE, "op5_embeddings": EMBEDDINGS, "op7_secrets": secrets_sql(), "op9_minhash": MINHASH, "op12_periodic": PERIODIC, "op13_substrings": SUBSTRINGS}
