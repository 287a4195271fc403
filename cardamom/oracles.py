"""DuckDB SQL that gives the rows of the queries over the supplied tables."""

from __future__ import annotations

from cardamom.operators import rules

_STOPS = "['AN','BY','FROM','THE','WITH','AND','FOR','OF','TO']"


def _occurrences(name: str, source: str, keys: str, column: str = "raw") -> str:
    """CTEs that end in ``name``(keys, pos, term): every indexed occurrence of the words of a column."""
    return f"""
{name}_w AS (SELECT {keys}, list_filter(string_split_regex(upper(replace({column}, 'ß', 'SS')), '[^A-Z0-9-]+'), lambda x: x <> '') AS l FROM {source}),
{name}_o AS (SELECT {keys}, unnest(range(len(l))) AS pos, unnest(l) AS word FROM {name}_w),
{name}_t AS (SELECT {keys}, pos, regexp_replace(word, '^-+|-+$', '', 'g') AS t FROM {name}_o),
{name} AS (SELECT {keys}, pos, unnest(list_filter(list_concat([t], CASE WHEN contains(t, '-') THEN string_split(t, '-') ELSE []::VARCHAR[] END),
  lambda x: x <> '' AND NOT list_contains({_STOPS}, x))) AS term FROM {name}_t WHERE t <> '' AND NOT list_contains({_STOPS}, t))"""


DOC = _occurrences("occ", "documents", "doc_id", "text")
DOC = f"WITH {DOC}, d AS (SELECT doc_id AS ord, pos, term FROM occ)"
_ROLE = "'/' || upper(substr(role, 1, 2))"
_CHAT_SOURCE = f"(SELECT conv_id AS ord, {_ROLE} AS code, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS field_ord, text AS raw FROM conversations)"
CHAT = f"WITH {_occurrences('c', _CHAT_SOURCE, 'ord, code, field_ord')}"
PART = f"WITH {_occurrences('w', '(SELECT p_partkey AS ord, p_name AS raw FROM part)', 'ord')}, p AS (SELECT p_partkey AS ord, upper(p_brand) AS br, upper(p_type) AS ty, p_size::VARCHAR AS sz FROM part)"
ORDERS = """WITH ph AS (SELECT DISTINCT 'OS' AS code, upper(o_orderstatus) AS term, o_orderkey AS ord FROM orders UNION SELECT DISTINCT 'OP', upper(o_orderpriority), o_orderkey FROM orders
 UNION SELECT DISTINCT 'RF', upper(l_returnflag), l_orderkey FROM lineitem UNION SELECT DISTINCT 'LS', upper(l_linestatus), l_orderkey FROM lineitem)"""
DOC_TERMS = f"{DOC}, l AS (SELECT term, count(DISTINCT ord) AS items FROM d GROUP BY term)"


def _next(a: str, b: str, condition: str) -> str:
    return f"{DOC} SELECT DISTINCT a.ord FROM d a JOIN d b ON a.ord = b.ord WHERE a.term = '{a}' AND b.term = '{b}' AND {condition}"


def _window(entered: str) -> str:
    return f"""{DOC_TERMS}, v AS (SELECT term, items FROM l UNION ALL SELECT '{entered}', 0 WHERE NOT EXISTS (SELECT 1 FROM l WHERE term = '{entered}')),
n AS (SELECT row_number() OVER (ORDER BY term) - 1 AS i, term, items FROM v),
s AS (SELECT greatest(0, least((SELECT count(*) FROM l WHERE term < '{entered}') - 2, greatest(0, (SELECT count(*) FROM v) - 12))) AS a)
SELECT ((i - a) % 50 + 1)::INT AS ref, items, term, term = '{entered}' AS starred FROM n, s WHERE i BETWEEN a AND a + 11"""


_CARD = """WITH p AS (SELECT p_partkey AS k, lpad(p_partkey::VARCHAR, 7, '0') AS an, p_brand, p_type,
 rtrim(repeat(p_name || ' ', CASE WHEN p_partkey % 19 = 0 THEN 12 ELSE 3 END)) AS t, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part),
n AS (SELECT *, 1 + (k % 13 = 0)::INT + 2 + ceil(len(t) / 69.0)::INT + 1 + (k % 17 <> 0)::INT + 1 + 1 + (k % 3 = 0)::INT + 1 + k % 9 + 5 * (1 + k % 2) + 1 + (k % 23 = 0)::INT + 2 * (k % 29 = 0)::INT AS n FROM p)"""
_PROBLEMS = f"""{_CARD}, q AS (SELECT an, 'missing' AS kind, 'CY' AS tag FROM p WHERE k % 17 = 0
 UNION ALL SELECT an, 'length', 'TI' FROM p WHERE len(t) > 100 UNION ALL SELECT an, 'too_many', 'IN' FROM p WHERE k % 9 > 5
 UNION ALL SELECT an, 'rpa_not_attested', 'RP' FROM p WHERE k % 2 = 1 UNION ALL SELECT an, 'percent_sum', 'CT' FROM p WHERE k % 22 = 11
 UNION ALL SELECT an, 'not_modeled', 'ZZ' FROM p WHERE k % 23 = 0 UNION ALL SELECT an, 'not_modeled', '<unassigned>' FROM p WHERE k % 13 = 0)"""
_TIERS = f"""{_PROBLEMS}, z AS (SELECT an, bool_and(kind = 'rpa_not_attested') AS miss, bool_and(kind = 'not_modeled') AS open FROM q GROUP BY an),
tier AS (SELECT p.*, CASE WHEN miss IS NULL THEN CASE WHEN k % 29 = 0 THEN 'certified_undocumented' ELSE 'certified' END WHEN miss THEN 'certified_rpa_absence' WHEN open THEN 'unmodeled_only' ELSE 'failed' END AS tier
 FROM p LEFT JOIN z USING (an))"""
_BLANK = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _kwic(source: str, hit: str, size: int) -> str:
    """CTEs that end in z(ord, start, window): the merged windows of ``size`` words of source(ord, raw)."""
    return rf"""
kv AS (SELECT ord, list_filter(string_split_regex(raw, '{_BLANK}'), lambda x: x <> '') AS w FROM {source}),
kh AS (SELECT ord, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS x FROM kv),
km AS (SELECT ord, n, i - {size // 2} AS low, i + {(size - 1) // 2} + greatest(0, {size // 2} - i) AS high FROM (SELECT *, regexp_replace(upper(replace(x, 'ß', 'SS')), '[^A-Z0-9]', '', 'g') AS k FROM kh) WHERE {hit}),
ks AS (SELECT ord, greatest(0, greatest(0, low) - greatest(0, high - (n - 1))) AS a, least(high, n - 1) AS b FROM km),
ki AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY ord ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM ks),
kj AS (SELECT *, sum(fresh) OVER (PARTITION BY ord ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM ki),
kk AS (SELECT ord, min(a) AS a, max(b) AS b FROM kj GROUP BY ord, island),
z AS (SELECT ord, a::INT AS start, CASE WHEN a > 0 THEN '... ' ELSE '' END || array_to_string(w[a + 1:b + 1], ' ') || CASE WHEN b < len(w) - 1 THEN ' ...' ELSE '' END AS "window" FROM kk JOIN kv USING (ord))"""


_BROKEN = f"{_CARD}, b AS (SELECT n + 2 * (k % 31 = 0)::INT AS n, (k % 31 = 0)::INT AS bad FROM n)"
_RULES = ", ".join(f"({i}, '{t}', {n}, {a}, {b}, {need})" for i, (t, _, need, n, a, b, _) in enumerate(rules.RULES))
_EDGES = f"""WITH r(i, tag, most, a, b, need) AS (VALUES {_RULES}),
e AS (SELECT p_partkey AS ord, p_partkey // {len(rules.RULES)} % 6 AS edge, r.* FROM part JOIN r ON i = p_partkey % {len(rules.RULES)}),
z AS (SELECT *, CASE edge WHEN 0 THEN greatest(a - 1, 0) WHEN 2 THEN b WHEN 3 THEN b + 1 ELSE greatest(a, 1) END AS size FROM e)
SELECT ord, 'length' AS kind, tag FROM z WHERE tag <> 'AN' AND (CASE WHEN tag IN ('FY', 'GY') THEN size NOT IN (2, 4) ELSE size NOT BETWEEN a AND b END) AND NOT (size = 0 AND most = 1 AND NOT need AND tag NOT IN ('FY', 'GY'))
UNION ALL SELECT ord, 'accession', tag FROM z WHERE tag = 'AN' AND size <> 7
UNION ALL SELECT ord, 'repeated', tag FROM z WHERE edge = 5 AND most = 1 UNION ALL SELECT ord, 'too_many', tag FROM z WHERE edge = 5 AND most BETWEEN 2 AND 9998"""
_SETS = f"{PART}, s AS (SELECT 1 AS set_id, ord FROM p WHERE sz = '7' UNION ALL SELECT 2, ord FROM p WHERE ty LIKE 'PROMO%' UNION ALL SELECT 3, ord FROM p WHERE sz IN ('7', '8'))"
_WORDS_IN_CHAT = "SELECT DISTINCT ord FROM c WHERE code IN ('/US', '/AS') AND term = '{}'"
_PAIRS = """WITH v AS (SELECT conv_id AS ord, upper(substr(role, 1, 2)) AS tag, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos FROM conversations),
a AS (SELECT ord, pos, max(CASE WHEN tag = 'US' THEN text END) AS "US", max(CASE WHEN tag = 'AS' THEN text END) AS "AS", max(CASE WHEN tag = 'SY' THEN text END) AS "SY" FROM v GROUP BY ord, pos)"""
_LINES = """WITH l AS (SELECT conv_id AS line_id, min(turn) + 1 AS first_line, max(turn) + 1 AS last_line FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, 'US' AS tag, turn FROM conversations WHERE role = 'user' AND turn = 0 UNION ALL SELECT conv_id, 'RO', turn FROM conversations),
j AS (SELECT conv_id AS line_id, tag, turn AS value_seq, turn + 1 AS line, turn * 82 AS offset, first_line, last_line, key, status, n_name AS gloss FROM x JOIN l ON l.line_id = conv_id, (VALUES ('k1', 'documented', 0), ('k2', 'chosen', 1)) e(key, status, nk) JOIN nation ON n_nationkey = nk WHERE key = 'k1' OR conv_id % 3 <> 0)"""
_RATES = "(VALUES ('purchase', 0.60::DECIMAL(10,2)), ('view', 0.05), ('signup', NULL)) r(format, rate)"

SQL = {
    "i1_phrase_keys": "SELECT p_partkey, upper(p_name) AS term FROM part",
    "i2_phrase_postings_docs": "SELECT DISTINCT 'LA' AS code, upper(lang) AS term, doc_id AS ord FROM documents UNION SELECT DISTINCT 'SO', upper(source), doc_id FROM documents",
    "i2_phrase_postings_orders": f"{ORDERS} SELECT * FROM ph",
    "i3_tokens": f"{DOC}, k AS (SELECT ord, count(*) AS n FROM d GROUP BY ord) SELECT doc_id, coalesce(n, 0)::INT AS n FROM documents LEFT JOIN k ON ord = doc_id",
    "i4_word_postings": f"{DOC} SELECT DISTINCT '/TX' AS code, term, ord FROM d",
    "i0_write_index": f"{DOC}, w AS (SELECT term, count(DISTINCT ord) AS n, count(*) AS o FROM d GROUP BY term) SELECT '/TX' AS code, count(*) AS terms, sum(n)::BIGINT AS postings, sum(o)::BIGINT AS occurrences FROM w",
    "a1_format": "SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN p_partkey % 29 = 0 THEN ['AN', 'TI', 'SN'] ELSE ['AN', 'TI'] END) AS tag FROM part) GROUP BY tag",
    "k4_sizes": f"{CHAT} SELECT DISTINCT code, CASE WHEN regexp_matches(term, '^[A-Z0-9]') THEN term[1] ELSE '_' END AS shard, true AS stored, true AS filled FROM c",
    "k5_shapes": """SELECT 'region' AS name, count(*) AS rows, '' AS faults FROM region UNION ALL SELECT 'nation', count(*), 'n_nationkey: int instead of bigint' FROM nation
UNION ALL SELECT 'supplier', count(*), 's_phone: None instead of string' FROM supplier UNION ALL SELECT 'customer', count(*), 'c_mktsegment: unexpected' FROM customer""",
    "a23_fetch": "SELECT lpad(p_partkey::VARCHAR, 7, '0') AS an, rtrim(repeat(p_name || ' ', CASE WHEN p_partkey % 19 = 0 THEN 12 ELSE 3 END)) AS raw FROM part WHERE p_partkey % 97 = 0 AND p_partkey % 194 <> 0",
    "a23_fetch_lines": "SELECT lpad(p_partkey::VARCHAR, 7, '0') AS an, '{\"orphans\":' || (p_partkey % 13 = 0)::INT || '}' AS json FROM part WHERE p_partkey % 11 = 0",
    "j10_card_lineage": """WITH p AS (SELECT p_partkey AS k, lpad(p_partkey::VARCHAR, 7, '0') AS an, p_name, (SELECT n_name FROM nation WHERE n_nationkey = 0) AS gloss FROM part)
SELECT an, 'TI' AS tag, rtrim(repeat(p_name || ' ', CASE WHEN k % 19 = 0 THEN 12 ELSE 3 END)) AS raw, gloss, true AS same FROM p UNION ALL SELECT an, 'IN', 'SMITH ' || k, gloss, true FROM p""",
    "i5_positions_docs": f"{DOC} SELECT term, count(*) AS n, sum(pos)::BIGINT AS places, sum(ord)::BIGINT AS ords FROM d GROUP BY term",
    "i5_positions_chat": f"{CHAT} SELECT code, term, ord, field_ord, pos FROM c",
    "i6_positions_subset": f"{CHAT} SELECT ord, field_ord, count(*) AS n FROM c WHERE code = '/US' GROUP BY ALL",
    "i7_merged_terms": f"{CHAT} SELECT term, count(DISTINCT ord) AS items FROM c GROUP BY term",
    "i8_occurrences": f"{CHAT} SELECT code, count(*) AS n FROM c GROUP BY code",
    "i9_mismatches": """WITH n AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'system') AS s, count(*) AS r FROM conversations GROUP BY 1)
SELECT 'talk' AS set_name, conv_id AS ord FROM n WHERE u <> a UNION ALL SELECT 'system', conv_id FROM n WHERE s <> r""",
    "i10_shards": f"{DOC}, w AS (SELECT DISTINCT term, ord FROM d) SELECT '/TX' AS code, CASE WHEN regexp_matches(term, '^[A-Z0-9]') THEN substr(term, 1, 1) ELSE '_' END AS shard, count(*) AS postings, count(DISTINCT term) AS terms FROM w GROUP BY ALL",
    "i11_alias": f"{PART} SELECT DISTINCT ord FROM w WHERE term LIKE 'S%'",
    "k1_index_files": f"{DOC}, w AS (SELECT DISTINCT term, ord FROM d) SELECT '/TX' AS code, CASE WHEN regexp_matches(term, '^[A-Z0-9]') THEN substr(term, 1, 1) ELSE '_' END AS shard, count(*) AS n FROM w GROUP BY ALL",
    "k2_term_files": f"{DOC} SELECT '/TX' AS code, term, count(DISTINCT ord) AS items FROM d GROUP BY term",
    "k4_report": f"{CHAT}, w AS (SELECT code, term, count(DISTINCT ord) AS n FROM c GROUP BY ALL) SELECT code, count(*) AS terms, sum(n)::BIGINT AS postings, (SELECT count(*) FROM c WHERE c.code = w.code) AS occurrences FROM w GROUP BY code",
    "k4_load": f"""{_BROKEN}, w AS (SELECT k, '/SF' AS code, unnest(CASE WHEN k % 3 = 0 THEN ['MAIN', 'CSRS'] ELSE ['MAIN'] END) AS term FROM p
 UNION ALL SELECT k, '/IN', unnest(['SMITH', k::VARCHAR]) FROM p UNION ALL SELECT k, '/IN', unnest(['JONES', i::VARCHAR]) FROM p, range(1, 9) r(i) WHERE i <= k % 9),
f AS (SELECT code AS name, unnest(['terms', 'postings', 'occurrences']) AS part, unnest([count(DISTINCT term), count(DISTINCT (k, term)), count(*)]) AS n FROM w GROUP BY code)
SELECT part, name, NULL AS an, n FROM f UNION ALL SELECT 'mismatch', 'subfiles', an, NULL FROM p WHERE (k % 3 = 0) <> (k % 2 = 1)
 UNION ALL SELECT 'orphan', NULL, an, 1 FROM p WHERE k % 13 = 0 UNION ALL SELECT 'bad_lines', NULL, NULL, sum(bad)::BIGINT FROM b""",
    "k6_manifest": "SELECT 'TY' AS code, count(DISTINCT upper(p_type)) AS terms, count(DISTINCT p_type) + 1 AS expected FROM part",
    "k7_drift": f"{DOC} SELECT DISTINCT '/TX' AS code, term FROM d WHERE term LIKE 'Q%'",
    "k8_readers": "WITH p AS (SELECT p_partkey AS k, lpad(p_partkey::VARCHAR, 7, '0') AS an, (p_partkey % 17 <> 0)::INT AS cy FROM part) SELECT an, 'CY' AS what, 5 AS field_seq, 0 AS value_seq, 'TOWN ' || (k % 10) AS first, 'VILLAGE ' || (k % 10) AS second FROM p WHERE k % 50 = 0 AND cy = 1 UNION ALL SELECT an, 'IN', 7 + cy, 0, 'SMITH ' || k, 'SMYTH ' || k FROM p WHERE k % 77 = 0",
    "k8_parity": "SELECT c_custkey, c_mktsegment, 'first' AS side FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 100 <> 0 UNION ALL SELECT c_custkey, lower(c_mktsegment), 'second' FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 100 <> 0",
    "k9_presence": f"{CHAT}, k AS (SELECT code FROM (VALUES ('/US'), ('/AS'), ('/SY'), ('/ZZ')) v(code) WHERE code NOT IN (SELECT code FROM c)) SELECT code, artifact FROM k, (VALUES ('terms'), ('postings'), ('places')) a(artifact)",
    "s1_phrase_and_word": f"{DOC} SELECT ord, row_number() OVER (ORDER BY ord) AS rank FROM (SELECT DISTINCT ord FROM d WHERE term = 'THIS') JOIN documents ON doc_id = ord WHERE upper(lang) = 'EN'",
    "s1_phrase": "SELECT doc_id AS ord FROM documents WHERE upper(source) = 'SRC3'",
    "s2_word_codes": f"{CHAT} {_WORDS_IN_CHAT.format('EN')}",
    "s3_prefix": f"{DOC} SELECT DISTINCT ord FROM d WHERE term LIKE 'TION%'",
    "s3_prefix_merged": f"{CHAT} SELECT DISTINCT ord FROM c WHERE term LIKE 'QU%'",
    "s4_phrase_prefix": f"{PART} SELECT ord FROM p WHERE ty LIKE 'PROMO%'",
    "s5_near_w": _next("ON", "IN", "b.pos - a.pos BETWEEN 1 AND 3"),
    "s5_next": _next("THAT", "IS", "b.pos = a.pos + 1"),
    "s6_near_n": _next("IN", "IT", "abs(b.pos - a.pos) BETWEEN 1 AND 2"),
    "s7_same_value": f"{CHAT} SELECT DISTINCT a.ord FROM c a JOIN c b USING (ord, code, field_ord) WHERE code IN ('/US', '/AS') AND a.term = 'DE' AND b.term = 'LA'",
    "s8_proximity_counts": f"""{DOC} SELECT 1 AS seq, 'TH?/TX' AS operand, count(DISTINCT ord) AS items FROM d WHERE term LIKE 'TH%' UNION ALL SELECT 2, 'IN/TX', count(DISTINCT ord) FROM d WHERE term = 'IN'
UNION ALL SELECT 3, 'TH?/TX(W2)IN/TX', count(DISTINCT a.ord) FROM d a JOIN d b USING (ord) WHERE a.term LIKE 'TH%' AND b.term = 'IN' AND b.pos - a.pos BETWEEN 1 AND 2""",
    "s9_set": "SELECT doc_id AS ord FROM documents WHERE upper(lang) = 'DE' AND upper(source) = 'SRC5'",
    "s10_rows": f"""{PART}, l AS (SELECT ty AS term FROM p GROUP BY ty), v AS (SELECT term, true AS there FROM l UNION ALL SELECT 'PROMO', false WHERE NOT EXISTS (SELECT 1 FROM l WHERE term = 'PROMO')),
n AS (SELECT row_number() OVER (ORDER BY term) - 1 AS i, term FROM v), s AS (SELECT greatest(0, least((SELECT count(*) FROM l WHERE term < 'PROMO') - 2, greatest(0, (SELECT count(*) FROM v) - 12))) AS a)
SELECT p.ord FROM p JOIN n ON n.term = p.ty, s WHERE i BETWEEN a + 2 AND a + 4""",
    "s11_first_field": "SELECT conv_id AS ord, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS first_user FROM conversations GROUP BY 1",
    "b1_and": f"{PART} SELECT ord FROM p WHERE br = 'BRAND#11' AND ord IN (SELECT ord FROM w WHERE term LIKE 'P%') UNION ALL SELECT ord FROM p WHERE sz = '7' AND ty LIKE 'STANDARD%'",
    "b2_or": f"{PART} SELECT ord FROM p WHERE sz IN ('1', '50')",
    "b3_not": f"{DOC} SELECT doc_id AS ord FROM documents WHERE upper(lang) = 'EN' AND doc_id NOT IN (SELECT ord FROM d WHERE term = 'THIS')",
    "b4_order": "SELECT doc_id AS ord, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE upper(lang) = 'FR'",
    "b5_operand_counts": f"{DOC} SELECT 1 AS seq, 'LA=EN' AS operand, count(*) AS items FROM documents WHERE upper(lang) = 'EN' UNION ALL SELECT 2, 'THAT', count(DISTINCT ord) FROM d WHERE term = 'THAT' UNION ALL SELECT 3, 'CION?', count(DISTINCT ord) FROM d WHERE term LIKE 'CION%'",
    "b6_steps": f"""{DOC}, e AS (SELECT doc_id AS ord FROM documents WHERE upper(lang) = 'EN'), t AS (SELECT DISTINCT ord FROM d WHERE term = 'THAT')
SELECT 1 AS step, count(*) AS items, sum(ord)::BIGINT AS ords FROM e UNION ALL SELECT 2, count(*), sum(ord)::BIGINT FROM t UNION ALL SELECT 3, count(*), sum(ord)::BIGINT FROM e JOIN t USING (ord)""",
    "b7_combine_and": f"{_SETS} SELECT ord FROM s GROUP BY ord HAVING count(*) = 3",
    "b7_combine_or": f"{_SETS} SELECT DISTINCT ord FROM s WHERE set_id < 3",
    "b7_combine_not": f"{_SETS} SELECT ord FROM s WHERE set_id = 2 AND ord NOT IN (SELECT ord FROM s WHERE set_id = 3)",
    "b8_combine_expression": f"{PART} SELECT ord FROM p WHERE ord IN (SELECT ord FROM w WHERE term LIKE 'S%') AND ty LIKE 'PROMO%' AND sz <> '7'",
    "b9_list_sets": f"{_SETS} SELECT set_id, count(*) AS items FROM s WHERE set_id BETWEEN 2 AND 3 GROUP BY set_id",
    "j3_decode": """WITH h AS (SELECT l_orderkey AS ord, l_returnflag AS code, arg_max(l_linestatus || l_linenumber, l_linenumber || l_linestatus) AS label FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS ord, k.code, label FROM orders CROSS JOIN (VALUES ('A'), ('N'), ('X')) k(code) LEFT JOIN h ON h.ord = o_orderkey AND h.code = k.code""",
    "j4_attestation": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'R10' ELSE (CASE WHEN c_custkey % 2 = 0 THEN 'R' ELSE '' END) || (c_custkey % 30 + 100) END AS value, ([88, 89, 94, 91])[c_custkey % 4 + 1]::INT AS year FROM customer),
k AS (SELECT *, TRY_CAST(right(value, 3) AS INT) - 100 AS n FROM c)
SELECT c_custkey, value, year, CASE WHEN year = 91 THEN 'no_warrant_set' WHEN value = 'R10' THEN 'not_applicable' WHEN n < CASE WHEN year = 94 THEN 10 ELSE 25 END THEN 'attested' ELSE 'not_attested' END AS state,
 CASE WHEN value <> 'R10' AND year IN (88, 89) THEN n_name WHEN value <> 'R10' AND year = 94 AND n < 10 THEN lower(n_name) END AS label FROM k LEFT JOIN nation ON n_nationkey = n""",
    "j6_zip_strict": f"{_PAIRS}, n AS (SELECT ord FROM v GROUP BY ord HAVING count(*) FILTER (tag = 'US') = count(*) FILTER (tag = 'AS')) SELECT ord, pos::INT AS pos, \"US\", \"AS\" FROM a JOIN n USING (ord) WHERE \"US\" IS NOT NULL",
    "j7_zip_surplus": f"{_PAIRS} SELECT *, \"US\" IS NOT NULL AND \"AS\" IS NOT NULL AND \"SY\" IS NOT NULL AS complete FROM a",
    "j8_zip_pair": f"{_PAIRS} SELECT ord, pos FROM a WHERE (\"US\" IS NULL) <> (\"AS\" IS NULL)",
    "j9_code_tags": "SELECT 'ST' AS code, 0::INT AS tag_seq, count(*) AS n FROM orders UNION ALL SELECT 'ST', 1, count(*) FROM lineitem UNION ALL SELECT 'PR', 0, count(*) FROM orders",
    "j10_lineage": f"{_LINES} SELECT * FROM j",
    "g1_term_list": f"{DOC} SELECT '/TX' AS code, term, count(DISTINCT ord) AS items FROM d GROUP BY term",
    "g2_values": "SELECT upper(source) AS term, count(*) AS items FROM documents WHERE upper(lang) = 'EN' GROUP BY 1",
    "g3_top": "SELECT row_number() OVER (ORDER BY count(*) DESC, upper(o_orderpriority))::INT AS rank, count(*) AS items, upper(o_orderpriority) AS term FROM orders WHERE o_orderstatus = 'O' GROUP BY 3 ORDER BY 1 LIMIT 8",
    "g5_first_key": "SELECT l_orderkey AS ord, min(upper(l_returnflag)) AS key FROM lineitem GROUP BY 1",
    "g10_percent_sums": """WITH s AS (SELECT l_orderkey AS ord, sum(CASE WHEN l_linenumber <> 7 THEN l_quantity::INT END) AS t, bool_or(l_linenumber = 7) AS odd FROM lineitem GROUP BY 1)
SELECT ord, CASE WHEN odd THEN 'percent_number' ELSE 'percent_sum' END AS kind, CASE WHEN odd THEN 'x' ELSE t::VARCHAR END AS message FROM s WHERE odd OR t <> 100""",
    "g11_costs": f"""WITH s AS (SELECT user_id AS session, ceil((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0)::BIGINT AS minutes, sum(coalesce(rate, 0)) AS shown FROM events LEFT JOIN {_RATES} ON format = event_type GROUP BY 1)
SELECT session, minutes, minutes * 0.25::DOUBLE AS connect_cost, shown::DOUBLE AS show_cost, (minutes * 0.25::DECIMAL(10,2) + shown)::DOUBLE AS total FROM s""",
    "g11_by_format": f"SELECT format, count(*) AS n, (count(*) * rate)::DOUBLE AS cost FROM events JOIN {_RATES} ON format = event_type WHERE rate IS NOT NULL GROUP BY format, rate",
    "g12_by_status": "SELECT (['chosen', 'inferred', 'documented'])[c_custkey % 3 + 1] AS status, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_name) AS place, c_name AS key FROM customer",
    "g13_weakest": f"{_LINES} SELECT DISTINCT line_id, CASE WHEN line_id % 3 = 0 THEN 'documented' ELSE 'chosen' END AS status FROM j",
    "g14_repeated_keys": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "g14_uncovered": "SELECT conv_id AS ord FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'system') = 0",
    "g14_repeated_postings": f"{PART} SELECT DISTINCT '/TI' AS code, term FROM w WHERE term LIKE 'A%'",
    "x1_browse": _window("TION"),
    "x1_browse_absent": _window("TIOZZZ"),
    "x1_browse_end": _window("ZZZZZZ"),
    "x2_browse_head": f"{DOC_TERMS} SELECT row_number() OVER (ORDER BY term)::INT AS ref, items, term, false AS starred FROM l ORDER BY term LIMIT 12",
    "x3_next_page": f"{DOC_TERMS} SELECT ((47 + row_number() OVER (ORDER BY term)) % 50 + 1)::INT AS ref, items, term, false AS starred FROM l WHERE term > 'TION' ORDER BY term LIMIT 12",
    "x4_previous_page": f"{DOC_TERMS}, n AS (SELECT row_number() OVER (ORDER BY term) - 1 AS i, * FROM l), s AS (SELECT greatest(0, count(*) - 24) AS a FROM l WHERE term <= 'TION') SELECT ((38 + i - a) % 50 + 1)::INT AS ref, items, term, false AS starred FROM n, s WHERE i BETWEEN a AND a + 11",
    "x5_wrapped": "SELECT o_orderkey, (44 + o_orderkey) % 50 + 1 AS ref FROM orders",
    "x6_sorted_set": f"""{ORDERS}, k AS (SELECT ord, coalesce((SELECT min(term) FROM ph p WHERE p.ord = s.ord AND code = 'OP' AND ord % 5 <> 0), '') AS a, coalesce((SELECT min(term) FROM ph p WHERE p.ord = s.ord AND code = 'RF'), '') AS b FROM ph s WHERE code = 'OS' AND term = 'O')
SELECT ord, row_number() OVER (ORDER BY a DESC, b, ord) AS rank FROM k""",
    "x8_slice": "SELECT * FROM (SELECT doc_id AS ord, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE upper(lang) = 'ES') WHERE rank = 1 OR rank BETWEEN 3 AND 5 OR rank >= 90",
    "x8_order_count": "SELECT least(count(*), 4) AS ordered FROM documents WHERE upper(lang) = 'ES'",
    "x9_collation": "SELECT 'LA' AS code, min(upper(lang)) AS low, max(upper(lang)) AS high FROM documents UNION ALL SELECT 'SO', min(upper(source)), max(upper(source)) FROM documents",
    "x10_kwic": f"WITH {_kwic('(SELECT doc_id AS ord, text AS raw FROM documents)', "k = 'THAT' OR k LIKE 'CIUD%'", 7)} SELECT ord, start, \"window\" FROM z",
    "x12_kwic_set": f"""{DOC}, s AS (SELECT DISTINCT ord FROM d JOIN documents ON doc_id = ord WHERE term = 'THAT' AND upper(lang) = 'EN'), r AS (SELECT ord, row_number() OVER (ORDER BY ord) AS rank FROM s),
{_kwic('(SELECT doc_id AS ord, text AS raw FROM documents JOIN s ON ord = doc_id)', "k = 'THAT'", 30)} SELECT rank, ord, start, "window" FROM z JOIN r USING (ord)""",
    "f18_stamp": "SELECT event_id, lower(strftime(ts, '%d%b%y')) || ' ' || strftime(ts, '%H:%M:%S') AS stamp FROM events",
    "f14_headings": "SELECT l_orderkey, string_agg(l_linenumber || ' ' || l_returnflag, '; ' ORDER BY l_linenumber::VARCHAR, l_returnflag) AS headings FROM lineitem GROUP BY 1",
    "f_text": r"""WITH c AS (SELECT *, (CASE WHEN c_custkey % 2 = 0 THEN 'R' ELSE '' END) || c_custkey % 1500 AS code, '9' || repeat('1', (c_custkey % 10)::INT) AS a FROM customer)
SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS alnum, ' ' || CASE WHEN len(a) >= 8 THEN a ELSE lpad(a, 8, '0') END AS shown, c_custkey % 3 <> 0 AS is_an, nullif(regexp_extract(code, '^R?([0-9]{3})$', 1), '') AS code,
 CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 9 <> 0 THEN c_custkey % 200 END::INT AS percent, true AS year, len(c_name) = 18 AS fits, (c_custkey % 70 > 60)::INT AS long_words, base64(encode(c_mktsegment)) AS b64, c_mktsegment AS trimmed, substr(c_name || c_mktsegment, 1, 24) AS excerpt FROM c""",
    "a21_offsets": "SELECT o_orderkey, (o_orderkey - 1) * 82 AS offset, o_orderkey AS line FROM orders",
    "a1_lines": f"{_BROKEN} SELECT sum(n)::BIGINT + 2 AS lines, sum(bad)::BIGINT AS bad_lines FROM b",
    "a2_alignment": "SELECT p_size, sum(len(p_name) + 1)::BIGINT AS length, sum(len(p_name) + 1) % 82 <> 0 AS misaligned FROM part GROUP BY 1",
    "a4_structure": f"{_CARD} SELECT '<< FIRST LINE' AS header, '>> ' || lpad(sum(n)::BIGINT::VARCHAR, 9, '0') || lpad(count(*)::VARCHAR, 9, '0') AS trailer FROM n",
    "a5_trailer": f"{_CARD} SELECT sum(n)::BIGINT AS declared_lines, sum(n)::BIGINT AS lines, count(*) AS declared_records, count(*) AS records FROM n",
    "a6_records": f"{_CARD} SELECT ord, an, n::BIGINT AS n_lines, 82 * n::BIGINT AS length FROM n",
    "a9_kinds": f"{_CARD}, k AS (SELECT *, (k % 13 = 0)::INT + ceil(len(t) / 69.0)::INT - 1 + (k % 3 = 0)::INT + k % 9 + 5 * (k % 2) AS c FROM n) SELECT 'separator' AS kind, count(*) AS n FROM k UNION ALL SELECT 'continuation', sum(c)::BIGINT FROM k UNION ALL SELECT 'tag', sum(n - c - 1)::BIGINT FROM k",
    "a13_fields": f"""{_CARD}, k AS (SELECT unnest(['AN', 'PN', 'TI', 'PI', 'ST', 'SF', 'IN', 'RP', 'AC', 'CM', 'FS', 'CT', 'PH']) AS tag, unnest([1, 1, ceil(len(t) / 69.0), 1, 1, 1 + (k % 3 = 0)::INT, 1 + k % 9, 1 + k % 2, 1 + k % 2, 1 + k % 2, 1 + k % 2, 1 + k % 2, 1]) AS c FROM n
 UNION ALL SELECT 'CY', 1 FROM n WHERE k % 17 <> 0 UNION ALL SELECT 'ZZ', 1 FROM n WHERE k % 23 = 0 UNION ALL SELECT unnest(['SN', 'SC']), 1 FROM n WHERE k % 29 = 0) SELECT tag, count(*) AS n, sum(c)::BIGINT AS lines FROM k GROUP BY tag""",
    "a14_orphans": f"{_CARD} SELECT an FROM p WHERE k % 13 = 0",
    "a15_values": f"""{_CARD} SELECT an, 'IN' AS tag, i AS value_seq, CASE WHEN i = 0 THEN 'SMITH ' || k ELSE 'JONES ' || i END AS raw, i > 0 AS continuation FROM p, range(0, 9) r(i) WHERE i <= k % 9
 UNION ALL SELECT an, 'SF', i, CASE WHEN i = 0 THEN 'MAIN' ELSE 'CSRS' END, i > 0 FROM p, range(0, 2) r(i) WHERE i = 0 OR k % 3 = 0
 UNION ALL SELECT an, 'CT', i, CASE WHEN k % 2 = 0 THEN '100%' WHEN i = 1 AND k % 11 = 0 THEN '040%' ELSE '050%' END, i > 0 FROM p, range(0, 2) r(i) WHERE i <= k % 2""",
    "a16_titles": f"{_CARD} SELECT an, t AS raw FROM p",
    "a18_headings": f"{_CARD} SELECT an, 'R101' AS code, 'SOILS ' || k % 5 AS label, 2 AS parts FROM p",
    "a20_geometry": f"{_CARD} SELECT an, 1 + k % 9 AS lines, 0::BIGINT AS drift FROM p",
    "a23_json": "SELECT p_partkey AS ord, '{\"ord\":' || p_partkey || ',\"fields\":[{\"tag\":\"BR\",\"values\":[\"' || p_brand || '\"]},{\"tag\":\"SZ\",\"values\":[\"' || p_size || '\"]}]}' AS json FROM part",
    "a24_range_faults": """WITH o AS (SELECT l_orderkey AS ord, max(l_linenumber)::BIGINT AS b FROM lineitem GROUP BY 1),
s AS (SELECT ord, ord // 1000 AS file, ord * 7 + CASE WHEN ord % 40 = 0 THEN 9 ELSE 0 END AS a, ord * 7 + b - 1 AS z FROM o), n AS (SELECT *, lead(a) OVER (PARTITION BY file ORDER BY a, ord) AS later FROM s),
f AS (SELECT ord, CASE WHEN z < a THEN 'inverted' WHEN ord % 64 = 3 THEN 'short' WHEN later <= z THEN 'overlap' END AS fault FROM n) SELECT * FROM f WHERE fault IS NOT NULL""",
    "a24_unknown": "SELECT DISTINCT l_orderkey AS ord FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)",
    "a25_fixity": "SELECT DISTINCT p_size, p_size % 7 <> 0 AND p_size % 5 <> 0 AS ok FROM part UNION ALL SELECT NULL, false",
    "a26_provenance": "SELECT c_custkey, 'RG' || lpad((c_custkey % 200)::VARCHAR, 3, '0') AS record_group, CASE WHEN c_custkey % 300 + 10 < 100 THEN (c_custkey % 300 + 10)::INT END AS fiscal_year FROM customer",
    "a27_prefix": f"{_CARD} SELECT * FROM (SELECT 1 AS line_no, '<< FIRST LINE' AS line UNION ALL SELECT 2, '$$' UNION ALL SELECT 3, CASE WHEN k % 13 = 0 THEN '   LOST' ELSE 'AN ' || an END FROM p WHERE ord = 0)",
    "v_problems": f"{_PROBLEMS} SELECT * FROM q",
    "v_fault_kinds": """SELECT p_partkey AS ord, (['repeated', 'accession', 'not_utf8', 'heading_parts', 'long_keyword', 'tag_not_ascii', 'column_counts', 'pair_counts', 'percent_number', 'length', 'not_modeled'])[p_partkey % 12] AS kind,
 (['PN', 'AN', 'TI', 'PH', 'DE', 'É1', 'RP', 'SN', 'CT', 'FY', 'HP'])[p_partkey % 12] AS tag FROM part WHERE p_partkey % 12 <> 0""",
    "v_bounds": _EDGES,
    "v_gates": """SELECT p_partkey AS ord, unnest(CASE p_partkey % 6
 WHEN 0 THEN [{'kind': 'length', 'tag': 'AC', 'message': 'bytes: 1, allowed 5-89'}, {'kind': 'length', 'tag': 'CT', 'message': 'bytes: 2, allowed 4-74'}]
 WHEN 1 THEN [{'kind': 'column_counts', 'tag': 'RP', 'message': '1,0,0,0,1'}, {'kind': 'percent_sum', 'tag': 'CT', 'message': '50'}]
 WHEN 2 THEN [{'kind': 'heading_parts', 'tag': 'SC', 'message': 'parts: 1'}]
 WHEN 3 THEN [{'kind': 'column_counts', 'tag': 'RP', 'message': '0,0,0,0,3'}, {'kind': 'percent_number', 'tag': 'CT', 'message': ' 50%'}]
 WHEN 4 THEN [{'kind': 'length', 'tag': 'RP', 'message': 'bytes: 2, allowed 4-74'}] END, recursive := true) FROM part WHERE p_partkey % 6 < 5""",
    "v25_unreadable": f"{_TIERS}, u AS (SELECT CASE WHEN k % 31 = 0 THEN 'unreadable' ELSE tier END AS tier FROM tier) SELECT count(*) AS total, count(*) FILTER (tier LIKE 'certified%') AS certified, count(*) FILTER (tier = 'certified_undocumented') AS certified_undocumented, count(*) FILTER (tier = 'certified_rpa_absence') AS certified_rpa_absence, count(*) FILTER (tier = 'failed') AS failed, count(*) FILTER (tier = 'unreadable') AS unreadable, count(*) FILTER (tier = 'unmodeled_only') AS unmodeled_only FROM u",
    "g9_summary": "SELECT count(*) AS records, count(*) FILTER (p_partkey % 12 NOT IN (1, 2)) AS identified, count(*) FILTER (p_partkey % 12 IN (1, 2)) AS with_problems FROM part",
    "g9_overview": """WITH p AS (SELECT p_partkey AS ord, p_partkey % 12 AS f, p_partkey % 12 NOT IN (4, 7, 8, 9) AS ok FROM part)
SELECT ord, CASE WHEN ok THEN CASE WHEN f = 0 THEN 12 ELSE 0 END END::BIGINT AS column_codes, CASE WHEN ok THEN CASE WHEN f = 0 THEN 1 ELSE 0 END END::BIGINT AS subcommodities, CASE WHEN ok THEN 1 END::BIGINT AS headings,
 CASE WHEN f <> 5 THEN ord % 5 = 0 END AS objectives, CASE WHEN f <> 5 THEN false END AS descriptors FROM p""",
    "f17_excerpts": """WITH h AS (SELECT doc_id, text, hex(encode(text)) AS x FROM documents)
SELECT doc_id, CASE WHEN substr(x, 49, 1) IN ('8', '9', 'A', 'B') THEN substr(x, 1, 48) ELSE decode(unhex(substr(x, 1, 48))) END AS excerpt FROM h""",
    "g6_tiers": f"{_TIERS} SELECT an, tier FROM tier",
    "g7_tally": f"{_TIERS} SELECT count(*) AS total, count(*) FILTER (tier LIKE 'certified%') AS certified, count(*) FILTER (tier = 'certified_undocumented') AS certified_undocumented, count(*) FILTER (tier = 'certified_rpa_absence') AS certified_rpa_absence, count(*) FILTER (tier = 'failed') AS failed, 0::BIGINT AS unreadable, count(*) FILTER (tier = 'unmodeled_only') AS unmodeled_only FROM tier",
    "g8_histogram": f"{_PROBLEMS} SELECT tag || ' ' || kind AS bucket, count(*) AS n FROM q GROUP BY 1",
    "k3_wide_rows": f"""{_TIERS}, c AS (SELECT an, count(*) AS problems FROM q GROUP BY an)
SELECT an, an AS accession, CASE WHEN len(t) <= 100 THEN t END AS title, CASE WHEN k % 17 <> 0 THEN 'TOWN ' || k % 10 END AS city, CASE WHEN k % 9 <= 5 THEN 1 + k % 9 END::INT AS investigators,
 CASE WHEN k % 2 = 0 THEN 1 END::INT AS rp_codes, tier LIKE 'certified%' AS certified, coalesce(problems, 0) AS problems FROM tier LEFT JOIN c USING (an)""",
    "k3_row_files": f"""{_TIERS}, c AS (SELECT an, count(*) AS problems FROM q GROUP BY an), u AS (SELECT tier.*, n.n, k % 31 = 0 AS lost FROM tier JOIN (SELECT k, n FROM n) n USING (k))
SELECT ord, CASE WHEN NOT lost THEN an END AS an, CASE WHEN len(t) <= 100 AND NOT lost THEN t END AS title, 82 * n::BIGINT - lost::INT AS length, CASE WHEN k % 9 <= 5 AND NOT lost THEN 1 + k % 9 END::INT AS investigators,
 tier LIKE 'certified%' AND NOT lost AS certified, CASE WHEN lost THEN 'unreadable' ELSE tier END AS tier, CASE WHEN lost THEN 0 ELSE coalesce(problems, 0) END::INT AS problems FROM u LEFT JOIN c USING (an)""",
    "g15_census": f"""{_CARD}, v(tag, an, n, odd) AS (SELECT 'AN', an, 7, 0 FROM p UNION ALL SELECT 'PN', an, len('P-' || k), 0 FROM p UNION ALL SELECT 'TI', an, len(t), 0 FROM p UNION ALL SELECT 'PI', an, len(rtrim(p_brand)), 0 FROM p
 UNION ALL SELECT 'CY', an, 6, 0 FROM p WHERE k % 17 <> 0 UNION ALL SELECT 'ST', an, len(rtrim(substr(p_type, 1, 20))), 0 FROM p UNION ALL SELECT 'SF', an, 4, 0 FROM p UNION ALL SELECT 'SF', an, 4, 0 FROM p WHERE k % 3 = 0
 UNION ALL SELECT 'IN', an, CASE WHEN i = 0 THEN len('SMITH ' || k) ELSE 7 END, 0 FROM p, range(0, 9) r(i) WHERE i <= k % 9
 UNION ALL SELECT tag, an, size, 0 FROM p, (VALUES ('RP', 4), ('AC', 5), ('CM', 5), ('FS', 5), ('CT', 4)) x(tag, size), range(0, 2) r(i) WHERE i <= k % 2
 UNION ALL SELECT 'PH', an, 13, 1 FROM p UNION ALL SELECT 'ZZ', an, 3, 0 FROM p WHERE k % 23 = 0 UNION ALL SELECT 'SN', an, 1, 0 FROM p WHERE k % 29 = 0 UNION ALL SELECT 'SC', an, 9, 1 FROM p WHERE k % 29 = 0)
SELECT tag, count(DISTINCT an) AS records, count(*) AS n, min(n)::INT AS least, max(n)::INT AS most, sum(odd)::BIGINT AS not_utf8 FROM v GROUP BY tag""",
    "d1_accession_lines": f"{_CARD} SELECT an, ' 0' || an AS line FROM p",
    "d2_brief": f"{_CARD} SELECT ' 0' || an AS accession, '' AS agency, 'P-' || k AS project, ' TO ' AS period, 'SMITH ' || k AS investigator, '' AS organization, p_brand AS location, t AS title FROM p",
    "d3_chosen_fields": f"{_CARD} SELECT an, 'MAIN|' || CASE WHEN k % 3 = 0 THEN 'CSRS|' ELSE '' END || CASE WHEN k % 2 = 0 THEN 'R101|A0100|C0100|F0100|100%' ELSE 'R101|R999|A0100|A0200|C0100|C0200|F0100|F0200|050%|' || CASE WHEN k % 11 = 0 THEN '040%' ELSE '050%' END END AS values FROM p",
    "d4_full_record": rf"""{_PAIRS}, f AS (SELECT ord, coalesce(arg_min(text, pos) FILTER (tag = 'US'), '') AS first_user, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (tag = 'AS'), '') AS answers FROM v GROUP BY 1),
g AS (SELECT ord, string_agg(pos || '|' || coalesce("US", '-') || '|' || coalesce("AS", '-') || '|' || ("US" IS NOT NULL AND "AS" IS NOT NULL), chr(10) ORDER BY pos) AS rows FROM a WHERE coalesce("US", "AS") IS NOT NULL GROUP BY 1),
q AS (SELECT ord, string_agg(pos || '|' || coalesce("US", '-') || '|' || coalesce("SY", '-') || '|' || ("US" IS NOT NULL AND "SY" IS NOT NULL), chr(10) ORDER BY pos) AS pairs FROM a WHERE coalesce("US", "SY") IS NOT NULL GROUP BY 1)
SELECT ord, first_user, answers, rows, pairs FROM f LEFT JOIN g USING (ord) LEFT JOIN q USING (ord)""",
    "d4_full_card": f"""{_CARD} SELECT an, 'P-' || k AS "PN", t AS "TI", (1 + k % 9)::INT AS investigators,
 CASE WHEN k % 2 = 0 THEN '0|R101|A0100|C0100|F0100|100%' ELSE '0|R101|A0100|C0100|F0100|050%;1|R999|A0200|C0200|F0200|' || CASE WHEN k % 11 = 0 THEN '040%' ELSE '050%' END END AS grid,
 CASE WHEN k % 29 = 0 THEN '0|C1' || chr(160) || chr(2) || 'WHEAT|1' END AS pairs, 'R101 SOILS ' || k % 5 AS ph_headings, NULL::VARCHAR AS gh_headings, NULL::INT AS narratives,
 CASE WHEN k % 17 <> 0 THEN 'CY=TOWN ' || k % 10 || ';' ELSE '' END || 'PI=' || p_brand || ';SF=MAIN;ST=' || rtrim(p_type[:20]) AS supplement FROM p""",
}
