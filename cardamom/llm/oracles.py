"""DuckDB SQL for the rows of those numbered queries that SQL can express."""

from __future__ import annotations

import re

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
c AS (SELECT x, count(*) AS n FROM link GROUP BY x), g AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, g.m AS component_id, e.vec_id = g.m AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN g ON g.x = e.vec_id
"""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s, min(page_id) OVER (PARTITION BY sha256(b)) AS f FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', s[i])]), '') AS b FROM h)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * b[5*i+1]::INT + 8 * b[5*i+2]::INT + 4 * b[5*i+3]::INT + 2 * b[5*i+4]::INT + b[5*i+5]::INT, 1)), '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
FROM bits
"""

OP6 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, unnest(range(1, len(h) // 2 - 198)) AS i FROM d WHERE len(h) >= 400),
g AS (SELECT r, i, md5_number(substr(h, 2 * i - 1, 400)) AS k FROM p JOIN d USING (r)),
m AS (SELECT r, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
e AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM m),
z AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS island FROM e),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM z GROUP BY r, island),
t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS after FROM s),
k AS (SELECT r, sum(b - a) AS gone, count(*) AS n, max(b) AS tail, string_agg(substr(h, 2 * after - 1, 2 * (a - after)), '' ORDER BY a) AS head FROM t JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE head || substr(h, 2 * tail - 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, md5(array_to_string(w[i:i + 4], chr(1)))) AS n FROM win JOIN w USING (r)),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
  + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (n_words >= 10 AND word_chars < 2 * n_words)::INT + 32 * (word_chars > 40 * n_words)::INT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits FROM f
"""

_RULES = "VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32)"
ABLATION = f"SELECT r.rule, count(*) FILTER (l.fail_bits & r.bit <> 0) AS failed, count(*) FILTER (l.fail_bits = r.bit) AS failed_alone FROM ({OP7}) l, ({_RULES}) r(rule, bit) GROUP BY r.rule"

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * z / w AS t FROM s),
q AS (SELECT t, 1.5 * (SELECT sum(z) FROM s) AS total, coalesce(sum(2.0 * z) OVER (ORDER BY t, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(w) OVER (ORDER BY t, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
level AS (SELECT arg_min((total - held) / free, t) AS x FROM q WHERE (total - held) / free <= t),
g AS (SELECT source, z, CASE WHEN z = 0 THEN 0.0 ELSE least(2.0 * z, w * x) END AS target FROM s, level),
c AS (SELECT d.doc_id, d.size, g.z, g.target, CASE WHEN g.z > 0 THEN g.target / g.z ELSE 0 END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null:' || d.h)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, z AS source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM c
"""

OP10 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, len(l) AS n, l, md5(l::VARCHAR) AS h FROM c),
p AS (SELECT DISTINCT k, md5(l[1:k]::VARCHAR) AS h FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
f AS (SELECT n, h, min(conv_id) AS first FROM h GROUP BY n, h)
SELECT conv_id, n AS n_turns, coalesce(f.first = conv_id AND p.k IS NULL, false) AS kept,
  CASE WHEN f.first = conv_id AND p.k IS NULL THEN array_to_string(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.x, '') || '<|im_end|>' || chr(10)), '') END AS chat
FROM h JOIN f USING (n, h) LEFT JOIN p ON p.k = h.n AND p.h = h.h
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(list_transform(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w FROM d),
g AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
f1 AS (SELECT lang, a, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING f >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
c2 AS (SELECT p.lang, p.a || ' ' || p.b AS phrase, p.f AS a, x.f AS l, y.f AS r, 1000000::HUGEINT * p.f * p.f // (x.f::HUGEINT * y.f) AS score
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.a = p.a JOIN f1 y ON y.lang = p.lang AND y.a = p.b WHERE p.f >= 10
  AND NOT EXISTS (FROM f3 q WHERE q.lang = p.lang AND 100 * q.f >= 50 * p.f AND ((q.a = p.a AND q.b = p.b) OR (q.b = p.a AND q.c = p.b)))),
c3 AS (SELECT q.lang, q.a || ' ' || q.b || ' ' || q.c AS phrase, q.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
  1000000::HUGEINT * q.f * q.f // (x.f::HUGEINT * yz.f) AS s1, 1000000::HUGEINT * q.f * q.f // (xy.f::HUGEINT * z.f) AS s2
  FROM f3 q JOIN f1 x ON x.lang = q.lang AND x.a = q.a JOIN f1 z ON z.lang = q.lang AND z.a = q.c
  JOIN f2 xy ON xy.lang = q.lang AND xy.a = q.a AND xy.b = q.b JOIN f2 yz ON yz.lang = q.lang AND yz.a = q.b AND yz.b = q.c),
every AS (SELECT lang, phrase, a, l, r, score FROM c2 UNION ALL SELECT lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""

#: For pages whose article is an element of that name, as in the supplied table: what the trained field has to find there.
OP13 = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS b FROM pages),
d AS (SELECT page_id, url, list_transform(b, lambda x: replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>')) AS b FROM a),
w AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM w
"""



def _over(sql: str, table: str, rows: str) -> str:
    """sql over ``rows`` in place of a table; rows name the table itself as main.table."""
    head = "WITH RECURSIVE " if sql.lstrip().startswith("WITH RECURSIVE") else "WITH "
    body = re.sub(rf"(?<![.\w]){table}(?!\w)", f"more_{table}", sql.lstrip().removeprefix(head))
    return f"{head}more_{table} AS ({rows}), {body}"


OP2_COPIES = _over(
    OP2,
    "embeddings",
    """SELECT vec_id, embedding, label FROM main.embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x: x * 2), label FROM main.embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id + 2000000000, list_transform(embedding, lambda x, i: (CASE WHEN (i - 1) % 8 = 0 THEN x::DOUBLE * (1 + 0.25 * (vec_id % 8)) ELSE x END)::FLOAT), label FROM main.embeddings WHERE vec_id % 3 = 0""",
)
OP4_COPIES = _over(OP4, "pages", "SELECT page_id, url, html FROM main.pages UNION ALL SELECT page_id + 1000000000, url || '&again', CASE WHEN page_id % 2 = 0 THEN html ELSE html || chr(10) END FROM main.pages WHERE page_id % 3 = 0")
OP10_SNAPSHOTS = _over(
    OP10,
    "conversations",
    """SELECT conv_id, turn, role, text FROM main.conversations UNION ALL SELECT conv_id + 1000000000, turn, role, text FROM main.conversations WHERE conv_id % 3 = 0 AND turn <= conv_id % 4
UNION ALL SELECT conv_id + 2000000000, turn, role, text FROM main.conversations WHERE conv_id % 5 = 0""",
)

SQL = {"op2_vectors": OP2, "op2_copies": OP2_COPIES, "op4_copies": OP4_COPIES, "op10_snapshots": OP10_SNAPSHOTS, "op4_warc": OP4, "op6_suffix": OP6, "op7_quality": OP7, "quality_ablation": ABLATION, "op9_mixing": OP9, "op10_chat": OP10, "op12_phrases": OP12, "op13_html": OP13}
