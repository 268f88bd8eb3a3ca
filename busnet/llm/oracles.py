"""DuckDB statements that give the rows of the registered queries where SQL can."""

from __future__ import annotations

# Words are runs of anything but 0x20 and 0x09 to 0x0D; A-Z alone is lower-cased.
_WORDS = r"""
    regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+')"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id,
        unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""



OP1 = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
s AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
    FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# kind, pattern, group of the value, its least length
_KINDS = [
    ("assign", f"({_either_case('password|passwd|secret|token|api_?key')})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("owned", "[A-Za-z0-9+/_=-]+", 0, 20),
]


def _kind_rows(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT row, owner, repo, {no} AS no, '{kind}' AS kind, stop - len AS start, stop, value FROM (
        SELECT row, owner, repo, length(m) AS len, value, sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY i) AS stop
        FROM (
            SELECT row, owner, repo, unnest(range(len(ms))) AS i, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m, unnest(vs) AS value
            FROM (SELECT row, owner, repo, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs,
                         regexp_split_to_array(t, '{pattern}') AS gaps FROM d)))
    WHERE length(value) >= {least}
      AND (no < 3 OR regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]'))"""


OP3 = f"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t
    FROM documents),
s AS ({" UNION ALL ".join(_kind_rows(i, *k) for i, k in enumerate(_KINDS))}),
f AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repositories FROM s GROUP BY value),
r AS (
    SELECT s.*, f.owners, f.repositories, f.owners = 1 AND f.repositories <= 2 AS live FROM s JOIN f USING (value)
    WHERE no < 3 OR f.owners = 1 AND f.repositories <= 2 AND NOT EXISTS (
        SELECT 1 FROM s b WHERE b.row = s.row AND b.no < 3 AND b.start < s.stop AND b.stop > s.start)),
e AS (
    SELECT row, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
        count(*) FILTER (no = 3) AS n_owned, count(*) FILTER (no < 3 AND live) AS n_live, count(*) FILTER (no < 3 AND NOT live) AS n_copied,
        max(owners) AS owners, max(repositories) AS repositories,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, no) FILTER (no < 3) AS base,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, no) AS spans
    FROM r GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_owned", "n_live", "n_copied", "owners", "repositories"))},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN e USING (row)
"""

OP4 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
g AS (
    SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true)::INT AS fresh
    FROM w JOIN f USING (k) WHERE m < doc_id),
h AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 49 AS z FROM h GROUP BY doc_id, span),
p AS (
    SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS x, a - 1 AS y FROM s
    UNION ALL SELECT d.doc_id, coalesce(max(z), 0) + 1, any_value(octet_length(b)) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT doc_id, string_agg(hex(b[x:y]), '' ORDER BY x) FILTER (x <= y) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP7 = r"""
WITH l AS (
    SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
c AS (
    SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
    FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, n, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM c),
f AS (SELECT *, first_value(struct_pack(doc_id := doc_id, n := n)) OVER (PARTITION BY a, b ORDER BY doc_id, n) AS place FROM w WHERE b IS NOT NULL),
o AS (
    SELECT doc_id, n, first_value(struct_pack(doc_id := doc_id, n := n)) OVER (PARTITION BY line ORDER BY doc_id, n) AS place
    FROM c WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 13),
r AS (
    SELECT doc_id, unnest([n, n + 1]) AS n FROM f WHERE place <> struct_pack(doc_id := doc_id, n := n)
    UNION SELECT doc_id, n FROM o WHERE place <> struct_pack(doc_id := doc_id, n := n)),
g AS (SELECT doc_id, n, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM r),
t AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR n - before > 1) AS n_runs FROM g GROUP BY doc_id),
k AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept
    FROM l LEFT JOIN c USING (doc_id, pos) LEFT JOIN r ON r.doc_id = c.doc_id AND r.n = c.n WHERE r.n IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
    coalesce(t.n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM c GROUP BY doc_id) m USING (doc_id)
LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


# CRC-32 of a text of ASCII characters: the table of 256 entries is made from its polynomial
_CRC_TABLE = """
    list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"""


def _crc32(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)))"""


# One row per turn read and state of the role grammar: the cheapest edits so far, with their least letters.
OP11 = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS entries),
o AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot
    FROM conversations, crc),
d AS (
    SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role,
        CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE lot WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM o),
n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d)),
t AS (
    SELECT *, left(role, 1) AS initial, CASE WHEN shown = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM n),
fill(s, z) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
keep(s, initial, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
pre AS (SELECT s, s AS m, '' AS letters, 0 AS cost, []::VARCHAR[] AS made FROM fill UNION ALL
    SELECT s, z, 'I', 3, [CASE z WHEN 2 THEN 'user:' ELSE 'assistant:' END] FROM fill),
moves AS (
    SELECT p.s, k.z, letters || 'K' AS letters, cost, made, k.initial, 'K' AS edit FROM pre p JOIN keep k ON k.s = p.m UNION ALL
    SELECT p.s, f.z, letters || 'R', cost + 3, made, NULL, 'R' FROM pre p JOIN fill f ON f.s = p.m UNION ALL
    SELECT p.s, p.m, letters || 'D', cost + 4, made, NULL, 'D' FROM pre p),
p AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS made FROM conversations
    UNION ALL
    SELECT conv_id, i, s, cost, audit, made FROM (
        SELECT p.conv_id, t.i, m.z AS s, p.cost + m.cost + CASE WHEN m.edit <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
            p.audit || m.letters AS audit,
            p.made || m.made || CASE m.edit WHEN 'K' THEN [t.role || ':' || t.text]
                WHEN 'R' THEN [CASE m.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || t.text] ELSE [] END AS made
        FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1
        JOIN moves m ON m.s = p.s AND (m.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.initial = t.initial)))
    QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1),
z AS (
    SELECT conv_id, i, cost + CASE s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost, audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
        made || CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS made
    FROM p),
best AS (
    SELECT z.* FROM z JOIN (SELECT conv_id, max(i) AS i FROM p GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM z.conv_id AND l.i = z.i
    QUALIFY row_number() OVER (PARTITION BY z.conv_id ORDER BY cost, audit) = 1),
c AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (step IS NOT NULL AND step NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS step FROM t) GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit,
    sha256(array_to_string(made, chr(10))) AS repaired_sha256
FROM best LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM best.conv_id
"""


def _op12(rounds: int = 10) -> str:
    """Each round measures every vector against every centroid."""
    parts = ["""
    v AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v, row_number() OVER () AS row
        FROM embeddings
        WHERE len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
    c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS m
        FROM v QUALIFY c < 8)"""]
    for i in range(rounds + 1):
        parts.append(f"""
    a{i} AS MATERIALIZED (
        SELECT row, vec_id, v, c, m, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
        FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c) = 1)""")
        if i < rounds:
            parts.append(f"""
    s{i} AS (
        SELECT c, j, sum(x::BIGINT)::HUGEINT AS s, count(*)::HUGEINT AS n
        FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY c, j),
    c{i + 1} AS MATERIALIZED (
        SELECT c, list((CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END)::DOUBLE ORDER BY j) AS m FROM s{i} GROUP BY c
        UNION ALL SELECT c, m FROM c{i} WHERE c NOT IN (SELECT c FROM s{i}))""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds}
"""


OP12 = _op12()


# measure, its cutoffs from lenient to strict
_RULES = [
    ("symbols", [300, 200, 150, 100, 70, 50, 30, 20, 10, 5]),
    ("repeated_lines", [800, 600, 500, 400, 300, 200, 150, 100, 50]),
    ("repeated_words", [250, 200, 150, 100, 70, 50, 30]),
    ("breadth", [200, 150, 120, 110, 100, 95, 90, 85, 80, 75, 70]),
    ("shouting", [900, 700, 500, 400, 300, 200, 150, 100]),
]
_GRID = ", ".join(f"('{name}', {i}, {c})" for name, cutoffs in _RULES for i, c in enumerate(cutoffs))

OP13 = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS entries),
t AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS l FROM t),
g AS (SELECT row, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
c AS (SELECT row, sum(least(8, i - before))::BIGINT AS n FROM (SELECT row, i, lag(i, 1, -8) OVER (PARTITION BY row ORDER BY i) AS before FROM r) GROUP BY row),
m AS (
    SELECT row, doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper
    FROM w LEFT JOIN c USING (row)),
s AS (
    SELECT *, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbols, coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS repeated_lines,
        coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeated_words, coalesce(word_chars * 10 // nullif(n_words, 0), 0) AS breadth,
        coalesce(upper * 1000 // nullif(word_chars, 0), 0) AS shouting
    FROM m),
u AS (UNPIVOT (SELECT row, doc_id, stratum, symbols::BIGINT AS symbols, repeated_lines::BIGINT AS repeated_lines, repeated_words::BIGINT AS repeated_words,
        breadth::BIGINT AS breadth, shouting::BIGINT AS shouting FROM s) ON symbols, repeated_lines, repeated_words, breadth, shouting INTO NAME rule VALUE x),
grid(rule, place, cutoff) AS (VALUES {_GRID}),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (
    SELECT stratum, rule, place, cutoff,
        count(*) FILTER (half = 0 AND quality = 0 AND x > cutoff) - 5 * count(*) FILTER (half = 0 AND quality > 0 AND x > cutoff) AS gain,
        count(*) FILTER (half = 1 AND quality > 0) AS n, count(*) FILTER (half = 1 AND quality > 0 AND x > cutoff) AS k
    FROM (SELECT u.*, q.quality, {_crc32("u.doc_id::VARCHAR")} % 2 AS half FROM crc, u JOIN q USING (doc_id)) JOIN grid USING (rule)
    GROUP BY stratum, rule, place, cutoff),
f AS (SELECT *, max(gain) OVER (PARTITION BY stratum, rule) AS most FROM h),
a AS (SELECT * FROM f WHERE most > 0 QUALIFY place <= min(place) FILTER (gain = most) OVER (PARTITION BY stratum, rule)),
b AS (
    SELECT stratum, rule, place, cutoff, CASE WHEN k >= n * 0.01 THEN 1 ELSE (
            SELECT sum(exp(lgamma(n + 1) - (CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99)))
            FROM (SELECT unnest(range(k + 1)) AS j)) END AS p
    FROM a),
d AS (
    SELECT stratum, rule, cutoff, max(p) OVER (PARTITION BY stratum, rule ORDER BY place) AS worst FROM b
    QUALIFY worst <= 0.05 / (SELECT greatest(count(*), 1) FROM (SELECT DISTINCT stratum, rule FROM a))),
e AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM d GROUP BY stratum, rule),
o(rule, no) AS (VALUES ('symbols', 0), ('repeated_lines', 1), ('repeated_words', 2), ('breadth', 3), ('shouting', 4)),
z AS (SELECT row, string_agg(rule, ',' ORDER BY no) AS rejected_by FROM u JOIN e USING (stratum, rule) JOIN o USING (rule) WHERE x > cutoff GROUP BY row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM s LEFT JOIN z USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": OP1, "op3_secrets": OP3, "op4_suffix": OP4, "op5_minhash": OP5, "op7_lines": OP7, "op11_conversations": OP11,
        "op12_centroids": OP12, "op13_quality": OP13,
    }
