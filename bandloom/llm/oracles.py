"""SQL (DuckDB) for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import chat, pii, secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORD = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM benchmark),
win AS (SELECT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
    FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(k) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, {ALNUM}) AS w FROM documents),
g AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) AS u(k)),
m AS (SELECT DISTINCT r, k, g.n, item FROM g JOIN win ON g.g = win.g AND g.n = win.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(range(k, k + n)) AS u(p) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM d, unnest(string_split(t, chr(10))) AS u(line)
    WHERE regexp_matches(line, {WORD}) GROUP BY r),
o AS (SELECT r, k, x FROM d, unnest(w) WITH ORDINALITY AS u(x, k)),
t AS (SELECT r, k, x AS a, lead(x) OVER v AS b, lead(x, 2) OVER v AS e FROM o WINDOW v AS (PARTITION BY r ORDER BY k)),
g AS (SELECT r, k, count(*) OVER (PARTITION BY r, a, b, e) AS c FROM t WHERE e IS NOT NULL),
p AS (SELECT r, count(DISTINCT k + j) AS n_repeat_words FROM g, range(3) AS q(j) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
      coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT * EXCLUDE (n_lines), NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= 3 * n_words AND 10 * n_dup_lines <= 5 * n_lines AS kept
    FROM b
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 4], ' ') END AS g
    FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(k) WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
m AS (SELECT c.a AS r, min(doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (r) JOIN m USING (r)
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped_length(column: str) -> str:
    """Code points of a text after escaping: one more for each backslash and each control string."""
    controls = [f"(length({column}) - length(replace({column}, {_text(c)}, ''))) // {len(c)}" for c in ("\\", *chat.CONTROL)]
    return f"length({column}) + " + " + ".join(controls)


CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, ''
      ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN) + len(chat.CLOSE) + 1} + {_escaped_length("text")} + {_escaped_length("role")} + (length(role) - length(replace(role, chr(10), '')))) AS BIGINT) AS formatted_chars, 0 AS rewrites
FROM t GROUP BY conv_id
"""


def _spans(kind: str, pattern: bytes, group: int, least: int) -> str:
    """(r, kind, k, start, end) of a kind's matches: lengths of pieces and matches, summed in turn."""
    p = _text(pattern.decode().replace('\\"', '"').replace("\\'", "'"))
    good = f"length(regexp_extract(m, {p}, {group})) >= {least}"
    return f"""SELECT r, '{kind}' AS kind, {secrets.ORDER[kind]} AS k, upto - length(m) AS s, upto AS e FROM (SELECT r, m,
        sum(length(piece) + length(m)) OVER (PARTITION BY r ORDER BY j) AS upto FROM (
      SELECT r, ms[j] AS m, ps[j] AS piece, j FROM (SELECT r, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS ps FROM d
          WHERE regexp_matches(t, {p})), unnest(range(1, len(ms) + 1)) AS u(j))) WHERE {good}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(kind, p, group, least) for kind, p, group, least, _ in secrets.RULES)}),
a AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ','
      ORDER BY s, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN a USING (r)
"""


def _matches(order: int, pattern: str, good: str) -> str:
    """(r, kind, k, s, e, score) of the matches m that are good; score in per cent."""
    kind = pii.KINDS[order]
    lo = f"greatest(s - {pii.NEAR + 1}, 0)"
    near = f"""CASE WHEN s <= {pii.NEAR} THEN chr(10) ELSE '' END || substr(t, {lo} + 1, s - {lo}) || chr(10) || substr(t, e + 1, {pii.NEAR + 1})
        || CASE WHEN e + {pii.NEAR} >= length(t) THEN chr(10) ELSE '' END"""
    alone = "true" if kind.base else "NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || substr(t, e + 1, 1), '[A-Za-z0-9]')"
    prior, high, low = round(100 * kind.prior), round(100 * pii.raised(kind, 1)), round(100 * pii.raised(kind, -1))
    around = f"translate({near}, '{UPPER}', '{LOWER}')"
    against = f"WHEN regexp_matches({around}, {_text(pii.whole(kind.against))}) THEN {low}" if kind.against else ""
    kept = "" if kind.base else f" WHERE score >= {round(100 * pii.THRESHOLD)}"
    return f"""SELECT * FROM (SELECT r, '{kind.name}' AS kind, {order} AS k, s, e,
        CASE WHEN regexp_matches({around}, {_text(pii.whole(kind.words))}) THEN {high} {against} ELSE {prior} END AS score
      FROM (SELECT r, t, m, CAST(upto - length(m) AS BIGINT) AS s, CAST(upto AS BIGINT) AS e FROM (SELECT r, t, m,
          sum(length(piece) + length(m)) OVER (PARTITION BY r ORDER BY j) AS upto FROM (
      SELECT r, t, ms[j] AS m, ps[j] AS piece, j
          FROM (SELECT r, t, regexp_extract_all(t, {_text(pattern)}) AS ms, string_split_regex(t, {_text(pattern)}) AS ps FROM d
          WHERE regexp_matches(t, {_text(pattern)})), unnest(range(1, len(ms) + 1)) AS u(j))))
      WHERE {alone} AND {good}){kept}"""


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
DIGIT = f"CAST(substr(reverse({DIGITS}), i + 1, 1) AS INT)"
LUHN = f"list_sum(list_transform(range(length({DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN {DIGIT} ELSE (2 * {DIGIT}) // 10 + (2 * {DIGIT}) % 10 END)) % 10 = 0"
BARE = "replace(m, ' ', '')"
CODES = f"list_transform(string_split(substr({BARE}, 5) || substr({BARE}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
MOD97 = f"list_reduce(list_concat([0], {CODES}), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
WEIGHED = " + ".join(f"{pii.ABA_WEIGHTS[k % 3]} * CAST(substr(m, {k + 1}, 1) AS INT)" for k in range(9))
PII_RULES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 999) > 255)) = 0"),
    (r"[0-9]([\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}"),
    (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
    (r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", MOD97),
    (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8) <> '0000'"),
    (r"[0-9]{9}", f"m <> '000000000' AND ({WEIGHED}) % 10 = 0"),
    (r"[0-9]{8}[A-Z]", f"substr('{pii.DNI_LETTERS}', CAST(substr(m, 1, 8) AS INT) % 23 + 1, 1) = substr(m, 9)"),
    (r"[0-9]{15}", LUHN),
)
_COUNTS = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kind.name}" for k, kind in enumerate(pii.KINDS) if kind.base)
_ALL = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_matches(k, pattern, good) for k, (pattern, good) in enumerate(PII_RULES))}),
a AS (SELECT r, {_COUNTS}, {_ALL} FILTER (WHERE k < 4) AS base, {_ALL} AS spans, string_agg(score, ',' ORDER BY k, s) AS scores, count(*) AS n_spans
    FROM s GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
    coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN a USING (r)
"""
