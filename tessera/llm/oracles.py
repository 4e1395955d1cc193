"""DuckDB SQL for the operators that SQL can express: 2, 4, 5 and 7."""

from __future__ import annotations

from . import chat, secret_scan


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NIBBLES = "[" + ", ".join(f"'{i:04b}'" for i in range(16)) + "]"
_FIVE = " + ".join(f"{1 << (4 - j)} * CAST(substr(bits, 5 * i + {j + 1}, 1) AS INTEGER)" for j in range(5))

WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(payload), ''), lambda h: {_NIBBLES}[strpos('0123456789abcdef', h)]), '') AS bits,
  max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to, url
FROM b"""


def _matches(nth: int, rule: secret_scan.Rule) -> str:
    rx = _quoted(rule.regex)
    return f"SELECT doc_id, {nth} AS nth, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, {rx}) AS gaps, regexp_extract_all(t, {rx}) AS own, regexp_extract_all(t, {rx}, {rule.group}) AS held FROM d WHERE regexp_matches(t, {rx})"


def _listed(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || begin_at || ':' || end_at, ',' ORDER BY begin_at, nth) FILTER ({where}), '')"


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(i, r) for i, r in enumerate(secret_scan.RULES))}),
n AS (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM m),
s AS (SELECT doc_id, nth, kind, least, length(held[i]) AS held, length(own[i]) AS size,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(own[1:i - 1], lambda x: length(x))), 0) AS begin_at FROM n),
f AS (SELECT doc_id, nth, kind, CAST(begin_at AS BIGINT) AS begin_at, CAST(begin_at + size AS BIGINT) AS end_at FROM s WHERE held >= least)
SELECT d.doc_id, count(*) FILTER (f.nth = 0) AS n_assign, count(*) FILTER (f.nth = 1) AS n_access, count(*) FILTER (f.nth = 2) AS n_hex,
  sha256({_listed("f.nth < 3")}) AS base_sha256, {_listed("f.nth IS NOT NULL")} AS spans
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""

_T = chat.Template()
_MOVES = " OR ".join(f"(before = '{state}' AND role IN ({', '.join(_quoted(r) for r in roles)}))" for state, roles in _T.moves.items())
_ESCAPE = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"

CHAT = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', {_quoted(chat.PROBE)}), (-1, 1, 'assistant', {_quoted(chat.PROBE)})) AS v(conv_id, turn, role, text)),
o AS (SELECT *, row_number() OVER w - 1 AS place, lag(role, 1, '') OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT *, NOT ({_MOVES}) AS bad FROM o)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(_T.begin.replace("{role}", "")) + len(_T.end)} + length(replace({_ESCAPE.format("role")}, chr(10), '\\n')) + length({_ESCAPE.format("text")})) AS BIGINT) AS formatted_chars,
  NOT bool_or(bad) AND bool_or(last AND role IN ({", ".join(_quoted(r) for r in _T.final)})) AS valid, min(place) FILTER (bad) AS first_bad_turn
FROM c GROUP BY conv_id"""

_NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"

#: A run of repeated sentences is gone from 20 words on, as PASSAGE_WORDS of the operator has it.
LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines[i] AS line, i, CAST(sum(length(lines[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(lines[i]) - 1 AS BIGINT) AS line_at
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
m AS (SELECT *, {_NORMAL.format("line")} AS norm FROM l),
u AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1 AS line_gone FROM m),
s AS (SELECT doc_id, i, line_at, line_gone, line, parts[j] AS part, j,
  CAST(line_at + sum(length(parts[j]) + 1) OVER (PARTITION BY doc_id, i ORDER BY j) - length(parts[j]) - 1 AS BIGINT) AS part_at
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM (SELECT *, string_split_regex(regexp_replace(line, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS parts FROM u))),
n AS (SELECT *, {_NORMAL.format("part")} AS own FROM s),
r AS (SELECT *, own <> '' AND row_number() OVER (PARTITION BY own ORDER BY doc_id, part_at) > 1 AS again, len(string_split(own, ' ')) AS words FROM n),
g AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, i, again ORDER BY j) AS island FROM r),
h AS (SELECT *, again AND sum(words) OVER (PARTITION BY doc_id, i, again, island) >= 20 AND NOT line_gone AS part_gone FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i, part_gone ORDER BY j) AS nth FROM h),
spans AS (SELECT doc_id, line_at AS a, line_at + length(line) AS b FROM u WHERE line_gone
  UNION ALL SELECT doc_id, min(part_at), max(part_at + length(part)) FROM h WHERE part_gone GROUP BY doc_id, i, island),
listed AS (SELECT doc_id, count(*) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, i, string_agg(CASE WHEN nth = 1 THEN '' ELSE ' ' END || part, '' ORDER BY j) AS line FROM k WHERE NOT line_gone AND NOT part_gone GROUP BY doc_id, i),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept_text FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(d.lines) AS n_units, coalesce(listed.n, 0) AS n_removed, coalesce(listed.spans, '') AS removed_spans, coalesce(texts.kept_text, '') AS kept_text
FROM d LEFT JOIN listed ON listed.doc_id = d.doc_id LEFT JOIN texts ON texts.doc_id = d.doc_id"""
