"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

_BLANK = r"NOT coalesce(regexp_matches(text, '[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'), false)"

_FAULTS = f"""
WITH m AS (SELECT DISTINCT session_id, event_id, seq, role, {_BLANK} AS blank FROM messages WHERE session_id IS NOT NULL),
  slots AS (SELECT session_id, seq FROM m UNION SELECT session_id, seq FROM tool_calls WHERE session_id IS NOT NULL),
  span AS (SELECT session_id, count(seq) AS n, min(seq) AS low, max(seq) AS high FROM slots GROUP BY 1),
  shared AS (SELECT DISTINCT session_id FROM (SELECT session_id, seq FROM m GROUP BY 1, 2 HAVING count(*) > 1)),
  state AS (SELECT session_id, max((role = 'user' AND NOT blank)::int) AS u, max((role = 'assistant' AND NOT blank)::int) AS a,
      max((role IS NULL OR role NOT IN ('user', 'assistant', 'reasoning'))::int) AS odd FROM m GROUP BY 1),
  t AS (SELECT session_id, seq, CASE WHEN role = 'user' THEN 'U' WHEN role = 'assistant' AND NOT blank THEN 'A' ELSE 'N' END AS cls
      FROM m WHERE NOT (blank AND role = 'user')),
  w AS (SELECT *, lead(cls) OVER s AS nxt, lead(CASE WHEN cls <> 'N' THEN cls END IGNORE NULLS) OVER s AS said
      FROM t WINDOW s AS (PARTITION BY session_id ORDER BY seq, cls)),
  gap AS (SELECT DISTINCT session_id FROM w WHERE cls = 'U' AND nxt IS DISTINCT FROM 'U' AND (said IS NULL OR said = 'U'))
SELECT i.session_id, coalesce(u = 0 OR a = 0, true) AS no_dialogue, coalesce(odd = 1, false) AS bad_role,
  coalesce(low <> 0 OR n <> high + 1, false) OR i.session_id IN (FROM shared) AS bad_sequence, i.session_id IN (FROM gap) AS no_reply
FROM (SELECT DISTINCT session_id FROM sessions WHERE session_id IS NOT NULL) i LEFT JOIN state USING (session_id) LEFT JOIN span USING (session_id)
"""

_TURNS = f"""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, event_id)::bigint AS turn_no, seq, event_id, role, text
FROM (SELECT DISTINCT session_id, event_id, seq, role, text FROM messages WHERE NOT ({_BLANK}))
WHERE session_id IN (SELECT session_id FROM ({_FAULTS}) WHERE NOT (no_dialogue OR bad_role OR bad_sequence OR no_reply))
"""

SQL: dict[str, str] = {
    "p1_found": "SELECT DISTINCT event_id FROM messages JOIN split_limits ON provider = split_part(session_id, ':', 1) WHERE length(text) > max_chars",
    "p1_rebuilt": "SELECT DISTINCT session_id, event_id, seq, md5(text) AS text_md5, 0::bigint AS n_oversized FROM messages WHERE text IS NOT NULL",
    "p4_found": f"SELECT session_id FROM ({_FAULTS}) WHERE no_dialogue OR bad_role OR bad_sequence OR no_reply",
    "p4_faults": _FAULTS,
    "p4_turns": _TURNS,
    "p4_matches": f"SELECT search_id, session_id, turn_no, event_id, role FROM ({_TURNS}) JOIN (SELECT DISTINCT search_id, session_id FROM search_matches) USING (session_id)",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
