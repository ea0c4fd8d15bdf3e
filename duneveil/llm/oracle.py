"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, md5(text), 'null') AS drawn FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3 AS ceiling FROM totals
), levels AS (
  SELECT *, row_number() OVER o AS place,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM ranked WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), stop AS (
  SELECT place AS first, level FROM levels WHERE level * weight <= ceiling ORDER BY place LIMIT 1
), targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN s.first IS NULL OR l.place < s.first THEN l.ceiling::DOUBLE ELSE s.level * l.weight END AS target
  FROM levels l LEFT JOIN stop s ON true
), sums AS (
  SELECT source, length(bin(size)) AS weight, sum(size)::BIGINT AS words FROM sized WHERE size > 0 GROUP BY ALL
), heavy AS (
  SELECT s.*, t.target, t.source_size,
    (t.target - (coalesce(sum(words) OVER (PARTITION BY s.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)::DOUBLE)
      / (sum(weight * words) OVER (PARTITION BY s.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM sums s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), brim AS (
  SELECT source, arg_max(level, weight) AS level, max(weight) AS weight FROM heavy WHERE level * weight <= 3 GROUP BY source
), expected AS (
  SELECT h.*, CASE WHEN h.weight <= a.weight THEN a.level * h.weight ELSE 3.0::DOUBLE END AS expected FROM heavy h LEFT JOIN brim a ON h.source IS NOT DISTINCT FROM a.source
), plan AS (
  SELECT source, weight, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p,
    target - (sum(floor(expected)::BIGINT * words) OVER (PARTITION BY source))::DOUBLE AS rest FROM expected
), u AS (
  SELECT d.*, t.source_size, t.target, coalesce(p.whole, 0) AS whole, p.rest, p.p,
    (('0x' || substr(md5('mix-1:' || drawn), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    LEFT JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.size > 0 AND length(bin(d.size)) = p.weight
), odds AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS ratio FROM u
), run AS (
  SELECT *, sum(CASE WHEN ratio IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY ratio / (1 + ratio) NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS reached FROM odds
), copies AS (
  SELECT *, (whole + CASE WHEN ratio IS NOT NULL AND reached - size / 2 <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM run
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM copies
"""

SITE_LINES = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages
), held AS (
  SELECT host, line, count(DISTINCT page_id) AS n FROM p, unnest(p.lines) AS t(line) GROUP BY host, line
), frame AS (
  SELECT h.host, list(h.line) AS bad FROM held h JOIN (SELECT host, count(*) AS total FROM p GROUP BY host) t USING (host)
  WHERE h.n >= 2 AND h.n > 0.1::DOUBLE * t.total GROUP BY h.host
), kept AS (
  SELECT p.*, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS good FROM p LEFT JOIN frame USING (host)
)
SELECT page_id, host, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(good), 0)::BIGINT AS n_dropped,
  CASE WHEN lines IS NULL THEN NULL ELSE coalesce(array_to_string(good, chr(10)), '') END AS kept_text
FROM kept
"""

ROTATION = r"""
WITH r AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS words FROM conversations
), parties AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM r WHERE speaker <> 'system'
), f AS (
  SELECT conv_id, perspective, turn, speaker, words, floor(turn / 256)::BIGINT AS block, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user ' || replace(replace(replace(replace(replace(speaker, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') || '|>' || chr(10) END AS head
  FROM r JOIN parties ON r.conv_id IS NOT DISTINCT FROM c
), g AS (
  SELECT *, head || words || '<|end|>' || chr(10) AS piece FROM f
), h AS (
  SELECT *, row_number() OVER o AS place, sum(length(piece)) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS LAST, speaker, words ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM g WINDOW o AS (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS LAST, speaker, words)
)
SELECT conv_id, perspective, block, coalesce(sum(sum(length(piece))) OVER (PARTITION BY conv_id, perspective ORDER BY block NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, count(*)::BIGINT AS n_turns, string_agg(piece, '' ORDER BY place) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN (stop - length(piece) + length(head))::VARCHAR || '-' || (stop - 1)::VARCHAR END, ',' ORDER BY place), '') AS mask
FROM h GROUP BY conv_id, perspective, block
"""


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text: DuckDB has none, so its table is made by rule."""
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda a, x: xor(a >> 8, ({table})[(xor(a, x) & 255) + 1])), 4294967295)"


REPAIR = rf"""
WITH RECURSIVE lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot
  FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM lots WHERE lot <> 0
), rows AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS prior,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text), copy) AS seen
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text), copy)
), faults AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM rows
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank,
    count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated, count_if(i > 1 AND prior || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM faults GROUP BY conv_id
), moves(origin, target, needed) AS (
  VALUES ('', 's', ''), ('', 'u', ''), ('s', 'u', ''), ('a', 'u', ''), ('u', 'u', 'assistant:'), ('u', 'a', ''), ('', 'a', 'user:'), ('s', 'a', 'user:'), ('a', 'a', 'user:')
), walk(conv_id, i, state, cost, audit, body) AS (
  SELECT conv_id, 0::BIGINT, '', 0::BIGINT, '', []::VARCHAR[] FROM facts
  UNION ALL
  SELECT conv_id, i, state, cost, audit, body FROM (
    SELECT w.conv_id, f.i, w.state, w.cost + 4 AS cost, w.audit || 'D' AS audit, w.body FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    UNION ALL
    SELECT w.conv_id, f.i, m.target, w.cost + CASE WHEN needed = '' THEN 0 ELSE 3 END + CASE WHEN f.initial = m.target THEN 0 ELSE 3 END + CASE WHEN f.fault IS NULL THEN 0 ELSE 3 END,
      w.audit || CASE WHEN needed = '' THEN '' ELSE 'I' END || CASE WHEN f.initial = m.target THEN 'K' ELSE 'R' END,
      list_concat(w.body, CASE WHEN needed = '' THEN [] ELSE [needed] END, [CASE WHEN f.initial = m.target THEN f.role WHEN m.target = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text])
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN moves m ON m.origin = w.state AND (m.target <> 's' OR f.initial = 's')
    WHERE f.fault IS NULL OR f.fault = 'truncated'
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), ends AS (
  SELECT w.conv_id, w.cost + CASE state WHEN 'u' THEN 3 WHEN 's' THEN 6 ELSE 0 END AS cost, w.audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit,
    list_concat(w.body, CASE state WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END) AS body, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal
  FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i
), best AS (
  SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

RANKING = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (
  SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0
), size AS (
  SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM docs
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), postings AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * size.N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM postings, size GROUP BY term, size.N
), scores AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * p.n * size.N) // size.L))))::BIGINT AS score
  FROM asked JOIN postings p USING (term) JOIN weights USING (term), size GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

SQL = {
    "op3_pareto_mix": MIX, "op4_site_line_dedup": SITE_LINES, "op7_perspective_rotation": ROTATION, "op11_bit_sliced_search": RANKING, "op13_structure_repair": REPAIR,
}
