"""The same results as SQL, for the operators that SQL can express on whole tables."""

from __future__ import annotations

_LINES = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, e' \t\n\x0B\f\r'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), e'\n') AS l FROM documents))
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines
  WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, e'\n' ORDER BY pos)
                       FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (key)
GROUP BY doc_id
"""

# What the escape adds a backslash to; the same strings as in the operator.
_CONTROL = (
    r"/?s>|\|[A-Za-z0-9_]{1,64}\|>|<SYS>>|</SYS>>|/?INST\]"
    r"|(?:start|end)_of_turn>|(?:bos|eos|pad|unk)>"
)

_CHATS = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         regexp_replace(text, '([<\[])(\\*(?:{_CONTROL}))', '\1\\\2', 'g') AS body
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || e'\n' || text || e'\n', '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(length(body) + CASE WHEN before IS NULL THEN length('<|im_start|>') + length(role) + 1
                                WHEN before = role THEN length('<|im_sep|>')
                                ELSE length(e'<|im_end|>\n<|im_start|>') + length(role) + 1 END)
        + length(e'<|im_end|>\n'))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

_ARCHIVES = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS digest
  FROM pages
),
firsts AS (SELECT digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY digest)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN firsts USING (digest)
"""

_CUTS = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
u AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
parts AS (
  SELECT *, substring(text, 1, least(x, y)) AS p, substring(text, least(x, y) + 1, abs(x - y)) AS m,
         substring(text, greatest(x, y) + 1) AS s FROM u
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

ORACLES: dict[str, str] = {
    "op5_line_dedup": _LINES,
    "op7_chat_formatting": _CHATS,
    "op9_warc": _ARCHIVES,
    "op12_fill_in_middle": _CUTS,
    "op13_hard_negative_mining": _NEGATIVES,
}
