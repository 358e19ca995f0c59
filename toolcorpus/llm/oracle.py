"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, replace(replace(text, '\', '\s'), '<|', '<\p') AS body,
         replace(replace(replace(role, '\', '\s'), '<|', '<\p'), chr(10), '\n') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE["op2_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')) AS word,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), 1) AS i FROM documents),
w AS (
  SELECT doc_id, i, word, CASE WHEN count(*) OVER o = 35 THEN string_agg(word, ' ') OVER o END AS win
  FROM words WHERE word <> ''
  WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT doc_id, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM w),
c AS (
  SELECT doc_id, i, word,
         bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT d.doc_id, count(c.i) AS n_words, count(c.i) FILTER (c.gone) AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (NOT c.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""

ORACLE["op6_mix_sources"] = """
WITH RECURSIVE s AS (
  SELECT source, count(*) AS n,
         CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s) * w / ((SELECT sum(w) FROM s) * n) AS rate FROM s),
m AS (SELECT source, greatest(1, ceil(rate / 8.0))::BIGINT AS pieces, rate / greatest(1, ceil(rate / 8.0)) AS mean FROM r),
c(source, mean, k, p, cdf) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM m
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k < 64),
d AS (SELECT doc_id, source, text,
             md5(coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(md5(text), '~')) AS key FROM documents),
u AS (SELECT d.doc_id, d.source, d.key, i.i,
             ('0x' || substr(md5('7|' || i.i || '|' || d.key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source, LATERAL (SELECT unnest(range(m.pieces)) AS i) i),
n AS (SELECT u.doc_id, u.key, count(c.k) AS copies
      FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.doc_id, u.key),
x AS (SELECT doc_id, key, unnest(range(1, copies + 1)) AS copy FROM n)
SELECT x.doc_id, d.source, x.copy::INTEGER AS copy,
       ('0x' || substr(md5('7|order|' || x.copy || '|' || x.key), 1, 15))::BIGINT AS shuffle_key, d.text
FROM x JOIN d ON x.doc_id = d.doc_id AND x.key = d.key
"""

ORACLE["op8_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
w AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER o AS last, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c
  FROM l WHERE length(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT doc_id, first, last, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS seen
  FROM w WHERE last IS NOT NULL),
gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM l JOIN k ON l.doc_id = k.doc_id AND k.seen > 1 AND l.i BETWEEN k.first AND k.last)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
       coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""

ORACLE["op10_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""

ORACLE["op13_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
r AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike
   AND s.score * 100 BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


ORACLE["op11_spelling_variants"] = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY 1, 2),
b AS (SELECT run, n, list_transform(range(0, length(hex(key)) // 2), lambda i: ('0x' || substr(hex(key), 2 * i + 1, 2))::BIGINT) AS bytes FROM k),
h AS (SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, x: @STEP@, 4294967295)) AS h FROM b),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
-- A byte for each letter, so that the distance counts letters.
t AS (SELECT word, n, translate(word, @MARKED@, @PLAIN@) AS s FROM w),
-- Two words one edit apart agree after at most one deletion from each.
d AS (SELECT word, n, s, unnest(list_distinct(list_transform(range(0, length(s) + 1), lambda i: substr(s, 1, i) || substr(s, i + 2)))) AS cut FROM t),
p AS (SELECT DISTINCT a.word, a.n, c.word AS near, c.n AS near_n FROM d a JOIN d c ON a.cut = c.cut AND a.word <> c.word AND levenshtein(a.s, c.s) = 1),
f AS (
  SELECT w.word, w.n, count(p.near) AS n_near, arg_min(p.near, (-p.near_n, p.near)) AS best, max(p.near_n) AS best_n
  FROM w LEFT JOIN p ON w.word = p.word GROUP BY w.word, w.n),
g AS (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f),
way AS (
  SELECT word, word AS root, 0 AS step FROM g
  UNION ALL SELECT way.word, g.form, step + 1 FROM way JOIN g ON way.root = g.word WHERE g.form IS NOT NULL)
SELECT g.*, l.root FROM g JOIN (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word) l ON g.word = l.word
"""
_MARKED = "".join(map(chr, range(0xC0, 0x100)))
_PLAIN = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'")[:64]


def _half(c: str, x: str) -> str:
    """One half byte of CRC-32: a table of 16, by its rule."""
    table = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    return f"xor({table}[(xor({c}, {x}) & 15) + 1], ({c}) >> 4)"


for _old, _new in (("@STEP@", _half(_half("c", "x"), "x >> 4")), ("@MARKED@", f"'{_MARKED}'"), ("@PLAIN@", f"'{_PLAIN}'")):
    ORACLE["op11_spelling_variants"] = ORACLE["op11_spelling_variants"].replace(_old, _new)
