"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[ \x09-\x0D]+'), lambda w: w <> '')"

# every pair that shares a shingle, then labels along links
OP1 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE
    WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE []::VARCHAR[] END AS g
  FROM d
), sets AS MATERIALIZED (
  SELECT min(doc_id) AS rep, g FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g
), e AS MATERIALIZED (
  SELECT rep, len(g) AS n, unnest(g) AS x FROM sets
), p AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b
  FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), l AS MATERIALIZED (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT rep, rep FROM sets
), r AS (
  SELECT a AS node, a AS root FROM l WHERE a = b
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b
), c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id
FROM s LEFT JOIN sets ON sets.g = list_sort(s.g) LEFT JOIN c ON c.node = sets.rep
"""

OP4 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {WORDS.format("text")} AS w FROM documents
), win AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), dup AS MATERIALIZED (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win
  ) WHERE k > 1
), gone AS MATERIALIZED (
  SELECT doc_id, list(DISTINCT i + o) AS places FROM dup, (SELECT unnest(range(0, 20)) AS o) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed, CASE WHEN places IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w[i]) END AS k
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_SHOWN = "'<|im_start|>' || coalesce(role, '') || chr(10) || coalesce({0}, '') || '<|im_end|>' || chr(10)"
OP6 = f"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    first_value(CASE WHEN role = 'assistant' THEN text END) OVER (
      PARTITION BY conv_id ORDER BY role = 'assistant' DESC, turn) AS first_text,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn
  FROM conversations
), u AS (
  SELECT *, CASE WHEN role = 'assistant' AND turn = last_turn THEN first_text ELSE text END AS other FROM t
), m AS (
  SELECT *, coalesce(min(CASE WHEN other <> text THEN i END) OVER (PARTITION BY conv_id) - 1,
    count(*) OVER (PARTITION BY conv_id)) AS n_prompt, {_SHOWN.format("text")} AS x, {_SHOWN.format("other")} AS y
  FROM u
), o AS (
  SELECT *, sum(CASE WHEN i > n_prompt THEN length(x) ELSE 0 END) OVER w - length(x) AS at_x,
    sum(CASE WHEN i > n_prompt THEN length(y) ELSE 0 END) OVER w - length(y) AS at_y, 13 + length(role) AS head
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY i)
)
SELECT conv_id, any_value(n_prompt) AS n_prompt,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (i <= n_prompt), '') AS prompt,
  coalesce(string_agg(x, '' ORDER BY i) FILTER (i > n_prompt), '') AS chosen,
  coalesce(string_agg(y, '' ORDER BY i) FILTER (i > n_prompt), '') AS rejected,
  coalesce(string_agg((at_x + head)::BIGINT || '-' || (at_x + length(x))::BIGINT, ',' ORDER BY i)
    FILTER (i > n_prompt AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((at_y + head)::BIGINT || '-' || (at_y + length(y))::BIGINT, ',' ORDER BY i)
    FILTER (i > n_prompt AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY conv_id
"""

_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP11 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_TERMS} AS w FROM documents
), c AS (
  SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), p AS MATERIALIZED (
  SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, n_docs
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

# bytes as pairs of hex digits
OP12 = """
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS m
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)
), f AS (
  SELECT m, min(doc_id) AS earliest FROM w GROUP BY m HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (m) WHERE doc_id > earliest
), r AS (
  SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g
), s AS (
  SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY doc_id, run
), p AS (
  SELECT doc_id, h, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS cut FROM s JOIN d USING (doc_id)
), k AS (
  SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed,
    string_agg(substr(h, 2 * cut + 1, 2 * (lo - cut)), '' ORDER BY lo) || substr(h, 2 * max(hi) + 1) AS kept
  FROM p GROUP BY doc_id, h
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def _fields(n_chars: str) -> str:
    columns = ("doc_id", "source", "lang", n_chars, "text")
    text = [f"({c})::VARCHAR" for c in columns]
    return " || ".join(f"coalesce(octet_length(encode({t})) || ':' || {t}, '-')" for t in text)


# crc32 of the decimal id, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
    lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

_LEVEL = "sha256(string_agg(h, '' ORDER BY i))"
OP13 = f"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS k, {_CRC} % 7 = 0 AS hit,
    sha256({_fields("n_chars")}) AS leaf, sha256({_fields("n_chars + 1")}) AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM documents
), t AS (
  SELECT k, 0 AS lv, i, n, leaf AS h FROM l
  UNION ALL
  SELECT k, lv + 1, i // 2, (n + 1) // 2, {_LEVEL} FROM t WHERE n > 1 GROUP BY k, lv, i // 2, (n + 1) // 2
), sub AS MATERIALIZED (
  SELECT k, h, lv AS depth, row_number() OVER (ORDER BY k) - 1 AS spot, count(*) OVER () AS m FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lv, spot AS i, m AS n, h FROM sub
  UNION ALL
  SELECT lv + 1, i // 2, (n + 1) // 2, {_LEVEL} FROM u WHERE n > 1 GROUP BY lv, i // 2, (n + 1) // 2
), r AS (SELECT h AS root, lv AS top FROM u WHERE n = 1), p AS MATERIALIZED (
  SELECT l.doc_id, g.lv, (l.i >> g.lv) & 1 AS right_one, t.h AS sib
  FROM l JOIN sub USING (k) CROSS JOIN unnest(range(63)) AS g(lv)
    LEFT JOIN t ON t.k = l.k AND t.lv = g.lv AND t.i = xor(l.i >> g.lv, 1)
  WHERE g.lv < sub.depth
  UNION ALL
  SELECT l.doc_id, sub.depth + g.lv, (sub.spot >> g.lv) & 1, u.h
  FROM l JOIN sub USING (k) CROSS JOIN r CROSS JOIN unnest(range(63)) AS g(lv)
    LEFT JOIN u ON u.lv = g.lv AND u.i = xor(sub.spot >> g.lv, 1)
  WHERE g.lv < r.top
), w AS (
  SELECT doc_id, 0 AS lv, CASE WHEN hit THEN other ELSE leaf END AS h FROM l
  UNION ALL
  SELECT doc_id, lv + 1, sha256(CASE WHEN sib IS NULL THEN h WHEN right_one = 1 THEN sib || h ELSE h || sib END)
  FROM w JOIN p USING (doc_id, lv)
), o AS (
  SELECT l.doc_id, leaf, sub.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root
  FROM l JOIN sub USING (k) CROSS JOIN r
    JOIN (SELECT doc_id, arg_max(h, lv) AS folded FROM w GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg(sib, '' ORDER BY lv) AS proof FROM p GROUP BY doc_id) USING (doc_id)
)
SELECT *, folded_root = root AS verified FROM o
"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op4_substring_dedup": OP4,
    "op6_preference_format": OP6,
    "op11_lexical_search": OP11,
    "op12_suffix_dedup": OP12,
    "op13_merkle_manifest": OP13,
}
