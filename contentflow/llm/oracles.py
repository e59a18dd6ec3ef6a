"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {}

ORACLES["op10_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE times > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (n_words < 50)::INT AS f1, (100 * n_repeat_words > 50 * n_words)::INT AS f2,
             (5 * n_symbols > word_chars)::INT AS f3, (2 * n_dup_lines > n_lines)::INT AS f4 FROM c),
long AS (SELECT source, rule, count(*) AS n, sum(f) AS failed
         FROM (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS f FROM f WHERE source IS NOT NULL) GROUP BY ALL),
prior AS (SELECT rule, sum(failed) / sum(n) AS m, var_pop(failed / n) AS v FROM long GROUP BY rule),
hosts AS (SELECT source, max((failed + k * m) / (n + k)) AS rate
          FROM long JOIN (SELECT *, greatest(1.0, least(1e6, m * (1 - m) / greatest(v, 1e-9) - 1)) AS k FROM prior) USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 + f2 > 0 AS base_failed,
       coalesce(rate > 0.5, false) AS host_failed, f1 + f2 = 0 AND NOT coalesce(rate > 0.5, false) AS kept
FROM f LEFT JOIN hosts USING (source)
"""

ORACLES["op1_chat"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;') AS body,
             replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;'), chr(10), '&nl;') AS who FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length('<|turn|>' || who || chr(10) || body || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op6_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM g WHERE nth > 1),
k AS (SELECT d.doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) d
      ANTI JOIN c USING (doc_id, j)),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""

ORACLES["op3_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 80 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = d.doc_id
"""

ORACLES["op9_language_model"] = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS a, w[i - 1] AS b, w[i - 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT doc_id, i, a, b, c,
        count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, doc_id) AS c1,
        CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b, a, i > 1) - count(*) OVER (PARTITION BY b, a, i > 1, doc_id) END AS c2,
        CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY c, b, a, i > 2) - count(*) OVER (PARTITION BY c, b, a, i > 2, doc_id) END AS c3 FROM t),
p AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM k),
n AS (SELECT doc_id, len(w) AS n, sum(len(w)) OVER () - len(w) AS others FROM d),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3 / p2)
                          WHEN c2 > 0 THEN ln(c2 / p1) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                          ELSE ln(greatest(c1, 1) / greatest(others, 1)) + least(i - 1, 2) * ln(0.4) END AS x FROM p JOIN n USING (doc_id))
SELECT n.doc_id, n.n::BIGINT AS n_words, round(avg(x), 6) AS lm_score FROM n LEFT JOIN s USING (doc_id) GROUP BY n.doc_id, n.n
"""

ORACLES["op11_hard_negatives"] = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, e.vec_id AS id, e.r, e.label = a.label AS same, list_inner_product(a.q, e.q)::BIGINT AS score
      FROM e a JOIN e ON e.r <> a.r WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, r) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, positive_id ORDER BY score DESC, id, r)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

ORACLES["op12_spelling"] = r"""
WITH RECURSIVE b(k, i, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
                              SELECT k, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM b WHERE i < 8),
t AS (SELECT list(v ORDER BY k) AS t FROM b WHERE i = 8),
o AS (SELECT doc_id, run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
      WHERE length(run) >= 5 GROUP BY ALL),
x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM o),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) // 2 + 1), lambda j: ('0x' || substr(x, 2 * j - 1, 2))::BIGINT)),
                                     lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) AS h FROM x, t),
w AS (SELECT word, sum(n)::BIGINT AS n
      FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND length(x.word) = length(y.word) AND x.word <> y.word
          UNION SELECT d.word, w.word FROM d JOIN w ON d.less = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
near AS (SELECT a AS word, count(*) AS n_near, max(n) AS top FROM pairs JOIN w ON w.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN (SELECT min(encode(b)) FROM pairs JOIN w y ON y.word = b WHERE a = w.word AND y.n = top) END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n
          FROM w LEFT JOIN near USING (word)),
f AS (SELECT * REPLACE (decode(form) AS form) FROM forms),
r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.up)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.up IS NULL
"""
