"""DuckDB SQL for the rows of the queries that SQL can express."""

_ESCAPES = r"coalesce(len(regexp_extract_all({0}, '[<\[]\\*(s>|/s>|INST\]|/INST\])')), 0)"

OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + {_ESCAPES.format("role")} + {_ESCAPES.format("text")}
           + length('<s></s>') + CASE role WHEN 'assistant' THEN length('[/INST]') ELSE length('[INST]') END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP5 = r"""
WITH lab AS (
  SELECT doc_id, CASE WHEN max(quality) < 1 THEN 0.5::DOUBLE WHEN max(coalesce(toxic, 0)) > 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(lab.weight, 1.0::DOUBLE) AS weight
  FROM documents d LEFT JOIN lab USING (doc_id)),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM sized GROUP BY source),
caps AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS total FROM sums),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
targets AS (
  SELECT source, source_size,
         CASE WHEN ratio > level THEN least(cap, (SELECT arg_min(level, ratio) FROM levels WHERE ratio > level) * w) ELSE cap END AS target
  FROM levels),
keyed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
         -ln((('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / s.weight AS key
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END AS epochs
  FROM keyed)
SELECT doc_id, size, source, source_size, target,
       (epochs * size + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken
FROM placed
"""

OP7 = r"""
WITH l AS (
  SELECT doc_id, text, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
bad AS (
  SELECT trim(line) AS t FROM l WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT source) >= 10)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(bad.t)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE bad.t IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad ON trim(l.line) = bad.t
GROUP BY l.doc_id
"""

_SHINGLES = r"""
SELECT {id}, h[i] || ' ' || h[i + 1] || ' ' || h[i + 2] || ' ' || h[i + 3] || ' ' || h[i + 4] AS s
FROM (SELECT {id}, h, unnest(range(1, len(h) - 3)) AS i
      FROM (SELECT {id}, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS h FROM {table}))
"""

OP10 = f"""
WITH ds AS (SELECT DISTINCT * FROM ({_SHINGLES.format(id="doc_id", table="documents")})),
its AS (SELECT DISTINCT * FROM ({_SHINGLES.format(id="item_id", table="benchmark")})),
sizes AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id),
found AS (
  SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) AS share
  FROM ds JOIN its USING (s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9),
lists AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(share) AS share
  FROM found GROUP BY doc_id)
SELECT d.doc_id, lists.items IS NULL AS kept, coalesce(lists.n, 0)::BIGINT AS n_items,
       coalesce(lists.items, '') AS items, coalesce(share, 0.0::DOUBLE) AS share
FROM documents d LEFT JOIN lists USING (doc_id)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n
  FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total, size.v
  FROM groups g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM grid),
away AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(away.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN away ON away.lang = a.lang AND away.source = a.source AND away.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS g, count(*)::BIGINT AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1 : j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[j + 1 :], ' ')),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT c.lang, c.phrase FROM f c JOIN f d ON d.lang = c.lang AND d.k > c.k AND c.k > 1
  WHERE 100 * d.f >= 80 * c.f AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = least.lang AND i.phrase = least.phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

ORACLE = {
    "op1_chat_format": OP1,
    "op5_mixing": OP5,
    "op7_line_dedup": OP7,
    "op10_decontamination": OP10,
    "op11_divergence": OP11,
    "op13_collocations": OP13,
}
