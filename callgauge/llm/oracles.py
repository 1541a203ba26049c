"""DuckDB statements of the results that SQL can express."""

_OP3 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) + 1
    + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

_OP7 = """
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS row_id FROM documents
), starts AS (
  SELECT row_id, unnest(range(0, length(h) // 2 - 199)) AS pos, h FROM raw WHERE length(h) >= 400
), windows AS (
  SELECT row_id, pos, hash(substr(h, CAST(2 * pos + 1 AS BIGINT), 400)) AS w FROM starts
), twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT row_id, pos FROM windows SEMI JOIN twice USING (w)),
marked AS (
  SELECT row_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY row_id ORDER BY pos) + 200 THEN 0 ELSE 1 END AS fresh FROM hits
), runs AS (SELECT row_id, pos, sum(fresh) OVER (PARTITION BY row_id ORDER BY pos) AS run FROM marked),
spans AS (SELECT row_id, run, min(pos) AS a, max(pos) + 200 AS b FROM runs GROUP BY row_id, run),
gaps AS (
  SELECT row_id, a, b, coalesce(lag(b) OVER (PARTITION BY row_id ORDER BY a), 0) AS prior_end FROM spans
), kept AS (
  SELECT row_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last_end,
    string_agg(substr(h, CAST(2 * prior_end + 1 AS BIGINT), CAST(2 * (a - prior_end) AS BIGINT)), '' ORDER BY a) AS lead_hex
  FROM gaps JOIN raw USING (row_id) GROUP BY row_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(lead_hex, '') || substr(h, CAST(2 * coalesce(last_end, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM raw LEFT JOIN kept USING (row_id)
"""

_OP9 = """
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN (SELECT sum(chars) FROM sizes) / ((SELECT count(*) FROM sizes) * chars) ELSE 1.0 END AS rate FROM sizes
), steps AS (
  SELECT source, rate, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(CAST(k AS DOUBLE)) END) OVER (PARTITION BY source ORDER BY k)) END AS p
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 14 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates)
), cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
keyed AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, '')) AS key FROM documents),
drawn AS (SELECT *, CAST(CAST('0x' || substr(md5('17:' || key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM keyed),
counted AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= u) AS n_copies FROM drawn d),
copies AS (SELECT *, unnest(range(0, n_copies)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5('17/' || key || '/' || CAST(copy AS VARCHAR)) AS shuffle_key FROM copies
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT row_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split
), sizes AS MATERIALIZED (SELECT row_id, count(*) AS n FROM shingles GROUP BY row_id),
shared AS MATERIALIZED (SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.row_id <> b.row_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes p ON p.row_id = x JOIN sizes q ON q.row_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT row_id, row_id AS seen FROM split UNION SELECT reach.row_id, y FROM reach JOIN links ON x = seen),
least AS (SELECT reach.row_id, min(doc_id) AS component_id FROM reach JOIN split ON split.row_id = seen GROUP BY reach.row_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM split JOIN least USING (row_id) LEFT JOIN sizes USING (row_id)
"""


def _codes(rounds: int = 4) -> str:
    """The rounds one after another; b0 is the first codebook, a<i> the assignments to b<i>."""
    parts = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT row_id, (i * 4) // len(q) AS p, i - ((i * 4) // len(q)) * (len(q) // 4) AS j, q[i + 1] AS x FROM (SELECT *, unnest(range(0, len(q))) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT p, row_id - 1 AS e, j, x AS c FROM v WHERE row_id <= 256)"""
    for i in range(rounds + 1):
        parts += f""",
a{i} AS MATERIALIZED (SELECT row_id, p, CAST(min(d * 256 + e) % 256 AS BIGINT) AS e, CAST(min(d * 256 + e) // 256 AS BIGINT) AS d FROM (SELECT row_id, v.p, e, sum((x - c) * (x - c)) AS d FROM v JOIN b{i} b ON b.p = v.p AND b.j = v.j GROUP BY ALL) GROUP BY row_id, p)"""
        if i < rounds:
            parts += f""",
m{i} AS (SELECT v.p, e, j, sum(x) AS s, count(*) AS n FROM v JOIN a{i} a ON a.row_id = v.row_id AND a.p = v.p GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"""
    return parts + f"""
, coded AS (SELECT row_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (row_id)
"""


_OP13 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS MATERIALIZED (
  SELECT lang, m, g, count(*) AS f FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m)))
  GROUP BY ALL HAVING count(*) >= 30
), found AS MATERIALIZED (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM grams WHERE m > 1),
inner_ones AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS g, max(a) AS longer FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM found)) GROUP BY ALL),
kept AS (SELECT found.* FROM found LEFT JOIN inner_ones USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (
  SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) c
  JOIN grams x ON x.lang = c.lang AND x.g = array_to_string(w[1:k], ' ') JOIN grams y ON y.lang = c.lang AND y.g = array_to_string(w[k + 1:], ' ')
), scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM scored) JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op3_chat": _OP3, "op7_suffixes": _OP7, "op9_mixing": _OP9, "op11_minhash": _OP11, "op12_codes": _codes(), "op13_phrases": _OP13}
