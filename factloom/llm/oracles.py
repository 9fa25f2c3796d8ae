"""DuckDB SQL that states what the queries return, where SQL can express it."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP10_NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    ELSE list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT DISTINCT a, a AS b FROM both_ways
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), smallest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(s.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(s.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN smallest s ON s.a = d.doc_id
"""

OP7_MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM s),
o AS (SELECT *, 3 * source_size / weight AS stop FROM w),
l AS (
  SELECT *, row_number() OVER up AS rank,
    (total - coalesce(sum(3 * source_size) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o WINDOW up AS (ORDER BY stop, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, weight * (SELECT min_by(level, rank) FROM l WHERE stop >= level)) AS target FROM l
), c AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2),
m AS (SELECT sum(size * n)::DOUBLE AS whole, round(sum(size * n * ln(size)) / sum(size * n), 9) AS mean FROM c),
p AS (SELECT source, (size * n)::DOUBLE AS w, ln(size) - mean AS x, whole FROM c, m),
newton AS (
  SELECT 0 AS i, source, source_size, target, 0.0::DOUBLE AS slope,
    CASE WHEN target < 3 * source_size * (1 - 1e-9) THEN ln(2 * (target / source_size) / (3 - target / source_size)) END AS a
  FROM t WHERE source_size > 0
  UNION ALL
  SELECT i + 1, source, source_size, target, slope + step, a - (e + hx * step) / h FROM (
    SELECT *, -(sum(gx) OVER () + 0.3 * whole * slope - coalesce(sum(CASE WHEN a IS NOT NULL THEN hx * e / h END) OVER (), 0))
      / (coalesce(sum(CASE WHEN a IS NOT NULL THEN hxx - hx * hx / h END) OVER (), 0) + 0.3 * whole) AS step
    FROM (
      SELECT i, source, source_size, target, slope, a, whole, sum(w * r) - target AS e, sum(w * r * x) AS gx, sum(w * r * (1 - r / 3)) + 1e-12 * source_size AS h,
        sum(w * r * (1 - r / 3) * x) AS hx, sum(w * r * (1 - r / 3) * x * x) AS hxx
      FROM (
        SELECT n.*, p.w, p.x, p.whole, CASE WHEN n.a IS NULL THEN 3 ELSE 3 / (1 + 2 * exp(-(n.a + n.slope * p.x))) END::DOUBLE AS r
        FROM newton n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE n.i < 20
      ) GROUP BY i, source, source_size, target, slope, a, whole
    )
  )
), f AS (SELECT source, round(a, 9) AS a, round(slope, 9) AS slope FROM newton WHERE i = 20),
r AS (
  SELECT d.*, t.source_size, t.target,
    CASE WHEN d.size = 0 THEN 0 WHEN f.a IS NULL THEN 3 ELSE round(3 / (1 + 2 * exp(-(f.a + f.slope * (ln(greatest(d.size, 1)) - m.mean)))), 9) END::DOUBLE AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source, m
), q AS (
  SELECT *, floor(rate)::BIGINT AS parts, (('0x' || substr(h, 1, 13))::BIGINT + 0.5) / 4503599627370496.0 / nullif(rate - floor(rate), 0) AS place FROM r
), u AS (
  SELECT *, floor(target + 0.5)::BIGINT - sum(parts * size) OVER (PARTITION BY source) AS need,
    coalesce(sum(CASE WHEN rate > parts THEN size END) OVER (PARTITION BY source ORDER BY place NULLS LAST, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q
)
SELECT doc_id, size, source_size, target, (parts * size + CASE WHEN rate > parts THEN greatest(0, least(size, need - before)) ELSE 0 END)::BIGINT AS taken FROM u
"""

#: The checksum is worked out byte by byte from a table that the query makes; near words meet where they agree with a letter left out.
OP11_SPELLING = """WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
summed AS (
  SELECT run, c, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))),
    lambda s, b: xor(s >> 8, t[1 + xor(s, b) % 256])), 4294967295) END AS h FROM counted, crc
), spelt AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM summed),
w AS (SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, max(m) AS m, min_by(other, (-m, other)) AS other FROM near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM steps s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(s.root, g.n) AS root FROM steps s JOIN (SELECT word AS root, n FROM w) g USING (root) GROUP BY 1) USING (word)
"""

OP13_JACCARD_JOIN = OP10_NEAR_DEDUP.replace("len(w) - 3", "len(w) - 2").replace("w[i:i+3]", "w[i:i+2]").replace(">= 80 *", ">= 90 *").replace(""" AS component_id,
  d.doc_id = coalesce(s.component_id, d.doc_id) AS kept""", " AS component_id")

QUERIES = {"op7_mixing": OP7_MIXING, "op10_near_dedup": OP10_NEAR_DEDUP, "op11_spelling": OP11_SPELLING, "op13_jaccard_join": OP13_JACCARD_JOIN}
