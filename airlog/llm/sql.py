"""SQL of the corpus queries that is too long to stand beside them."""

#: crcs(s, crc): the unsigned CRC-32 of the UTF-8 bytes of each row of a table strings(s). The checksum is linear, so it is the
#: exclusive or of what every byte gives at its distance from the end and of what the starting value gives.
CRC = """
bits AS (SELECT b, b AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
bytes AS (SELECT b, c FROM bits WHERE k = 8),
coded AS (SELECT s, hex(encode(s)) AS h, length(hex(encode(s))) // 2 AS n FROM strings),
shifted AS (
  SELECT b, c, 0 AS d FROM (SELECT b::BIGINT AS b, c::BIGINT AS c FROM bytes UNION ALL SELECT -1, 4294967295)
  UNION ALL SELECT s.b, xor(s.c >> 8, y.c), d + 1 FROM shifted s JOIN bytes y ON y.b = s.c & 255
  WHERE d < (SELECT coalesce(max(n), 0) FROM coded)),
single AS (
  SELECT s, n, ('0x' || substr(h, 2 * j + 1, 2))::BIGINT AS b, n - 1 - j AS d FROM (SELECT *, unnest(range(n)) AS j FROM coded)
  UNION ALL SELECT s, n, -1, n FROM coded),
crcs AS (SELECT s, xor(bit_xor(f.c), 4294967295) AS crc FROM single JOIN shifted f USING (b, d) GROUP BY s)
"""

IMPORTANCE = r"""
WITH RECURSIVE texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, row, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS nth FROM (
    SELECT side, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts)),
runs AS (
  SELECT side, row, word AS s FROM words
  UNION ALL SELECT side, row, word || ' ' || follower FROM (
    SELECT *, lead(word) OVER (PARTITION BY side, row ORDER BY nth) AS follower FROM words) WHERE follower IS NOT NULL),
strings AS (SELECT DISTINCT s FROM runs),
""" + CRC + r""",
bucketed AS (SELECT side, row, crc % 10000 AS bucket, count(*) AS n FROM runs JOIN crcs USING (s) GROUP BY ALL),
counts AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t
  FROM range(10000) b(bucket) LEFT JOIN bucketed USING (bucket) GROUP BY b.bucket),
totals AS (SELECT sum(s)::BIGINT AS ss, sum(t)::BIGINT AS tt FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts, totals),
weighed AS (
  SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM bucketed JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
lengths AS (SELECT row, count(*) AS n_words FROM words WHERE side = 0 GROUP BY row),
scored AS (
  SELECT t.row, t.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(n_words, 0) AS n_words,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(t.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts t LEFT JOIN weighed USING (row) LEFT JOIN lengths USING (row) WHERE t.side = 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_words, n_features) AS place,
         count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ordered
"""

PREFIX_TRIE = r"""
WITH RECURSIVE strings AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, '') AS s FROM conversations),
""" + CRC + r""",
turns AS (
  SELECT conv_id, turn, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations),
own AS (
  SELECT conv_id, list({'key': sha256(said), 'words': words} ORDER BY turn NULLS FIRST, base64(unhex(sha256(said)[1:30]))) AS turns FROM turns
  GROUP BY conv_id),
paths AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:(c.crc % 4)], []), o.turns[(c.crc % 4) + 1:]) AS turns
  FROM own o JOIN crcs c ON c.s = coalesce(o.conv_id::VARCHAR, '') LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
members AS (
  SELECT conv_id, d AS depth, len(turns) AS turns, list_transform(turns[1:d], lambda t: t.key) AS node,
         CASE WHEN d > 0 THEN list_transform(turns[1:(d - 1)], lambda t: t.key) END AS parent,
         CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS words
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(coalesce(conv_id::VARCHAR, ''), ',' ORDER BY conv_id NULLS LAST) FILTER (turns = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)),
below AS (
  SELECT node[1:a] AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved_tokens, c.ends_sha256
FROM counted c JOIN below b USING (node) LEFT JOIN nodes p ON p.node = c.parent
"""

SIMILAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS component FROM v UNION SELECT l.b, r.component FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(component) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON l.node = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""
