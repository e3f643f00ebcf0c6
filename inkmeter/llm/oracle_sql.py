"""DuckDB SQL of the operators that SQL can express, each written on its own from the operator's definition."""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
                  sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d, n HAVING count(*) > 1)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.keeper IS NULL OR g.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.keeper <> p.page_id THEN g.keeper END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n"""

# Every window of the item's size that starts at a shared shingle (or ends with the document), compared exactly.
OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
      FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, n, k, sh, count(*) AS c FROM
         (SELECT item_id, n, k, unnest(list_transform(range(1, n - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS sh
          FROM i) GROUP BY ALL),
ds AS (SELECT doc_id, k, len(w) AS nw, unnest(range(0, len(w) - k + 1)) AS pos,
              unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS sh
       FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
hits AS (SELECT DISTINCT ds.doc_id, ds.nw, bs.item_id, bs.n, bs.k,
                greatest(0, least(ds.pos, ds.nw - bs.n)) AS s FROM ds JOIN bs ON ds.sh = bs.sh AND ds.k = bs.k),
win AS (SELECT h.doc_id, h.item_id, h.n, h.k, h.nw, h.s, ds.sh, count(*) AS c
        FROM hits h JOIN ds ON ds.doc_id = h.doc_id AND ds.k = h.k AND ds.pos BETWEEN h.s AND h.s + h.n - h.k
        GROUP BY ALL),
shared AS (SELECT w.doc_id, w.item_id, w.n, w.k, w.nw, w.s, sum(least(w.c, bs.c)) AS m
           FROM win w JOIN bs ON bs.item_id = w.item_id AND bs.sh = w.sh GROUP BY ALL),
sim AS (SELECT doc_id, item_id, n, s,
               m / ((least(n, nw) - k + 1) + (n - k + 1) - m) AS similarity FROM shared)
SELECT doc_id, item_id, CAST(max(similarity) AS DOUBLE) AS similarity,
       CAST(arg_max(s, similarity * 1000000 - s / 1000000.0) AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words
FROM sim WHERE similarity >= 0.8 GROUP BY doc_id, item_id, n"""

OP3 = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce('=' || source, '?') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         CAST('0x' || substr(md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR), text)), 1, 8) AS BIGINT) % 256 AS block
  FROM documents),
parts AS (SELECT src, block, CAST(sum(n_tokens) AS BIGINT) AS size FROM r GROUP BY src, block),
totals AS (SELECT src, CAST(sum(size) AS BIGINT) AS tokens FROM parts GROUP BY src HAVING sum(size) > 0),
shares AS (SELECT src, tokens, tokens / CAST((SELECT sum(tokens) FROM totals) AS DOUBLE) AS p FROM totals),
ends AS (SELECT min(p) AS p0, max(p) AS p1 FROM shares),
bis(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1,
         CASE WHEN pow(p0, (lo + hi) / 2 - 1) / pow(p1, (lo + hi) / 2 - 1) > 1.5 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(p0, (lo + hi) / 2 - 1) / pow(p1, (lo + hi) / 2 - 1) > 1.5 THEN hi ELSE (lo + hi) / 2 END
  FROM bis, ends WHERE step < 60),
a AS (SELECT round(hi, 9) AS a FROM bis WHERE step = 60),
w AS (SELECT src, tokens, pow(p, a) / sum(pow(p, a)) OVER () AS weight FROM shares, a),
q AS (SELECT src, tokens, weight * (SELECT max(tokens / weight) FROM w) AS quota FROM w),
f AS (SELECT *, CAST(floor(quota / tokens + 1e-9) AS BIGINT) AS whole FROM q),
passes AS (SELECT src, tokens, quota, whole, unnest(range(0, whole + 1)) AS epoch FROM f),
turns AS (SELECT p.*, parts.block, parts.size,
                 sum(size) OVER (PARTITION BY p.src, epoch ORDER BY
                   md5(concat_ws('|', 'mix-1', p.src, CAST(epoch AS VARCHAR), CAST(block AS VARCHAR)))
                   ROWS UNBOUNDED PRECEDING) AS upto
          FROM passes p JOIN parts ON p.src = parts.src),
chosen AS (SELECT src, block, epoch,
                  round(least((epoch * tokens + upto - size / 2) / quota, 1.0), 9) AS mix_key
           FROM turns WHERE epoch < whole OR upto <= quota - whole * tokens + 1e-6
           UNION ALL
           SELECT src, block, 0, 0.0 FROM parts WHERE src NOT IN (SELECT src FROM totals))
SELECT r.doc_id, r.source, r.n_tokens, c.epoch, r.block, CAST(c.mix_key AS DOUBLE) AS mix_key
FROM r JOIN chosen c ON r.src = c.src AND r.block = c.block"""

# Windows of the bytes, repeated ones merged into runs, the rest put together again (as hexadecimal digits).
OP10 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n
           FROM documents),
win AS (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200),
keyed AS (SELECT doc_id, i, md5(x[i + 1:i + 200]) AS k FROM win),
dup AS (SELECT doc_id, i FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new
           FROM dup),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT d.doc_id, d.x, r.a AS b, coalesce(lag(r.b) OVER (PARTITION BY d.doc_id ORDER BY r.a), 0) AS a
         FROM d JOIN runs r ON d.doc_id = r.doc_id
         UNION ALL
         SELECT d.doc_id, d.x, d.n, coalesce(m.b, 0) FROM d LEFT JOIN
           (SELECT doc_id, max(b) AS b FROM runs GROUP BY doc_id) m ON d.doc_id = m.doc_id),
rest AS (SELECT doc_id, string_agg(CASE WHEN b > a THEN hex(x[a + 1:b]) ELSE '' END, '' ORDER BY a) AS x FROM gaps GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(g.removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(g.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(rest.x)) AS kept_sha256
FROM d JOIN rest ON d.doc_id = rest.doc_id LEFT JOIN gone g ON d.doc_id = g.doc_id"""

# crc32 a byte at a time over its table; near words by deleting one letter of each, at the same place or on one side only.
OP11 = r"""
WITH tab AS (SELECT list(list_reduce([i::UBIGINT, 1, 1, 1, 1, 1, 1, 1, 1],
          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t
        FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents WHERE text IS NOT NULL)
         WHERE length(r) >= 6 GROUP BY 1, 2),
bytes AS (SELECT *, hex(encode(concat(coalesce(doc_id::VARCHAR, ''), ':', run))) AS hx FROM runs),
hashed AS (SELECT doc_id, run, c, xor(list_reduce(
             list_prepend(4294967295::UBIGINT, list_transform(range(0, length(hx) // 2),
               lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::UBIGINT)),
             lambda h, b: xor(h >> 8, t[((xor(h, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM bytes, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                    ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
          FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
         FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
         UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
         UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
         FROM near GROUP BY word),
named AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form,
                 CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (WITH RECURSIVE r AS (SELECT word, word AS at FROM named
           UNION ALL SELECT r.word, named.form FROM r JOIN named ON named.word = r.at WHERE named.form IS NOT NULL)
         SELECT r.word, r.at AS root FROM r JOIN named ON named.word = r.at AND named.form IS NULL)
SELECT named.word, n, n_near, form, form_n, root FROM named JOIN walk ON named.word = walk.word"""

# Every pair of sets that share a shingle is counted; components by the smallest id that is reached.
OP12 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')))) END AS sh
      FROM d),
c AS (SELECT md5(array_to_string(sh, chr(10))) AS k, any_value(sh) AS sh, any_value(len(sh)) AS n, min(doc_id) AS first
      FROM s WHERE len(sh) > 0 GROUP BY 1),
x AS (SELECT k, n, unnest(sh) AS v FROM c),
links AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.v = b.v AND a.k <> b.k
          GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT c.k, least(min(c.first), min(o.first)) AS component_id
         FROM c LEFT JOIN reach ON c.k = reach.a LEFT JOIN c o ON o.k = reach.b GROUP BY c.k)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles,
       CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE comp.component_id END AS component_id,
       coalesce(CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE comp.component_id END = s.doc_id, false) AS kept
FROM s LEFT JOIN comp ON comp.k = md5(array_to_string(s.sh, chr(10))) AND len(s.sh) > 0"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS i, item_id,
             list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT i, item_id, unnest(w) AS t FROM b),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d)
       WHERE t IN (SELECT t FROM q) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t),
scored AS (SELECT q.i, q.item_id, tf.r, tf.doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))))::BIGINT AS score
           FROM q JOIN tf ON q.t = tf.t JOIN wt ON wt.t = tf.t, c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0) WHERE rank <= 50"""

SQL = {"op11_spelling_variants": OP11, "op12_minhash": OP12, "op13_lexical_search": OP13, "op3_mixing": OP3, "op8_decontamination": OP8, "op9_warc": OP9, "op10_suffix_dedup": OP10}
