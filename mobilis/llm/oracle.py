"""DuckDB SQL for the operators that SQL can express."""

ORACLE_SQL = {}

ORACLE_SQL["op1_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id
), m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated USING (doc_id)
), j AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > word_chars
          OR (n_lines > 0 AND n_dup_lines / n_lines > 3 / 10)) AS failed
  FROM m
), h AS (
  SELECT host, count(*) AS n, count_if(failed) AS f FROM j GROUP BY host
), p AS (
  SELECT sum(f) / sum(n) AS m, var_samp(f / n) AS v FROM h
), q AS (
  SELECT m, greatest(2.0, least(1000.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS w FROM p
), verdict AS (
  SELECT host, (f + m * w) / (n + w) > 0.5 AS rejected FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT rejected) AS kept
FROM j JOIN verdict ON j.host IS NOT DISTINCT FROM verdict.host
"""

ORACLE_SQL["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL["op2_minhash_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 80 * (ca.n + cb.n - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), root AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM root LEFT JOIN c USING (doc_id)
"""

ORACLE_SQL["op11_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM p
)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM r
"""

ORACLE_SQL["op13_collocations"] = r"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents)
), q AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), w AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS d, ws FROM q WHERE len(ws) > 0
), o AS MATERIALIZED (
  SELECT lang, d, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), x AS MATERIALIZED (
  SELECT lang, word AS w1, lead(word, 1) OVER s AS w2, lead(word, 2) OVER s AS w3, lead(word, 3) OVER s AS w4
  FROM o WINDOW s AS (PARTITION BY d ORDER BY i)
), f AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, w1, '' AS w2, '' AS w3, '' AS w4, count(*) AS a FROM x GROUP BY ALL
  UNION ALL
  SELECT lang, 2, w1 || ' ' || w2, w1, w2, '', '', count(*) FROM x WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, '', count(*) FROM x WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, w1, w2, w3, w4, count(*) FROM x WHERE w4 IS NOT NULL GROUP BY ALL
), n AS MATERIALIZED (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT * FROM f WHERE k > 1 AND a >= 30
), parts AS MATERIALIZED (
  SELECT lang, phrase, k, a, 1 AS j, w1 AS head, ltrim(w2 || ' ' || w3 || ' ' || w4) AS tail FROM c
  UNION ALL
  SELECT lang, phrase, k, a, 2, w1 || ' ' || w2, w3 || ' ' || w4 FROM c WHERE k > 2
  UNION ALL
  SELECT lang, phrase, k, a, 3, w1 || ' ' || w2 || ' ' || w3, w4 FROM c WHERE k > 3
), cut AS MATERIALIZED (
  SELECT t.lang, t.phrase, t.k, t.a, t.j, x.a AS l, y.a AS r, (2000000::HUGEINT * t.a // (x.a + y.a))::BIGINT AS score
  FROM parts t JOIN f x ON x.lang = t.lang AND x.phrase = t.head JOIN f y ON y.lang = t.lang AND y.phrase = rtrim(t.tail, ' ')
), lowest AS MATERIALIZED (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), part AS MATERIALIZED (
  SELECT lang, a, unnest([w1 || ' ' || w2, w2 || ' ' || w3]) AS phrase FROM c WHERE k = 3
  UNION ALL
  SELECT lang, a, unnest([w1 || ' ' || w2, w2 || ' ' || w3, w3 || ' ' || w4, w1 || ' ' || w2 || ' ' || w3, w2 || ' ' || w3 || ' ' || w4])
  FROM c WHERE k = 4
), longer AS MATERIALIZED (
  SELECT lang, phrase, max(a) AS a FROM part GROUP BY lang, phrase
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT o.lang, o.phrase, o.a, o.l, o.r, n.n, o.score,
             row_number() OVER (PARTITION BY o.lang ORDER BY o.score DESC, o.a DESC, o.phrase) AS rank
      FROM lowest o JOIN n USING (lang) LEFT JOIN longer g ON g.lang = o.lang AND g.phrase = o.phrase
      WHERE g.a IS NULL OR 100::HUGEINT * g.a < 80::HUGEINT * o.a)
WHERE rank <= 2000
"""
