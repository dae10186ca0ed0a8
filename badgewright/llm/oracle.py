"""SQL for the operators that SQL can express: DuckDB over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, i, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split)
), repeated AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING min(doc_id) <> max(doc_id)
), judged AS (
  SELECT lines.*, coalesce(repeated.first <> lines.doc_id, false) AS dropped FROM lines LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)
), repeated AS (
  SELECT key FROM windows GROUP BY key HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN repeated USING (key)
), words AS (
  SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM (
    SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
    FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM patterns
), windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM docs, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, i, size, item_id FROM windows JOIN patterns USING (size, key)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found)
  GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN own USING (doc_id)
"""

LEXICAL_SEARCH = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), lengths AS (
  SELECT r, doc_id, len(w) AS n FROM docs WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), found AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM found GROUP BY term), totals
), scores AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN found USING (term) JOIN lengths USING (r), totals
  GROUP BY item_id, doc_id, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""

# DuckDB has no CRC-32: its table of bytes and its loop are spelt out, once per distinct feature.
RESAMPLING = rf"""
WITH crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), texts AS (
  SELECT true AS of_corpus, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT of_corpus, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT of_corpus, r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS feature FROM words
), distinct_runs AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs)
), buckets AS (
  SELECT feature, xor(list_reduce(
      list_concat([4294967295], [CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT) for k in range(len(h) // 2)]),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM distinct_runs, crc_table
), counted AS (
  SELECT of_corpus, r, bucket, count(*) AS n FROM runs JOIN buckets USING (feature) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(n) FILTER (of_corpus), 0) AS s_all, coalesce(sum(n) FILTER (NOT of_corpus), 0) AS t_all FROM counted
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)
                                      / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (of_corpus), 0) AS s, coalesce(sum(n) FILTER (NOT of_corpus), 0) AS t
        FROM counted GROUP BY bucket), totals
), weights AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM counted JOIN gains USING (bucket) WHERE of_corpus GROUP BY r
), scored AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST(CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (r) WHERE of_corpus
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""

ORACLE = {
    "op5_line_dedup": LINE_DEDUP,
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op9_decontamination": DECONTAMINATION,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op12_resampling": RESAMPLING,
}
