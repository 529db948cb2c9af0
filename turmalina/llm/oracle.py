"""DuckDB counterparts of the queries whose contract SQL can express."""

ORACLE = {}

# Links by all pairs of documents that share a shingle, components by walking the links.
ORACLE["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (
    SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b
    WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (
    SELECT a, b FROM both_ways
    UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (
    SELECT reach.a AS r, min(words.doc_id) AS least FROM reach JOIN words ON words.r = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""

# Every window of every size that an item has, against every window of that size of a document.
ORACLE["op7_benchmark_decontamination"] = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id, w, least(len(w), 10) AS k
    FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
    WHERE len(w) > 0),
item_windows AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
doc_windows AS (
    SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM words, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
hits AS (SELECT r, i, k, item_id FROM doc_windows JOIN item_windows USING (k, s)),
marks AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
names AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(marks.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(names.n, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(marks.n, 0) > 0 AS contaminated
FROM words LEFT JOIN marks USING (r) LEFT JOIN names USING (r)
"""

# Sources by cap per weight: one is clamped as long as its cap is below the level.
ORACLE["op13_source_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source),
levels AS (
    SELECT *, 3 * source_size <= weight * (
               CAST(sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER earlier, 0) AS DOUBLE)
               / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS DOUBLE)) AS clamped
    FROM sources
    WINDOW earlier AS (ORDER BY 3 * source_size / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
    SELECT CAST(sum(source_size) - coalesce(sum(3 * source_size) FILTER (clamped), 0) AS DOUBLE)
           / CAST(sum(weight) FILTER (NOT clamped) AS DOUBLE) AS level
    FROM levels),
goals AS (
    SELECT source, source_size, CASE WHEN clamped THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target
    FROM levels, water),
shares AS (
    SELECT d.doc_id, d.size, g.source_size, g.target,
           CASE WHEN g.source_size > 0 THEN CAST(floor(target) AS BIGINT) // g.source_size ELSE 0 END AS whole,
           CASE WHEN g.source_size > 0 THEN CAST(floor(target) AS BIGINT) % g.source_size ELSE 0 END AS rest,
           sum(d.size) OVER (PARTITION BY d.source, d.draw) AS held,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE UNBOUNDED PRECEDING) AS upto
    FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
parts AS (
    SELECT *, CAST(CASE WHEN size = 0 OR rest <= upto - held THEN 0 WHEN upto <= rest THEN size
                        ELSE size * (rest - (upto - held)) // held END AS BIGINT) AS part
    FROM shares)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
       CAST(whole AS BIGINT) AS whole, part
FROM parts
"""
