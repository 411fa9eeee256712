"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from frameloom.llm import license_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, i AS place, parts[i] AS line, trim(translate(parts[i], '{UPPER}', '{LOWER}'), {BLANKS}) AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS u(i)
), repeated AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, CAST(count(r.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN repeated r USING (key) GROUP BY doc_id
"""


OP5 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS h FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)] END) AS s FROM split)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL
  ) p JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 100 * p.k >= 75 * (s.n + t.n - p.k)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) l ON l.a = d.doc_id
"""

OP7 = """
WITH usable AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_RUNS = ", ".join(
    f"({n}, '{label}', {str(exact).lower()}, {j}, {len(w) - license_scan.K + 1}, '{w[j]}', '{w[j + 1]}', '{w[j + 2]}')"
    for n, (text, label, exact) in enumerate(license_scan.TEMPLATES)
    for w in [text.split()]
    for j in range(len(w) - license_scan.K + 1)
)
OP9 = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents
), runs(template, label, exact, place, n_runs, t0, t1, t2) AS (VALUES {_RUNS}
), words AS (
  SELECT doc_id, i - 1 AS i, w[i] AS w0, w[i + 1] AS w1, w[i + 2] AS w2 FROM split, unnest(range(1, len(w) - 1)) AS u(i)
), hits AS (
  SELECT doc_id, template, label, exact, n_runs, i, place FROM words JOIN runs ON w0 = t0 AND w1 = t1 AND w2 = t2
), phrases AS (
  SELECT doc_id, label, i - place AS start FROM hits WHERE exact GROUP BY doc_id, template, label, n_runs, i - place HAVING count(*) = n_runs
), marked AS (
  SELECT *, CASE WHEN i - place - lag(i - place) OVER (PARTITION BY doc_id, template ORDER BY i - place) > {license_scan.SLACK} THEN 1 ELSE 0 END AS new FROM hits WHERE NOT exact
), merged AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY i - place) AS cluster FROM marked
), candidates AS (
  SELECT doc_id, template, label, n_runs, cluster, i, place FROM merged
  WHERE (doc_id, template, cluster) IN (SELECT (doc_id, template, cluster) FROM merged GROUP BY doc_id, template, cluster, n_runs HAVING count(DISTINCT place) >= {license_scan.COVERAGE} * n_runs)
), chains(doc_id, template, label, n_runs, cluster, i, place, n, first) AS (
  SELECT doc_id, template, label, n_runs, cluster, i, place, 1, i FROM candidates
  UNION
  SELECT c.doc_id, c.template, c.label, c.n_runs, c.cluster, h.i, h.place, c.n + 1, c.first
  FROM chains c JOIN candidates h ON h.doc_id = c.doc_id AND h.template = c.template AND h.cluster = c.cluster
  WHERE h.i > c.i AND h.place > c.place AND abs((h.i - h.place) - (c.i - c.place)) <= {license_scan.SLACK}
), spans AS (
  SELECT doc_id, template, label, n::DOUBLE / n_runs AS share, first AS start, i + {license_scan.K} AS stop
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, template, cluster ORDER BY n DESC, first, i) AS r FROM chains) WHERE r = 1 AND n::DOUBLE / n_runs >= {license_scan.COVERAGE}
), notices AS (
  SELECT doc_id, label, share FROM spans a WHERE NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.label <> a.label AND b.share > a.share AND a.start >= b.start AND a.stop <= b.stop)
), every AS (
  SELECT doc_id, label, start, true AS exact, 1.0::DOUBLE AS share FROM phrases
  UNION ALL SELECT doc_id, label, NULL, false, share FROM notices
), per_doc AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) AS first_word, max(start) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM every GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM split LEFT JOIN per_doc USING (doc_id)
"""

OP12 = rf"""
WITH numbered AS (
  SELECT row_number() OVER () AS d, doc_id, text FROM documents
), words AS (
  SELECT d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM numbered
), postings AS (
  SELECT d, t, count(*) AS tf FROM words GROUP BY d, t
), lengths AS (
  SELECT d, count(*) AS n FROM words GROUP BY d
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY t, docs
), asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), scored AS (
  SELECT i, item_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t) JOIN lengths USING (d), whole GROUP BY i, item_id, d
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN numbered USING (d) WHERE score > 0)
WHERE rank <= 10
"""

OP13 = r"""
WITH RECURSIVE placed AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS place,
    md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS content, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), crc(c, digits, i, x) AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR), 0, 4294967295::BIGINT FROM placed
  UNION ALL
  SELECT c, digits, i + 1, CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(x, ascii(digits[i // 8 + 1])::BIGINT) ELSE x END AS y FROM crc WHERE i < 8 * len(digits))
), convs AS (
  SELECT c, c - c % 20 AS base, xor(x, 4294967295::BIGINT) % 4 AS h, (SELECT count(*) FROM placed p WHERE p.c = crc.c - crc.c % 20) AS n_base
  FROM crc WHERE i = 8 * len(digits)
), steps AS (
  SELECT v.c, place AS depth, content, words FROM convs v JOIN placed p ON p.c = v.base AND place <= h
  UNION ALL SELECT v.c, place - h + least(h, n_base), content, words FROM convs v JOIN placed p ON p.c = v.c AND place > h
), named AS (
  SELECT c, depth, words, string_agg(content, '') OVER (PARTITION BY c ORDER BY depth) AS node,
    coalesce(string_agg(content, '') OVER (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent FROM steps
  UNION ALL SELECT c, 0, 0, '', NULL FROM convs
), nodes AS (
  SELECT node, min(parent) AS parent, min(depth) AS depth, count(*) AS n_convs, min(c) AS conv_id, (count(*) - 1) * min(words) AS saved FROM named GROUP BY node
), children AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT a.node, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved
  FROM nodes w LEFT JOIN children k ON k.node = w.node JOIN named a ON a.c = w.conv_id AND a.depth <= w.depth GROUP BY a.node
), ends AS (
  SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM (SELECT c, max_by(node, depth) AS node FROM named GROUP BY c) GROUP BY node
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes v LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN children k ON k.node = v.node JOIN below b ON b.node = v.node LEFT JOIN ends e ON e.node = v.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op5_jaccard_join": OP5, "op7_topk_search": OP7, "op9_license_scan": OP9, "op12_ranked_search": OP12, "op13_prefix_trie": OP13}
