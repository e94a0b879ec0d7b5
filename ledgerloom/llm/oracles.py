"""DuckDB SQL for the queries that SQL can express."""

LINE_DEDUP = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
w AS (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS p FROM l WHERE len(a) >= 3),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a[p], a[p + 1], a[p + 2] ORDER BY doc_id, p) AS rn FROM w),
c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r WHERE rn > 1),
x AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS q, unnest(a) AS line FROM l),
k AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.q) FILTER (WHERE c.q IS NULL) AS kept, count(c.q) AS n
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.q = c.q GROUP BY x.doc_id)
SELECT l.doc_id, coalesce(len(a), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
       CASE WHEN l.text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""

DECONTAMINATE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(a), 10) AS n, array_to_string(list_slice(a, p, p + 9), ' ') AS k
       FROM (SELECT item_id, a, unnest(range(1, greatest(len(a) - 9, 1) + 1)) AS p FROM b WHERE len(a) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(a, p, p + n - 1), ' ') AS k
       FROM (SELECT doc_id, a, n, unnest(range(1, len(a) - n + 2)) AS p FROM d, sizes WHERE len(a) >= n)),
m AS (SELECT doc_id, item_id, p, bw.n FROM dw JOIN bw USING (k) WHERE dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(a), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
""".replace("lower(text)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS a FROM documents),
w AS (SELECT doc_id, a, unnest(range(1, len(a) - 48)) AS p FROM d WHERE len(a) >= 50),
k AS (SELECT doc_id, p, array_to_string(list_slice(a, p, p + 49), ' ') AS k FROM w),
r AS (SELECT doc_id, p, doc_id > min(doc_id) OVER (PARTITION BY k) AS again FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM r WHERE again),
x AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS q, unnest(a) AS word FROM d),
t AS (SELECT x.doc_id, count(c.q) AS n, string_agg(word, ' ' ORDER BY x.q) FILTER (WHERE c.q IS NULL) AS kept
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.q = c.q GROUP BY x.doc_id)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

EXACT_TOP_K = """
WITH v AS (SELECT vec_id, [x > 0 FOR x IN embedding] AS c FROM embeddings WHERE len(embedding) > 0),
d AS (SELECT q.vec_id, v.vec_id AS neighbor_id, list_sum([(z[1] <> z[2])::BIGINT FOR z IN list_zip(q.c, v.c)]) AS distance
      FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, rank, neighbor_id, distance::BIGINT AS distance FROM r WHERE rank <= 10
"""

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM t WINDOW w AS (PARTITION BY k)
"""

RANKED_SEARCH = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS q FROM i GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
p AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // words AS m FROM n, a),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20
"""


def _vector_codes(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """A table expression for each round: entries, then who is nearest to which; the width of a part follows the vectors."""
    nearest = """a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, arg_min(e, d * 1000 + e) AS e, min(d) AS d
    FROM (SELECT vec_id, v.p, v.x, c.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.x, c.x)])::BIGINT AS d FROM v JOIN c{k} AS c USING (p)) GROUP BY vec_id, p)"""
    means = """c{n} AS MATERIALIZED (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{k} AS c LEFT JOIN
    (SELECT p, e, list(s ORDER BY j) AS x FROM (SELECT p, e, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS s FROM a{k}, (SELECT unnest(range(1, width + 1)) AS j FROM size) GROUP BY p, e, j) GROUP BY p, e) AS m USING (p, e))"""
    steps = [nearest.format(k=0)]
    for k in range(rounds):
        steps += [means.format(k=k, n=k + 1), nearest.format(k=k + 1)]
    between = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS y FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
size AS (SELECT greatest(1, ceil(max(len(y)) / {parts}))::BIGINT AS width FROM kept),
v AS MATERIALIZED (SELECT vec_id, p, list_resize(y, {parts} * width, 0)[p * width + 1 : (p + 1) * width] AS x FROM kept, size, (SELECT unnest(range({parts})) AS p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}),
c0 AS MATERIALIZED (SELECT p, e, x FROM v JOIN f USING (vec_id)),
{between},
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM r JOIN kept USING (vec_id), s
"""


VECTOR_CODES = _vector_codes()

ORACLES = {"op1_line_dedup": LINE_DEDUP, "op3_substring_dedup": SUBSTRING_DEDUP, "op7_decontaminate": DECONTAMINATE, "op9_exact_top_k": EXACT_TOP_K, "op11_vector_codes": VECTOR_CODES, "op12_exact_dedup": EXACT_DEDUP, "op13_ranked_search": RANKED_SEARCH}
