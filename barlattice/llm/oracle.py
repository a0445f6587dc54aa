"""DuckDB SQL for the numbered queries that SQL can say; plain all-pairs or all-windows versions."""

#: Vectors that take part: no null, NaN or infinite component, and not all zero.
VALID = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

OP1 = f"""WITH {VALID}, p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

OP3 = f"""WITH RECURSIVE {VALID}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c(node, component) AS (SELECT a, a FROM n UNION SELECT l.b, c.component FROM c JOIN l ON l.a = c.node WHERE c.component < l.b), m AS (SELECT node, min(component) AS component FROM c GROUP BY node)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.component, e.vec_id) AS component_id, e.vec_id = coalesce(m.component, e.vec_id) AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.node = e.vec_id"""

OP8 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
b AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 20 THEN 0 ELSE 1 END AS fresh FROM r)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 20 AS z FROM b GROUP BY doc_id, n),
k AS (SELECT p.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY p.doc_id ORDER BY a), 1) AS before FROM p),
t AS (SELECT k.doc_id, sum(z - a) AS removed, max(z) AS tail, string_agg(array_to_string(w[before:a - 1], ' '), ' ' ORDER BY a) FILTER (a > before) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN removed IS NULL THEN array_to_string(w, ' ') ELSE concat_ws(' ', kept, nullif(array_to_string(w[tail:], ' '), '')) END) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

OP9 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM s) WHERE doc_id > first_doc),
b AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM r)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM b GROUP BY doc_id, n),
k AS (SELECT p.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY p.doc_id ORDER BY a), 0) AS before FROM p),
t AS (SELECT k.doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

OP6 = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('6:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS held FROM d GROUP BY source), s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS party FROM s0),
s2 AS (SELECT *, CAST((party - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, party ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
lv AS (SELECT arg_min(level, (cap / weight, party)) FILTER (level * weight <= cap) AS level FROM s3), t AS (SELECT party, source, source_size, held, least(lv.level * weight, cap) AS target FROM s3, lv),
u AS (SELECT CAST(greatest(1, least(64, floor(min(target) FILTER (target > 0) / 16))) AS BIGINT) AS unit FROM t), n AS (SELECT CAST(round(sum(target) / any_value(unit)) AS BIGINT) AS blocks FROM t, u), q AS (SELECT party, i, target / (2 * i + 1) AS quotient FROM (SELECT party, target, unnest(range(0, (SELECT blocks FROM n))) AS i FROM t WHERE target > 0)),
w AS (SELECT party, count(*) AS quota FROM (SELECT party FROM q ORDER BY quotient DESC, party, i LIMIT (SELECT blocks FROM n)) GROUP BY party),
t2 AS (SELECT t.*, coalesce(quota, 0) AS quota, CAST(greatest(1, ceil(source_size / greatest(1000000, ceil(sum(source_size) OVER () / 100000))), ceil(held / 100000)) AS BIGINT) AS shards FROM t LEFT JOIN w USING (party)),
e AS (SELECT d.doc_id, d.size, d.key, t2.*, CAST('0x' || left(d.key, 8) AS BIGINT) % shards AS shard FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source),
h AS (SELECT party, shard, sum(size) AS words, any_value(quota) AS quota FROM e GROUP BY 1, 2), hq AS (SELECT *, words / (2 * i + 1) AS quotient FROM (SELECT *, unnest(range(0, quota)) AS i FROM h WHERE words > 0)),
hr AS (SELECT party, shard, quota, row_number() OVER (PARTITION BY party ORDER BY quotient DESC, shard, i) AS rank FROM hq), hw AS (SELECT party, shard, count(*) AS seats FROM hr WHERE rank <= quota GROUP BY 1, 2),
g AS (SELECT e.*, h.words, least(coalesce(seats, 0) * u.unit, 3 * h.words) AS take, sum(e.size) OVER (PARTITION BY e.party, e.shard ORDER BY key, doc_id) - e.size AS before FROM e CROSS JOIN u JOIN h ON h.party = e.party AND h.shard = e.shard LEFT JOIN hw ON hw.party = e.party AND hw.shard = e.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN words > 0 THEN take // words ELSE 0 END * size + least(greatest(take - CASE WHEN words > 0 THEN take // words ELSE 0 END * words - before, 0), size) AS BIGINT) AS taken FROM g"""
