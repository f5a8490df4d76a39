"""DuckDB SQL with the rows of those llm queries that SQL can express."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS key FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank, 3 * source_size AS lim FROM sizes
), weighed AS (
  SELECT *, 1 + (source_rank - 1) % 3 AS weight, lim::DOUBLE / (1 + (source_rank - 1) % 3) AS ratio FROM ranked
), filled AS (
  SELECT *, (sum(source_size) OVER ()
      - coalesce(sum(lim) OVER (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY ratio, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), sources AS (
  SELECT source, source_rank, source_size, n_docs,
    coalesce(least(lim::DOUBLE, weight * (SELECT level FROM filled WHERE level <= ratio ORDER BY ratio, source_rank LIMIT 1)), 0.0) AS target
  FROM filled
), claims AS (
  SELECT source_rank, target / (2 * k + 1) AS q
  FROM (SELECT source_rank, target, unnest(range(0, floor(target / 16)::BIGINT + (SELECT count(*) FROM sources) + 3)) AS k FROM sources) WHERE target > 0
), seats AS (
  SELECT source_rank, count(*) AS seats FROM (SELECT source_rank, row_number() OVER (ORDER BY q DESC, source_rank) AS r FROM claims)
  WHERE r <= (SELECT floor(sum(source_size) / 16 + 0.5) FROM sources) GROUP BY source_rank
), dealt AS (
  SELECT d.doc_id, d.size, d.key, s.source_rank, s.source_size, s.target, coalesce(seats, 0) AS seats,
    ('0x' || substr(d.key, 1, 8))::BIGINT % ceil(n_docs / 4096.0)::BIGINT AS shard
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN seats USING (source_rank)
), shards AS (
  SELECT source_rank, shard, sum(size)::BIGINT AS shard_size, any_value(seats) AS seats,
    CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(size)::BIGINT / any_value(source_size) ELSE 0.0 END AS share
  FROM dealt GROUP BY source_rank, shard
), shard_claims AS (
  SELECT source_rank, shard, seats, share / (2 * k + 1) AS q
  FROM (SELECT *, unnest(range(0, floor(share / 16)::BIGINT + (SELECT count(*) FROM shards) + 3)) AS k FROM shards) WHERE share > 0
), quota AS (
  SELECT source_rank, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY q DESC, shard) AS r FROM shard_claims) WHERE r <= seats GROUP BY source_rank, shard
), placed AS (
  SELECT d.*, shard_size, coalesce(quota, 0)::BIGINT AS quota,
    sum(size) OVER (PARTITION BY source_rank, shard ORDER BY d.key, size, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM dealt d JOIN shards USING (source_rank, shard) LEFT JOIN quota USING (source_rank, shard)
), quotas AS (
  SELECT *, stop - size AS start, ceil(shard_size / 16.0)::BIGINT AS blocks FROM placed
), passed AS (
  SELECT *, CASE WHEN shard_size > 0 THEN least(3, (quota * 16) // shard_size) ELSE 0 END AS passes FROM quotas
), rested AS (
  SELECT *, CASE WHEN passes >= 3 THEN 0 ELSE floor((quota * 16 - passes * shard_size) / 16.0 + 0.5)::BIGINT END AS rest,
    CASE WHEN blocks % 1000003 = 0 THEN 998244353 ELSE 1000003 END AS step,
    ('0x' || substr(md5('7:' || source_rank || ':' || shard), 1, 8))::BIGINT AS offs FROM passed
)
SELECT doc_id, size, source_size, target,
  (passes * size + CASE WHEN size > 0 AND rest > 0 THEN coalesce(list_sum(list_transform(range(start // 16, (stop - 1) // 16 + 1),
    lambda j: CASE WHEN (step * j + offs) % greatest(blocks, 1) < rest THEN least(stop, (j + 1) * 16) - greatest(start, j * 16) ELSE 0 END)), 0) ELSE 0 END)::BIGINT AS taken,
  passes::BIGINT AS passes, quota AS quota_blocks
FROM rested
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), i AS (
  SELECT item_id, {WORDS} AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[p + 1 : p + least(13, len(w))], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, p, l, array_to_string(w[p + 1 : p + l], ' ') AS t
  FROM (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS p FROM d, (SELECT DISTINCT l FROM iw))
), hit AS (
  SELECT r, p, l, item_id FROM dw JOIN iw USING (l, t)
), n AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM hit) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN ids USING (r)
"""



WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


def _licenses(threshold: float = 0.8) -> str:
    """Brute force: all phrases at all places, all templates against all runs of words of all lines."""
    from corpusflow.llm.license_scan import PHRASES, ROOM, TEMPLATES, need

    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(
        f"('{t.label}', {t.words}, {need(len(t.words), threshold)}, {list(t.must)}::VARCHAR[], {ROOM * t.length})" for t in TEMPLATES
    )
    return rf"""
WITH phrases(p, label) AS (VALUES {phrases}), templates(label, t, need, must, room) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {WORDS} AS w FROM documents),
places AS (
  SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS i FROM d, phrases
), base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY r
), lines AS (
  SELECT r, row_number() OVER () AS line, {WORDS} AS b FROM (SELECT r, unnest(string_split(text, chr(10))) AS text FROM d WHERE text IS NOT NULL)
), runs AS (
  SELECT r, line, label, t, need, list_sort(list_filter(list_transform(range(0, greatest(len(b) - room, 0) + 1), lambda s: list_sort(list_intersect(t, b[s + 1 : s + room]))), lambda m: len(m) >= need AND len(list_intersect(must, m)) = len(must)), 'DESC') AS ms
  FROM lines, templates WHERE len(list_intersect(t, b)) >= need AND len(list_intersect(must, b)) = len(must)
), best AS (
  SELECT r, line, label, t, list_filter(ms, lambda m: len(m) = list_max(list_transform(ms, lambda o: len(o))))[1] AS m FROM runs WHERE len(ms) > 0
), pairs AS (
  SELECT r, line, label, m, len(m) / len(t) AS part FROM best
), met AS (
  SELECT r, list(DISTINCT label) AS own, max(part) AS best FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM pairs o WHERE o.line = p.line AND (o.part > p.part OR o.part = p.part AND len(o.m) > len(p.m)) AND len(list_intersect(p.m, o.m)) = len(p.m)) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(own, []))), ',') AS labels, coalesce(best, 0.0) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN met USING (r)
"""


#: Brute force: every pair that shares an n-gram, then all that links reach.
JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT r, r AS t FROM n UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.t
), least_id AS (
  SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY 1
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN least_id USING (r)
"""

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, i, array_to_string(w[i + 1 : i + 3], ' ') AS t FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM d)
), twice AS (
  SELECT r, t FROM g GROUP BY r, t HAVING count(*) > 1
), covered AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT g.r, unnest(range(i, i + 3)) AS q FROM g JOIN twice USING (r, t)) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)
"""

CLUSTER_START = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS c, v FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8
)"""
CLUSTER_ROUND = """, a{i} AS MATERIALIZED (
  SELECT rid, vec_id, v, c, d FROM (
    SELECT k.rid, k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM kept k, c{i} c
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)"""
CLUSTER_MEANS = """, c{j} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS v FROM (
      SELECT c, p, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY c, p
    ) GROUP BY c
  ) n ON o.c = n.c
)"""
CLUSTERS = (
    CLUSTER_START + "".join(CLUSTER_ROUND.format(i=i) + CLUSTER_MEANS.format(i=i, j=i + 1) for i in range(10)) +
    CLUSTER_ROUND.format(i=10) + """
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a10 a JOIN c10 c ON a.c = c.c
"""
)

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH numbered AS (
  SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS w FROM documents
), counted AS (
  SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS t FROM numbered) GROUP BY rid, t
), sizes AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n FROM numbered WHERE len(w) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), asked AS (
  SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark)
), weighed AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*)::BIGINT AS df FROM counted WHERE t IN (SELECT t FROM asked) GROUP BY t), corpus
), scored AS (
  SELECT a.item_id, s.doc_id, c.rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * s.n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN weighed USING (t) JOIN counted c USING (t) JOIN sizes s USING (rid), corpus GROUP BY a.item_id, s.doc_id, c.rid
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {
    "quality_base_columns": QUALITY, "op4_jaccard_join": JACCARD, "op2_warc": WARC, "op6_license_scan": _licenses(),
    "op9_source_mixing": MIXING, "op10_decontamination": DECONTAMINATION,
    "op11_centroid_clustering": CLUSTERS, "op12_lexical_search": SEARCH
}
