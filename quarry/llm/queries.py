"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, fingerprints, mixing, ngram_join, packing, passage_dedup, prefix_trie, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_packing": packing.op3_packing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_token_files": token_files.op6_token_files,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_passage_dedup": passage_dedup.op8_passage_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

#: Sets of 3-word shingles, classes of equal sets, links of 0.9, and what each class reaches over links.
OP2 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
c AS (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS class_id FROM s),
r AS (SELECT class_id AS d, any_value(s) AS s, any_value(n) AS n FROM c WHERE n > 0 GROUP BY class_id),
x AS (SELECT d, n, unnest(s) AS t FROM r),
l AS (SELECT a.d AS a, b.d AS b FROM x a JOIN x b ON a.t = b.t AND a.d < b.d GROUP BY a.d, b.d, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT d, d AS m FROM r UNION SELECT reach.d, e.b FROM reach JOIN e ON e.a = reach.m),
root AS (SELECT d, min(m) AS root FROM reach GROUP BY d)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE root END AS component_id, CASE WHEN n = 0 THEN doc_id ELSE class_id END AS class_id FROM c LEFT JOIN root ON d = class_id"""

#: All 50-byte strings as hexadecimal digits, the first document of each, and the runs of bytes that later ones lose.
OP4 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), d AS (SELECT doc_id, x, length(x) // 2 AS n FROM h),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s), m AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM m)),
sp AS (SELECT doc_id, island, min(i) AS b, max(i) + 50 AS e FROM g GROUP BY ALL),
k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS prev FROM sp),
a AS (SELECT doc_id, sum(e - b) AS r, count(*) AS c, string_agg(substr(x, 2 * prev + 1, 2 * (b - prev)), '' ORDER BY b) AS kept, max(e) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(from_hex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op2_ngram_join": OP2, "op4_suffix_dedup": OP4}

#: crc32 of bytes given as hexadecimal digits, by a table of 256 remainders.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda s, x: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)) AS t)"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda p: ('0x' || p)::BIGINT)), lambda s, b: xor(s // 256, t[xor(s % 256, b) + 1])), 4294967295)"

#: Virtual slots, their pieces, and a greedy deal of them to 24 shards, the largest first.
OP13 = f"""WITH RECURSIVE {CRC_TABLE}, d AS MATERIALIZED (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size, {CRC.format("coalesce(text, '')")} AS text_crc32, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3))::INT AS virtual_slot FROM documents, crc),
t AS (SELECT sum(size)::BIGINT AS total FROM d),
p AS MATERIALIZED (SELECT *, CASE WHEN 4 * 24 * sum(size) OVER (PARTITION BY virtual_slot) > total THEN (sum(size) OVER o - size) // greatest(total // 384, 1) ELSE 0 END::INT AS piece, row_number() OVER o - 1 AS nth FROM d, t WINDOW o AS (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)),
u0 AS (SELECT virtual_slot, piece, count(*) AS n, sum(size)::BIGINT AS b, min(nth) AS first FROM p GROUP BY virtual_slot, piece),
u AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY b DESC, virtual_slot, piece) AS i FROM u0),
g AS (SELECT 0::BIGINT AS i, list_transform(range(24), lambda k: 0::BIGINT) AS loads, 0 AS shard
  UNION ALL SELECT i, list_transform(range(1, 25), lambda k: loads[k] + CASE WHEN k = lightest THEN b ELSE 0 END), lightest::INT - 1 FROM (SELECT u.i, u.b, g.loads, list_position(g.loads, list_min(g.loads)) AS lightest FROM g JOIN u ON u.i = g.i + 1)),
m AS (SELECT virtual_slot, piece, first, shard, sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot, piece) - n AS base FROM u JOIN g USING (i))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, (base + nth - first)::BIGINT AS slot, NULL::INT AS grown_shard, virtual_slot, piece FROM p JOIN m USING (virtual_slot, piece)"""

QUERIES["op13_sharding"] = sharding.op13_sharding
ORACLE_SQL["op13_sharding"] = OP13


def _clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds one after the other: the nearest centroid of each vector, then floors of means."""
    near = "SELECT id, vec_id, x, c.cluster, list_sum(list_transform(range(1, {0}), lambda i: (x[i] - c.c[i]) * (x[i] - c.c[i])))::BIGINT AS d FROM v, c{1} c".replace("{0}", str(dims + 1))
    best = "a{1} AS MATERIALIZED (SELECT id, vec_id, x, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS nth FROM (" + near + ")) WHERE nth = 1)"
    mean = """m{1} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT cluster, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{1}, (SELECT unnest(range(1, {0})) AS i) GROUP BY cluster, i) GROUP BY cluster),
c{2} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{1} c LEFT JOIN m{1} m USING (cluster))""".replace("{0}", str(dims + 1))
    steps = []
    for r in range(rounds + 1):
        steps.append(best.replace("{1}", str(r)))
        if r < rounds:
            steps.append(mean.replace("{1}", str(r)).replace("{2}", str(r + 1)))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {dims}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS cluster, x AS c FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h, x LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


QUERIES["op11_centroids"] = centroids.op11_centroids
ORACLE_SQL["op11_centroids"] = _clusters_sql()

#: Rebuilt conversations, a name for each prefix, and for each node all nodes on the way of its smallest member.
OP12 = rf"""WITH {CRC_TABLE},
t AS (SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS o FROM (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
s AS (SELECT conv_id, base, c.n, h, least(h, coalesce(b.n, 0)) AS m FROM (SELECT conv_id, n, conv_id - conv_id % 20 AS base, {CRC.format("conv_id::VARCHAR")} % 4 AS h FROM c, crc) c LEFT JOIN (SELECT conv_id AS base, n FROM c) b USING (base)),
r AS (SELECT s.conv_id, o AS pos, k, words FROM s JOIN t ON t.conv_id = s.base AND o <= m UNION ALL SELECT s.conv_id, m + o - h, k, words FROM s JOIN t ON t.conv_id = s.conv_id AND o > h),
p AS (SELECT conv_id, pos, words, sha256(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM r),
q AS (SELECT conv_id, pos, words, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY pos) AS parent FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM s),
e AS MATERIALIZED (SELECT conv_id, pos, words, key, parent, pos = m + greatest(n - h, 0) AS is_last FROM q JOIN s USING (conv_id)),
nd AS MATERIALIZED (SELECT key, max(parent) AS parent, min(conv_id) AS conv_id, pos AS depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_last), '')) AS ends_sha256 FROM e GROUP BY key, pos),
ch AS (SELECT parent AS key, count(*) AS n FROM nd WHERE parent IS NOT NULL GROUP BY parent),
sub AS (SELECT e.key, sum(d.own)::BIGINT AS saved_tokens, count(*) FILTER (ch.key IS NULL) AS n_leaves FROM nd d JOIN e ON e.conv_id = d.conv_id AND e.pos <= d.depth LEFT JOIN ch ON ch.key = d.key GROUP BY e.key)
SELECT nd.conv_id, nd.depth::BIGINT AS depth, pn.conv_id AS parent_conv_id, nd.n_convs, coalesce(ch.n, 0)::BIGINT AS n_children, n_leaves, saved_tokens, nd.ends_sha256 FROM nd JOIN sub USING (key) LEFT JOIN ch USING (key) LEFT JOIN nd pn ON pn.key = nd.parent"""

QUERIES["op12_prefix_trie"] = prefix_trie.op12_prefix_trie
ORACLE_SQL["op12_prefix_trie"] = OP12
