"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embed_dedup, line_dedup, mixing, ngram_join, quality, secret_scan, sharding, token_store, warc
from .shared import table

SHARDS = 24


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(table(spark, sf_dir, "embeddings"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.roundtrip(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.roundtrip(table(spark, sf_dir, "pages"))
    return found.where("note is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: CRC-32 byte by byte, row numbers by id, and the permutation of sharding.py walked until every row is below n.
OP3_SQL = r"""
WITH RECURSIVE polynomial AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
      FROM documents, polynomial),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM d),
whole AS (SELECT count(*) AS n, greatest(2, length(bin(greatest(count(*) - 1, 1)))) // 2 AS lb, greatest(2, length(bin(greatest(count(*) - 1, 1)))) - greatest(2, length(bin(greatest(count(*) - 1, 1)))) // 2 AS rb FROM d),
walk AS (
  SELECT row_number, row_number AS v, true AS fresh FROM numbered
  UNION ALL
  SELECT row_number, (l2 << rb) | r2, false FROM (
    SELECT row_number, rb, v >> rb AS l0, v & ((1::BIGINT << rb) - 1) AS r0,
           xor(l0, ('0x' || substr(md5(r0 || ':SEED:0'), 1, 12))::BIGINT & ((1::BIGINT << lb) - 1)) AS l1, xor(r0, ('0x' || substr(md5(l1 || ':SEED:1'), 1, 12))::BIGINT & ((1::BIGINT << rb) - 1)) AS r1,
           xor(l1, ('0x' || substr(md5(r1 || ':SEED:2'), 1, 12))::BIGINT & ((1::BIGINT << lb) - 1)) AS l2, xor(r1, ('0x' || substr(md5(l2 || ':SEED:3'), 1, 12))::BIGINT & ((1::BIGINT << rb) - 1)) AS r2
    FROM walk, whole WHERE fresh OR v >= n))
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % SHARDS)::INT AS shard, v // SHARDS AS slot, NULL::INT AS grown_shard, row_number
FROM walk JOIN numbered USING (row_number), whole WHERE NOT fresh AND v < n
""".replace("SEED", str(sharding.SEED)).replace("SHARDS", str(SHARDS))

#: All pairs within a label.
OP4_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size,
    embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AS usable FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.usable AND b.usable AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id, vec_id AS root FROM e UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id),
low AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY ALL),
class AS (SELECT label, v, min(vec_id) AS class_id FROM e WHERE usable GROUP BY ALL),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY ALL)
SELECT e.vec_id, coalesce(class_id, e.vec_id) AS class_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN low USING (vec_id) LEFT JOIN n USING (vec_id) LEFT JOIN class c ON e.usable AND c.label = e.label AND c.v = e.v
"""

#: Whole shingle sets, joined on every shared shingle.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::UBIGINT[] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))] ELSE list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) END)) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id),
low AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY ALL),
class AS (SELECT s, min(doc_id) AS class_id FROM s WHERE len(s) > 0 GROUP BY ALL),
n AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY ALL)
SELECT s.doc_id, coalesce(class_id, s.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, component_id, s.doc_id = component_id AS kept
FROM s JOIN low USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN class USING (s)
""".replace("\\\\p", "\\p")

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 18 * source_size // weight, source IS NULL, source) AS place FROM w),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM o),
c AS (SELECT *, bool_and(cap * left_weight <= left_size * weight) OVER (ORDER BY place) AS capped FROM l),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN cap::DOUBLE
                  ELSE (max(CASE WHEN NOT capped THEN left_size END) OVER () * weight)::DOUBLE
                       / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE END AS target FROM c),
e AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(budget // source_size, 3) ELSE 0 END AS epochs FROM e),
r AS (SELECT d.doc_id, d.size, f.source_size, f.target, f.epochs, CASE WHEN f.epochs < 3 THEN f.budget - f.epochs * f.source_size ELSE 0 END AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - run)))::BIGINT AS taken FROM r
"""

OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM m
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_token_store": op5_token_store,
    "op6_ngram_join": op6_ngram_join,
    "op7_secrets": op7_secrets,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
}
ORACLE_SQL: dict[str, str] = {"op3_sharding": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op6_ngram_join": OP6_SQL, "op9_mixing": OP9_SQL, "op10_warc": OP10_SQL}
