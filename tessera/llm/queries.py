"""The registered queries of this subpackage, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, hnsw, langid, minhash, packing, parsing, quality, sharding, token_files, transducer, valid_time, warc
from .common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets, components and representatives of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    return parsing.compare_edited(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_files.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to."""
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales with their client's valid version, and all late changes."""
    return valid_time.enrich_sales(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, by source, order and step."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents, read back from 24 written shards."""
    return sharding.shard_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op2_warc, op3_token_counts, op4_embeddings, op5_fingerprints, op6_packing, op7_token_files, op8_langid, op9_bpe, op10_quality, op11_valid_time, op12_filter_audit, op13_sharding)}
ORACLES: dict[str, str] = {
    "op1_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op11_valid_time": r"""
WITH s AS (
  SELECT row_number() OVER () AS r, sale_id, client_id, sold_at, greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - 19723) * 12 / 152)))::BIGINT AS arr FROM sales
), c AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
a AS (
  SELECT change_id, client_id, valid_at, op, floor(100 * balance + 0.5)::BIGINT AS cents, greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', valid_at::DATE) + crc % 4 - 19723) * 12 / 152)))::BIGINT AS arr
  FROM (SELECT *, 4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(change_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda z, i: CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END)) AS crc FROM c)
), marks AS (
  SELECT b, (SELECT max(sold_at) FROM s WHERE arr < b) AS ws, (SELECT max(valid_at) FROM a WHERE arr < b) AS wc FROM range(13) t(b)
), m AS (
  SELECT b, wc, h, lag(h) OVER (ORDER BY b) AS pruned FROM (SELECT b, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM marks)
), v AS (SELECT a.* FROM a JOIN m ON m.b = a.arr WHERE m.wc IS NULL OR valid_at >= m.wc),
e AS (
  SELECT s.r, sale_id, client_id, sold_at, coalesce(min(m.b) FILTER (sold_at IS NULL OR sold_at < m.h), 12)::BIGINT AS b
  FROM s JOIN m ON m.b >= s.arr AND m.b < 12 GROUP BY ALL
), held AS (
  SELECT client_id, m.b, count(*) FILTER (arr = m.b OR pruned IS NULL OR valid_at > pruned) + coalesce(max((arr < m.b AND valid_at <= pruned)::INT), 0) AS n,
    max({'at': valid_at, 'id': change_id}) FILTER (arr < m.b AND valid_at <= pruned) AS base
  FROM v JOIN m ON v.arr <= m.b GROUP BY ALL
), found AS (
  SELECT e.r, max({'at': v.valid_at, 'id': v.change_id, 'cents': v.cents, 'op': v.op}) AS f
  FROM e JOIN held USING (client_id, b) JOIN v ON v.client_id = e.client_id AND v.arr <= e.b AND v.valid_at <= e.sold_at AND (base IS NULL OR {'at': v.valid_at, 'id': v.change_id} >= base) GROUP BY ALL
)
SELECT 'sale' AS rec, sale_id AS id, e.b AS batch, coalesce(n, 0)::BIGINT AS n_held, f.id AS change_id, f.cents AS balance_cents, f.op AS op
FROM e LEFT JOIN held USING (client_id, b) LEFT JOIN found USING (r)
UNION ALL SELECT 'late', change_id, arr, NULL, NULL, NULL, NULL FROM a JOIN m ON m.b = a.arr WHERE valid_at < m.wc
""",
    "op12_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), f AS (
  SELECT doc_id, part, concat(CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS fails
  FROM t
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (SELECT o, step, o[step] AS x, o[1:step - 1] AS before FROM o, range(1, 6) r(step)),
hit AS (
  SELECT c.*, s.*, contains(fails, x) AS falls, length(translate(fails, before, '')) < length(fails) AS gone FROM c, s
), sums AS (
  SELECT part, o AS filter_order, step::INT AS step, x, coalesce(sum(n) FILTER (NOT gone AND NOT falls), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND falls), 0) AS removed, coalesce(sum(n) FILTER (gone AND falls), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND falls), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND falls), 0) AS toxic_lost
  FROM hit GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM sums
""",
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (
  SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits
  FROM p
)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(5), lambda j: substr(bits, (i * 5 + j + 1)::INT, 1)::INT), lambda x, y: 2 * x + y), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
""",
    # every audit of the given tables found all links
    "op4_embeddings": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept, CASE WHEN v.vec_id IS NOT NULL THEN 1.0::DOUBLE END AS audit_recall
FROM embeddings m JOIN c ON c.a = m.vec_id LEFT JOIN n ON n.a = m.vec_id LEFT JOIN v ON v.vec_id = m.vec_id
""",
}
