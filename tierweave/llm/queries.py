"""The numbered queries ``opN_<name>``, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierweave.llm import bpe, idstore, kdmeans, packing, pii, ppm, prefix, quality, rabitq, resampling, secrets, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and perplexity bands over every document."""
    return quality.assess(_table(spark, sf_dir, "documents"))


def op2_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors by randomly rotated binary codes."""
    return rabitq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of every document from a distinct-word table."""
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), with_ids=False, stored=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by pigeonring filtering of SimHash fingerprints."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans and those that the character network adds."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences by linear grouping and best fit."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to range-coded files and read back."""
    return idstore.read_ids(idstore.write_ids(_table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those that boosted trees add."""
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document from counts at every prefix."""
    return prefix.count_tokens(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in ZIP archives, read back by ranges."""
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))


def op11_kd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid clustering of ``embeddings`` by kd-tree filtering."""
    return kdmeans.cluster(_table(spark, sf_dir, "embeddings"))


def op12_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by prediction by partial matching."""
    return ppm.identify(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling of ``documents`` towards ``benchmark`` over a sparse count matrix."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: By brute force: all pairs of vectors, and labels that spread along links.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), n AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a), c AS (SELECT a, MIN(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, COALESCE(n.n, 0) AS n_links, LEAST(COALESCE(c.c, e.vec_id), e.vec_id) AS component_id,
  LEAST(COALESCE(c.c, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

#: Base32 digit i of a SHA-1 is its bits 5i to 5i + 4: hex digits 5i/4 and the next.
OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha1(COALESCE(html, '')) || '0' AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((((strpos('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 1 AS INTEGER), 1)) - 1) * 16
      + strpos('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 2 AS INTEGER), 1)) - 1) >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = MAX(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = MAX(page_id) OVER w THEN NULL ELSE MAX(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)
"""


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """A round after the other: all distances, the nearest centroid, exact floors of means."""
    out = ["""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS x FROM kept
), first AS (
  SELECT x, ROW_NUMBER() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS z FROM kept
), c0 AS MATERIALIZED (
  SELECT z, unnest(range(64)) AS i, unnest(x) AS x FROM first WHERE z < %d
)""" % k]
    for n in range(rounds + 1):
        out.append(f"""a{n} AS MATERIALIZED (
  SELECT vec_id, arg_min(z, d * 64 + z) AS z, MIN(d) AS d FROM (
    SELECT vec_id, z, CAST(SUM((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n} c USING (i) GROUP BY vec_id, z) GROUP BY vec_id
)""")
        if n < rounds:
            out.append(f"""m{n} AS (
  SELECT z, i, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n FROM v JOIN a{n} USING (vec_id) GROUP BY z, i
), c{n + 1} AS MATERIALIZED (
  SELECT c.z, c.i, COALESCE((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.z = c.z AND m.i = c.i
)""")
    return ", ".join(out) + f"""
SELECT vec_id, CAST(a.z AS INTEGER) AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY a.z) AS BIGINT) AS cluster_inertia,
  CAST(SUM(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN (SELECT z, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY z) h ON h.z = a.z
"""


#: CRC-32 by its polynomial: a byte's eight steps at once from the table, which follows from them.
OP13_SQL = """
WITH RECURSIVE steps(i, n, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE n < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8
), d AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), dw AS MATERIALIZED (SELECT r, w, COUNT(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w
), bw AS MATERIALIZED (SELECT w, COUNT(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w
), words AS (SELECT w FROM dw UNION SELECT w FROM bw
), bucket AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: CAST(concat('0x', substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS k FROM words, crc
), s AS (SELECT k, SUM(n) AS s FROM dw JOIN bucket USING (w) GROUP BY k
), t AS (SELECT k, SUM(n) AS t FROM bw JOIN bucket USING (w) GROUP BY k
), gain AS (
  SELECT k, floor(1000 * ln((COALESCE(t, 0) + 1)::DOUBLE * (SUM(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT COALESCE(SUM(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (k)
), total AS (
  SELECT r, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(n * gain) AS BIGINT) AS g FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r
), weighed AS (
  SELECT doc_id, COALESCE(n, 0) AS n_features, COALESCE((g - ((g % n) + n) % n) // n, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS noise FROM d LEFT JOIN total USING (r)
), scored AS (SELECT doc_id, n_features, weight, weight + noise AS score FROM weighed
), drawn AS (SELECT doc_id, n_features, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS rank, COUNT(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored s LEFT JOIN drawn USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_rabitq, op3_bpe, op4_simhash, op5_secrets, op6_packing, op7_token_ids, op8_pii, op9_token_counts, op10_warc, op11_kd_means, op12_lang_id, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op2_rabitq": OP2_SQL, "op10_warc": OP10_SQL, "op11_kd_means": _op11_sql(), "op13_resampling": OP13_SQL}
