"""Queries over the numbered operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, lang_id, ngram_join, packing, periodic, quality, secrets, shards, substring_dedup, token_counts, variants, warc
from .common import scratch_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = lang_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), train=~held_out)
    out = lang_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.interleave(_read(spark, sf_dir, "documents"), shards=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=10)
    return decontaminate.digest(found)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(_read(spark, sf_dir, "documents"), length=50)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), ~held_out, "quality")
    out = quality.score(docs.select("doc_id", "text"), model, threshold=0.3)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    warc.write_archives(_read(spark, sf_dir, "pages"), path, least=100)
    found = warc.resolved(warc.reassembled(warc.read_records(spark, path)))
    return found.select(
        warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number(F.col("refers_to")).alias("refers_to"), "problem"
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.vocabulary(_read(spark, sf_dir, "documents"), least_length=6, least_count=5, slips=199)
    return variants.group_variants(words, times=5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.detect(_read(spark, sf_dir, "documents"), loops=True))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_language_id, op3_secret_scan, op4_sharding, op5_token_counts, op6_decontamination, op7_ngram_join, op8_substring_dedup, op9_quality, op10_neighbours, op11_warc, op12_spelling_variants, op13_periodic_runs, pipeline)
}

#: A-Z in lower case, and nothing else changed.
LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW.format(t="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW.format(t='text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s + 1 : s + least(len(ws), 10)], ' ') AS x FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS s FROM b WHERE len(ws) > 0)),
g AS (SELECT r, s, n, array_to_string(ws[s + 1 : s + n], ' ') AS x FROM (SELECT d.r, d.ws, k.n, unnest(range(len(d.ws) - k.n + 1)) AS s FROM d, (SELECT DISTINCT n FROM w) k WHERE len(d.ws) >= k.n)),
f AS (SELECT g.r, g.s, g.n, w.item_id FROM g JOIN w ON g.n = w.n AND g.x = w.x),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM f) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM f) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""",
    "op7_ngram_join": rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOW.format(t="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[s + 1 : s + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 3, 1))) AS s FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT u.doc_id AS a, v.doc_id AS b, count(*) AS k FROM g u JOIN g v ON u.x = v.x AND u.doc_id < v.doc_id GROUP BY ALL) p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id WHERE c.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.root, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id) r USING (doc_id)""",
    "op8_substring_dedup": """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, substring(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 49)) AS p FROM d WHERE length(x) >= 100)),
f AS (SELECT w.doc_id, w.p FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)) m USING (s) WHERE w.doc_id > m.least),
o AS (SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
r AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o) GROUP BY doc_id, k),
k AS (SELECT r.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * coalesce(last, 0) + 1, 2 * (lo - coalesce(last, 0))), '' ORDER BY lo) || substring(any_value(x), 2 * max(hi) + 1) AS kept
  FROM (SELECT *, lag(hi) OVER (PARTITION BY doc_id ORDER BY lo) AS last FROM r) r JOIN d USING (doc_id) GROUP BY r.doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op11_warc": """SELECT page_id, n AS payload_bytes, sha256(t) AS payload_digest, CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to, NULL::VARCHAR AS problem
FROM (SELECT page_id, t, octet_length(encode(t)) AS n, min(page_id) OVER (PARTITION BY t) AS least FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))""",
}
