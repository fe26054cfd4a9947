"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import ann, extraction, importance, jaccard, lm, media, mixing, packing, periods, pii, quality, secrets, toxicity
from foliospark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_rows(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_rows(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest_rows(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_mixing, op2_ppm, op3_toxicity, op4_ann, op5_packing, op6_jaccard, op7_extraction, op8_quality, op9_media, op10_secrets, op11_pii, op12_importance, op13_runs, pipeline]
    return {f.__name__: f for f in found}


JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' '))
                                    WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM sets d LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, d.s
"""


#: The checksum is computed over a feature's bytes with its usual table, which a recursion makes.
IMPORTANCE_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
rows AS (
  SELECT row_number() OVER () AS r, doc_id, text, 0 AS aim FROM documents
  UNION ALL SELECT row_number() OVER (), NULL, text, 1 FROM benchmark),
words AS (
  SELECT r, doc_id, aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM rows),
features AS (
  SELECT r, aim, unnest(w) AS f FROM words
  UNION ALL SELECT r, aim, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counts AS (SELECT r, aim, f, count(*) AS n FROM features GROUP BY r, aim, f),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counts)),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST(instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 17 AS BIGINT))),
    lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc),
sums AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (WHERE aim = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE aim = 1), 0) AS DOUBLE) AS t FROM counts JOIN buckets USING (f) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums),
totals AS (SELECT r, sum(n) AS n, sum(n * gain) AS total FROM counts JOIN buckets USING (f) JOIN gains USING (bucket) WHERE aim = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
    CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM words LEFT JOIN totals USING (r) WHERE aim = 0),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * (SELECT count(*) FROM noisy WHERE words >= 20) // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard": JACCARD_SQL, "op12_importance": IMPORTANCE_SQL}
