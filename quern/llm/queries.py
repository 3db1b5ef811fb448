"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import brown, decontamination, language, lexical, minhash, negatives, packing, quality, secrets, sharding, simhash, token_counts, toxicity
from quern.scratch import scratch_path


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def _table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of held-out documents (remainder 1 of 3) train nothing."""
    docs, labels = _table(spark, sf_dir, "documents", ["doc_id", "text"]), _table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return toxicity.score_toxicity(docs, labels, _remainder(3) == 1)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled_shards(_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of remainder 2 of 7 are held out."""
    return brown.class_scores(_table(spark, sf_dir, "documents", ["doc_id", "text"]), _remainder(7) == 2)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of remainder 0 of 5 are held out."""
    return language.identify(_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]), _remainder(5) == 0)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in two deliveries. The first begins a ledger; the second, which is all documents, scans only blobs that the ledger lacks."""
    docs = _table(spark, sf_dir, "documents", ["doc_id", "text"])
    path = scratch_path(spark, "secret-ledger")
    secrets.append(docs.filter(_remainder(2) == 0), path)
    return secrets.secret_scan(docs, path=path)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents", ["doc_id", "text"]), _table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])).drop("n_tokens", *quality.MEASURES)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents", ["doc_id", "text"]), _table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id has its label moved on by one of ten; every hundredth is an anchor."""
    vectors = _table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return negatives.hard_negatives(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_packing, op3_sharding, op4_minhash, op5_token_counts, op6_brown, op7_language, op8_secrets, op9_decontamination, op10_quality, op11_lexical, op12_simhash, op13_negatives)
}

#: Queries whose rows SQL can express. The others learn, draw or encode; tests hold them against brute force.
SQL: dict[str, str] = {
    "op4_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || chr(1) || len(w)] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op11_lexical": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), q AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
m AS (SELECT r, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM t JOIN w USING (term) JOIN m USING (r) JOIN q USING (term) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "op13_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
}
