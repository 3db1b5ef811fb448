"""A training corpus from raw documents, in five stages. Each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import decontamination, minhash, packing, quality, secrets
from quern.scratch import materialize

#: Shingles of five words and a similarity of 0.8 or more are near duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
ROW = "_row"
#: Bits of a row number for the row's place in its file.
FILE_BITS = 40
#: Row numbers, of eight bytes, that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Chunks that packing remembers in a generation, a fifth of the default: by the last stage the JVM has grown by four stages before.
PACKING_CHUNKS = 100_000


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row: the place of its file among the table's files, by path, and its place in the file. docs is a written table.

    Both are of the table itself, so every job gives a row the same number, however the scan is split.
    """
    file = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
    files = materialize(file.select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_nth")), "files")
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return placed.join(F.broadcast(files), "_file").withColumn(ROW, F.shiftleft("_nth", FILE_BITS) + F.col("_at")).select(*docs.columns, ROW)


def _without(numbered: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """numbered without the rejected row numbers: broadcast up to BROADCAST_ROWS of them, joined by an exchange beyond."""
    rejected = materialize(rejected, name)
    few = rejected.count() <= BROADCAST_ROWS
    return numbered.join(F.broadcast(rejected) if few else rejected, ROW, "left_anti").drop(ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the bands of tokeniser fertility reject. Null and empty texts are rejected."""
    numbered = _numbered(docs)
    judged = quality.quality_rules(numbered.select(ROW, "text", "lang"), id_col=ROW)
    return _without(numbered, judged.filter("NOT kept").select(ROW), "poor")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id, and of rows that share it the first. Texts without words are groups of their own."""
    numbered = _numbered(docs)
    grouped = minhash.near_duplicates(numbered.select(F.struct("doc_id", ROW).alias("_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT, id_col="_id")
    return _without(numbered, grouped.filter("NOT kept").select(f"_id.{ROW}"), "copies")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    numbered = _numbered(docs)
    found = decontamination.contaminated(numbered.select(ROW, "text"), benchmark, id_col=ROW)
    return _without(numbered, found.filter("contaminated").select(ROW), "leaks")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every finding in their texts gives way to a mark, and n_chars follows."""
    return secrets.redact(docs, docs.columns).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.packed_documents(docs.select("doc_id", "text"), memo_chunks=PACKING_CHUNKS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The stages encode with public tokenizers and fit bands by quantile sketches, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
