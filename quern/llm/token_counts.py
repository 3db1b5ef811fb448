"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import map_texts
from quern.llm.vocabularies import piece_chunks, piece_counts, vocabulary_path

LIMIT = 4096


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes, n_tokens of the whole text, over_limit.

    Arrow batches are cut into slices of equal bytes. Texts are split at boundaries that no piece crosses,
    each distinct chunk of a slice is encoded once, and a text's count is the sum over its chunks.
    Null text counts as empty: 0 bytes, 0 tokens. Null, repeated ids and repeated rows each give their row.
    Other columns of docs are ignored, whatever their names. An empty table gives an empty table.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")

    def make():
        memo = piece_counts(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            chunks = [piece_chunks(t) if t else [] for t in batch.column("text").to_pylist()]
            count = memo.of(set(chain.from_iterable(chunks))).__getitem__
            n = pa.array([sum(map(count, c)) for c in chunks], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

        return work

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = cols.schema["id"].dataType.simpleString()
    out = map_texts(cols, "text", make, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
