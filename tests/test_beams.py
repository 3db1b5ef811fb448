"""Candidates of a beam search are given out in small batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ngram_models as L


def test_best_are_the_first_of_all(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_CANDIDATES", 50)
    d = spark.range(40).select("id", F.when(F.col("id") % 7 > 0, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.array(*[F.sin(F.col("id") * (k + 1) + t) for k in range(3)]))).alias("f"))
    every = L.beam_candidates(d, "id", "f", ["_", "a", "b"], width=100)
    some = L.beam_candidates(d, "id", "f", ["_", "a", "b"], width=100, best=2)
    assert every.count() > 400 and every.filter("rank <= 2").exceptAll(some).isEmpty() and some.exceptAll(every.filter("rank <= 2")).isEmpty()
    assert some.schema.names == ["id", "rank", "text", "acoustic", "fused"] and some.filter("id % 7 = 0").isEmpty()
