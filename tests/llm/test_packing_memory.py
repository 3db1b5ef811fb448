"""How much packing remembers of chunks, and that its rows don't depend on it."""

from __future__ import annotations

import pytest
from pyspark import SparkContext

import corpus_pipeline
from quern.llm import batches, minhash, packing, quality
from quern.llm.vocabularies import vocabulary_path, word_bpe_ids

TEXTS = [" ".join(f"w{n}x{n * 7919 % 1000003}" for n in range(a, a + 400)) for a in range(0, 8000, 200)]


def test_memo_holds_what_it_is_given():
    memo = word_bpe_ids(vocabulary_path("word_bpe_49k.json"), 500)
    for t in TEXTS:
        wanted = set(t.split(" "))
        got = memo.of(wanted)
        assert wanted <= got.keys()
        assert len(memo.new) + len(memo.old) <= 2 * (500 + len(wanted))


def test_rows_do_not_depend_on_the_memo(spark):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None, "", "Some <|x|> | text"])), "doc_id long, text string").coalesce(1)
    rows = lambda n: sorted(map(tuple, packing.tokenized_pieces(docs, memo_chunks=n, keep_ids=True).collect()))
    assert rows(300) == rows(500_000)


def test_pipeline_packs_with_its_own(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "tokenized_pieces", lambda *a, f=packing.tokenized_pieces, **b: asked.append(b["memo_chunks"]) or f(*a, **b))
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert corpus_pipeline.best_fit_packing(spark, docs, "").count() == 2
    assert asked == [corpus_pipeline.PACKING_CHUNKS]


def test_plan_starts_no_python_processes(spark, monkeypatch):
    """Rows that Python hands over one by one pass through worker processes of another kind, which stay beside the others."""
    pieces = packing.tokenized_pieces(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"))
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a: pytest.fail("rows sent by Python"))
    assert packing.pack(pieces).count() == 2
    assert packing.pack(pieces.filter("doc_id > 2")).count() == 0


@pytest.mark.parametrize("of", (quality, minhash))
def test_small_slices(spark, monkeypatch, of):
    limits = []
    monkeypatch.setattr(of, "map_texts", lambda *a, f=batches.map_texts: limits.append(a[4:]) or f(*a))
    docs = spark.createDataFrame([(1, "a b c d e f", "en"), (2, "a b c d e f", "en")], "doc_id long, text string, lang string")
    (quality.text_measures(docs) if of is quality else minhash.near_duplicates(docs.select("doc_id", "text"), 5, 80)).count()
    assert limits and set(limits) == {(batches.SMALL_BYTES,)}
