"""Each stage on documents made for it, against plain loops."""

from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import documents, multiset, near_groups, shingles
from tests.llm.test_encoders import base_counts
from tests.llm.test_groups import base_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


def written(spark, df, folder):
    df.write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def test_stages_keep_the_columns_and_do_their_work(spark, tmp_path):
    docs = written(spark, documents(spark).select(COLUMNS), tmp_path / "documents")
    stages = dict(pipeline.STAGES)
    good = written(spark, stages["quality_rules"](spark, docs, SF), tmp_path / "good")
    assert good.columns == COLUMNS
    assert all(not base_counts(r["text"])[-1] for r in good.collect())

    first = written(spark, stages["near_duplicates"](spark, docs, SF), tmp_path / "first")
    assert first.columns == COLUMNS
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = near_groups(rows, 5, 80)
    left = first.count()
    assert left == sum(not shingles(t, 5) for _, t in rows) + len({g for g, (_, t) in zip(groups, rows) if shingles(t, 5)})
    again = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert near_groups(again, 5, 80) == list(range(left))

    hidden = stages["secret_scans"](spark, docs, SF)
    assert hidden.columns == COLUMNS and hidden.count() == docs.count()
    assert hidden.filter("length(text) <> n_chars").count() == 0
    assert not any(base_spans((r["text"] or "").replace("[SECRET]", " ")) for r in hidden.collect())

    clean = stages["benchmark_decontamination"](spark, docs, SF)
    assert clean.columns == COLUMNS and clean.count() == docs.count()
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.lit(5000).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).limit(3)
    mixed = written(spark, docs.unionByName(leak), tmp_path / "mixed")
    assert stages["benchmark_decontamination"](spark, mixed, SF).count() == docs.count()


def test_run(spark):
    """Every text that the stages leave is packed once and whole, in sequences without gaps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, SF), name)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got, by = pipeline.run(spark, SF).collect(), defaultdict(list)
    assert want and multiset(tuple(r)[:5] for r in got) == multiset(want)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        assert sum(n for _, n in places) <= 4096
        assert [a for a, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = written(spark, documents(spark).select(COLUMNS).limit(0), tmp_path / "none")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_verdicts_hold_when_the_scan_is_split_anew(spark, tmp_path):
    docs = written(spark, documents(spark).select(COLUMNS).repartition(8), tmp_path / "documents")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.lit(5000).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).limit(3)
    mixed = written(spark, docs.unionByName(leak).repartition(8), tmp_path / "mixed")
    for name, table in (("quality_rules", docs), ("near_duplicates", docs), ("benchmark_decontamination", mixed)):
        rows = []
        for later in ("1", "64"):  # the verdicts are written under 1
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            kept = dict(pipeline.STAGES)[name](spark, table, SF)
            spark.conf.set("spark.sql.files.minPartitionNum", later)
            rows.append(multiset(kept.collect()))
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert rows[0] == rows[1] and 0 < len(rows[0]) < table.count()
