from __future__ import annotations

import pytest

from quern.sources import readers, writers


def test_pair_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('french,tgt,x\n"a ""b""\nc",d,1\n,e,2\nf, ,3\n" ",g,4\n')
    got = readers.pair_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r["src"], r["tgt"]) for r in got.collect()) == [(" ", "g"), ('a "b"\nc', "d")]
    with pytest.raises(ValueError):
        readers.pick(["q"], readers.SOURCE_NAMES)


def test_pair_tsv_and_predictions(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('NA\tnull\n\tb\n"q\tr\n')
    assert sorted(map(tuple, readers.pair_tsv(spark, str(tmp_path / "a.tsv")).collect())) == [('"q', "r"), ("NA", "null")]
    (tmp_path / "p.tsv").write_text("a\tb\tc\td\nshort\tline\n\tx\ty\n")
    assert sorted(map(tuple, readers.predictions(spark, str(tmp_path / "p.tsv")).collect())) == [("", "x", "y"), ("a", "b", "c")]


def test_tagged_union_and_required(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text(f"src\n{n}1\n")
    t = readers.tagged_union(spark, str(tmp_path))
    assert sorted(map(tuple, t.collect())) == [("a1", "a.csv"), ("b1", "b.csv")]
    with pytest.raises(ValueError):
        readers.required(t, ["src", "tgt"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\nc", "d")], "src string, tgt string")
    writers.pair_files(df, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/tsv")).collect()] == ["a\\tb\\nc\td"]
    assert spark.read.csv(str(tmp_path / "out/csv"), header=True, multiLine=True, escape='"').collect() == df.collect()
    runs = spark.createDataFrame([("e", "c", 1, 2.0, None)], "experiment string, condition string, seed int, bleu double, chrf double")
    writers.by_run(runs, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).columns == ["bleu", "experiment", "condition", "seed"]
    assert not writers.guarded(df, df, str(tmp_path / "no"))
    assert writers.guarded(df, df.limit(0), str(tmp_path / "yes"))
