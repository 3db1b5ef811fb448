"""Sheets and documents that are written, by hand where the writer has no such part, and read again; listings, drifting types, sections."""

from __future__ import annotations

import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import ngram_models as L
from quern.sources import containers as C
from quern.sources import readers


def rows_of(spark, folder, **kinds):
    return sorted((r["path"].rsplit("/", 1)[-1], r["kind"], r["part"], r["row"], r["cells"]) for r in C.read_parts(spark, str(folder), **kinds).collect())


def test_sheets(spark, tmp_path):
    rows = [["French", "x", "Translation"], ["a & b", 1, "<c>"], [None, 2.5, " d "], ["only"], [True, 1e21, None]]
    (tmp_path / "a.xlsx").write_bytes(C.sheet_bytes(rows))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.xlsx").write_bytes(C.sheet_bytes([["p", "q", "r"], ["1", None, "2"]]))
    (tmp_path / "c.xlsx").write_bytes(b"no container")
    (tmp_path / "d.txt").write_text("not listed")
    got = rows_of(spark, tmp_path)
    assert got[:5] == [("a.xlsx", "sheet", 0, 0, ["French", "x", "Translation"]), ("a.xlsx", "sheet", 0, 1, ["a & b", "1", "<c>"]), ("a.xlsx", "sheet", 0, 2, [None, "2.5", " d "]), ("a.xlsx", "sheet", 0, 3, ["only"]), ("a.xlsx", "sheet", 0, 4, ["True", "1e+21", None])]
    assert got[5:] == [("b.xlsx", "sheet", 0, 0, ["p", "q", "r"]), ("b.xlsx", "sheet", 0, 1, ["1", None, "2"]), ("c.xlsx", "unreadable", 0, 0, [])]
    pairs = sorted((r["row"], r["src"], r["tgt"]) for r in C.sheet_pairs(C.read_parts(spark, str(tmp_path))).filter(F.col("path").endswith("a.xlsx")).collect())
    assert pairs == [(1, "a & b", "<c>"), (2, "nan", " d "), (3, "only", "nan"), (4, "True", "nan")]
    assert [(r["src"], r["tgt"]) for r in C.sheet_pairs(C.read_parts(spark, str(tmp_path / "sub"))).collect()] == [("1", "nan")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "e.xlsx").write_bytes(C.sheet_bytes([["alone"], ["1"]]))
    with pytest.raises(Exception, match="two columns"):
        C.sheet_pairs(C.read_parts(spark, str(tmp_path / "one"))).collect()


def test_shared_strings_and_places(spark, tmp_path):
    """Another writer's forms: shared strings with runs and readings, cells named by place, a sheet that isn't the first file."""
    ns = f'xmlns="{C.S[1:-1]}" xmlns:r="{C.R[1:-1]}"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>reading</t></rPh></si></sst>")
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="x" r:id="q2"/><sheet name="y" r:id="q1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="q1" Target="worksheets/no.xml"/><Relationship Id="q2" Target="/xl/worksheets/yes.xml"/></Relationships>')
        z.writestr("xl/worksheets/yes.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2" t="str"><v>far</v></c></row><row r="5"><c r="A5" t="s"><v>0</v></c><c r="C5"><v>3.0</v></c></row></sheetData></worksheet>')
    got = rows_of(spark, tmp_path)
    assert [(r, c) for _, _, _, r, c in got] == [(1, [None, "two runs", *[None] * 24, "far"]), (4, ["plain", None, "3"])]


def test_documents(spark, tmp_path):
    (tmp_path / "t.docx").write_bytes(C.document_bytes([[["French", "Translation"], ["un", "x\ny"], ["alone"]], [["deux", "z", "more"]]], ["left : out"]))
    (tmp_path / "p.docx").write_bytes(C.document_bytes([], ["1. le chat : ŋu : ku", " ", "2) — : ku", "3. le chien ŋa ŋi", "mot", "12.", "le ŋa"]))
    (tmp_path / "h.docx").write_bytes(C.document_bytes([[["FRENCH", "translation"]]], ["x: y"]))
    span = '<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:tc>'
    tall = lambda v, t: f"<w:tc><w:tcPr><w:vMerge{v}/></w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "m.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{C.W[1:-1]}"><w:body><w:tbl><w:tr>{tall(" w:val=\'restart\'", "top")}<w:tc><w:p/></w:tc></w:tr><w:tr>{tall("", "")}{span}</w:tr></w:tbl></w:body></w:document>')
    rows = C.read_parts(spark, str(tmp_path))
    assert [(r["row"], r["cells"]) for r in rows.filter(F.col("path").endswith("m.docx")).orderBy("row").collect()] == [(0, ["top", ""]), (1, ["top", "wide\tx", "wide\tx"])]
    words = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    pairs, doubtful = C.document_pairs(rows.filter(~F.col("path").endswith("m.docx")), words(["le", "chien", "chat"]), words(["ŋa", "ŋi"]), "ŋ")
    assert sorted((r["kind"], r["src"], r["tgt"]) for r in pairs.collect()) == [
        ("paragraph", "le", "ŋa"), ("paragraph", "le chat : ŋu", "ku"), ("paragraph", "le chien", "ŋa ŋi"), ("paragraph", "x", "y"), ("table", "deux", "z"), ("table", "un", "x\ny"),
    ]
    assert sorted((r["line"], r["src"], r["tgt"], r["confidence"]) for r in doubtful.collect()) == [("mot", None, None, None), ("— : ku", "—", ": ku", 0.0)]


def test_listing_reads_no_content(spark, tmp_path):
    for model in ("m1", "m2"):
        for seed in (1, 2):
            folder = tmp_path / model / "e" / "C1" / f"seed{seed}"
            folder.mkdir(parents=True)
            (folder / "test_metrics.json").write_text("not json")
            (folder / "other.json").write_text("{}")
    (tmp_path / "test_metrics.json.bak").write_text("x")
    found = readers.listed(spark, str(tmp_path), "/test_metrics.json")
    assert "content" not in found.columns and "content:" not in found._jdf.queryExecution().executedPlan().toString()
    got = readers.with_run(found.withColumnRenamed("path", "_path"))
    assert sorted((r["model"], r["experiment"], r["condition"], r["seed"], r["length"]) for r in got.collect()) == [(m, "e", "C1", s, 8) for m in ("m1", "m2") for s in (1, 2)]


def test_drifting_types(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, 10, 1.5)], "k long, v int, w float").coalesce(1).write.parquet(f"{path}/a")
    spark.createDataFrame([(2, "x", 7, 0)], "k long, v string, w int, __index_level_0__ long").coalesce(1).write.parquet(f"{path}/b")
    spark.createDataFrame([(3, 4)], "k int, w long").coalesce(1).write.parquet(f"{path}/c")
    spark.createDataFrame([(4, 11, 2.5)], "k long, v int, w float").coalesce(1).write.parquet(f"{path}/e")
    t = readers.drifting(spark, path)
    assert t.dtypes == [("k", "bigint"), ("v", "string"), ("w", "double")]
    assert sorted(map(tuple, t.collect())) == [(1, "10", 1.5), (2, "x", 7.0), (3, None, 4.0), (4, "11", 2.5)]
    assert [readers.wider(x) for x in (["int", "int"], ["tinyint", "bigint"], ["bigint", "float"], ["int", "string"], ["date", "timestamp"], ["array<int>", "int"])] == ["int", "bigint", "double", "string", "timestamp", "string"]


def test_sections_go_on_over_splits(spark, tmp_path):
    grams = [f"-{1 + k / 1000}\tw{k}" for k in range(3_000)] + ["-0.5\ttwo words\t-0.1", "broken\tx", "-0.7"]
    pairs = [f"-{2 + k / 1000}\tw{k} w{k + 1}" for k in range(2_000)]
    text = "\n".join(["about -9\tthis model", "\\data\\", "ngram 1=3001", "ngram 2 = 2000", "", "\\1-grams:", *grams, "", "\\2-grams:", *pairs, "", "\\end\\", "-1\tbehind"])
    (tmp_path / "m.arpa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        t = L.read_arpa(spark, str(tmp_path))
        assert {r["n"]: r["count"] for r in t.groupBy("n").count().collect()} == {1: 3001, 2: 2000}
        assert t.filter("gram = 'two words'").collect() == [(1, "two words", -0.5, -0.1)]
        assert t.filter(f"n = 1 AND gram = 'w2999'").count() == t.filter("n = 2 AND gram = 'w1999 w2000'").count() == 1
        (tmp_path / "m.arpa").write_text(re.sub("ngram 1=3001", "ngram 1=3000", text))
        with pytest.raises(ValueError, match="3000, 3001"):
            L.read_arpa(spark, str(tmp_path))
        assert L.read_arpa(spark, str(tmp_path), check=False).count() == 5001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_entries_with_drifting_names(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"text": "", "prompt": "p"}\n{"target_text": "t", "prompt": "p"}\n{"other": 1}\nbroken {\n["text"]\n{"text": "a"}\n\n{"text": nul\n')
    assert sorted(r["text"] for r in readers.usable_texts(spark, str(tmp_path)).collect()) == ["a", "p", "t"]
