"""Reports as they are written: order of lines, empty tables, nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import reports as R
from quern.sources import readers, writers


def written(spark, rows, path) -> list[str]:
    writers.ordered_lines(rows, str(path))
    return [line for p in sorted(path.glob("part-*")) for line in p.read_text().split("\n")[:-1]]


def test_lists(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", "one"), (2, "a", "two\nlines"), (3, "b", None), (10, "b", "ten")], "i int, m string, t string")
    rule = "=" * 60
    assert written(spark, R.by_section(rows, "i", "m", "t"), tmp_path / "s") == [rule, "A (1 sentences)", rule, "", "2. two\\nlines", "", "", rule, "B (3 sentences)", rule, "", "1. one", "3. ", "10. ten", "", ""]
    assert written(spark, R.template(rows.filter("i > 2"), "i", "t", "T", "H"), tmp_path / "t") == ["T", rule, "H", rule, "", "3. ", "   → ", "", "10. ten", "   → ", ""]
    assert written(spark, R.template(rows.limit(0), "i", "t", "T", "H"), tmp_path / "e") == ["T", rule, "H", rule, ""]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", "x", 1.25), (2, "m", "x", None), (3, "m", "y|z", 2.0), (1, "n", "x", 3.0)], "i int, s string, c string, v double")
    v = F.format_string("%.1f", "v")
    cells = [F.col("c"), F.when(F.col("v").isNotNull(), v)]
    got = written(spark, R.latex_table(rows, "s", "i", "lr", ["C", "V"], cells, "Cap", "tab:x"), tmp_path / "l")
    assert got[:7] == ["\\begin{table*}[t]", "\\centering\\small", "\\caption{Cap}", "\\label{tab:x}", "\\begin{tabular}{lr}", "\\toprule", "C & V \\\\"]
    assert got[7:] == ["\\midrule", "\\multicolumn{2}{l}{\\textit{m}} \\\\", "\\midrule", "x & 1.3 \\\\", " & -- \\\\", "y|z & 2.0 \\\\", "\\midrule", "\\multicolumn{2}{l}{\\textit{n}} \\\\", "\\midrule", "x & 3.0 \\\\", "\\bottomrule", "\\end{tabular}", "\\end{table*}"]
    m = written(spark, R.markdown_table(rows.filter("s = 'm'"), "i", ["C", "V"], cells, "Title"), tmp_path / "m")
    assert m == ["## Title", "", "| C | V |", "|---|---|", "| x | 1.3 |", "| x | — |", "| y\\|z | 2.0 |"]


def test_running_text(spark, tmp_path):
    rows = [(k, f" word{k}a word{k}b \n") for k in range(200)] + [(300, "  "), (301, None), (302, "end")]
    writers.paragraph(spark.createDataFrame(rows, "i int, t string").repartition(7), "i", "t", str(tmp_path / "p"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    assert text == " ".join([*(f"word{k}a word{k}b" for k in range(200)), "end"]) + " "


def test_vocabularies_and_pools(spark):
    side = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = R.vocabulary_sets({"a": side(["x", "y", "y", None]), "b": side(["y", "z", "u"])}).first().asDict()
    assert got == {"a_words": 2, "b_words": 3, "both": 1, "either": 4, "a_only": 1, "b_only": 2, "both_percent": 100 / 3, "b_only_percent": 200 / 3}
    assert R.vocabulary_sets({"a": side(["x"]), "b": side([])}).first()["both_percent"] == 0.0
    assert sorted(r[0] for r in R.words_of({"a": side(["x", "y"]), "b": side(["y", None])}, "a").collect()) == ["x"]
    d = spark.createDataFrame([("A", 1.0, 10), ("A", 2.0, 20), ("B", 4.0, 31), ("C", None, 5)], "c string, v double, n int")
    got = {r["pool"]: tuple(r)[1:] for r in R.pooled(d, "c", {"p": ["A", "B"], "q": ["B"], "r": ["C"]}, ["v"], "n").collect()}
    assert got == {"p": (3, 20, 2.3, 1.5), "q": (1, 31, 4.0, None), "r": (1, 5, None, None)}


def test_normal_forms(spark):
    d = spark.createDataFrame([(1, "é", None), (2, "é", "a"), (3, None, "ﬁ")], "k int, x string, y string")
    assert {(r["k"], r["column"]): tuple(r)[2:] for r in R.normal_form_diagnosis(d, "k", ["x", "y"]).collect()} == {(1, "x"): (2, 2, 1, True, True), (2, "x"): (1, 2, 1, True, False), (2, "y"): (1, 1, 1, False, False), (3, "y"): (1, 1, 1, False, False)}
    assert [tuple(r) for r in R.normal_form_changes(d, "k", ["x", "y"]).collect()] == [(1, "x", "é", "é", 2, 1, 1)]
    got = {r["column"]: tuple(r)[1:] for r in R.normal_form_summary(d, "k", ["x", "y"]).collect()}
    assert got == {"x": (3, 1, 100 / 3, 1), "y": (3, 0, 0.0, 0)}


def test_checkpoints(spark, tmp_path):
    d = spark.createDataFrame([(1, " u1 "), (2, "u2"), (3, " "), (4, None), (5, "u5")], "k int, url string")
    path = str(tmp_path / "c")
    assert sorted(r["k"] for r in readers.unfinished(d, "url", path).collect()) == [1, 2, 5]
    writers.checkpointed(d.filter("k < 2 OR k = 3"), "url", path)
    assert sorted(r["k"] for r in readers.unfinished(d, "url", path).collect()) == [2, 5]
    writers.checkpointed(d.filter("k = 5"), "url", path)
    assert sorted(r["k"] for r in readers.unfinished(d, "url", path).collect()) == [2]
