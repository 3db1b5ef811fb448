"""Guards, catalog matches and comparisons on rows made for their edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import sentences as S
from quern.functions import text as T
from quern.operators import catalog as C
from quern.operators import guards as G
from quern.operators import metrics as M
from quern.operators import sampling as Q
from quern.operators import systems as Y
from quern.scratch import materialize, release


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_word_edits_of_many_words(spark):
    many = [f"w{k}" for k in range(40_000)]
    rows = [(1, " ".join(many), " ".join(many[:-1] + ["x"])), (2, "a b a", "a a"), (3, None, "a b"), (4, "", ""), (5, "a", None)]
    got = {r["id"]: r["n"] for r in frame(spark, rows[1:], "id int, r string, h string").select("id", M.word_edits(F.col("r"), F.col("h")).alias("n")).collect()}
    assert got == {2: 1, 3: 2, 4: 0, 5: 1}
    codes = M._word_codes.func(*(__import__("pandas").Series([t.split()]) for t in rows[0][1:]))
    r, h = codes["ref"][0], codes["hyp"][0]
    assert len(set(r)) == 40_000 and sum(a != b for a, b in zip(r, h)) == 1 and not any(0xD800 <= ord(c) < 0xE000 for c in r)


def test_systems_that_differ_are_errors(spark):
    a = frame(spark, [(1, "s", "r", "p"), (2, "t", "r", "p")], "idx int, src string, ref string, pred string")
    b = a.withColumn("src", F.when(F.col("idx") == 2, "other").otherwise(F.col("src")))
    assert Y.aligned({"a": a, "b": a}).count() == 2
    with pytest.raises(Exception, match="differ at 2"):
        Y.aligned({"a": a, "b": b}).collect()
    refs = frame(spark, [("x", "c", "d"), ("x", "e", "f")], "sentence_id string, canonical string, alternative string")
    with pytest.raises(Exception, match="two canonical texts"):
        C.alternatives(refs).collect()


def test_fallback_and_exact_draws(spark):
    df = frame(spark, [(k, "train") for k in range(9)], "id int, split string")
    assert G.with_fallback(df, "split", ["id"], most=4).filter("split = 'dev'").count() == 4
    assert G.with_fallback(df.withColumn("split", F.lit("dev")), "split", ["id"]).count() == 9
    assert {r["split"] for r in Q.index_split(df.select("id"), "id").collect()} == {"train"}
    assert Q.plain_validation(df.select("id").limit(1), "id", 0.1).first()["split"] == "val"
    for n, k in ((9, 4), (3, 4), (1, 4), (0, 4)):
        got = Q.context_rows(df.select(F.col("id").alias("row")), df.filter(F.col("id") < n), "row", "id", k).collect()
        assert len(got) == 9 * min(n, k) == len({(r["row"], r["context"]) for r in got})


def test_poisson_weights(spark):
    got = spark.range(20_000).select(M.poisson_weight(Q.draw_number(5, F.col("id"))).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20_000 for r in got}
    assert abs(sum(w * s for w, s in share.items()) - 1) < 0.03 and abs(share[0] - 0.3679) < 0.015 and max(share) >= 4


def test_catalog_edges(spark):
    keys = ["run", "verb"]
    catalog = C.deduplicated(frame(spark, [("r", "v", "Il mange", 1), ("r", "v", "il  x", 2), ("r", "v", "il ne mange pas de pain", 3), ("r", "w", "il mange bien", 4)], "run string, verb string, french string, k int"), keys, "k")
    rows = [(1, "r", "v", "il mange"), (2, "r", "v", "Il mange une pomme"), (3, "r", "v", "il mange pas de pain demain"), (4, "r", "v", "il mangera"), (5, "r", "v", None), (6, "q", "v", "il mange"), (7, "r", "z", "il mange bien donc")]
    got = {r["id"]: (r["status"], r["clean"], r["residue"]) for r in C.matched(frame(spark, rows, "id int, run string, verb string, t string"), catalog, keys, ["run"], "id", "t").collect()}
    assert got[1] == ("fixed", "Il mange", "") and got[2] == ("moved_residue", "Il mange", "une pomme") and got[3] == ("moved_residue", "il ne mange pas de pain", "demain")
    assert got[4][0] == got[5][0] == got[6][0] == "no_match" and got[7] == ("moved_residue", "il mange bien", "donc")
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(C.prepended(F.lit("a  b"), F.lit("A b c"))) == "A b c" and one(C.prepended(F.lit(None).cast("string"), F.lit("t"))) == "t"
    assert tuple(one(C.without_record(F.lit("text 3\nM2\tx\ny"), "\\d+\\nM[1-5]\\t.*"))) == ("text", "3\nM2\tx\ny")


def test_slash_rules(spark):
    texts = ["e sɔsɔ/xɔxɔ?", "keke / ehun baci/eba.", "sɔ/xɔ un/deux", "x / y", "xɔ fini / sɔ fini", "ku te / xɔ te", "sɔ/sɔ", "/ a", ""]
    got = [tuple(r["s"]) for r in frame(spark, list(enumerate(texts)), "i int, x string").orderBy("i").select(S.slash_alternatives(F.col("x")).alias("s")).collect()]
    assert got == [
        ("e xɔxɔ?", "e sɔsɔ?", "normalized"), ("keke baci.", "ehun eba.", "normalized"), ("sɔ/xɔ un/deux", "", "needs_review"), ("x", "y", "normalized"), ("xɔ fini", "sɔ fini", "normalized"),
        ("xɔ te", "ku te", "normalized"), ("sɔ/sɔ", "", "needs_review"), ("/ a", "", "needs_review"), ("", "", "no_slash"),
    ]


def test_abbreviations_and_scratch(spark):
    texts = ["a b b b c", "x x x x x x x x", " ".join(f"w{k}" for k in range(40)), "short  text", "", None, "a a b b"]
    got = [tuple(r["a"]) for r in frame(spark, list(enumerate(texts)), "i int, x string").orderBy("i").select(T.abbreviated(F.col("x")).alias("a")).collect()]
    assert got == [("a b b b", True), ("x x x x x x", True), (" ".join(f"w{k}" for k in range(14)), True), ("short  text", False), ("", False), ("", False), ("a a b b", False)]
    materialize(spark.range(3), "numbers")
    assert release(spark) >= 1 and release(spark) == 0
