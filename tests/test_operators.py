"""Operators without SQL against plain versions and round trips on small rows."""

from __future__ import annotations

import io
import math
import time
import wave
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import predicates as P
from quern.functions import sentences as S
from quern.functions.text import french_number, numbers_to_words
from quern.operators import audio as A
from quern.operators import ngram_models as L
from quern.operators import sampling as Q
from quern.operators import scores as K
from quern.operators.audit import audit
from quern.sources import readers, writers


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).coalesce(1).select(column).collect()]


def test_sentences(spark):
    x = F.col("x")
    texts = ["Je mange du riz", "je n'ai pas d'argent", "Où vas-tu?", "D'où viennent-elles?", "Que fait-il ?", "12. Elle est allée au marché", "Nous allons boire de l'eau", "Où est-ce que vous voyez?", "j'achète", "", None]
    assert values(spark, S.detect_module(x), texts) == ["M1", "M2", "M5", "M5", "M5", "M3", "M4", "M5", "M1", "M1", None]
    assert values(spark, S.subject_pronoun(x), texts) == ["je", "je", "tu", "elles", "il", "elle", "nous", "vous", "je", None, None]
    assert values(spark, S.detect_verb(x, S.detect_module(x)), texts) == ["manger", "avoir", "aller", "venir", "faire", "aller", "boire", "voir", "acheter", None, None]
    assert values(spark, S.detect_verb(x, S.detect_module(x), "partie2"), texts)[0] is None
    assert values(spark, S.module_number(x), ["M3", " module5_questions_dedup", "x", None]) == [3, 5, None, None]
    assert values(spark, S.negate(x), ["j'ai faim", "tu vas", "tu manges du riz", "oui", None]) == ["je n'ai pas faim", "tu ne vas pas", "tu ne manges pas du riz", "oui", None]


def test_slashes(spark):
    got = values(spark, S.slash_alternatives(F.col("x")), ["e sɔ / xɔ fini", "a b", "e xɔ fini/ ku fini", "ŋu sɔ te / xɔ te", "un / deux", "a/b/c", "a / a", None])
    assert [None if g is None else tuple(g) for g in got] == [
        ("e xɔ fini", "e sɔ fini", "normalized"), ("a b", "", "no_slash"), ("e xɔ fini", "ku fini", "normalized"), ("ŋu xɔ te", "ŋu sɔ te", "normalized"),
        ("un", "deux", "normalized"), ("a/b/c", "", "needs_review"), ("a / a", "", "needs_review"), None,
    ]


def test_predicates(spark):
    x = F.col("x")
    assert values(spark, P.numbered_lines(x), ["1. a\nb\n 2) c ", "", None]) == [["a", "c"], [], None]
    assert [[tuple(t) for t in r] for r in values(spark, P.targets(x), ["hf://a/b:main, x/y,", "https://h/p"])] == [[("hf://a/b", "main"), ("x/y", "y")], [("https://h/p", "p")]]
    assert values(spark, P.codec_ids(x, "s"), ["<|s_12|>a<|t_3|><|s_4|>", "", None]) == [[12, 4], [], None]
    assert values(spark, P.likely_question(x), ["Où vas-tu", "Quelqu'un", "il va"]) == [True, True, False]


def test_scores(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat", ["the cat sat on the mat"]), (2, "a b", ["c d"]), (3, None, ["x"]), (4, "the cat is here", ["the cat was here", "a cat is here now"])], "k int, h string, r array<string>")
    got = {r["k"]: r for r in K.corpus_scores(d, "h", "r", ["k"]).collect()}
    assert got[1]["bleu"] == got[1]["chrf"] == got[1]["chrfpp"] == 100.0
    assert got[2]["bleu"] == got[3]["bleu"] == got[3]["chrf"] == 0.0
    # 4 of 4 words, 3 of 3 pairs (two from the second reference), 1 of 2 triples, none of 1 (a half); as long as the first reference
    assert math.isclose(got[4]["bleu"], 100 * (1 * 1 * 1 / 2 * 1 / 2) ** 0.25, abs_tol=1e-3)
    s = K.sentence_scores(d.select("k", "h", F.when(F.col("k") != 3, F.col("r")[0]).alias("r")), "h", "r")
    assert {r["k"]: r["sentence_bleu"] for r in s.collect()}[3] is None
    assert K.words_13a("Hi, it's 3.5 (ok).") == ["Hi", ",", "it's", "3.5", "(", "ok", ")", "."]


def test_edits(spark):
    d = spark.createDataFrame([("a b c d", "a x c"), ("", "a b"), (None, None), ("b a c", "c b a")], "r string, h string")
    assert [tuple(r[0]) for r in d.coalesce(1).select(K.word_operations("r", "h")).collect()] == [(1, 0, 1, 4), (0, 2, 0, 0), (0, 0, 0, 0), (0, 1, 1, 3)]
    assert [tuple(r[0]) for r in d.coalesce(1).select(K.translation_edits("h", "r")).collect()] == [(2, 4), (2, 0), (0, 0), (1, 3)]
    assert [round(r[0], 3) for r in d.coalesce(1).select(K.rouge_l("r", "h")).collect()] == [57.143, 0.0, 0.0, 66.667]


def test_wilcoxon(spark):
    a = [1.1, 2.3, 3.7, 4.1, 5.9, 7.2]
    d = spark.createDataFrame([("x", v, 0.0) for v in a] + [("y", 1.0, 0.5), ("y", 2.0, 1.0)] + [("z", 1.0, 1.0)] * 6, "k string, a double, b double")
    got = {r["k"]: r for r in K.wilcoxon(d, "a", "b", ["k"]).collect()}
    assert got["x"]["w_plus"] == 21 and got["x"]["p_value"] == 2 / 64  # all signs alike: two of 2^6 ways
    assert got["y"]["p_value"] is None and got["z"]["p_value"] == 1.0


def test_language_models(spark, tmp_path):
    (tmp_path / "m.arpa").write_text("\\data\\\nngram 1=4\n\n\\1-grams:\n-1.0\t<unk>\n-0.5\ta\t-0.2\n-0.6\t</s>\n-9\t<s>\t-0.1\n\n\\2-grams:\n-0.3\t<s> a\n\n\\end\\\n")
    model = L.read_arpa(spark, str(tmp_path / "m.arpa"))
    assert model.count() == 5
    d = spark.createDataFrame([(1, "a"), (2, "b a"), (3, ""), (4, None)], "k int, x string")
    got = dict(map(tuple, L.backoff_scores(d, "k", F.filter(F.split("x", " "), lambda w: w != ""), model, 2).collect()))
    # a after <s>, then the end behind a's backoff; an unknown word behind <s>'s backoff, a behind none, the end behind a's
    assert got == {1: -0.3 - 0.2 - 0.6, 2: round(-0.1 - 1.0 - 0.5 - 0.2 - 0.6, 6), 3: -99.0, 4: -99.0}
    assert values(spark, L.ctc_collapse(F.col("x")), [[1, 1, 0, 1, 2, 2], [0], []], "x array<int>") == [[1, 1, 2], [], []]
    assert values(spark, L.greedy_labels(F.col("x")), [[[0.1, 0.9], [0.2, 0.8], [0.5, 0.5]]], "x array<array<double>>") == [[1]]
    runs = values(spark, L.repeated_runs(F.split("x", " ")), ["a a b b b b a a a", "a b", "x x x"])
    assert [r and tuple(r) for r in runs] == [("b", 2, 4), None, ("x", 0, 3)]


def test_prefix_beam(spark, tmp_path):
    """Against sums over all paths, alone and fused with a model that is read from a file."""
    rng = np.random.default_rng(3)
    names = ["_", "a", "b", "c"]
    (tmp_path / "m.arpa").write_text("\\data\\\nngram 1=6\nngram 2=3\n\n\\1-grams:\n-2.0\t<unk>\n-0.5\ta\t-0.2\n-0.9\tb\t-0.1\n-0.6\t</s>\n-9\t<s>\t-0.1\n-1.5\tc\n\n\\2-grams:\n-0.3\t<s> a\n-0.2\ta b\n-0.4\tb </s>\n\n\\end\\\n")
    model = L.read_arpa(spark, str(tmp_path / "m.arpa"))
    frames = [rng.normal(size=(5, 4)) * 2 for _ in range(6)]
    rows = [(k, f.tolist()) for k, f in enumerate(frames)] + [(6, None), (7, [])]
    df = spark.createDataFrame(rows, "k int, f array<array<double>>")
    whole = []
    for f in frames:
        logs = f - np.log(np.exp(f).sum(axis=1, keepdims=True))
        mass: dict = {}
        for path in product(range(4), repeat=5):
            labels = tuple(x for i, x in enumerate(path) if x and (not i or path[i - 1] != x))
            mass[labels] = mass.get(labels, 0.0) + math.exp(sum(logs[t][x] for t, x in enumerate(path)))
        whole.append({labels: math.log(p) for labels, p in mass.items()})
    assert len(whole[0]) < 400
    for got, want in zip((L.prefix_beam(f, 400) for f in frames), whole):
        assert {labels for labels, _ in got} == set(want) and all(math.isclose(p, want[labels], abs_tol=1e-9) for labels, p in got)
        assert np.allclose([p for _, p in got], sorted(want.values(), reverse=True))
    narrow = L.prefix_beam(frames[0], 3)
    assert len(narrow) == 3 and all(p <= whole[0][labels] + 1e-9 for labels, p in narrow)
    got = L.beam_candidates(df, "k", "f", names, width=400, model=model, alpha=0.7, beta=0.3).collect()
    assert {r["k"] for r in got} == set(range(6))
    texts = sorted({r["text"] for r in got})
    lm = dict(map(tuple, L.backoff_scores(spark.createDataFrame([(t,) for t in texts], "t string"), "t", F.filter(F.split("t", " "), lambda w: w != ""), model, 2).collect()))
    lm[""] = -0.1 - 0.6  # the end right behind the start
    for k in range(6):
        want = {" ".join(names[x] for x in labels): a + math.log(10) * 0.7 * lm[" ".join(names[x] for x in labels)] + 0.3 * len(labels) for labels, a in whole[k].items()}
        mine = [r for r in got if r["k"] == k]
        assert all(math.isclose(r["fused"], want[r["text"]], abs_tol=1e-5) for r in mine)
        assert max(mine, key=lambda r: r["fused"])["rank"] == 1 and math.isclose(mine[0]["fused"], max(want.values()), abs_tol=1e-5)
    # candidates without the model, rescored by joins, give the same best text
    plain = L.beam_candidates(df, "k", "f", names, width=400)
    scored = plain.join(spark.createDataFrame(list(lm.items()), "text string, lm double"), "text")
    best = {r["k"]: r["text"] for r in L.rescore(scored.select("k", "text", "acoustic", "lm"), "k", [math.log(10) * 0.7], [0.3]).collect()}
    assert all(best[k] == next(r["text"] for r in got if r["k"] == k and r["rank"] == 1) for k in range(6))
    with pytest.raises(ValueError):
        L.beam_candidates(df, "k", "f", names, model=model, most_entries=3)


def test_cover_is_the_plain_greedy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 600)) for k in range(2_000)]
    sets, covered, want = {k: set(t.split()) for k, t in rows}, set(), []
    while len(want) < 700:
        k = min((k for k in sets), key=lambda k: (-len(sets[k] - covered), k))
        gain = len(sets[k] - covered)
        want.append((len(want) + 1, k, gain))
        covered |= sets.pop(k)
    assert want[-1][2] == 0  # words run out, rows follow by key
    df = spark.createDataFrame(rows, "k int, t string")
    words = F.filter(F.split("t", " "), lambda w: w != "")
    assert sorted(map(tuple, Q.covering(df, "k", words, 700).collect())) == want
    assert sorted(map(tuple, Q.covering(df, "k", words, 60, candidates=7).collect())) == want[:60]
    assert sorted(map(tuple, Q.covering(df, "k", words, 30, candidate_words=50).collect())) == want[:30]
    assert Q.covering(df.limit(0), "k", words, 5).count() == 0 and Q.covering(df.limit(3), "k", words, 5).count() == 3


def test_edits_with_shifts():
    """Worked by hand: shifts cost one each, spans move whole, a shift that saves nothing isn't made."""
    cases = [
        ("b c d a", "a b c d", 1), ("a b c d", "a b c d", 0), ("c d e a b", "a b c d e", 1), ("x a b", "a b", 1), ("a b", "a b x y", 2), ("d c b a", "a b c d", 3),
        ("this is a test of this", "this of is a test this", 1), ("e f a b c d g h", "a b c d e f g h", 1), ("a x c", "a b c", 1), ("", "a b", 2), ("a b", "", 2),
    ]
    assert [(h, r, K.shifted_edits(h.split(), r.split())) for h, r, _ in cases] == cases
    rng = np.random.default_rng(8)
    took, edits = [], []
    for _ in range(40):
        ref = [f"w{int(x)}" for x in rng.zipf(1.6, 60) % 200]
        hyp = [w for w in ref if rng.random() > 0.1]
        at = int(rng.integers(0, len(hyp) - 8))
        hyp = hyp[:at] + hyp[at + 4 :] + hyp[at : at + 4]
        began = time.process_time()
        edits.append(K.shifted_edits(hyp, ref))
        took.append(time.process_time() - began)
        assert edits[-1] <= K._table(hyp, ref)[-1, -1]
    assert sorted(took)[20] < 0.05


def test_several_references(spark):
    """chrF takes the reference of the highest score for each row, for each number of word orders."""
    d = spark.createDataFrame([(1, "the cat is here", ["nothing like it", "the cat is here"]), (2, "a b", []), (3, "one two", [None, "one"])], "k int, h string, r array<string>")
    got = {r["k"]: r for r in K.corpus_scores(d, "h", "r", ["k"]).collect()}
    assert got[1]["chrf"] == got[1]["chrfpp"] == 100.0 and got[2]["chrf"] == 0.0 and 0 < got[3]["chrf"] < 100
    one = {r["k"]: r for r in K.corpus_scores(d.withColumn("r", F.slice("r", 2, 1)), "h", "r", ["k"]).collect()}
    assert one[3]["chrf"] == got[3]["chrf"]


def test_audio(spark, tmp_path):
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(b"".join(v.to_bytes(2, "little", signed=True) for v in (16384, 0, -32768, -32768)))
    (tmp_path / "a.wav").write_bytes(data.getvalue())
    (tmp_path / "b.wav").write_bytes(b"no sound")
    got = {r["path"][-5:]: (r["samples"], r["rate"]) for r in readers.waveforms(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": ([0.25, -1.0], 8000), "b.wav": (None, None)}
    x = F.col("x")
    assert values(spark, A.resampled(x, 4, 2), [[0.0, 1.0, 2.0, 3.0], [5.0, 6.0], []], "x array<float>") == [[0.0, 3.0], [5.0], []]
    assert [(r["policy"], [round(v, 4) for v in r["samples"]]) for r in values(spark, A.scaled(x), [[0.5], [655.36], [1e6, -5e5], [0.0], [float("nan")], []], "x array<float>")] == [
        ("already_float_minus1_to_1", [0.5]), ("integer_like_divide_by_65536", [0.01]), ("peak_normalized_to_0p98", [0.98, -0.49]), ("zero_peak", [0.0]), ("silent_or_non_finite", [0.0]), ("silent_or_non_finite", []),
    ]
    flat = list(range(7)) + [0, 9, 9, 9, 9, 9, 9] + [5] * 7 + list(range(7))
    assert values(spark, A.without_repeats(x), [flat, []], "x array<int>") == [list(range(7)) + [5] * 7 + list(range(7)), []]
    with pytest.raises(Exception, match="whole frames"):
        values(spark, A.without_repeats(x), [[1, 2]], "x array<int>")


def test_samples(spark):
    d = spark.createDataFrame([(k, "a" if k % 3 else "b", f"w{k % 5} v{k % 7}") for k in range(40)], "k int, s string, x string")
    got = Q.shuffled_pairs(d, "s", F.col("k") < 4, "k", "s", "x").collect()
    assert sorted(r["x"] for r in got) == sorted(r["x"] for r in d.collect()) and len({r["k"] for r in got}) == 40
    assert all(r["x"] == f"w{r['k'] % 5} v{r['k'] % 7}" for r in got if r["k"] < 4)
    cover = Q.covering(d, "k", F.split("x", " "), 9).collect()
    assert [(r["k"], r["gain"]) for r in cover][:2] == [(0, 2), (1, 2)] and sum(r["gain"] for r in cover) == 12
    assert Q.validation_split(d, ["s"], F.col("k"), 0.0).filter("split = 'val'").count() == 0
    c = Q.context_rows(d, d, "k", "k", 3).groupBy("k").count().collect()
    assert len(c) == 40 and all(1 <= r["count"] <= 3 for r in c)


def test_more_readers_and_writers(spark, tmp_path):
    assert readers.pick_any_case(["x", "FRENCH", "Target"]) == ("FRENCH", "Target") and readers.pick_any_case(["a", "b"]) == ("a", "b")
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\n")
    assert readers.tabular(spark, str(tmp_path / "t.tsv")).collect() == [("1", "nan")]
    (tmp_path / "r.jsonl").write_text('{"idx": 1, "v": "a"}\n{"idx": 2, "v": "b"}\n{"idx": 1, "v": "c"}\n')
    assert sorted(map(tuple, readers.last_by_index(spark, str(tmp_path / "r.jsonl")).collect())) == [(1, "c"), (2, "b")]
    with pytest.raises(ValueError):
        readers.records(spark, str(tmp_path / "r.jsonl"), ["w"])
    for seed in (1, 2):
        (tmp_path / f"runs/m/exp1/FULL/seed{seed}").mkdir(parents=True)
        (tmp_path / f"runs/m/exp1/FULL/seed{seed}/m.json").write_text(f'{{"bleu": {seed}.5}}')
    got = readers.metric_files(spark, str(tmp_path / "runs"), "m.json").select("model", "experiment", "condition", "seed", "bleu")
    assert sorted(map(tuple, got.collect())) == [("m", "exp1", "FULL", 1, 1.5), ("m", "exp1", "FULL", 2, 2.5)]
    (tmp_path / "p.txt").write_text("1. a: b : - c\nnothing\n")
    assert readers.paragraph_pairs(spark, str(tmp_path / "p.txt")).collect() == [("a: b", "c")]
    (tmp_path / "man.tsv").write_text("p\tt\nx\ty\nz\t\nw\n")
    assert readers.manifest(spark, str(tmp_path / "man.tsv"), ["p", "t"]).collect() == [("x", "y")]
    d = spark.createDataFrame([(2, "b\tc", None), (1, "a", "z"), (3, "d", "e")], "i int, s string, t string")
    writers.aligned(d, "i", ["s", "t"], str(tmp_path / "al"))
    read = lambda c: [line for p in sorted((tmp_path / "al" / c).glob("_part=*/part-*")) for line in p.read_text().split("\n")[:-1]]
    assert read("s") == ["a", "b\\tc", "d"] and read("t") == ["z", "", "e"]
    writers.union_of_keys([d.select("i"), d.select("t")], str(tmp_path / "u"))
    assert spark.read.csv(str(tmp_path / "u"), header=True).columns == ["i", "t"]
    assert writers.summary(d, "t").collect()[0][0] == '{"total":3,"by":{"e":1,"null":1,"z":1}}'


@pytest.mark.parametrize(("n", "words"), [(0, "zéro"), (21, "vingt et un"), (71, "soixante et onze"), (80, "quatre-vingts"), (81, "quatre-vingt-un"), (91, "quatre-vingt-onze"), (99, "quatre-vingt-dix-neuf"), (200, "deux cents"), (201, "deux cent un"), (1000, "mille"), (1100, "mille cent"), (80_000, "quatre-vingt mille"), (200_000, "deux cent mille"), (2_000_080, "deux millions quatre-vingts")])
def test_french_numbers(n, words):
    assert french_number(n) == words


def test_numbers_inside_words_and_other_languages_stay(spark):
    df = spark.createDataFrame([("x12 et 3.05 de 16",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(numbers_to_words(F.col("t"), "fr")).collect()] == ["x12 et trois virgule zéro cinq de seize", None, ""]
    assert [r[0] for r in df.select(numbers_to_words(F.col("t"), "ee")).collect()] == ["x12 et 3.05 de 16", None, ""]


def test_audit_of_null_and_blank_sides(spark):
    """A told boundary isn't judged, null sides are empty, an equal line is reported once, and brackets move with the prefix."""
    rows = [(1, "f", "r", "il va", "sur le champ) mi wo", "lexicon_split"), (2, "f", "r", "il va", "sur le champ) mi wo", "lexicon_split"), (3, "f", "r", "il va", "sur le champ", "colon"), (4, "f", None, None, None, "lexicon_split"), (5, "f", "ɖɛ", "ɖɛ", "xyz", "lexicon_split")]
    df = spark.createDataFrame(rows, "id long, source string, raw string, src string, tgt string, method string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = {(r["id"], r["issue"]): (r["confidence"], r["suggested_src"], r["suggested_tgt"]) for r in audit(df, "id", words("va"), words("wo"), F.lit(None).cast("string")).collect()}
    assert got == {
        (1, "source_prefix_in_target"): ("high", "il va sur le champ)", "mi wo"), (4, "empty_target"): ("needs-human", "", ""),
        (5, "target_letters_in_source"): ("high", "", ""), (5, "no_target_evidence"): ("needs-human", "", ""),
    }
