"""Token counts, packing and quality rules against the libraries and plain loops."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quern.llm import packing, quality, token_counts
from quern.llm.vocabularies import safe_word_vocabulary
from tests.llm.cases import documents, empty, multiset, words


def test_token_counts(spark):
    docs = documents(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in docs.collect():
        n = len(model.encode(r["text"] or ""))
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 4096))
    assert multiset(token_counts.token_counts(docs).collect()) == multiset(want)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_token_counts_of_odd_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["<s> </s><unk>", "a▁b ▁", "  lead", "trail  ", "\n\n x \n", "a\tb", "  x", "fi ﬁ Å", "\x00 nul", "<0x0A>", " "]
    rows = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    assert [rows[k] for k in range(len(odd))] == [len(model.encode(t)) for t in odd]


def test_packing_round_trip(spark):
    docs = documents(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.append((r["doc_id"], k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.packed_documents(docs).collect()
    assert multiset(r[:5] for r in got) == multiset(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(w[3] for w in want) // 4096)  # no packing has fewer sequences
    assert packing.packed_documents(empty(spark)).count() == 0


def test_special_strings_in_any_case(spark):
    """The library takes special strings before it lowers capitals: only the exact ones are one id."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "A<|endoftext|>B C", "<|StartOfText|><|startoftext|>", "<| x |> <|", "ONE <|endoftext|>\nTwo", "İstanbul É <|X", "e\u0301 \u0301x"]
    rows = {r["doc_id"]: bytes(r["ids"]) for r in packing.tokenized_pieces(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), keep_ids=True).collect()}
    assert [rows[k] for k in range(len(odd))] == [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in odd]
    assert safe_word_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_of_one_length_meet_their_own_places(spark):
    """Many combinations use the same filler length; each piece gets one place."""
    rows = [(k, 0, 0, n, 7) for k, n in enumerate([3000 - 7 * j for j in range(150)] + [5] * 3000 + [4096] * 3)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096


def test_minimum_bin_slack_takes_the_fullest():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 30, 5)}
        gap = int(rng.integers(0, 60))
        chosen = packing.fullest(gap, counts, sorted(counts, reverse=True))
        best = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(a * b for a, b in zip(c, counts))) <= gap)
        assert sum(a * n for a, n in chosen.items()) == best
        assert all(n <= counts[a] for a, n in chosen.items())


def base_counts(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_base_counts(spark):
    docs = documents(spark)
    got = quality.quality_rules(docs).collect()
    assert multiset(r[:7] for r in got) == multiset((r["doc_id"], *base_counts(r["text"])) for r in docs.collect())
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_bands_reject_other_writing_and_keep_prose(spark):
    rng = np.random.default_rng(2)
    vocabulary = "the house stands near river and people walk along old road every morning while birds sing above green fields".split()
    prose = [" ".join(rng.choice(vocabulary, 120)) for _ in range(300)]
    junk = ["".join(chr(int(c)) for c in rng.integers(0x12000, 0x12300, 6)) for _ in range(300)]
    rows = [(k, t, "en") for k, t in enumerate(prose)] + [(1000, " ".join(rng.permutation(junk)), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[1000]
    assert sum(got.values()) >= 295


def test_fertility_measures(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in documents(spark).join(quality.text_measures(documents(spark).select("doc_id", "text", "lang")).drop("lang"), "doc_id").collect():
        ids = model.encode(r["text"] or "")
        if not ids:
            assert r["chars_per_token"] is None and r["byte_share"] is None and r["token_entropy"] is None
            continue
        assert r["n_tokens"] == len(ids)
        assert abs(r["chars_per_token"] - len(r["text"]) / len(ids)) < 1e-9
        p = np.array(list(Counter(ids).values())) / len(ids)
        assert abs(r["token_entropy"] - float(-(p * np.log2(p)).sum() / np.log2(len(ids) + 1))) < 1e-9


PROSE = "the house stands near river and people walk along old road every morning while birds sing above green fields".split()


def test_copies_leave_the_bands_as_they_are(spark):
    """Of 400 texts from plain prose to nearly half random words, the middle one is repeated to two thirds of all rows."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    odd = lambda: "".join(rng.choice(letters, 7))
    rows = [(k, " ".join(odd() if rng.random() < k / 1000 else str(rng.choice(PROSE)) for _ in range(120)), "en") for k in range(400)]
    many = rows + [(1000 + k, rows[200][1], "en") for k in range(800)]
    kept = lambda r: {x["doc_id"]: x["kept"] for x in quality.quality_rules(spark.createDataFrame(r, "doc_id long, text string, lang string")).filter("doc_id < 1000").collect()}
    first = kept(rows)
    assert kept(many) == first and sum(first.values()) >= 395


def test_small_groups_are_not_judged_by_other_languages(spark):
    rng = np.random.default_rng(6)
    greek = "το σπίτι στέκεται κοντά στο ποτάμι και οι άνθρωποι περπατούν στον παλιό δρόμο κάθε πρωί ενώ πουλιά τραγουδούν".split()
    vietnamese = "ngôi nhà đứng gần dòng sông và người ta đi bộ dọc con đường cũ mỗi buổi sáng khi chim hót trên cánh đồng".split()
    text = lambda words: " ".join(rng.choice(words, 120))
    rows = [(-1 - k, text(PROSE), "en") for k in range(1500)]
    for k, (words, lang, n) in enumerate(((greek, "el", 60), (greek, None, 30), (vietnamese, "vi", 30), (greek, "xx", 1))):
        rows += [(1000 * (k + 1) + j, text(words), lang) for j in range(n)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    judged = [r for r in got if r["doc_id"] >= 1000 and not r["base_failed"]]
    assert len(judged) > 100
    assert all(r["kept"] for r in judged)


def test_dominant_script():
    scripts = quality._Scripts()
    cases = {"plain words": "LATIN", "12 - 3": "", "": "", "é à": "LATIN", "δρόμο road δρόμο": "GREEK", "ひらがなカタカナ漢字": "KANA", "漢字 ok 漢": "CJK", "🙂 €": ""}
    assert {t: quality.dominant_script(t, scripts) for t in cases} == cases


def test_verdict_is_that_of_plain_quantiles(spark):
    """kept against quantiles of sorted lists of each group's distinct texts, reckoned in plain loops from the same measures."""
    import math

    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    odd = lambda: "".join(rng.choice(letters, 7))
    rows = [(k, " ".join(odd() if rng.random() < (k % 50) / 60 else str(rng.choice(PROSE)) for _ in range(90)), ("en", "de", None)[k % 3]) for k in range(240)]
    rows += [(1000 + k, "".join(chr(0x12000 + j % 300) + " " for j in range(k, k + 80)), "en") for k in range(2)] + rows[:30]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    text = {i: (t, lang) for i, t, lang in rows}
    group = lambda i: f"lang:{text[i][1]}" if text[i][1] else "script:LATIN"
    measures = {r["doc_id"]: [r[m] for m in quality.MEASURES] for r in got}
    passed = {r["doc_id"] for r in got if not r["base_failed"]}
    bands, stats = {}, defaultdict(dict)
    for g in {group(i) for i in passed}:
        own = {text[i][0]: measures[i] for i in passed if group(i) == g}
        for k, m in enumerate(quality.MEASURES):
            v = sorted(round(x[k] * 10_000) / 10_000 for x in own.values())
            stats[g][m] = (len(v), [v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.5, 0.75)])
    for m in quality.MEASURES:
        part = lambda mid: 1.0 if m == "byte_share" else mid  # noqa: B023, E731
        total = sum(s[m][0] for s in stats.values())
        spread = [sum(s[m][0] * abs(s[m][1][1] - s[m][1][side]) / part(s[m][1][1]) for s in stats.values()) / total for side in (0, 2)]
        for g, s in stats.items():
            n, (low, mid, high) = s[m]
            wide = 8.0 * math.sqrt(max(1.0, 200 / n))
            least = 0.01 if m == "byte_share" else 0.05 * mid
            bands[g, m] = (mid - max((mid - low) * wide, spread[0] * part(mid) * wide, least), mid + max((high - mid) * wide, spread[1] * part(mid) * wide, least))
    for r in got:
        want = r["doc_id"] in passed and all(bands[group(r["doc_id"]), m][0] <= x <= bands[group(r["doc_id"]), m][1] for m, x in zip(quality.MEASURES, measures[r["doc_id"]]))
        assert r["kept"] == want, r
