"""Learned operators: held-out accuracy, distributions and awkward rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import brown, language, toxicity
from tests.llm.cases import documents, empty, lower, multiset, words

SF = "/root/testdata/sf0.01"


def test_toxicity_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows) / len(rows)
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert right > 0.93 and sum(caught) / len(caught) > 0.7
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in range(12, 60)] + [(3, None), (None, 1), (12, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, F.col("doc_id") % 3 == 1)
    assert got.count() == docs.count()
    assert got.filter("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL OR predicted <> CAST(score >= 0.7 AS int)").count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0), F.lit(False)).count() == docs.count()
    assert toxicity.score_toxicity(empty(spark), labels, F.lit(False)).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    got = language.identify(docs, F.col("doc_id") % 5 == 0).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}
    assert language.identify(empty(spark), F.lit(False)).count() == 0


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    texts, labels = [bytes(rng.integers(97, 110, 20).tolist()) for _ in range(40)], ["a", "b"] * 20
    before = language.train(texts, labels, epochs=0, size=10)
    after = language.train(texts, labels, epochs=60, size=10)

    def loss(net):
        p = language.pooled(net, texts)
        return -np.log(p[np.arange(40), [net.labels.index(x) for x in labels]] + 1e-9).mean()

    assert loss(after) < 0.8 * loss(before)


def test_backpropagation_matches_differences():
    """Gradients of a weighted sum of all states against differences of that sum."""
    rng = np.random.default_rng(1)
    table, u, x = rng.normal(0, 0.5, (257, 9)), rng.normal(0, 0.5, (3, 9)), rng.integers(0, 5, (7, 4))
    weights = rng.normal(0, 1, (7, 4, 3))

    def total(t, v):
        h, out = np.zeros((4, 3)), 0.0
        for k in range(7):
            a, b = t[x[k]], h @ v
            z, r = 1 / (1 + np.exp(-(a[:, :3] + b[:, :3]))), 1 / (1 + np.exp(-(a[:, 3:6] + b[:, 3:6])))
            c = np.tanh(a[:, 6:] + r * b[:, 6:])
            h = z * h + (1 - z) * c
            out += (h * weights[k]).sum()
        return out

    states, kept = language._run(table.astype(np.float32), u.astype(np.float32), x, True)
    d_table, d_u = language._back(table.astype(np.float32), u.astype(np.float32), x, states, kept, weights.astype(np.float32))
    for grad, base, other in ((d_u, u, lambda v: total(table, v)), (d_table, table, lambda t: total(t, u))):
        for i in range(min(5, len(base))):
            for j in range(9):
                up, down = base.copy(), base.copy()
                up[i, j] += 1e-4
                down[i, j] -= 1e-4
                assert abs((other(up) - other(down)) / 2e-4 - grad[i, j]) < 2e-3


def test_pooled_is_the_mean_over_positions():
    """A text's probabilities against a loop over its bytes, with state that runs in over the context on either side."""
    rng = np.random.default_rng(4)
    texts, size, context = [bytes(rng.integers(97, 103, n).tolist()) for n in (1, 40, 128, 300)], language.WINDOW, language.CONTEXT
    net = language.train(texts * 4, ["a", "b", "c", "a"] * 4, epochs=3)
    got = language.pooled(net, [*texts, b""])
    at = lambda t, k: t[k] if 0 <= k < len(t) else 256

    def state(which, codes):
        h, n = np.zeros(language.HIDDEN), language.HIDDEN
        for code in codes:
            a, b = net.tables[which][code], h @ net.recurrent[which]
            z, r = 1 / (1 + np.exp(-(a[:n] + b[:n]))), 1 / (1 + np.exp(-(a[n : 2 * n] + b[n : 2 * n])))
            c = np.tanh(a[2 * n :] + r * b[2 * n :])
            h = c + z * (h - c)
        return h

    for t, p in zip(texts, got):
        sums = np.zeros(3)
        for k in range(len(t)):
            first = k - k % size
            ahead = state(0, [at(t, j) for j in range(first - context, k + 1)])
            behind = state(1, [at(t, j) for j in range(first + size + context - 1, k - 1, -1)])
            logits = np.r_[ahead, behind] @ net.out + net.bias
            e = np.exp(logits - logits.max())
            sums += e / e.sum()
        assert np.abs(p - sums / len(t)).max() < 1e-3
    assert not got[-1].any()


def test_no_language_is_left_out_of_the_sample(spark):
    rows = spark.createDataFrame([(k, f"text {k}", f"l{k % 70}") for k in range(700)] + [(900, None, "zz"), (901, "x", None)], "id long, text string, lang string")
    texts, labels = language.training_sample(rows, together=100)
    assert set(labels) == {f"l{k}" for k in range(70)} and len(texts) == 70
    assert len(language.training_sample(rows, per_label=3)[0]) == 210


def test_toxic_scores_of_plain_loops(spark):
    """Scores of 50 texts from the model's dictionaries, one compression at a time."""
    import zstandard

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = toxicity.train(*toxicity.training_sample(docs.filter(~held).selectExpr("doc_id AS id", "text"), labels, "doc_id"))
    params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda content: (lambda c: lambda w: len(c.compress(toxicity.coded(w))))(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params))
    toxic, ordinary = size(model.toxic), size(model.ordinary)
    picked = docs.join(labels, "doc_id").filter("length(text) < 3000").orderBy(F.desc("toxic"), "doc_id").limit(50)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, held).join(picked.select("doc_id"), "doc_id").collect()}
    for r in picked.collect():
        words = toxicity.word_windows(r["text"])
        gains = [g for w in words if (g := ordinary(w) - toxic(w)) >= model.gain and toxic(w) <= model.length]
        x = [math.log1p(len(gains)), math.log1p(100 * len(gains) / max(1, len(words))), min(max(gains, default=0), 4.0 * model.gain) / model.gain]
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, [*x, 1]))))) < 1e-6


def test_brown_counts_and_base(spark):
    docs = documents(spark)
    got = brown.class_scores(docs, F.col("doc_id") % 7 == 2, classes=4, clustered=50, carried=120).collect()
    count: Counter = Counter()
    rows = [(r["doc_id"], [*words(lower(r["text"] or "")), ""], r["doc_id"] is not None and r["doc_id"] % 7 == 2) for r in docs.collect()]
    for _, tokens, held in rows:
        if not held:
            count.update(tokens)
    n, v = sum(count.values()), len(count)
    want = []
    for i, tokens, held in rows:
        want.append((i, held, len(tokens), sum(count[t] > 0 for t in tokens), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens), 6)))
    assert multiset((*r[:5], round(r["base_score"], 6)) for r in got) == multiset(want)
    assert all(r["score"] < 0 for r in got)
    assert brown.class_scores(empty(spark), F.lit(False)).count() == 0
    assert {r["score"] for r in brown.class_scores(docs, F.lit(True)).collect()} == {0.0}


def probability(model: brown.Model, count: dict, before: bytes, word: bytes) -> float:
    """P(word | before) of a model, straight from its counts."""
    names = [w for w, _ in model.head[: len(model.of) - 1]]
    rare = len(model.table) - 1
    cls = lambda w: int(model.of[names.index(w)]) if w in names else rare
    a, b = cls(before), cls(word)
    unigram = (model.table[:, b].sum() + 1) / (model.table.sum() + len(model.table))
    step = (model.table[a, b] + brown.PRIOR * unigram) / (model.table[a].sum() + brown.PRIOR)
    own = {w: c for w, c in count.items() if cls(w) == b}
    return step * (own[word] / sum(own.values()) if word in names else (count.get(word, 0) + 1) / (sum(own.values()) + len(own) + 1))


def fitted(spark):
    rows = [(k, t) for k, t in enumerate(["a b a c", "b c d e f", "a b", "g", "a b c d", "e f a b", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count = Counter(w for _, t in rows for w in brown.words_of(t))
    return docs, brown.fit(docs, classes=2, clustered=4, carried=6)[0], count


def test_brown_is_a_distribution(spark):
    """After any word, the probabilities of all known words and one unknown sum to 1."""
    _, model, count = fitted(spark)
    for before in [*count, b"never seen"]:
        assert abs(sum(probability(model, count, before, w) for w in [*count, b"unknown"]) - 1) < 1e-9


def test_brown_scores_of_plain_loops(spark):
    docs, model, count = fitted(spark)
    probes = [(100 + k, t) for k, t in enumerate(["a b c", "g unknown g", "", None, "D E F a new a"])]
    both = docs.unionByName(spark.createDataFrame(probes, "doc_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in brown.class_scores(both, F.col("doc_id") >= 100, classes=2, clustered=4, carried=6).collect()}
    for r in both.collect():
        w = [b"", *brown.words_of(r["text"])]
        assert abs(got[r["doc_id"]] - sum(math.log10(probability(model, count, a, b)) for a, b in zip(w, w[1:]))) < 1e-9


def test_batches_never_lower_the_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = brown.word_counts(docs)
    names = [w for w, _ in brown.most_frequent(counts, 400)]
    bigrams = brown.materialize(brown.bigram_counts(docs, names), "bigrams")
    values = [brown.likelihood(brown.exchange(bigrams, len(names), 8, rounds)[1]) for rounds in (0, 1, 3)]
    assert values[0] < values[1] <= values[2]


def test_brown_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = brown.class_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.97 * r["b"]


def test_gain_is_the_change_in_likelihood():
    rng = np.random.default_rng(6)
    n, k = 12, 3
    pairs = rng.integers(0, 9, (n, n)).astype(float)
    np.fill_diagonal(pairs, 0)
    of = rng.integers(0, k, n)

    def table(of):
        t = np.zeros((k, k))
        for a in range(n):
            for b in range(n):
                t[of[a], of[b]] += pairs[a, b]
        return t

    for w in range(n):
        right = np.bincount(of, weights=pairs[w], minlength=k)
        left = np.bincount(of, weights=pairs[:, w], minlength=k)
        got = brown.gains(table(of), right[None], left[None], of[[w]])[0]
        for to in range(k):
            moved = of.copy()
            moved[w] = to
            assert abs(got[to] - (brown.likelihood(table(moved)) - brown.likelihood(table(of)))) < 1e-6


def test_crc_is_the_drivers(spark):
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("x")).collect()
    assert all(r["x"] == zlib.crc32(str(r["id"]).encode()) for r in got)
