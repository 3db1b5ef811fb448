"""Scores of candidates and references, n-gram models, tests, waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators import agreement as N
from quern.operators import audio as A
from quern.operators import ngram_models as L
from quern.operators import scores as K
from quern.queries import score_sql as Q
from quern.queries.registry import PAIRS, pairs, query, table, words_sql


def _refs(d):
    """Two references: the answer and the answer in lower case."""
    return d.withColumn("refs", F.array("tgt", F.lower("tgt")))


@query(Q.CORPUS_SCORES)
def met_corpus_scores(spark, sf_dir):
    d = _refs(pairs(spark, sf_dir)).withColumn("part", F.pmod("conv_id", F.lit(4)))
    return K.corpus_scores(d, "src", "refs", ["part"])


@query(Q.SENTENCE_SCORES)
def met_sentence_scores(spark, sf_dir):
    return K.sentence_scores(pairs(spark, sf_dir), "src", "tgt").select("ord", "sentence_bleu", "sentence_chrf", "sentence_chrfpp")


@query(Q.SPOTLIGHT)
def met_spotlight(spark, sf_dir):
    """The 20 pairs of the widest gap between chrF and BLEU: the limit is the feature."""
    s = K.sentence_scores(pairs(spark, sf_dir), "src", "tgt").withColumn("gap", F.col("sentence_chrf") - F.col("sentence_bleu"))
    return s.orderBy(F.desc("gap"), "ord").limit(20).select("ord", "gap")


@query(Q.OPERATIONS)
def met_word_operations(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", K.word_operations("tgt", "src").alias("o")).select("ord", "o.*")


@query(Q.ROUGE)
def met_rouge_l(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", F.round(K.rouge_l("tgt", "src"), 6).alias("rouge_l"))


@query()
def met_translation_edit_rate(spark, sf_dir):
    d = table(spark, sf_dir, "part").withColumn("size", F.pmod("p_size", F.lit(5)))
    return K.translation_edit_rate(d, "p_name", "p_type", ["size"])


@query(f"WITH {PAIRS} SELECT ord, round(len({words_sql('tgt')}) / greatest(len({words_sql('src')}), 1), 6) AS ratio, trim(coalesce(tgt, '')) = '' AS empty FROM pairs")
def met_length_ratio(spark, sf_dir):
    n = lambda c: F.size(tokens(F.col(c)))
    return pairs(spark, sf_dir).select("ord", F.round(n("tgt") / F.greatest(n("src"), F.lit(1)), 6).alias("ratio"), (F.trim(F.coalesce("tgt", F.lit(""))) == "").alias("empty"))


@query("WITH r AS (SELECT row_number() OVER () AS id, l_orderkey AS u, l_returnflag AS f, l_quantity AS q, round(l_discount * 100)::INT AS d FROM lineitem), s AS (SELECT u, count(*) AS m FROM r GROUP BY u HAVING count(*) > 1), t AS (SELECT r.*, m FROM r JOIN s USING (u)), "
       "mid AS (SELECT d, sum(c) OVER (ORDER BY d) - c / 2 AS x FROM (SELECT d, count(*) AS c FROM t GROUP BY d)), x AS (SELECT t.*, x FROM t JOIN mid USING (d)), n AS (SELECT count(*) AS n FROM x), "
       "o AS (SELECT sum((a.f <> b.f)::INT / (a.m - 1)) AS f, sum((a.q - b.q) ** 2 / (a.m - 1)) AS q, sum((a.x - b.x) ** 2 / (a.m - 1)) AS d FROM x a JOIN x b ON a.u = b.u AND a.id <> b.id), "
       "cf AS (SELECT f AS v, count(*)::DOUBLE AS c FROM x GROUP BY 1), cq AS (SELECT q AS v, count(*)::DOUBLE AS c FROM x GROUP BY 1), cd AS (SELECT x AS v, count(*)::DOUBLE AS c FROM x GROUP BY 1), "
       "e AS (SELECT (SELECT sum(a.c * b.c) FROM cf a JOIN cf b ON a.v <> b.v) AS f, (SELECT sum(a.c * b.c * (a.v - b.v) ** 2) FROM cq a, cq b) AS q, (SELECT sum(a.c * b.c * (a.v - b.v) ** 2) FROM cd a, cd b) AS d) "
       "SELECT unnest(['nominal', 'interval', 'ordinal']) AS level, n, unnest([round(1 - o.f * (n - 1) / e.f, 8), round(1 - o.q * (n - 1) / e.q, 8), round(1 - o.d * (n - 1) / e.d, 8)]) AS alpha FROM o, e, n")  # fmt: skip
def sta_krippendorff(spark, sf_dir):
    """Lines of an order as ratings of it, at three levels; SQL goes over all pairs."""
    t = table(spark, sf_dir, "lineitem").withColumn("d", F.round(F.col("l_discount") * 100).cast("int"))
    level = lambda name, c: N.krippendorff(t, "l_orderkey", c, name).select(F.lit(name).alias("level"), "n", F.round("alpha", 8).alias("alpha"))
    return level("nominal", "l_returnflag").unionByName(level("interval", "l_quantity")).unionByName(level("ordinal", "d"))


@query("WITH x AS (SELECT o_orderpriority AS p, o_orderkey % 3 AS a, CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 3 ELSE o_custkey % 3 END AS b FROM orders), m AS (SELECT p, count(*) AS n, avg((a = b)::INT) AS agreed FROM x GROUP BY p), s AS (SELECT p, c, count(*) FILTER (a = c) / count(*) AS pa, count(*) FILTER (b = c) / count(*) AS pb FROM x, (VALUES (0), (1), (2)) v(c) GROUP BY p, c), e AS (SELECT p, sum(pa * pb) AS e FROM s GROUP BY p) SELECT p AS o_orderpriority, n, round(agreed, 8) AS agreed, round((agreed - e) / (1 - e), 8) AS kappa FROM m JOIN e USING (p)")
def sta_kappa(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3).alias("a"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderkey") % 3).otherwise(F.col("o_custkey") % 3).alias("b"))
    return N.cohen_kappa(o, "a", "b", ["o_orderpriority"]).select("o_orderpriority", "n", F.round("agreed", 8).alias("agreed"), F.round("kappa", 8).alias("kappa"))


@query("WITH c AS (SELECT l_linestatus AS k, l_returnflag AS a, l_linenumber AS b, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(o) OVER (PARTITION BY k, a) AS ra, sum(o) OVER (PARTITION BY k, b) AS rb, sum(o) OVER (PARTITION BY k) AS n FROM c), s AS (SELECT k, max(n)::BIGINT AS n, max(n) * (sum(o * o / (ra * rb)) - 1) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS f FROM t GROUP BY k) "
       "SELECT k AS l_linestatus, n, round(x, 6) AS chi_square, f AS freedom, round(exp(-x / 2) * list_sum(list_transform(generate_series(0, f // 2 - 1), lambda i: (x / 2) ** i / gamma(i + 1))), 8) AS p_value FROM s")  # fmt: skip
def sta_chi_square(spark, sf_dir):
    """Return flags against line numbers, for each status; degrees of freedom are even, so the tail is a finite sum."""
    x = N.chi_square(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", ["l_linestatus"])
    return x.select("l_linestatus", "n", F.round("chi_square", 6).alias("chi_square"), "freedom", F.round("p_value", 8).alias("p_value"))


@query(Q.wilcoxon("SELECT o_orderpriority, o_totalprice - 100000 - o_custkey AS d FROM orders", "o_orderpriority"))
def sta_wilcoxon_orders(spark, sf_dir):
    """Prices against what customers' numbers would have them be, by priority."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("a"), (F.col("o_custkey") + 100000).cast("double").alias("b"))
    return K.wilcoxon(o, "a", "b", ["o_orderpriority"])


@query(Q.wilcoxon("SELECT l_returnflag, l_quantity / 100 - l_discount AS d FROM lineitem", "l_returnflag"))
def sta_wilcoxon(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 100).alias("a"), F.col("l_discount").alias("b"))
    return K.wilcoxon(o, "a", "b", ["l_returnflag"])


GRAMS = (
    f"t AS (SELECT list_concat(['<s>'], {words_sql('lower(text)')}, ['</s>']) AS w FROM benchmark), "
    + "g AS (" + " UNION ALL ".join(f"SELECT {n} AS n, unnest(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM t" for n in (1, 2, 3)) + "), "
    + "c AS (SELECT n, gram, count(*) AS c FROM g GROUP BY ALL), z AS (SELECT sum(c) AS tokens, count(*) AS v FROM c WHERE n = 1), "
    + "m AS (SELECT c.n, c.gram, round(log10((c.c + 1) / (coalesce(p.c, z.tokens) + z.v)), 4) AS logprob FROM c CROSS JOIN z LEFT JOIN c p ON c.n > 1 AND p.n = c.n - 1 AND p.gram = regexp_replace(c.gram, ' [^ ]*$', ''))"
)


def model(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark")
    return L.add_one(L.gram_counts(t, tokens(F.lower("text")), 3))


@query(f"WITH {GRAMS} SELECT * FROM m")
def agg_ngram_model(spark, sf_dir):
    return model(spark, sf_dir).select(F.col("n").cast("long").alias("n"), "gram", "logprob")


@query(f"WITH {GRAMS}, d AS (SELECT item_id, list_concat(['<s>'], {words_sql('text')}, ['</s>']) AS w FROM benchmark), p AS (SELECT item_id, w, unnest(generate_series(2, len(w))) AS i FROM d WHERE len(w) > 2), "
       "k AS (SELECT item_id, i, coalesce((SELECT logprob FROM m WHERE m.n = 3 AND i >= 3 AND m.gram = array_to_string(w[i - 2:i], ' ')), (SELECT logprob FROM m WHERE m.n = 2 AND m.gram = array_to_string(w[i - 1:i], ' ')), (SELECT logprob FROM m WHERE m.n = 1 AND m.gram = w[i]), -99) AS s FROM p) "
       "SELECT d.item_id, round(coalesce(sum(k.s), -99), 4) AS score FROM d LEFT JOIN k USING (item_id) GROUP BY d.item_id")  # fmt: skip
def met_backoff_scores(spark, sf_dir):
    """The benchmark as written under the model of its lower-case texts: known trigrams, then shorter ones, then -99."""
    t = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return L.backoff_scores(t, "item_id", tokens(F.col("text")), model(spark, sf_dir), 3).select("item_id", F.round("score", 4).alias("score"))


def _candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice", "p_size")
    c = F.array(F.struct(F.col("p_name").alias("text"), (F.col("p_retailprice") / -1000).alias("acoustic"), (F.col("p_size") / -10).alias("lm")), F.struct(F.col("p_type").alias("text"), F.lit(-1.0).alias("acoustic"), F.lit(-2.0).alias("lm")))
    return p.select("p_partkey", F.inline(c))


_CANDIDATES = """c AS (SELECT p_partkey, p_name AS text, p_retailprice / -1000 AS acoustic, p_size / -10 AS lm FROM part UNION ALL SELECT p_partkey, p_type, -1.0, -2.0 FROM part),
g AS (SELECT a AS alpha, b AS beta FROM (VALUES (0.0), (0.5)) x(a), (VALUES (0.0), (1.0)) y(b)),
r AS (SELECT alpha, beta, p_partkey, arg_max(text, acoustic + alpha * lm + beta * len(regexp_split_to_array(text, '\\s+'))) AS text FROM c, g GROUP BY ALL)"""


@query(f"WITH {_CANDIDATES}, e AS (SELECT alpha, beta, round(100.0 * sum(levenshtein(p_name, text)) / sum(length(p_name)), 4) AS cer FROM r JOIN part USING (p_partkey) GROUP BY ALL) SELECT alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, cer FROM e ORDER BY cer, alpha, beta LIMIT 1")
def met_best_rescoring(spark, sf_dir):
    r = L.rescore(_candidates(spark, sf_dir), "p_partkey", [0.0, 0.5], [0.0, 1.0])
    return L.best_point(r, table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("ref")), "p_partkey")


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: (floor(abs(v) * 10))::INT % 3) AS ids FROM embeddings) SELECT vec_id, array_to_string(list_filter(list_transform(generate_series(1, len(ids)), lambda i: CASE WHEN i = 1 OR ids[i] <> ids[i - 1] THEN ids[i] ELSE 0 END), lambda v: v <> 0), ' ') AS labels FROM x")
def met_ctc_collapse(spark, sf_dir):
    ids = F.transform("embedding", lambda v: A.code(v, 10) % 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(L.ctc_collapse(ids), lambda v: v.cast("string")), " ").alias("labels"))


_FRAMES = "list_transform(generate_series(0, 4), lambda t: list_transform(embedding[4 * t + 1:4 * t + 4], lambda v: 8 * v::DOUBLE))"


@query(f"WITH x AS (SELECT vec_id, {_FRAMES} AS f FROM embeddings), l AS (SELECT vec_id, list_transform(f, lambda r: list_transform(r, lambda v: v - ln(list_sum(list_transform(r, lambda u: exp(u)))))) AS f FROM x), "
       "p AS (SELECT range AS n, list_transform(generate_series(0, 4), lambda t: (range // (4 ** t)::BIGINT) % 4) AS path FROM range(1024)), "
       "c AS (SELECT n, path, array_to_string(list_transform(list_filter(generate_series(1, 5), lambda i: path[i] <> 0 AND (i = 1 OR path[i] <> path[i - 1])), lambda i: substr('_abc', path[i] + 1, 1)), ' ') AS text FROM p), "
       "s AS (SELECT vec_id, text, ln(sum(exp(list_sum(list_transform(generate_series(1, 5), lambda t: f[t][path[t] + 1]))))) AS acoustic FROM l, c GROUP BY ALL) "
       "SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY acoustic DESC, text) AS INTEGER) AS rank, text, round(acoustic, 6) AS acoustic FROM s QUALIFY rank <= 3")  # fmt: skip
def met_ctc_beam(spark, sf_dir):
    """The three best label sequences of five frames of a blank and three labels; the beam holds all of them, so that probabilities are whole. SQL sums over all paths."""
    f = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda t: F.transform(F.slice("embedding", 4 * t + 1, 4), lambda v: 8 * v.cast("double")))
    b = L.beam_candidates(table(spark, sf_dir, "embeddings").select("vec_id", f.alias("f")), "vec_id", "f", ["_", "a", "b", "c"], width=400, best=3)
    return b.select("vec_id", "rank", "text", F.round("acoustic", 6).alias("acoustic"))


@query("WITH w AS (SELECT doc_id, " + words_sql("text") + " AS w FROM documents), f AS (SELECT doc_id, w, list_filter(generate_series(1, len(w) - 2), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])[1] AS i FROM w) SELECT doc_id, w[i] AS word, (i - 1)::BIGINT AS start FROM f WHERE i IS NOT NULL")
def win_repeated_runs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", L.repeated_runs(tokens(F.col("text"))).alias("r")).filter("r IS NOT NULL")
    return d.select("doc_id", "r.word", F.col("r.start").cast("long").alias("start"))


@query("WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM conversations) SELECT row_number() OVER (ORDER BY ch) + 1 AS id, ch FROM c WHERE ch <> '' UNION ALL SELECT 0, '<pad>' UNION ALL SELECT 1, '<unk>'")
def agg_character_vocabulary(spark, sf_dir):
    return L.vocabulary(table(spark, sf_dir, "conversations"), "text")


@query("WITH x AS (SELECT vec_id, list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))) AS peak FROM embeddings) SELECT vec_id, CASE WHEN peak = 0 THEN 'zero_peak' WHEN peak <= 1 THEN 'already_float_minus1_to_1' WHEN peak <= 65536 THEN 'integer_like_divide_by_65536' ELSE 'peak_normalized_to_0p98' END AS policy FROM x")
def aud_scaling(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.scaled(F.col("embedding"))["policy"].alias("policy"))


@query("SELECT vec_id, (floor(len(embedding) / 48.0 * 16))::BIGINT AS n, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[len(embedding)]::DOUBLE, 5) AS last FROM embeddings")
def aud_resampled(spark, sf_dir):
    y = A.resampled(F.col("embedding"), 48, 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", y.alias("y")).select("vec_id", F.size("y").cast("long").alias("n"), F.round(F.element_at("y", 1).cast("double"), 5).alias("first"), F.round(F.element_at("y", -1).cast("double"), 5).alias("last"))


@query("SELECT vec_id, array_to_string(list_transform(embedding[1:4], lambda v: (floor(abs(v) * 100))::INT), ' ') AS coarse, array_to_string(list_transform(embedding[1:16], lambda v: (floor(abs(v) * 100))::INT), ' ') AS fine FROM embeddings")
def aud_codes_round_trip(spark, sf_dir):
    """Codes of three levels, interleaved and taken apart again; four steps of codes are made from each vector."""
    x = F.transform("embedding", lambda v: A.code(v, 100))
    back = A.levels_of(A.interleaved(F.slice(x, 1, 4), F.slice(x, 1, 8), F.slice(x, 1, 16), 128266), 128266)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return table(spark, sf_dir, "embeddings").select("vec_id", text(back["coarse"]).alias("coarse"), text(back["fine"]).alias("fine"))


_RAGGED = "(SELECT vec_id, embedding[1:1 + vec_id % 60] AS x, list_transform(generate_series(1, vec_id % 5), lambda i: i::INT) AS y FROM embeddings)"


@query(f"WITH x AS {_RAGGED}, p AS (SELECT *, (row_number() OVER (ORDER BY len(x), vec_id) - 1) // 16 AS batch FROM x), b AS (SELECT batch, max(len(x)) AS longest, max(len(y)) AS target, count(*) AS n, sum(len(x)) AS held, string_agg(vec_id::VARCHAR, ' ' ORDER BY len(x) DESC, vec_id) AS keys, round(sum(list_sum(list_transform(x, lambda v: v::DOUBLE))), 4) AS total FROM p GROUP BY batch) "
       "SELECT batch, keys, longest::BIGINT AS longest, target::BIGINT AS target, (n * longest - held)::BIGINT AS padding, total FROM b")  # fmt: skip
def aud_batches(spark, sf_dir):
    """Vectors of unequal length in batches of 16; what is filled up, and sums over what isn't."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, (1 + F.col("vec_id") % 60).cast("int")).alias("x"), F.when(F.col("vec_id") % 5 > 0, F.sequence(F.lit(1), (F.col("vec_id") % 5).cast("int"))).alias("y"))
    b = A.collated(t, "vec_id", "x", "y", 16)
    flat = lambda c: F.flatten(c)
    total = F.aggregate(F.zip_with(flat("waveforms"), flat("mask"), lambda v, m: F.when(m, v.cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    keys = F.array_join(F.transform("keys", lambda k: k.cast("string")), " ")
    return b.select("batch", keys.alias("keys"), F.size(F.get("waveforms", F.lit(0))).cast("long").alias("longest"), F.size(F.get("targets", F.lit(0))).cast("long").alias("target"), F.size(F.filter(flat("mask"), lambda m: ~m)).cast("long").alias("padding"), F.round(total, 4).alias("total"))


@query("WITH x AS (SELECT vec_id, embedding, unnest(generate_series(0, 51)) AS k FROM embeddings WHERE len(embedding) = 64), n AS (SELECT vec_id, k, embedding, unnest(generate_series(greatest(0, k * 5 // 4 - 8), least(63, k * 5 // 4 + 8))) AS j FROM x), "
       "t AS (SELECT vec_id, k, embedding[j + 1]::DOUBLE AS v, greatest(-6, least(6, (j - k * 1.25) * 3.96 / 5)) AS t FROM n) "
       "SELECT vec_id, k, round(sum(v * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) END * cos(t * pi() / 12) ** 2 * 3.96 / 5), 4) + 0.0 AS sample FROM t GROUP BY ALL")  # fmt: skip
def aud_sped(spark, sf_dir):
    """Vectors of 64 samples played five quarters as fast."""
    y = A.sped(F.col("embedding"), 16000, 1.25)
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", F.posexplode(y).alias("k", "v")).select("vec_id", F.col("k").cast("long").alias("k"), (F.round("v", 4) + 0.0).alias("sample"))


_TRIM = "x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE len(embedding) = 64)"


@query(f"WITH {_TRIM}, a AS (SELECT vec_id, x, list_sort(list_transform(x, lambda v: abs(v))) AS m, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) AS rms FROM x) SELECT vec_id, 64::BIGINT AS n, round(20 * log10(greatest(rms, 1e-10) / greatest(m[4] + (m[5] - m[4]) * 0.15, 1e-10)), 1) AS snr_db FROM a")
def aud_trimmed(spark, sf_dir):
    """Vectors of 64 samples lie within one frame each, so none is cut; the ratio of their level to the fifth percentile of magnitudes."""
    t = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64)
    return t.select("vec_id", A.trimmed("embedding").alias("t")).select("vec_id", F.size("t.samples").cast("long").alias("n"), "t.snr_db")


@query("SELECT vec_id, (7 * least(len(embedding) // 7, 3))::BIGINT AS n, round(list_sum(list_transform(embedding[1:least(len(embedding), 21)], lambda v: v::DOUBLE)), 5) AS total FROM embeddings")
def aud_truncated(spark, sf_dir):
    """Three frames of seven at most."""
    y = A.truncated(F.slice("embedding", F.lit(1), (F.floor(F.size("embedding") / 7) * 7).cast("int")), 21)
    return table(spark, sf_dir, "embeddings").select("vec_id", y.alias("y")).select("vec_id", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v.cast("double")), 5).alias("total"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding[1:63], lambda v: floor(abs(v) * 10)::INT) AS c FROM embeddings WHERE len(embedding) >= 63), f AS (SELECT vec_id, list_filter(generate_series(0, 8), lambda i: i = 0 OR c[7 * i + 1] <> c[7 * i - 6]) AS kept, c FROM x) SELECT vec_id, array_to_string(flatten(list_transform(kept, lambda i: c[7 * i + 1:7 * i + 7])), ' ') AS codes FROM f")
def ded_frames(spark, sf_dir):
    """Frames of seven codes without those whose first code is that of the last one kept; nine frames are made from each vector."""
    c = F.transform(F.slice("embedding", 1, 63), lambda v: A.code(v, 10))
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 63).select("vec_id", F.array_join(F.transform(A.without_repeats(c), lambda v: v.cast("string")), " ").alias("codes"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: (greatest(-1, least(0.999, v)) * 32768)::DOUBLE) AS x FROM embeddings), q AS (SELECT vec_id, list_transform(x, lambda v: floor(v) / 32768.0) AS x FROM e) SELECT vec_id, len(x)::BIGINT AS n, 8000 AS rate, round(list_sum(list_transform(x, lambda v: v * v)), 4) AS power FROM q")
def aud_decoded(spark, sf_dir):
    """Each vector as a file of 16 bits, made in a task, and decoded."""

    @F.pandas_udf("binary")
    def as_wav(rows):
        import io
        import wave

        import numpy as np
        import pandas as pd

        def one(x):
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
                w.writeframes(np.floor(np.clip(np.asarray(x, dtype=np.float64), -1, 0.999) * 32768).astype("<i2").tobytes())
            return out.getvalue()

        return pd.Series([one(x) for x in rows])

    w = table(spark, sf_dir, "embeddings").select("vec_id", A.decode_wav(as_wav("embedding")).alias("w"))
    return w.select("vec_id", F.size("w.samples").cast("long").alias("n"), "w.rate", F.round(F.aggregate("w.samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")), 4).alias("power"))
