"""Systems side by side, summaries of runs and statistics of comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import systems as Y
from quern.queries.registry import query, table, words_sql

# Suppliers stand for test rows; three systems' scores are made from their keys.
_A, _B, _C = "(s_suppkey * 37 % 1000) / 10.0", "(s_suppkey * 53 % 997) / 10.0", "(s_suppkey * 71 % 991) / 10.0"
_TAGS = "list_filter([CASE WHEN s_suppkey % 7 = 0 THEN 'neg' END, CASE WHEN s_suppkey % 11 = 0 THEN 'q' END, CASE WHEN s_suppkey % 13 = 0 THEN 'past' END], lambda x: x IS NOT NULL)"


def _scores(spark, sf_dir):
    k = F.col("s_suppkey")
    made = lambda m, n, name: (k * m % n / F.lit(10.0)).alias(name)
    tags = F.array_compact(F.array(F.when(k % 7 == 0, "neg"), F.when(k % 11 == 0, "q"), F.when(k % 13 == 0, "past")))
    return table(spark, sf_dir, "supplier").select(k.alias("idx"), F.col("s_name").alias("ref"), made(37, 1000, "a"), made(53, 997, "b"), made(71, 991, "c"), tags.alias("tags"))


@query("SELECT s_suppkey AS idx, s_name AS src, upper(s_name) AS ref, lower(s_name) AS pred_one, s_name AS pred_two FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0")
def jon_aligned(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("src"), F.upper("s_name").alias("ref"), "s_name")
    return Y.aligned({"one": s.filter("idx % 2 = 0").withColumn("pred", F.lower("s_name")), "two": s.filter("idx % 3 = 0").withColumn("pred", F.col("s_name"))})


@query(f"WITH s AS (SELECT s_suppkey AS idx, CASE WHEN s_suppkey < 40 THEN 'structured' ELSE 'tatoeba' END AS subset, greatest({_A}, {_B}, {_C}) - least({_A}, {_B}, {_C}) AS spread FROM supplier) SELECT idx, subset, round(spread, 4) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY spread DESC, idx) AS n FROM s) WHERE n <= 4")
def win_widest_spread(spark, sf_dir):
    """Four of each subset: the feature."""
    s = Y.widest_spread(_scores(spark, sf_dir), "idx", ["a", "b", "c"], F.when(F.col("idx") < 40, "structured").otherwise("tatoeba"), 4)
    return s.select("idx", "subset", F.round("spread", 4).alias("spread"))


@query(f"SELECT s_suppkey AS idx, round({_A} - {_B}, 4) AS gap FROM supplier WHERE s_suppkey >= 5 AND {_A} >= 60 AND {_B} < 50 ORDER BY {_A} - {_B} DESC, s_suppkey LIMIT 3")
def win_spotlight(spark, sf_dir):
    """Three rows from the fifth on: the feature."""
    return Y.spotlight(_scores(spark, sf_dir), "idx", "a", "b", 5, least_chrf=60).select("idx", F.round("gap", 4).alias("gap"))


@query(f"""WITH s AS (SELECT s_suppkey AS idx, {_A} - {_B} AS gap, {_TAGS} AS tags FROM supplier), p AS (SELECT * FROM s WHERE gap >= 5 OR (SELECT count(*) FROM s WHERE gap >= 5) < 8),
a AS (SELECT idx FROM p WHERE list_contains(tags, 'neg') ORDER BY gap DESC, idx LIMIT 1), b AS (SELECT idx FROM p WHERE list_contains(tags, 'q') AND idx NOT IN (SELECT idx FROM a) ORDER BY gap DESC, idx LIMIT 1),
c AS (SELECT idx FROM p WHERE list_contains(tags, 'past') AND idx NOT IN (SELECT idx FROM a UNION ALL SELECT idx FROM b) ORDER BY gap DESC, idx LIMIT 1), u AS (SELECT idx, 1 AS o FROM a UNION ALL SELECT idx, 2 FROM b UNION ALL SELECT idx, 3 FROM c),
r AS (SELECT idx, 3 + row_number() OVER (ORDER BY gap DESC, idx) AS o FROM p WHERE idx NOT IN (SELECT idx FROM u)), w AS (SELECT * FROM u UNION ALL SELECT * FROM r)
SELECT row_number() OVER (ORDER BY o)::INT AS place, idx FROM w ORDER BY o LIMIT 8""")
def srt_covering_examples(spark, sf_dir):
    """Eight examples: the feature."""
    s = _scores(spark, sf_dir).withColumn("gap", F.col("a") - F.col("b"))
    return Y.covering_examples(s, "idx", "gap", "tags", 8, 5.0)


_POISSON = "(" + " + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in __import__("quern.operators.metrics", fromlist=["POISSON"]).POISSON) + ")"


def _wins(rows: str, key: str, resamples: int, seed: int) -> str:
    """p value of rows (key, a, b) by the same hashed draws."""
    return f"(SELECT 1 - avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) FROM (SELECT r, sum({_POISSON} * (b - a)) AS gain FROM (SELECT r, a, b, ('0x' || substr(md5('{seed}|' || r || '|' || {key}), 1, 8))::BIGINT AS u FROM {rows}, range(1, {resamples + 1}) d(r)) GROUP BY r))"


@query(f"WITH s AS (SELECT s_suppkey AS idx, {_A} AS a, {_B} AS b FROM supplier) SELECT count(*) AS pairs, round(CASE WHEN stddev_pop(b - a) > 0 THEN avg(b - a) / stddev_pop(b - a) ELSE 0 END, 6) AS d_paired, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b) - avg(a), 6) AS delta, round({_wins('s', 'idx', 200, 1)}, 6) AS p_value FROM s")
def sta_comparison(spark, sf_dir):
    """200 resamples of two systems over the same references."""
    s = _scores(spark, sf_dir)
    return Y.comparison(s.select("idx", "ref", F.col("a").alias("score")), s.select("idx", "ref", F.col("b").alias("score")), "idx", "score", 200)


@query(f"WITH s AS (SELECT c_custkey AS k, length(c_name)::DOUBLE + c_nationkey AS a, c_nationkey * 1.5 + 7 AS b FROM customer) SELECT {_wins('s', 'k', 100, 1)} AS p_value, 100 AS resamples")
def sta_bootstrap(spark, sf_dir):
    from quern.operators.metrics import bootstrap_wins

    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.length("c_name").cast("double") + F.col("c_nationkey")).alias("a"), (F.col("c_nationkey") * 1.5 + 7).alias("b"))
    return bootstrap_wins(s, "k", "a", "b", 100).select("p_value", F.col("resamples").cast("int").alias("resamples"))


@query(f"WITH w AS (SELECT r, sum(n * v) / nullif(sum(n), 0) AS m FROM (SELECT r, v, {_POISSON} AS n FROM (SELECT r, c_acctbal AS v, ('0x' || substr(md5('1|' || r || '|' || c_custkey), 1, 8))::BIGINT AS u FROM customer, range(1, 201) d(r))) GROUP BY r) SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM w")
def sta_interval(spark, sf_dir):
    from quern.operators.scores import bootstrap_interval

    return bootstrap_interval(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 200)


_RUNS = "runs AS (SELECT s_nationkey % 4 AS model, s_nationkey % 3 AS condition, s_suppkey AS seed, s_acctbal / 100 AS bleu FROM supplier), ov AS (SELECT model, condition, seed, bleu + 1 AS bleu FROM runs WHERE seed % 5 = 0), w AS (SELECT * FROM ov UNION ALL SELECT * FROM runs WHERE seed % 5 <> 0)"


@query(f"WITH {_RUNS}, g AS (SELECT model, condition, count(*) AS n, avg(bleu) AS m, coalesce(stddev_samp(bleu), 0) AS d FROM w WHERE model IN (0, 1, 3) AND condition IN (0, 2) GROUP BY ALL) SELECT model, condition, n, round(m, 6) AS mean, format('{{:.1f}}', m) || CASE WHEN d > 0 THEN '±' || format('{{:.1f}}', d) ELSE '' END || CASE WHEN n < 5 THEN ' (n=' || n || ')' ELSE '' END AS cell FROM g")
def agg_robustness(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 4).alias("model"), (F.col("s_nationkey") % 3).alias("condition"), F.col("s_suppkey").alias("seed"), (F.col("s_acctbal") / 100).alias("bleu"))
    r = Y.robustness(s, s.filter("seed % 5 = 0").withColumn("bleu", F.col("bleu") + 1), ["model", "condition"], {"model": [0, 1, 3], "condition": [0, 2]}, ["bleu"])
    return r.select("model", "condition", "n", F.round("bleu_mean", 6).alias("mean"), F.col("bleu_cell").alias("cell"))


@query("WITH o AS (SELECT CASE WHEN r_regionkey = 0 THEN 'local' ELSE 'm' || r_regionkey END AS model, n_name AS recipe, n_nationkey::DOUBLE AS score FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT 'm' || (n_nationkey % 6) AS model, n_name || '2' AS recipe, n_nationkey * 2.0 AS score FROM nation), "
       "g AS (SELECT model, a, b FROM (SELECT DISTINCT model FROM n), (VALUES ('ALGERIA', 'ALGERIA2'), ('ETHIOPIA', 'BRAZIL2'), ('CANADA', NULL)) v(a, b)) SELECT g.model, a AS old_recipe, b AS new_recipe, coalesce(o.score, f.score) AS old, n.score AS new, n.score - coalesce(o.score, f.score) AS delta FROM g LEFT JOIN o ON o.model = g.model AND o.recipe = a LEFT JOIN o f ON f.model = 'local' AND f.recipe = a LEFT JOIN n ON n.model = g.model AND n.recipe = b")  # fmt: skip
def jon_mapped_recipes(spark, sf_dir):
    """Nations as recipes; those of one region are the local bucket."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    t = table(spark, sf_dir, "nation")
    old = t.select(F.when(F.col("n_regionkey") == 0, "local").otherwise(F.concat(F.lit("m"), F.col("n_regionkey").cast("string"))).alias("model"), name.alias("recipe"), k.cast("double").alias("score"))
    new = t.select(F.concat(F.lit("m"), (k % 6).cast("string")).alias("model"), F.concat(name, F.lit("2")).alias("recipe"), (k * 2.0).alias("score"))
    return Y.mapped(old, new, [("ALGERIA", "ALGERIA2"), ("ETHIOPIA", "BRAZIL2"), ("CANADA", None)])


@query("SELECT count(*) AS n_total, count(*) FILTER (event_id % 17 = 0) AS n_failed, count(*) FILTER (event_id % 2 = 0) AS n_audio, count(*) FILTER (event_id % 3 <> 0) AS asr_n, round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 4) AS asr_mean, max(CASE WHEN event_id % 3 <> 0 THEN value END) AS asr_max, count(*) FILTER (event_id % 5 = 0) AS tts_n, round(avg(CASE WHEN event_id % 5 = 0 THEN value * 2 END), 4) AS tts_mean, max(CASE WHEN event_id % 5 = 0 THEN value * 2 END) AS tts_max FROM events")
def agg_cascade_summary(spark, sf_dir):
    """Events as results of a cascade whose stages may be missing."""
    k = F.col("event_id")
    r = table(spark, sf_dir, "events").select(k, F.when(k % 3 != 0, F.struct(F.col("value").alias("elapsed_sec"))).alias("asr"), F.when(k % 5 == 0, F.struct((F.col("value") * 2).alias("elapsed_sec"))).alias("tts"))
    return Y.cascade_summary(r, ["asr", "tts"], k % 2 == 0, k % 17 == 0)


@query("SELECT c_nationkey, coalesce(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 0) AS mean, round(coalesce(stddev_samp(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 0), 1) AS deviation FROM customer GROUP BY 1")
def agg_filled_deviations(spark, sf_dir):
    """Sample deviations; what one value or none leaves undefined is 0."""
    from quern.operators.reports import filled_mean_and_spread

    return table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).groupBy("c_nationkey").agg(*filled_mean_and_spread("v"))


def _coded(words: str) -> str:
    """A word sequence as one ASCII character for each different word of the pair."""
    return f"array_to_string(list_transform({words}, lambda w: chr((33 + list_position(known, w))::INT)), '')"


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[.,!?;:()\\[\\]\"''«»“”‘’]', '', 'g'), '\\s+', ' ', 'g'))"
_SPLIT = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def _utterances(ref: str, hyp: str) -> str:
    return f"""b AS (SELECT p_partkey, p_size, {ref} AS r, {hyp} AS h, {_NORM.format(ref)} AS rn, {_NORM.format(hyp)} AS hn FROM part), w AS (SELECT *, {_SPLIT.format('r')} AS rw, {_SPLIT.format('h')} AS hw, {_SPLIT.format('rn')} AS rnw, {_SPLIT.format('hn')} AS hnw FROM b),
k AS (SELECT *, list_distinct(list_concat(list_concat(rw, hw), list_concat(rnw, hnw))) AS known FROM w), e AS (SELECT p_partkey, p_size, levenshtein({_coded('rw')}, {_coded('hw')}) AS we, len(rw) AS wn, levenshtein(r, h) AS ce, length(r) AS cn, levenshtein({_coded('rnw')}, {_coded('hnw')}) AS wen, len(rnw) AS wnn, levenshtein(rn, hn) AS cen, length(rn) AS cnn FROM k),
u AS (SELECT *, round(100 * we / wn, 2) AS wer, round(100 * ce / cn, 2) AS cer, round(100 * wen / wnn, 2) AS wer_norm, round(100 * cen / cnn, 2) AS cer_norm FROM e)"""


_REF, _HYP = "p_name || '. ' || p_type", "upper(p_type) || ' ' || p_name"


def _spoken(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_size", F.concat("p_name", F.lit(". "), "p_type").alias("ref"), F.concat(F.upper("p_type"), F.lit(" <pad>"), "p_name").alias("hyp"))


@query(f"WITH {_utterances(_REF, _HYP)} SELECT p_partkey, wer, cer, wer_norm, cer_norm FROM u")
def met_utterance_rates(spark, sf_dir):
    from quern.operators.metrics import utterance_rates

    return utterance_rates(_spoken(spark, sf_dir), "ref", "hyp").select("p_partkey", "wer", "cer", "wer_norm", "cer_norm")


@query(f"WITH {_utterances(_REF, _HYP)} SELECT p_size % 5 AS part, count(*) AS n, round(100.0 * sum(we) / sum(wn), 2) AS wer_raw, round(100.0 * sum(ce) / sum(cn), 2) AS cer_raw, round(100.0 * sum(wen) / sum(wnn), 2) AS wer_norm, round(100.0 * sum(cen) / sum(cnn), 2) AS cer_norm, round(quantile_cont(wer_norm, 0.5), 2) AS median_wer, round(quantile_cont(cer_norm, 0.5), 2) AS median_cer, round(avg(wer_norm), 2) AS mean_wer, count(*) FILTER (p_partkey % 19 = 0) AS errors FROM u GROUP BY 1")
def met_error_report(spark, sf_dir):
    from quern.operators.metrics import error_report

    return error_report(_spoken(spark, sf_dir).withColumn("part", F.col("p_size") % 5), "ref", "hyp", ["part"], F.col("p_partkey") % 19 == 0)


@query(f"WITH {_utterances(_REF, _HYP)} SELECT p_size % 5 AS part, round(100.0 * sum(we) / greatest(sum(wn), 1), 2) AS wer, round(100.0 * sum(ce) / greatest(sum(cn), 1), 2) AS cer FROM u GROUP BY 1")
def met_unclamped_rates(spark, sf_dir):
    from quern.operators.metrics import unclamped_rates

    p = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("part"), F.concat("p_name", F.lit(". "), "p_type").alias("ref"), F.concat_ws(" ", F.upper("p_type"), "p_name").alias("hyp"))
    return unclamped_rates(p, "ref", "hyp", ["part"])


@query(f"WITH w AS (SELECT lang, {words_sql('lower(text)')} AS w FROM documents), v AS (SELECT lang, count(DISTINCT x) AS vocabulary FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang), n AS (SELECT lang, count(*) AS sentences, sum(len(w))::BIGINT AS words, round(avg(len(w)), 4) AS mean_length, min(len(w)) AS least, max(len(w)) AS most FROM w GROUP BY lang) SELECT n.*, coalesce(vocabulary, 0) AS vocabulary, CASE WHEN words > 0 THEN round(vocabulary / words, 6) ELSE 0 END AS type_token_ratio FROM n LEFT JOIN v ON n.lang IS NOT DISTINCT FROM v.lang")
def agg_property_report(spark, sf_dir):
    r = Y.property_report(table(spark, sf_dir, "documents"), "lang", "text")
    return r.withColumn("mean_length", F.round("mean_length", 4)).withColumn("type_token_ratio", F.round("type_token_ratio", 6))
