"""Text similarity and statistics over question and answer pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.predicates import character_jaccard
from quern.functions.text import tokens
from quern.operators import metrics as M
from quern.operators import scores as K
from quern.queries import score_sql as Q
from quern.queries.registry import PAIRS, pairs, query, table, words_sql

_WORDS = f"w AS (SELECT ord, {words_sql('tgt')} AS r, {words_sql('src')} AS h FROM pairs)"


@query(f"WITH {PAIRS}, {_WORDS}, " + ", ".join(f"g{n} AS (SELECT sum(least(r, h))::BIGINT AS m, sum(h)::BIGINT AS t FROM (SELECT ord, g, sum(a) AS r, sum(b) AS h FROM (SELECT ord, unnest(list_transform(generate_series(1, len(r) - {n - 1}), lambda i: array_to_string(r[i:i + {n - 1}], chr(1)))) AS g, 1 AS a, 0 AS b FROM w UNION ALL SELECT ord, unnest(list_transform(generate_series(1, len(h) - {n - 1}), lambda i: array_to_string(h[i:i + {n - 1}], chr(1)))), 0, 1 FROM w) GROUP BY ord, g))" for n in (1, 2)) + " SELECT g1.m AS match1, g2.m AS match2 FROM g1, g2")
def met_clipped_matches(spark, sf_dir):
    """Clipped unigram and bigram matches of words between white space."""
    p, total = pairs(spark, sf_dir), lambda n: F.coalesce(F.sum("match"), F.lit(0)).alias(f"match{n}")
    one, two = (M.clipped(p, "ord", tokens(F.col("tgt")), tokens(F.col("src")), n).agg(total(n)) for n in (1, 2))
    return one.crossJoin(two)  # one row each


@query(Q.CORPUS_BLEU)
def met_bleu(spark, sf_dir):
    d = pairs(spark, sf_dir).select(F.lit("all").alias("part"), "src", F.array("tgt").alias("refs"))
    return K.corpus_scores(d, "src", "refs", ["part"]).select("n", "bleu")


@query(Q.CORPUS_CHRF)
def met_chrf(spark, sf_dir):
    d = pairs(spark, sf_dir).select(F.lit("all").alias("part"), "src", F.array("tgt").alias("refs"))
    return K.corpus_scores(d, "src", "refs", ["part"]).select("n", "chrf", "chrfpp")


@query(Q.ERROR_RATES)
def met_error_rates(spark, sf_dir):
    return M.error_rates(pairs(spark, sf_dir).withColumn("all", F.lit("all")), "tgt", "src", ["all"])


@query("SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS edits FROM part")
def met_character_edits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.character_edits(F.col("p_name"), F.col("p_type")).alias("edits"))


@query(f"WITH {PAIRS} SELECT ord, round(100 * len(list_intersect(list_distinct(string_split(src, '')), list_distinct(string_split(tgt, '')))) / len(list_distinct(list_concat(string_split(src, ''), string_split(tgt, '')))), 4) AS jaccard FROM pairs")
def met_character_jaccard(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", F.round(100 * character_jaccard(F.col("src"), F.col("tgt")), 4).alias("jaccard"))


@query("SELECT l_returnflag, count(*) AS n, round(CASE WHEN stddev_pop(l_quantity - l_tax) > 0 THEN avg(l_quantity - l_tax) / stddev_pop(l_quantity - l_tax) ELSE 0 END, 6) AS d_paired, round((avg(l_quantity) - avg(l_tax)) / sqrt((var_pop(l_quantity) + var_pop(l_tax)) / 2), 6) AS d_pooled FROM lineitem GROUP BY 1")
def sta_effect_sizes(spark, sf_dir):
    return M.effect_sizes(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", ["l_returnflag"])


@query("WITH t AS (SELECT o_orderpriority AS test, 1.0 / count(*) AS p FROM orders GROUP BY 1) SELECT test, p < 0.05 / count(*) OVER () AS significant FROM t")
def sta_bonferroni(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("test")).agg((1.0 / F.count("*")).alias("p"))
    n = t.agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(n)).select("test", (F.col("p") < 0.05 / F.col("n")).alias("significant"))
