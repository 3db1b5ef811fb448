"""Deduplication, decontamination, splits, samples, joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators import rows as R
from quern.operators.ordering import quantiles
from quern.queries.registry import PAIRS, pairs, query, table, words_sql


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def ded_text_first(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("WITH " + PAIRS + " SELECT min(ord) AS ord, src, tgt FROM pairs GROUP BY src, tgt")
def ded_pair_first(spark, sf_dir):
    return R.keep_first(pairs(spark, sf_dir).select("ord", "src", "tgt"), ["src", "tgt"], ["ord"])


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def ded_last_wins(spark, sf_dir):
    return R.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT o_orderkey, 'M' || row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS seq FROM orders")
def win_running_sequence(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("M"), n.cast("string")).alias("seq"))


@query("SELECT doc_id FROM documents WHERE lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM benchmark WHERE text IS NOT NULL)")
def dec_by_key(spark, sf_dir):
    key = F.lower(F.trim(F.col("text")))
    return R.without_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), key, key).select("doc_id")


@query("WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark), k AS (SELECT * FROM b WHERE trim(line) <> '') SELECT source, count(DISTINCT doc_id) AS docs, count(DISTINCT line) AS lines FROM l JOIN k USING (line) GROUP BY source")
def dec_report(spark, sf_dir):
    lines = lambda t, *c: t.select(*c, F.explode(F.split("text", "\n")).alias("line"))
    held = lines(table(spark, sf_dir, "benchmark")).filter("trim(line) <> ''").distinct()
    hit = lines(table(spark, sf_dir, "documents"), "doc_id", "source").join(held, "line")
    return hit.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("line").alias("lines"))


@query("WITH g AS (SELECT c_custkey, md5('7|' || c_custkey) AS h FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY h, c_custkey) AS k, count(*) OVER () AS n FROM g) SELECT c_custkey, CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN 'test' WHEN k <= greatest(1, floor(n * 0.1)) + greatest(1, floor(n * 0.1)) THEN 'validation' ELSE 'train' END AS split FROM r")
def smp_group_split(spark, sf_dir):
    return R.group_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.1, 0.1, seed=7)


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3|' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 50")
def smp_stratified(spark, sf_dir):
    """50 a stratum: the feature."""
    return R.strata_sample(table(spark, sf_dir, "orders"), "o_orderpriority", 50, "o_orderkey", 3).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey FROM part ORDER BY md5('5|' || p_partkey), p_partkey LIMIT 100")
def smp_uniform(spark, sf_dir):
    """100 rows: the feature."""
    return R.sample_rows(table(spark, sf_dir, "part").select("p_partkey"), 100, "p_partkey", 5)


@query("WITH a AS (SELECT s_nationkey AS k, count(*) AS na, sum(s_acctbal) AS sa FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS nb, sum(c_acctbal) AS sb FROM customer GROUP BY 1) SELECT k, na, nb, CASE WHEN na IS NULL THEN 'right_only' WHEN nb IS NULL THEN 'left_only' ELSE 'both' END AS side, round(sa - sb, 2) AS delta FROM a FULL JOIN b USING (k)")
def jon_outer_with_side(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("na"), F.sum("s_acctbal").alias("sa"))
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("nb"), F.sum("c_acctbal").alias("sb"))
    side = F.when(F.col("na").isNull(), "right_only").when(F.col("nb").isNull(), "left_only").otherwise("both")
    return a.join(b, "k", "full_outer").select("k", "na", "nb", side.alias("side"), F.round(F.col("sa") - F.col("sb"), 2).alias("delta"))


@query("SELECT d.doc_id, count(b.item_id) AS n, max(length(b.text)) AS longest FROM documents d LEFT JOIN benchmark b ON starts_with(d.text, b.text) GROUP BY d.doc_id")
def jon_longest_prefix(spark, sf_dir):
    """Texts meet benchmark items by their first 24 characters, or by all of an item that is shorter; an equality, so no pairs are compared at large. The lengths that occur are 25 at most."""
    items = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select("item_id", F.col("text").alias("item"), F.least(F.length("text"), F.lit(24)).alias("k"))
    lengths = [r["k"] for r in items.select("k").distinct().collect()] or [0]
    head = lambda c: F.substr(c, F.lit(1), F.col("k")).alias("h")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = d.select("*", F.explode(F.array(*[F.lit(k) for k in lengths])).alias("k")).select("*", head(F.col("text")))
    hits = cut.join(items.select("*", head(F.col("item"))), ["k", "h"]).filter(F.col("text").startswith(F.col("item")))
    found = hits.groupBy("doc_id").agg(F.count("item_id").alias("n"), F.max(F.length("item")).alias("longest"))
    return d.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), "longest")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jon_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def jon_condition_pairs(spark, sf_dir):
    """All unordered pairs of the five regions, which are conditions here and not rows of data."""
    a, b = (table(spark, sf_dir, "region").select(F.col("r_name").alias(x)) for x in "ab")
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


@query("SELECT n_nationkey, first_key FROM nation LEFT JOIN (SELECT c_nationkey, arg_min(c_custkey, c_custkey) AS first_key FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON n_nationkey = c_nationkey")
def jon_first_lookup(spark, sf_dir):
    first = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min_by("c_custkey", "c_custkey").alias("first_key"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(first, "n_nationkey", "left")


@query("SELECT w AS word, bool_or(lang = 'en') AS in_en, bool_or(lang = 'de') AS in_de FROM (SELECT lang, unnest(" + words_sql("lower(text)") + ") AS w FROM documents) WHERE lang IN ('en', 'de') GROUP BY w HAVING count(DISTINCT lang) = 2")
def set_vocabulary_overlap(spark, sf_dir):
    w = table(spark, sf_dir, "documents").filter("lang IN ('en', 'de')").select("lang", F.explode(tokens(F.lower("text"))).alias("word"))
    both = w.groupBy("word").agg(F.bool_or(F.col("lang") == "en").alias("in_en"), F.bool_or(F.col("lang") == "de").alias("in_de"))
    return both.filter("in_en AND in_de")


@query("WITH v AS (SELECT DISTINCT lang, unnest(" + words_sql("lower(text)") + ") AS w FROM documents), n AS (SELECT lang, count(*) AS n FROM v GROUP BY lang) SELECT a.lang AS a, b.lang AS b, round(100 * count(*) / any_value(n.n), 4) AS coverage FROM v a JOIN v b USING (w) JOIN n ON n.lang = b.lang GROUP BY 1, 2")
def agg_vocabulary_coverage(spark, sf_dir):
    """Words meet by word; a word has one row for each language at most."""
    v = table(spark, sf_dir, "documents").select("lang", F.explode(tokens(F.lower("text"))).alias("w")).distinct()
    by = v.groupBy("w").agg(F.collect_set("lang").alias("langs"))
    two = by.select(F.explode("langs").alias("a"), "langs").select("a", F.explode("langs").alias("b")).groupBy("a", "b").count()
    n = two.filter("a = b").select(F.col("b"), F.col("count").alias("n"))
    return two.join(F.broadcast(n), "b").select("a", "b", F.round(100 * F.col("count") / F.col("n"), 4).alias("coverage"))


@query("WITH w AS (SELECT lang, unnest(" + words_sql("text") + ") AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang) SELECT c.lang, sum(c.n)::BIGINT AS tokens, count(*) AS types, round(count(*) / sum(c.n), 6) AS ttr, count(*) FILTER (c.n = 1) AS hapax, round(-sum(c.n / t.n * log2(c.n / t.n)), 4) AS entropy FROM c JOIN t ON c.lang IS NOT DISTINCT FROM t.lang GROUP BY c.lang")
def agg_corpus_statistics(spark, sf_dir):
    """Tokens, types, their ratio, words that stand once, and entropy in bits, by language."""
    c = table(spark, sf_dir, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    s = c.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("hapax"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    entropy = F.log2("tokens") - F.col("nlogn") / F.col("tokens")
    return s.select("lang", "tokens", "types", F.round(F.col("types") / F.col("tokens"), 6).alias("ttr"), "hapax", F.round(entropy, 4).alias("entropy"))


@query("SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 7 THEN '4-7' WHEN n <= 15 THEN '8-15' ELSE '16+' END AS bucket, count(*) AS docs FROM (SELECT len(" + words_sql("text") + ") AS n FROM documents) GROUP BY 1")
def agg_length_buckets(spark, sf_dir):
    n = F.size(tokens(F.col("text")))
    bucket = F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").when(n <= 15, "8-15").otherwise("16+")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("docs"))


@query("WITH n AS (SELECT source, len(" + words_sql("text") + ") AS n FROM documents) SELECT source, count(*) AS docs, round(avg(n), 4) AS mean, round(coalesce(stddev_samp(n), 0), 4) AS sd, quantile_cont(n, 0.5) AS median, list_sort(list(n))[greatest(1, floor(count(*) * 0.95)::BIGINT)] AS p95, count(*) FILTER (n > 128) AS over_128 FROM n GROUP BY source")
def agg_length_summary(spark, sf_dir):
    """p95 is the element at the truncated place in ascending order, found by rank and not by gathering a source's lengths."""
    n = table(spark, sf_dir, "documents").select("source", F.size(tokens(F.col("text"))).alias("n"))
    s = n.groupBy("source").agg(F.count("*").alias("docs"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 4).alias("sd"), F.sum((F.col("n") > 128).cast("long")).alias("over_128"))
    upto = F.sum("k").over(Window.partitionBy("source").orderBy("n"))
    place = n.groupBy("source", "n").agg(F.count("*").alias("k")).withColumn("upto", upto)
    p95 = place.join(F.broadcast(s.select("source", "docs")), "source").filter(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("docs") * 0.95))).groupBy("source").agg(F.min("n").alias("p95"))
    return s.join(p95, "source").join(quantiles(n, "n", {"median": 0.5}, ["source"]), "source")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std_pop, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY ALL")
def agg_deviations(spark, sf_dir):
    q = "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("std_pop"), F.round(F.stddev_samp(q), 6).alias("std"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.percentile(q, 0.1).alias("p10"), F.percentile(q, 0.9).alias("p90"))


@query("WITH m AS (SELECT source, lang, avg(n_chars) AS m FROM documents GROUP BY ALL) SELECT source, round(avg(m), 4) AS mean_of_means, count(*) AS langs FROM m GROUP BY source")
def agg_mean_of_means(spark, sf_dir):
    m = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("m"))
    return m.groupBy("source").agg(F.round(F.avg("m"), 4).alias("mean_of_means"), F.count("*").alias("langs"))


@query("WITH m AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT p, round(m - (SELECT m FROM m WHERE p = '1-URGENT'), 2) AS delta FROM m")
def agg_delta_to_baseline(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.avg("o_totalprice").alias("m"))
    base = m.filter("p = '1-URGENT'").select(F.col("m").alias("base"))
    return m.join(F.broadcast(base), how="left").select("p", F.round(F.col("m") - F.col("base"), 2).alias("delta"))


@query("SELECT substr(md5(string_agg(text, chr(10) ORDER BY text)), 1, 12) AS fingerprint FROM benchmark")
def agg_fingerprint(spark, sf_dir):
    """Of the benchmark, which is small by contract: one value over a sorted list is one task."""
    return table(spark, sf_dir, "benchmark").agg(F.substring(F.md5(F.array_join(F.sort_array(F.collect_list("text")), "\n")), 1, 12).alias("fingerprint"))


@query("WITH t AS (SELECT doc_id, list_concat(['<s>'], " + words_sql("text") + ", ['</s>']) AS w FROM documents), g AS (SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def agg_bigrams(spark, sf_dir):
    w = F.concat(F.array(F.lit("<s>")), tokens(F.col("text")), F.array(F.lit("</s>")))
    pairs_ = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    return table(spark, sf_dir, "documents").select(w.alias("w")).select(F.explode(pairs_).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT date_trunc('month', l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT strftime(m, '%Y-%m') AS month, q, q - lag(q) OVER (ORDER BY m) AS delta FROM m")
def win_adjacent_delta(spark, sf_dir):
    """The window runs over months, which do not grow with the rows."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_quantity").alias("q"))
    return m.select("month", "q", (F.col("q") - F.lag("q").over(Window.orderBy("month"))).alias("delta"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def srt_best_with_ties(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 END, 99) AS place FROM customer")
def srt_custom_ranks(spark, sf_dir):
    rank = F.create_map(F.lit("BUILDING"), F.lit(0), F.lit("AUTOMOBILE"), F.lit(1))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(rank[F.col("c_mktsegment")], F.lit(99)).alias("place"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def rsh_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.count(F.lit(1)))
    return p.select("user_id", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("error", F.lit(0)).alias("error"))


@query("SELECT s_suppkey, 'acctbal' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier")
def rsh_unpivot(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["acctbal", "nation"], "metric", "value")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def agg_subset_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, row_number() OVER (ORDER BY r_name, n_name) AS id FROM region JOIN nation ON n_regionkey = r_regionkey")
def gen_grid(spark, sf_dir):
    """A grid of regions and nations with running numbers, as job grids have."""
    j = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("r_name", "n_name", F.row_number().over(Window.orderBy("r_name", "n_name")).alias("id"))


@query("SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS hi, round(list_min(embedding)::DOUBLE, 6) AS lo, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / len(embedding)), 5) AS rms FROM embeddings")
def aud_levels(spark, sf_dir):
    from quern.operators.audio import levels

    v = table(spark, sf_dir, "embeddings").select("vec_id", levels(F.col("embedding"), F.lit(16)).alias("l"))
    return v.select("vec_id", F.round("l.hi", 6).alias("hi"), F.round("l.lo", 6).alias("lo"), F.round("l.rms", 5).alias("rms"))
