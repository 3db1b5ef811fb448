"""Joins, reshaping, windows and records that report tables are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import predicates as P
from quern.functions import text as T
from quern.operators import reports as G
from quern.operators import rows as R
from quern.queries.registry import PAIRS, pairs, query, table, words_sql
from quern.sources import readers, writers


@query("SELECT s_suppkey, coalesce(a.k, b.k) AS matched, CASE WHEN a.k IS NOT NULL THEN 'strong' WHEN b.k IS NOT NULL THEN 'weak' ELSE 'none' END AS how FROM supplier LEFT JOIN (SELECT c_nationkey, round(c_acctbal) AS r, min(c_custkey) AS k FROM customer GROUP BY ALL) a ON a.c_nationkey = s_nationkey AND a.r = round(s_acctbal) LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) b ON b.c_nationkey = s_nationkey")
def jon_fallback(spark, sf_dir):
    """The strong key (nation and rounded balance) first; suppliers without a match there take the weak one (nation)."""
    c = table(spark, sf_dir, "customer")
    strong = c.groupBy(F.col("c_nationkey").alias("s_nationkey"), F.round("c_acctbal").alias("r")).agg(F.min("c_custkey").alias("a"))
    weak = c.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("b"))
    j = table(spark, sf_dir, "supplier").withColumn("r", F.round("s_acctbal")).join(strong, ["s_nationkey", "r"], "left").join(weak, "s_nationkey", "left")
    how = F.when(F.col("a").isNotNull(), "strong").when(F.col("b").isNotNull(), "weak").otherwise("none")
    return j.select("s_suppkey", F.coalesce("a", "b").alias("matched"), how.alias("how"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'rejected' END, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def jon_override(spark, sf_dir):
    """A filled override wins over the row's own value."""
    o = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "rejected").alias("override"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(o, "doc_id", "left").select("doc_id", F.coalesce(T.blank_to_null(F.col("override")), "source").alias("source"))


@query("SELECT a.conv_id, a.turn, a.text = b.text AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def jon_zip(spark, sf_dir):
    """Turns side by side with the next, by their place and not by the order of files."""
    c = table(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("text") == F.col("next")).alias("same"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) = max(value) AS agrees FROM events GROUP BY user_id")
def jon_last_change(spark, sf_dir):
    """Of each user the last event, and whether its value is the greatest."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("v"), F.max("value").alias("m"))
    return e.select("user_id", "event_id", (F.col("v") == F.col("m")).alias("agrees"))


@query("SELECT a.o_orderpriority AS a, b.o_orderpriority AS b, count(*) AS customers FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) a JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) b ON a.o_custkey = b.o_custkey AND a.o_orderpriority < b.o_orderpriority GROUP BY 1, 2")
def jon_paired_conditions(spark, sf_dir):
    """Customers that two priorities share, each pair of priorities once. A customer has five priorities at most."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    two = o.select(F.explode("p").alias("a"), "p").select("a", F.explode("p").alias("b")).filter("a < b")
    return two.groupBy("a", "b").agg(F.count("*").alias("customers"))


@query("SELECT d.source, count(*) FILTER (l.toxic = 1) AS inside, count(*) FILTER (l.toxic = 0) AS outside, count(*) FILTER (l.doc_id IS NULL) AS unknown FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def set_attribution(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("known"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(l, "doc_id", "left").groupBy("source").agg(n(F.col("toxic") == 1).alias("inside"), n(F.col("toxic") == 0).alias("outside"), n(F.col("known").isNull()).alias("unknown"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 5")
def srt_examples(spark, sf_dir):
    """Five a type: the limit is the feature, and it prunes before the exchange."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("event_type", "event_id")


@query(f"WITH {PAIRS} SELECT 'forward' AS direction, ord, regexp_replace(src, '[\\t\\n]+', ' ', 'g') AS a, regexp_replace(tgt, '[\\t\\n]+', ' ', 'g') AS b FROM pairs WHERE trim(src) <> '' AND trim(tgt) <> '' UNION ALL SELECT 'reverse', ord, regexp_replace(tgt, '[\\t\\n]+', ' ', 'g'), regexp_replace(src, '[\\t\\n]+', ' ', 'g') FROM pairs WHERE trim(src) <> '' AND trim(tgt) <> ''")
def rsh_directions(spark, sf_dir):
    flat = lambda c: F.regexp_replace(c, "[\\t\\n]+", " ")
    p = pairs(spark, sf_dir).filter("trim(src) <> '' AND trim(tgt) <> ''").select("ord", flat("src").alias("s"), flat("tgt").alias("t"))
    both = F.array(F.struct(F.lit("forward").alias("direction"), F.col("s").alias("a"), F.col("t").alias("b")), F.struct(F.lit("reverse").alias("direction"), F.col("t").alias("a"), F.col("s").alias("b")))
    return p.select("ord", F.inline(both)).select("direction", "ord", "a", "b")


@query("SELECT n_regionkey, CASE WHEN min(n_nationkey) = max(n_nationkey) THEN min(n_nationkey)::VARCHAR ELSE min(n_nationkey) || '-' || max(n_nationkey) END AS ids FROM nation GROUP BY n_regionkey")
def rsh_tier_ranges(spark, sf_dir):
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("lo"), F.max("n_nationkey").alias("hi"))
    return n.select("n_regionkey", F.when(F.col("lo") == F.col("hi"), lo).otherwise(F.concat(lo, F.lit("-"), hi)).alias("ids"))


@query("WITH s AS (SELECT n_regionkey AS split, count(*) AS n FROM nation GROUP BY 1), c AS (SELECT split, n, sum(n) OVER (ORDER BY split) - n AS first FROM s) SELECT n_nationkey, split FROM nation JOIN c ON n_nationkey >= first AND n_nationkey < first + n")
def rsh_slices(spark, sf_dir):
    """Rows cut into contiguous slices by the splits' sizes; the table of splits is small and its bounds are a range join."""
    n = table(spark, sf_dir, "nation")
    s = n.groupBy(F.col("n_regionkey").alias("split")).agg(F.count("*").alias("n"))
    c = s.withColumn("first", F.sum("n").over(Window.orderBy("split")) - F.col("n"))  # splits, not rows
    return n.join(F.broadcast(c), (F.col("n_nationkey") >= F.col("first")) & (F.col("n_nationkey") < F.col("first") + F.col("n"))).select("n_nationkey", "split")


@query("WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM conversations) WHERE ch <> '' GROUP BY ch) SELECT ch, n, round(100 * sum(n) OVER (ORDER BY n DESC, ch) / (SELECT sum(n) FROM c), 4) AS share, n < 10 AS rare FROM c")
def win_cumulative_share(spark, sf_dir):
    """The window runs over the distinct characters."""
    c = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.orderBy(F.desc("n"), "ch").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("ch", "n", F.round(100 * upto / total, 4).alias("share"), (F.col("n") < 10).alias("rare"))


@query("WITH m AS (SELECT n_name, avg(s_acctbal) AS m FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT n_name, rank() OVER (ORDER BY m NULLS LAST) AS place FROM m")
def win_rank_missing_last(spark, sf_dir):
    m = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.avg("s_acctbal").alias("m"))
    return m.select("n_name", F.rank().over(Window.orderBy(F.asc_nulls_last("m"))).cast("long").alias("place"))  # nations, not rows


@query("SELECT lang, count(*) - count(DISTINCT text) AS duplicates, round(avg(length(text)), 4) AS mean_length, sum((trim(coalesce(text, '')) = '')::INT)::BIGINT AS empty FROM documents GROUP BY lang")
def agg_duplicates(spark, sf_dir):
    """Copies are counted by a hash of the text, so that no exchange carries texts."""
    d = table(spark, sf_dir, "documents").select("lang", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("h"), F.length("text").alias("k"), T.is_blank(F.col("text")).cast("long").alias("e"))
    one = d.groupBy("lang", "h").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.count("k").alias("known"), F.sum("e").alias("e"))
    return one.groupBy("lang").agg((F.sum("n") - F.count("h")).alias("duplicates"), F.round(F.sum("k") / F.sum("known"), 4).alias("mean_length"), F.sum("e").alias("empty"))


@query("SELECT page_id, md5(url) || '.html' AS name, sha256(html) AS digest FROM pages")
def agg_content_digests(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.md5("url"), F.lit(".html")).alias("name"), F.sha2("html", 256).alias("digest"))


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 3600.0, 4) AS hours, count(DISTINCT lang) AS langs, array_to_string(list_sort(list_distinct(list(lang))), ' ') AS lang_list FROM documents GROUP BY source")
def agg_manifest(spark, sf_dir):
    """Languages are few, so a set of them is bounded."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sort_array(F.collect_set("lang")).alias("l"))
    return d.select("source", "n", "chars", F.round(F.col("chars") / 3600.0, 4).alias("hours"), F.size("l").cast("long").alias("langs"), F.array_join("l", " ").alias("lang_list"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (k IS NULL) AS failed, round(avg(value), 4) AS mean, quantile_cont(value, 0.5) AS median, max(value) AS most FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def agg_stages(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return G.stage_summary(e, "event_type", "value", F.col("k").isNull()).withColumn("mean", F.round("mean", 4))


@query("WITH r AS (SELECT DISTINCT unnest(" + words_sql("text") + ") AS w FROM conversations WHERE role = 'user'), h AS (SELECT DISTINCT unnest(" + words_sql("text") + ") AS w FROM conversations WHERE role = 'assistant') SELECT (SELECT count(*) FROM r) AS ref_words, (SELECT count(*) FROM h) AS hyp_words, (SELECT count(*) FROM r JOIN h USING (w)) AS shared")
def agg_vocabulary_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')").select("role", F.explode(T.tokens(F.col("text"))).alias("w"))
    w = c.groupBy("w").agg(F.bool_or(F.col("role") == "user").alias("r"), F.bool_or(F.col("role") == "assistant").alias("h"))
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return w.agg(n(F.col("r")).alias("ref_words"), n(F.col("h")).alias("hyp_words"), n(F.col("r") & F.col("h")).alias("shared"))


@query("WITH m AS (SELECT o_orderpriority AS p, o_orderstatus AS s, avg(o_totalprice) AS m FROM orders GROUP BY ALL), u AS (SELECT p, s, 'mean' AS metric, m AS value FROM m UNION ALL SELECT o_orderpriority, o_orderstatus, 'most', max(o_totalprice) FROM orders GROUP BY 1, 2) SELECT p, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM u GROUP BY ALL")
def agg_any_metric(spark, sf_dir):
    """Mean and population deviation of every metric of the runs, one row each."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), "o_orderstatus").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return G.metric_summary(m, ["p"], ["mean", "most"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def orc_pending(spark, sf_dir):
    """What a finished checkpoint doesn't have yet."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return R.without_keys(c, done, F.col("c_custkey"), F.col("o_custkey"))


@query(f"WITH {PAIRS} SELECT ord, '{{\"messages\":' || to_json([{{'role': 'user', 'content': src}}, {{'role': 'assistant', 'content': tgt}}]) || '}}' AS record FROM pairs")
def snk_chat(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", writers.chat("src", "tgt").alias("record"))


@query("SELECT lang, CASE WHEN count(*) = 0 THEN '-' ELSE printf('%.2f', avg(n_chars)) || '±' || printf('%.2f', stddev_samp(n_chars)) END AS cell FROM documents GROUP BY lang HAVING count(*) > 1")
def snk_cells(spark, sf_dir):
    m = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("m"), F.stddev_samp("n_chars").alias("s"), F.count("*").alias("n")).filter("n > 1")
    return m.select("lang", writers.mean_and_deviation(F.col("m"), F.col("s")).alias("cell"))


@query("SELECT n_regionkey, string_agg(i || '. ' || n_name, chr(10) ORDER BY i) AS list FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) GROUP BY n_regionkey")
def snk_numbered_list(spark, sf_dir):
    """A region's nations as one numbered list; lists are bounded by the names of a module."""
    names = F.sort_array(F.collect_list("n_name"))
    lines = F.transform(names, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(lines, "\n").alias("list"))


@query("SELECT 1::INT AS seed, regexp_extract(p, '([^/]+)/[^/]+/[^/]+/seed', 1) AS model, n FROM (SELECT 'runs/' || lower(o_orderpriority) || '/exp1/' || o_orderstatus || '/seed1/m.json' AS p, count(*) AS n FROM orders GROUP BY 1)")
def src_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("runs/"), F.lower("o_orderpriority"), F.lit("/exp1/"), F.col("o_orderstatus"), F.lit("/seed1/m.json")).alias("_path")).agg(F.count("*").alias("n"))
    return readers.with_run(o).select("seed", "model", "n")


@query("SELECT c_custkey, coalesce(o.n, c.n) AS n FROM (SELECT c_custkey, -1 AS n FROM customer) c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def src_prefer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    o = o.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return readers.prefer(o, table(spark, sf_dir, "customer").select("c_custkey", F.lit(-1).cast("long").alias("n")), ["c_custkey"])


@query("SELECT doc_id, CASE WHEN doc_id < 455 THEN 'structured' ELSE 'random' END AS subset FROM documents")
def flt_routing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.routed_by_place(F.col("doc_id"), 455).alias("subset"))


@query("SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size > 40) THEN 'structured' ELSE 'random' END AS subset FROM part")
def flt_routing_by_text(spark, sf_dir):
    """Rows whose text another table has."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return G.routed_by_membership(p, "p_name", p.filter("p_size > 40").select(F.concat("p_name", F.lit(" ")).alias("t")), "t").select("p_partkey", "subset")


_LABELLED = "^(.*[^:/]):([^:/]+)$"


@query(f"WITH t AS (SELECT page_id, trim(string_split(url, ',')[1]) AS t FROM pages) SELECT page_id, CASE WHEN regexp_matches(t, '{_LABELLED}') THEN regexp_extract(t, '{_LABELLED}', 2) ELSE list_filter(string_split(t, '/'), lambda p: p <> '')[-1] END AS label FROM t")
def spl_targets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.get(P.targets(F.col("url")), F.lit(0))["label"].alias("label"))
