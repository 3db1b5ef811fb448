"""Guards of splits, exact splits and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import guards as G
from quern.operators import sampling as Q
from quern.plans import conditions as C
from quern.queries.registry import PAIRS, pairs, query, table

_KEY = "lower(trim(text))"
_LINES = "unnest(string_split(text, chr(10)))"


def _key():
    return F.lower(F.trim("text"))


def _lines(t, *columns):
    return t.select(*columns, F.explode(F.split("text", "\n")).alias("text"))


@query(f"WITH {PAIRS}, x AS (SELECT trim(src) AS s, CASE WHEN ord % 5 = 0 THEN trim(src) WHEN ord % 7 = 0 THEN ' ' ELSE trim(tgt) END AS t FROM pairs) SELECT count(*) AS pairs, count(*) FILTER (s = '' OR trim(t) = '') AS empty, count(*) FILTER (s <> '' AND s = t) AS identical, count(*) FILTER (s <> '' AND trim(t) <> '' AND s <> t) AS kept FROM x")
def ded_side_counts(spark, sf_dir):
    """Every fifth answer is made the question and every seventh blank."""
    tgt = F.when(F.col("ord") % 5 == 0, F.col("src")).when(F.col("ord") % 7 == 0, " ").otherwise(F.col("tgt"))
    return G.side_counts(pairs(spark, sf_dir).withColumn("tgt", tgt))


@query("WITH k AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) SELECT doc_id, 'M5_' || lpad(row_number() OVER (ORDER BY doc_id)::VARCHAR, greatest(4, length((row_number() OVER (ORDER BY doc_id))::VARCHAR)::INT), '0') AS new_id FROM k")
def ded_numbered_first(spark, sf_dir):
    return G.numbered_first(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id", "M5_").select("doc_id", "new_id")


@query(f"WITH l AS (SELECT doc_id, source, {_LINES} AS text FROM documents), b AS (SELECT DISTINCT trim(t) AS k FROM (SELECT {_LINES} AS t FROM benchmark) WHERE trim(t) <> '') SELECT doc_id, count(*) AS lines FROM l WHERE trim(text) NOT IN (SELECT k FROM b) GROUP BY doc_id")
def dec_by_stripped_line(spark, sf_dir):
    """Lines that the benchmark doesn't have, capitals told apart."""
    from quern.operators.rows import without_keys

    held = _lines(table(spark, sf_dir, "benchmark")).filter("trim(text) <> ''")
    return without_keys(_lines(table(spark, sf_dir, "documents"), "doc_id"), held, F.trim("text"), F.trim("text")).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(f"WITH l AS (SELECT source, lower(trim(t)) AS k FROM (SELECT source, {_LINES} AS t FROM documents)), b AS (SELECT DISTINCT lower(trim(t)) AS k FROM (SELECT {_LINES} AS t FROM benchmark)) SELECT source, count(*) AS rows, count(b.k) AS dropped FROM l LEFT JOIN b USING (k) GROUP BY source")
def dec_drop_counts(spark, sf_dir):
    return G.drop_counts(_lines(table(spark, sf_dir, "documents"), "source"), "source", _lines(table(spark, sf_dir, "benchmark")), _key(), _key())


@query(f"WITH d AS (SELECT doc_id, lang, source, {_KEY} AS k FROM documents), t AS (SELECT DISTINCT {_KEY} AS k FROM benchmark UNION SELECT k FROM d WHERE lang = 'es'), f AS (SELECT DISTINCT k FROM d WHERE lang = 'fr'), e AS (SELECT DISTINCT k FROM d WHERE doc_id % 3 = 0) "
       "SELECT d.doc_id, CASE WHEN t.k IS NOT NULL THEN 'test' WHEN f.k IS NOT NULL AND e.k IS NOT NULL THEN 'french+third' WHEN f.k IS NOT NULL THEN 'french' WHEN e.k IS NOT NULL THEN 'third' ELSE 'kept' END AS verdict FROM d LEFT JOIN t USING (k) LEFT JOIN f USING (k) LEFT JOIN e USING (k)")  # fmt: skip
def dec_guarded_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    test = table(spark, sf_dir, "benchmark").select("text").unionByName(d.filter("lang = 'es'").select("text"))
    return G.guarded_pool(d, _key(), test, {"french": d.filter("lang = 'fr'"), "third": d.filter("doc_id % 3 = 0")}, _key()).select("doc_id", "verdict")


@query(f"WITH d AS (SELECT DISTINCT {_KEY} AS k, source AS s FROM documents WHERE text IS NOT NULL) SELECT a.s AS a, b.s AS b, count(*) AS keys FROM d a JOIN d b ON a.k = b.k AND a.s < b.s GROUP BY ALL")
def dec_source_leaks(spark, sf_dir):
    """Texts that two sources share, as splits that should share none."""
    return G.leaks(table(spark, sf_dir, "documents"), "source", _key())


@query("SELECT a.s AS a, b.s AS b, count(*) AS keys FROM (SELECT DISTINCT o_custkey AS k, o_orderpriority AS s FROM orders) a JOIN (SELECT DISTINCT o_custkey AS k, o_orderpriority AS s FROM orders) b ON a.k = b.k AND a.s < b.s GROUP BY ALL")
def dec_group_leaks(spark, sf_dir):
    """Customers whose orders are in two priorities, as groups in two splits."""
    return G.leaks(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_custkey"))


@query("SELECT conv_id * 1000 + turn AS id, 'train' AS split FROM conversations UNION ALL (SELECT conv_id * 1000 + turn, 'dev' FROM conversations ORDER BY length(text), conv_id * 1000 + turn LIMIT 64)")
def flt_fallback_dev(spark, sf_dir):
    """64 rows: the feature."""
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").alias("size"), F.lit("train").alias("split"))
    return G.with_fallback(t, "split", ["size", "id"]).select("id", "split")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'structured' ELSE 'tatoeba' END AS subset FROM orders")
def flt_routed(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return G.routed(table(spark, sf_dir, "orders"), F.col("o_custkey"), c, F.col("c_custkey"), "structured", "tatoeba").select("o_orderkey", "subset")


@query("SELECT CASE WHEN p_retailprice / 100 < 10 THEN 'short' WHEN p_retailprice / 100 > 15 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1")
def flt_durations(spark, sf_dir):
    """Prices as durations, with how many are too short or too long."""
    from quern.functions.predicates import first_reason

    seconds = F.col("p_retailprice") / 100
    return table(spark, sf_dir, "part").select(F.coalesce(first_reason({"short": seconds < 10, "long": seconds > 15}), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) FILTER (length(text) > 5000) AS too_long, count(*) FILTER (length(text) <= 5000 AND length(text) < 40) AS too_short, count(*) FILTER (length(text) BETWEEN 40 AND 5000) AS kept FROM documents GROUP BY lang")
def flt_sequence_lengths(spark, sf_dir):
    from quern.functions.predicates import first_reason

    size = F.length("text")
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce(first_reason({"too_long": size > 5000, "too_short": size < 40}), F.lit("kept")).alias("reason"))
    return d.groupBy("lang").agg(*[F.sum((F.col("reason") == r).cast("long")).alias(r) for r in ("too_long", "too_short", "kept")])


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND trim(lang) <> '' AND trim(source) <> ''")
def flt_metadata(spark, sf_dir):
    from quern.functions.text import is_blank

    return table(spark, sf_dir, "documents").filter(~is_blank(F.col("lang")) & ~is_blank(F.col("source"))).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def smp_first_rows(spark, sf_dir):
    """25 rows: the feature."""
    return G.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 25)


@query("WITH k AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN '' ELSE 'c' || o_custkey END AS base, 's' || o_orderkey AS sid FROM orders) SELECT o_orderkey, coalesce(nullif(base, ''), sid) AS group_key FROM k")
def smp_group_keys(spark, sf_dir):
    """A base id where there is one, else the row's own id."""
    from quern.functions.text import first_filled

    base = F.when(F.col("o_custkey") % 4 == 0, None).when(F.col("o_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", first_filled(base, F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).alias("group_key"))


def _splits(size):
    return f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('7|' || c_custkey), c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN k <= greatest(1, {size}) THEN 'test' WHEN k <= 2 * greatest(1, {size}) THEN 'validation' ELSE 'train' END AS split FROM r"


@query(_splits("round_even(n * 0.15, 0)"))
def smp_rounded_group_split(spark, sf_dir):
    """Shares of the groups to the nearest even number."""
    from quern.operators.rows import group_split

    return group_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.15, 0.15, seed=7, rounding="bround")


@query("WITH g AS (SELECT DISTINCT o_custkey AS c FROM orders), r AS (SELECT c, row_number() OVER (ORDER BY md5('7|' || c), c) AS k, count(*) OVER () AS n FROM g) SELECT o_orderkey, CASE WHEN k <= greatest(1, ceil(n * 0.1)) THEN 'validation' ELSE 'train' END AS split FROM orders JOIN r ON c = o_custkey")
def smp_grouped_validation(spark, sf_dir):
    """Whole customers' orders, a tenth of the customers and any part of one more."""
    from quern.operators.sampling import grouped_validation

    return grouped_validation(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.1, seed=7).select("o_orderkey", "split")


_RANKED = "SELECT c_custkey, row_number() OVER (ORDER BY md5('{s}|' || c_custkey), c_custkey) AS k, count(*) OVER () AS n FROM {t}"


@query(f"WITH r AS ({_RANKED.format(s=1, t='customer')}) SELECT c_custkey, CASE WHEN k <= greatest(1, floor(n * 0.05)) THEN 'val' ELSE 'train' END AS split FROM r")
def smp_plain_validation(spark, sf_dir):
    return Q.plain_validation(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.05)


@query(f"WITH r AS ({_RANKED.format(s=1, t='customer')}), z AS (SELECT *, greatest(1, floor(n * 0.05)) AS m FROM r) SELECT c_custkey, CASE WHEN n < 10 OR k <= n - 2 * m THEN 'train' WHEN k <= n - m THEN 'val' ELSE 'test' END AS split FROM z")
def smp_index_split(spark, sf_dir):
    return Q.index_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("SELECT n || '-' || d AS subset, t AS p_type FROM (SELECT n, d, t, row_number() OVER (PARTITION BY n, d ORDER BY md5(s || '|' || t), t) AS k FROM (SELECT DISTINCT p_type AS t FROM part), (VALUES (2), (5)) x(n), (VALUES ('a', 3), ('b', 4), ('c', 5)) y(d, s)) WHERE k <= n")
def smp_random_subsets(spark, sf_dir):
    return Q.random_subsets(table(spark, sf_dir, "part"), "p_type", [2, 5], 3)


_MIXED = "r AS (SELECT corpus, key, row_number() OVER (PARTITION BY corpus ORDER BY md5('1|' || corpus || '|' || key), key) AS k, least((SELECT count(*) FROM supplier), (SELECT count(*) FROM customer)) AS n FROM b)"


@query(f"WITH b AS (SELECT 0 AS corpus, s_suppkey AS key FROM supplier UNION ALL SELECT 1, c_custkey FROM customer), {_MIXED} SELECT corpus, key, row_number() OVER (ORDER BY md5('2|' || corpus || '|' || key), corpus, key) AS place FROM r WHERE k <= n")
def smp_mixed(spark, sf_dir):
    return Q.mixed(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")


_NUMBER = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(f"WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('1|' || s_suppkey), s_suppkey) - 1 AS place, count(*) OVER () AS n FROM supplier) SELECT draw, s_suppkey FROM range(1, 501) d(draw) JOIN p ON place = {_NUMBER.format(chr(39) + '1|' + chr(39) + ' || draw')} % n")
def smp_with_replacement(spark, sf_dir):
    """500 draws: the number is the feature."""
    return Q.drawn_with_replacement(table(spark, sf_dir, "supplier"), "s_suppkey", 500)


@query(f"WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('1|' || c_custkey), c_custkey) - 1 AS place FROM customer), z AS (SELECT count(*) AS n FROM customer), o AS (SELECT o_orderkey, n, {_NUMBER.format(chr(39) + '1|' + chr(39) + ' || o_orderkey')} % n AS a, 1 + {_NUMBER.format(chr(39) + '2|' + chr(39) + ' || o_orderkey')} % greatest(1, n // 4) AS b FROM orders, z), s AS (SELECT *, unnest(generate_series(1, least(4, n))) AS slot FROM o) SELECT o_orderkey, slot::INT AS slot, c_custkey AS context FROM s JOIN p ON place = (a + (slot - 1) * b) % n")
def smp_context_rows(spark, sf_dir):
    """Four different context customers for each order."""
    return Q.context_rows(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_orderkey", "c_custkey", 4)


@query(f"WITH r AS ({_RANKED.format(s=1, t='customer')}), a AS (SELECT c_custkey, k <= ceil(n * 0.1) AS test FROM r), q AS ({_RANKED.format(s=2, t='(SELECT * FROM a WHERE NOT test)')}) SELECT c_custkey, 'test' AS split FROM a WHERE test UNION ALL SELECT c_custkey, CASE WHEN k <= ceil(n * (0.1 / 0.9)) THEN 'dev' ELSE 'train' END FROM q")
def smp_two_step(spark, sf_dir):
    return Q.two_step_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("SELECT condition, count(*) AS n FROM (SELECT unnest(CASE WHEN m <= 2 THEN ['ADD-M1M2', 'ADD-M1M2M3', 'ADD-M1M2M3M4'] WHEN m = 3 THEN ['ADD-M1M2M3', 'ADD-M1M2M3M4'] WHEN m = 4 THEN ['ADD-M1M2M3M4'] ELSE [] END) AS condition FROM (SELECT o_orderkey % 5 + 1 AS m FROM orders)) GROUP BY 1")
def gen_additive(spark, sf_dir):
    return C.additive(table(spark, sf_dir, "orders"), F.pmod("o_orderkey", F.lit(5)) + 1).groupBy("condition").agg(F.count("*").alias("n"))


_SELECTIONS = {"TFIDF": "c_custkey % 3 = 0", "LENGTH": "c_custkey % 5 = 0", "VOCAB": "c_custkey % 7 = 0"}


@query("WITH s AS (SELECT DISTINCT c_nationkey AS k, 0 AS o, 's' AS pool FROM customer WHERE c_custkey % 11 = 0), "
       + ", ".join(f"x{k} AS (SELECT DISTINCT c_nationkey AS k, {k} AS o, '{n}' AS pool FROM customer WHERE {w})" for k, (n, w) in enumerate(_SELECTIONS.items(), 1))
       + ", a AS (" + " UNION ALL ".join(f"SELECT 'STRUCT4K-{n}2K' AS condition, * FROM (SELECT * FROM s UNION ALL SELECT * FROM x{k})" for k, n in enumerate(_SELECTIONS, 1)) + " UNION ALL SELECT 'STRUCT4K-ALL-BASELINES', * FROM (SELECT * FROM s UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3)) SELECT condition, k, arg_min(pool, o) AS pool FROM a GROUP BY condition, k")
def gen_combos(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    of = lambda where, pool: c.filter(where).select(F.col("c_nationkey").alias("k")).distinct().withColumn("pool", F.lit(pool))
    return C.combos(of("c_custkey % 11 = 0", "s"), {n: of(w, n) for n, w in _SELECTIONS.items()}, "k")


@query("WITH t AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 0), o AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 10 <> 0), f AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY md5('1|' || c_custkey), c_custkey) AS r, floor(count(*) OVER () * 0.1) AS n FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 10 <> 0), "
       "x AS (SELECT run, 'test' AS split, 'test' AS origin, k FROM t, (VALUES ('A'), ('B1'), ('B2'), ('B3')) v(run) UNION ALL SELECT run, 'train', 'base', k FROM o, (VALUES ('A'), ('B1'), ('B2')) v(run) UNION ALL SELECT run, CASE WHEN run = 'B2' AND r <= n THEN 'test' ELSE 'train' END, 'new', k FROM f, (VALUES ('B1'), ('B2'), ('B3')) v(run)) SELECT run, split, origin, count(*) AS n, sum(k)::BIGINT AS keys FROM x GROUP BY ALL")  # fmt: skip
def gen_expansions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return C.expansions(c.filter("k % 3 = 0"), c, c.filter("k % 10 = 0"), "k").groupBy("run", "split", "origin").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("WITH x AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'ERROR' ELSE text END AS text FROM documents) SELECT min(doc_id) AS doc_id, '2026-01-31' AS created FROM x WHERE text <> 'ERROR' GROUP BY text")
def gen_combined(spark, sf_dir):
    """Texts of three languages and the rest as modules; every sixth is a failure."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 6 == 0, "ERROR").otherwise(F.col("text")).alias("text"))
    return C.combined([d.filter("lang = 'en'"), d.filter("lang = 'fr'").drop("lang"), d.filter("coalesce(lang, '') NOT IN ('en', 'fr')")], "text", "doc_id", ["text"], "2026-01-31").select("doc_id", "created")


@query("WITH c AS (SELECT sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0) SELECT DISTINCT sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT digest FROM c)")
def orc_pending_contents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return G.pending(d, d.filter("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest")), F.col("text")).select("digest")
