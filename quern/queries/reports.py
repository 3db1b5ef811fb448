"""Reports over cells, characters, vocabularies and pools, printed tables and lists, checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import sentences as S
from quern.functions.text import tokens
from quern.operators import ordering as O
from quern.operators import reports as R
from quern.queries.registry import query, table, words_sql
from quern.scratch import scratch_path
from quern.sources import readers, writers

_MARKED = "t AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' cafe' || chr(769) WHEN 1 THEN ' né' ELSE '' END AS name, CASE WHEN p_partkey % 7 > 0 THEN p_type || CASE WHEN p_partkey % 5 = 0 THEN 'o' || chr(771) ELSE '' END END AS type FROM part), c AS (SELECT p_partkey, 'name' AS col, name AS text FROM t UNION ALL SELECT p_partkey, 'type', type FROM t WHERE type IS NOT NULL)"
_NFD = "length(text) + len(list_filter(string_split(text, ''), lambda ch: strip_accents(ch) <> ch AND strip_accents(ch) <> ''))"


def _marked(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 3 == 0, " café").when(k % 3 == 1, " né").otherwise(""))
    kind = F.when(k % 7 > 0, F.concat("p_type", F.when(k % 5 == 0, "õ").otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), kind.alias("type"))


@query(f'WITH {_MARKED} SELECT p_partkey, col AS "column", text AS original_text, nfc_normalize(text) AS normalized_text, length(text) AS original_length, length(nfc_normalize(text)) AS normalized_length, length(text) - length(nfc_normalize(text)) AS char_difference FROM c WHERE nfc_normalize(text) <> text')
def txt_nfc_cells(spark, sf_dir):
    """Each cell that NFC changes; composed and decomposed letters are put into two columns of parts."""
    return R.normal_form_changes(_marked(spark, sf_dir), "p_partkey", ["name", "type"])


@query(f'WITH {_MARKED} SELECT p_partkey, col AS "column", length(text) AS length, {_NFD} AS nfd_length, length(nfc_normalize(text)) AS nfc_length, length(nfc_normalize(text)) <> {_NFD} AS has_combining, nfc_normalize(text) <> text AS would_change FROM c')
def txt_nfc_diagnosis(spark, sf_dir):
    return R.normal_form_diagnosis(_marked(spark, sf_dir), "p_partkey", ["name", "type"])


@query(f'WITH {_MARKED}, n AS (SELECT count(*) AS n FROM part) SELECT col AS "column", any_value(n) AS total_rows, count(*) FILTER (nfc_normalize(text) <> text) AS rows_changed, round(100.0 * count(*) FILTER (nfc_normalize(text) <> text) / any_value(n), 6) AS percentage, sum(abs(length(text) - length(nfc_normalize(text))))::BIGINT AS total_char_diff FROM c, n GROUP BY col')
def txt_nfc_summary(spark, sf_dir):
    s = R.normal_form_summary(_marked(spark, sf_dir), "p_partkey", ["name", "type"])
    return s.withColumn("percentage", F.round("percentage", 6))


@query("SELECT o_custkey, round(avg(o_totalprice), 1) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 1) AS o_totalprice_std FROM orders GROUP BY o_custkey")
def agg_rounded_deviations(spark, sf_dir):
    """Many customers have one order and so no deviation."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*R.mean_and_spread(["o_totalprice"]))


@query("WITH p AS (SELECT 'V' || (p_partkey % 7) AS c, p_size, p_retailprice / 7 AS price FROM part), m AS (SELECT * FROM (VALUES ('one', 'V1'), ('three', 'V1'), ('three', 'V2'), ('three', 'V3'), ('last', 'V6')) v(pool, c)) SELECT pool, count(*) AS n, round_even(avg(p_size), 0)::BIGINT AS size, round(avg(price), 1) AS price_mean, round(stddev_samp(price), 1) AS price_std FROM p JOIN m USING (c) GROUP BY pool")
def agg_pooled(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"c": F.concat(F.lit("V"), (F.col("p_partkey") % 7).cast("string")), "price": F.col("p_retailprice") / 7})
    return R.pooled(p, "c", {"one": ["V1"], "three": ["V1", "V2", "V3"], "last": ["V6"], "none": ["V9"]}, ["price"], "p_size")


@query("WITH c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch) SELECT ch, 'U+' || upper(lpad(printf('%x', ord(ch)), 4, '0')) AS codepoint, n, round(100 * n / sum(n) OVER (), 6) AS percent, round(100 * sum(n) OVER (ORDER BY n DESC, ch) / sum(n) OVER (), 6) AS cumulative, n < 10 AS is_rare FROM c")
def agg_character_shares(spark, sf_dir):
    c = R.character_frequencies(table(spark, sf_dir, "documents"), "text")
    return c.withColumns({"percent": F.round("percent", 6), "cumulative": F.round("cumulative", 6)})


def _vocabularies(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = lambda lang: d.filter(F.col("lang") == lang).select(F.explode(tokens(F.lower("text"))).alias("word"))
    return {"en": words("en"), "de": words("de")}


_WORDS = "v AS (SELECT DISTINCT lang, unnest(" + words_sql("lower(text)") + ") AS word FROM documents WHERE lang IN ('en', 'de')), w AS (SELECT word, bool_or(lang = 'en') AS e, bool_or(lang = 'de') AS d FROM v GROUP BY word)"


@query(f"WITH {_WORDS} SELECT count(*) FILTER (e) AS en_words, count(*) FILTER (d) AS de_words, count(*) FILTER (e AND d) AS both, count(*) AS either, count(*) FILTER (NOT d) AS en_only, count(*) FILTER (NOT e) AS de_only, round(100.0 * count(*) FILTER (e AND d) / count(*) FILTER (d), 6) AS both_percent, round(100.0 * count(*) FILTER (NOT e) / count(*) FILTER (d), 6) AS de_only_percent FROM w")
def set_vocabularies(spark, sf_dir):
    s = R.vocabulary_sets(_vocabularies(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("both_percent", "de_only_percent")})


@query(f"WITH {_WORDS} SELECT 'both' AS part, word FROM w WHERE e AND d UNION ALL SELECT 'either', word FROM w UNION ALL SELECT 'en', word FROM w WHERE NOT d UNION ALL SELECT 'de', word FROM w WHERE NOT e")
def set_vocabulary_words(spark, sf_dir):
    v = _vocabularies(spark, sf_dir)
    parts = [R.words_of(v, p).select(F.lit(p).alias("part"), "word") for p in ("both", "either", "en", "de")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_RUNS = "SELECT o_orderpriority AS model, o_orderstatus AS condition, year(o_orderdate) % 3 AS subset, count(*) AS n, avg(o_totalprice) / 1000 AS m, stddev_samp(o_totalprice) / 1000 AS s FROM orders GROUP BY ALL"


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("condition"), (F.year("o_orderdate") % 3).alias("subset"))
    o = o.agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 1000).alias("m"), (F.stddev_samp("o_totalprice") / 1000).alias("s"))
    return O.ranks_within(o, ["model"], ["condition", "subset"], "place")


@query(f"WITH r AS (SELECT *, row_number() OVER w AS place, lag(condition) OVER w AS above FROM ({_RUNS}) WINDOW w AS (PARTITION BY model ORDER BY condition, subset)), "
       "h AS (SELECT '' AS section, 0 AS part, i - 1 AS place, x[i] AS line FROM (SELECT ['\\begin{table*}[t]', '\\centering\\small', '\\caption{Prices}', '\\label{tab:prices}', '\\begin{tabular}{llrr}', '\\toprule', 'Status & Year & $n$ & Price \\\\'] AS x), generate_series(1, 7) g(i)), "
       "f AS (SELECT chr(1114111) AS section, 3 AS part, i - 1 AS place, x[i] AS line FROM (SELECT ['\\bottomrule', '\\end{tabular}', '\\end{table*}'] AS x), generate_series(1, 3) g(i)), "
       "t AS (SELECT model AS section, 1 AS part, i - 1 AS place, CASE WHEN i = 2 THEN '\\multicolumn{4}{l}{\\textit{' || model || '}} \\\\' ELSE '\\midrule' END AS line FROM (SELECT DISTINCT model FROM r), generate_series(1, 3) g(i)), "
       "b AS (SELECT model AS section, 2 AS part, place, CASE WHEN condition = above THEN '' ELSE condition END || ' & ' || subset || ' & ' || n || ' & ' || printf('%.1f', m) || '$\\pm$' || coalesce(printf('%.1f', s), '--') || ' \\\\' AS line FROM r) "
       "SELECT section, part::INT AS part, place::BIGINT AS place, line FROM (SELECT * FROM h UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT * FROM b)")  # fmt: skip
def snk_latex_table(spark, sf_dir):
    """Mean prices by priority, status and year; a status that is that of the row above isn't printed again."""
    form = lambda c: F.coalesce(F.format_string("%.1f", c), F.lit("--"))
    cells = [F.col("condition"), F.col("subset"), F.col("n"), F.concat(form(F.col("m")), F.lit(r"$\pm$"), form(F.col("s")))]
    return R.latex_table(_runs(spark, sf_dir), "model", "place", "llrr", ["Status", "Year", "$n$", "Price"], cells, "Prices", "tab:prices")


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY model, condition, subset) AS place FROM ({_RUNS})) SELECT place, '| ' || model || ' | ' || n || ' | ' || coalesce(printf('%.1f', m) || ' +/- ' || printf('%.1f', s), '—') || ' |' AS line FROM r UNION ALL SELECT 0, '## Prices' UNION ALL SELECT -1, '' UNION ALL SELECT -2, '| Priority | n | Price |' UNION ALL SELECT -3, '|----------|---|-------|'")
def snk_markdown_table(spark, sf_dir):
    """Written as a file and read again; a line of the table's head has its place from the end."""
    r = O.ranks(_runs(spark, sf_dir).drop("place"), ["model", "condition", "subset"], "place")
    price = F.concat(F.format_string("%.1f", "m"), F.lit(" +/- "), F.when(F.col("s").isNotNull(), F.format_string("%.1f", "s")))
    t = R.markdown_table(r, "place", ["Priority", "n", "Price"], [F.col("model"), F.col("n"), price], "Prices")
    path = scratch_path(spark, "markdown")
    writers.ordered_lines(t, path)
    back = spark.read.text(path).select(F.col("value").alias("line"))
    return back.join(t.select("line", F.when(F.col("part") == 1, F.col("place")).otherwise(-F.col("place")).alias("place")), "line").select("place", "line")


@query("WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_name, p_type FROM part), n AS (SELECT p_type, count(*) AS n FROM p GROUP BY p_type) SELECT p_type AS section, 1::INT AS part, i AS place, i || '. ' || p_name AS line FROM p UNION ALL SELECT p_type, CASE WHEN k < 4 THEN 0 ELSE 2 END::INT, k, CASE k WHEN 0 THEN repeat('=', 60) WHEN 1 THEN upper(p_type) || ' (' || n || ' sentences)' WHEN 2 THEN repeat('=', 60) ELSE '' END FROM n, generate_series(0, 5) g(k)")
def snk_by_section(spark, sf_dir):
    """Parts listed by their types, with the numbers of the whole list."""
    p = O.ranks(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["p_partkey"], "i")
    return R.by_section(p, "i", "p_type", "p_name")


@query("WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_name FROM part), l AS (SELECT i || '. ' || p_name AS line FROM p UNION ALL SELECT '   → ' FROM p UNION ALL SELECT '' FROM p UNION ALL SELECT unnest(['FORM', repeat('=', 60), 'Write after the arrow', repeat('=', 60), ''])) SELECT line, count(*) AS n FROM l GROUP BY line")
def snk_template(spark, sf_dir):
    """A form to fill in, written and read again."""
    p = O.ranks(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], "i")
    path = scratch_path(spark, "template")
    writers.ordered_lines(R.template(p, "i", "p_name", "FORM", "Write after the arrow"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT unnest(list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word")
def snk_paragraph(spark, sf_dir):
    """All documents as one running text, of whose words none is lost or glued to the next."""
    path = scratch_path(spark, "paragraph")
    writers.paragraph(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return spark.read.option("lineSep", " ").text(path).select(F.explode(F.split("value", "\\s+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


_ASKED = "CASE p_partkey % 4 WHEN 0 THEN p_partkey || '. Est-ce queil ' || p_name WHEN 1 THEN ' EST-CE QUE ellemange ' || p_name || ' ' WHEN 2 THEN 'Qu''est-ce qu''on voit, que ilsont ' || p_name ELSE '12.  34. que elles ' || p_name END"


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(trim({_ASKED}), '^\\d+\\.\\s*', ''), '(est-ce qu[e''])\\s*([a-zéèêà])', '\\1 \\2', 'gi'), '(que\\s+)(il|elle|ils|elles)([a-zéèêà])', '\\1\\2 \\3', 'gi')) AS sentence FROM part")
def prd_clean_sentences(spark, sf_dir):
    """Numbers at the start go, glued questions and pronouns are set apart."""
    k, name = F.col("p_partkey"), F.col("p_name")
    x = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(". Est-ce queil "), name)).when(k % 4 == 1, F.concat(F.lit(" EST-CE QUE ellemange "), name, F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("Qu'est-ce qu'on voit, que ilsont "), name)).otherwise(F.concat(F.lit("12.  34. que elles "), name))
    return table(spark, sf_dir, "part").select("p_partkey", S.clean_sentence(x).alias("sentence"))


@query("SELECT page_id, url FROM pages WHERE trim(url) <> '' AND trim(url) NOT IN (SELECT trim(url) FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 1)")
def orc_resumed(spark, sf_dir):
    """What two runs that broke off have left to fetch; the checkpoint has blank lines too."""
    path, p = scratch_path(spark, "checkpoint"), table(spark, sf_dir, "pages").select("page_id", "url")
    first = readers.unfinished(p, "url", path)
    writers.checkpointed(first.filter("page_id % 3 = 0").unionByName(p.limit(1).withColumn("url", F.lit("  "))), "url", path)
    writers.checkpointed(readers.unfinished(p, "url", path).filter("page_id % 5 = 1"), "url", path)
    return readers.unfinished(p, "url", path)
