"""Texts for reports, models and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import predicates as P
from quern.functions import sentences as S
from quern.functions import text as T
from quern.operators import ngram_models as L
from quern.operators.audio import code
from quern.queries.registry import PAIRS, pairs, query, table, words_sql

_NAMES = {"en": "English", "fr": "French", "de": "German"}


@query("SELECT doc_id, 'language ' || CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'None' END || '<asr_text>' || text AS value FROM documents")
def txt_prefixed(spark, sf_dir):
    """Spanish has no name here."""
    return table(spark, sf_dir, "documents").select("doc_id", T.prefixed(F.col("text"), F.col("lang"), _NAMES).alias("value"))


@query("WITH n AS (SELECT doc_id, text AS old, trim(regexp_replace(regexp_replace(text, '([!?.]){2,}', '\\1', 'g'), '\\s+', ' ', 'g')) AS text FROM documents) SELECT doc_id, text, CASE WHEN text IS DISTINCT FROM old THEN old END AS text_original FROM n")
def txt_with_backup(spark, sf_dir):
    return T.with_backup(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", T.collapse(T.squeeze_marks(F.col("text"))))


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '…' ELSE t END AS line FROM f")
def txt_one_line(spark, sf_dir):
    """60 characters: the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text"), 60).alias("line"))


@query(f"""WITH w AS (SELECT doc_id, text, {words_sql('text')} AS w FROM documents), f AS (SELECT *, list_filter(generate_series(1, len(w) - 2), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])[1] AS i FROM w),
g AS (SELECT *, coalesce(list_filter(generate_series(i, len(w)), lambda j: w[j] <> w[i])[1] - i, len(w) - i + 1) AS run FROM f)
SELECT doc_id, CASE WHEN len(w) = 0 THEN '' WHEN i IS NOT NULL THEN array_to_string(w[1:i - 1 + least(run, 6)], ' ') WHEN len(w) > 36 THEN array_to_string(w[1:14], ' ') ELSE text END AS text, len(w) > 0 AND (i IS NOT NULL OR len(w) > 36) AS cut FROM g""")
def txt_abbreviated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.abbreviated(F.col("text")).alias("a")).select("doc_id", "a.text", "a.cut")


@query("SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(regexp_replace(replace(text, ' ', '<pad>'), '<[a-z_]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations")
def txt_strip_tags(spark, sf_dir):
    """Spaces are made tags first, so that there is something to strip."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.strip_tags(F.replace("text", F.lit(" "), F.lit("<pad>"))).alias("text"))


@query("WITH c AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark) SELECT item_id, regexp_replace(regexp_replace(regexp_replace(t, '\\s+([.,!?;:])', '\\1', 'g'), '([.,!?;:])([^\\s.,!?;:\"''])', '\\1 \\2', 'g'), '  +', ' ', 'g') AS text FROM c")
def txt_for_language_model(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.for_language_model(F.col("text")).alias("text"))


@query("WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark), v AS (SELECT ch, row_number() OVER (ORDER BY ch) + 1 AS id FROM c WHERE ch <> ''), m AS (SELECT map_from_entries(list((ch, id))) AS m FROM v) SELECT conv_id * 1000 + turn AS key, array_to_string(list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: coalesce(m[x], 1)), ' ') AS ids, array_to_string(list_filter(string_split(text, ''), lambda x: m[x] IS NOT NULL), '') AS back FROM conversations, m")
def txt_character_ids(spark, sf_dir):
    """Turns in the ids of the benchmark's characters and back again; characters that it lacks are unknown (1) and don't come back."""
    v = L.vocabulary(table(spark, sf_dir, "benchmark"), "text")
    one = v.agg(F.map_from_entries(F.collect_list(F.struct("ch", "id"))).alias("ids"), F.map_from_entries(F.collect_list(F.struct("id", "ch"))).alias("chars"))  # Unicode's characters at most
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text").join(F.broadcast(one))
    c = c.select("key", T.encoded(F.col("text"), F.col("ids"), 1).alias("ids"), "chars")
    return c.select("key", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), T.decoded(F.col("ids"), F.col("chars"), 2).alias("back"))


_CLEANED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), '  +', ' ', 'g'), '\\s+([.,!?;:])', '\\1', 'g'), '([.,!?;:])([^\\s.,!?;:\"''])', '\\1 \\2', 'g'), '  +', ' ', 'g'))"


@query(f"WITH c AS (SELECT lang, text, {_CLEANED} AS new FROM documents) SELECT lang, sum(CASE WHEN text <> new THEN len(regexp_extract_all(text, ' {{2,}}')) ELSE 0 END)::BIGINT AS double_spaces, sum(CASE WHEN text <> new THEN len(regexp_extract_all(text, '\\s+[.,!?;:]')) ELSE 0 END)::BIGINT AS spaces_before_marks FROM c GROUP BY lang")
def prd_spacing_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", P.spacing_changes(F.col("text"), T.clean_cell(F.col("text"))).alias("c"))
    return d.groupBy("lang").agg(F.sum("c.double_spaces").alias("double_spaces"), F.sum("c.spaces_before_marks").alias("spaces_before_marks"))


@query(f"WITH {PAIRS} SELECT ord, array_to_string(list_filter([CASE WHEN contains(src, '?') AND NOT contains(tgt, '?') THEN '? added' END, CASE WHEN contains(src, '!') AND NOT contains(tgt, '!') THEN '! added' END, CASE WHEN contains(src, '\"') AND NOT contains(tgt, '\"') THEN 'quotes added' END, CASE WHEN contains(tgt, '  ') AND NOT contains(src, '  ') THEN 'double spaces removed' END], lambda x: x IS NOT NULL), ',') AS kinds FROM pairs")
def prd_change_kinds(spark, sf_dir):
    """The answer as the text before, the question as the one after."""
    return pairs(spark, sf_dir).select("ord", F.array_join(P.change_kinds(F.col("tgt"), F.col("src")), ",").alias("kinds"))


@query("WITH w AS (SELECT doc_id, regexp_extract(lower(text), '([a-zà-öø-ÿœ'']+)[^a-zà-öø-ÿœ'']*$', 1) AS w FROM documents) SELECT doc_id, CASE WHEN w IN ('de', 'la', 'que', 'the', 'of', 'et') THEN w END AS ending FROM w")
def prd_incomplete_endings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.incomplete_ending(F.col("text"), ("de", "la", "que", "the", "of", "et")).alias("ending"))


@query("SELECT p_partkey, array_to_string(list_transform(generate_series(1, p_size % 5), lambda i: p_name || ' ' || i), '|') AS items FROM part")
def spl_numbered_lines(spark, sf_dir):
    """Lists are made of each part's name, with a line that belongs to none between."""
    lines = F.transform(F.sequence(F.lit(0), F.pmod("p_size", F.lit(5))), lambda i: F.when(i == 0, F.lit("no item")).otherwise(F.concat(F.lit(" "), i.cast("string"), F.lit(". "), F.col("p_name"), F.lit(" "), i.cast("string"), F.lit(" "))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.numbered_lines(F.array_join(lines, "\n")), "|").alias("items"))


@query("SELECT vec_id, array_to_string(list_transform(embedding[1:8], lambda v: (floor(abs(v) * 1000))::INT), ' ') AS ids, (floor(abs(embedding[9]) * 1000))::INT::VARCHAR AS other FROM embeddings")
def spl_codec_ids(spark, sf_dir):
    """Numbers of each vector written as tags of two families among words, and read again."""
    number = lambda v: code(v, 1000).cast("string")
    tag = lambda name, v: F.concat(F.lit(f"said <|{name}_"), number(v), F.lit("|>"))
    text = F.concat(F.array_join(F.transform(F.slice("embedding", 1, 8), lambda v: tag("s", v)), ""), tag("bicodec_global", F.get("embedding", F.lit(8))))
    join = lambda name: F.array_join(F.transform(P.codec_ids(text, name), lambda v: v.cast("string")), " ")
    return table(spark, sf_dir, "embeddings").select("vec_id", join("s").alias("ids"), join("bicodec_global").alias("other"))


@query("WITH w AS (SELECT p_partkey, string_split('il ' || p_name, ' ') AS w FROM part) SELECT p_partkey, w[1] || CASE WHEN regexp_matches(lower(w[2]), '^[aeiouhéèêàâîôûœ]') THEN ' n' || chr(39) ELSE ' ne ' END || w[2] || ' pas' || CASE WHEN len(w) > 2 THEN ' ' || array_to_string(w[3:], ' ') ELSE '' END AS text FROM w")
def gen_elided_negations(spark, sf_dir):
    """Part names as sentences without a verb of their own: the second word is negated, by the rule of the second run."""
    return table(spark, sf_dir, "part").select("p_partkey", S.negate(F.concat(F.lit("il "), F.col("p_name")), elide=True).alias("text"))


def _replaced(column: str) -> str:
    for pattern, new in T.PUNCTUATION:
        quoted = [v.replace("'", "''") for v in (pattern, new.replace("$", "\\"))]
        column = f"regexp_replace({column}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return column


@query(f"SELECT item_id, nfc_normalize(regexp_replace({_replaced('text')}, '\\pC', ' ', 'g')) AS text FROM (SELECT item_id, 'a ( “' || text || '” ) , l’eau – 5 % : «' || chr(160) || 'b' || chr(160) || '» 1' || chr(160) || '000…' || chr(7) AS text FROM benchmark)")
def txt_for_translation(spark, sf_dir):
    """Marks of all kinds are put around each item."""
    x = F.concat(F.lit("a ( “"), "text", F.lit("” ) , l’eau – 5 % : «\u00a0b\u00a0» 1\u00a0000…\x07"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.for_translation(x).alias("text"))


_BELOW_100 = "CASE WHEN {0} < 20 THEN ones[{0} + 1] ELSE tens[{0} // 10 + 1] || CASE WHEN {0} % 10 > 0 THEN '-' || ones[{0} % 10 + 1] ELSE '' END END"
_BELOW_1000 = "CASE WHEN {0} >= 100 THEN ones[{0} // 100 + 1] || ' hundred' || CASE WHEN {0} % 100 > 0 THEN ' and ' || (" + _BELOW_100.replace("{0}", "({0} % 100)") + ") ELSE '' END ELSE " + _BELOW_100 + " END"
_WORDS = f"(CASE WHEN n >= 1000000 THEN ({_BELOW_1000.format('(n // 1000000)')}) || ' million' || CASE WHEN n % 1000000 = 0 THEN '' WHEN n % 1000000 < 100 THEN ' and ' ELSE ', ' END ELSE '' END || CASE WHEN n % 1000000 >= 1000 THEN ({_BELOW_1000.format('(n // 1000 % 1000)')}) || ' thousand' || CASE WHEN n % 1000 = 0 THEN '' WHEN n % 1000 < 100 THEN ' and ' ELSE ', ' END ELSE '' END || CASE WHEN n % 1000 > 0 THEN ({_BELOW_1000.format('(n % 1000)')}) ELSE '' END)"


@query(f"SELECT k AS o_orderkey, 'No ' || {_WORDS} || ', x' || n || ' of ' || ones[n % 10 + 1] || ' point ' || ones[n % 7 + 1] || '.' AS text FROM (SELECT o_orderkey AS k, o_orderkey * 37 AS n, {list(T.ENGLISH_ONES)} AS ones, {list(T.ENGLISH_TENS)} AS tens FROM orders WHERE o_orderkey > 0)")
def txt_number_words(spark, sf_dir):
    n = F.col("o_orderkey") * 37
    text = F.concat(F.lit("No "), n.cast("string"), F.lit(", x"), n.cast("string"), F.lit(" of "), (n % 10).cast("string"), F.lit("."), (n % 7).cast("string"), F.lit("."))
    return table(spark, sf_dir, "orders").filter("o_orderkey > 0").select("o_orderkey", T.numbers_to_words(text, "en").alias("text"))
