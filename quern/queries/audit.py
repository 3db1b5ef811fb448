"""The audit of split lines over sentences that are cut at known places."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.sentences import TARGET_LETTERS, incomplete_ending
from quern.operators import audit as A
from quern.queries.registry import query
from quern.queries.sentences import _SENTENCES, _sentences

_SOURCE, _TARGET, _TAILS, _ENDINGS = ("mange", "bois", "vais", "allé"), ("wo", "eba", "america", "eha"), ("mi wo eba", "eha ɖɛ", "", "contribution ???"), ("pas", "que", "ne")
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_MARKS = ".,;:!?()[]{}\"“”"


def _lines(spark, sf_dir):
    """Sentences cut after one to three words; what is behind the cut begins the target, and every fifth boundary was told."""
    s = _sentences(spark, sf_dir).withColumn("n", F.length("french")).withColumn("w", F.split("french", " "))
    cut, tail = F.col("n") % 3 + 1, F.get(F.array(*[F.lit(t) for t in _TAILS]), F.col("n") % 4)
    rest = F.trim(F.concat_ws(" ", F.array_join(F.slice("w", cut + 1, F.size("w")), " "), tail))
    return s.select(
        F.concat_ws("|", "object", "verb", "pronoun", "module").alias("id"), F.col("object").alias("source"), F.lit("").alias("raw"), F.array_join(F.slice("w", F.lit(1), cut), " ").alias("src"),
        F.when(F.col("n") % 11 == 0, "").otherwise(rest).alias("tgt"), F.when(F.col("n") % 5 == 0, "colon").otherwise(A.GUESSED).alias("method"),
    )


def _words(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


_LINES = f"""{_SENTENCES}, c AS (SELECT *, length(french) AS n, string_split(french, ' ') AS w FROM s), lines AS (SELECT concat_ws('|', object, verb, pronoun, module) AS id, object AS source, array_to_string(w[1:n % 3 + 1], ' ') AS src,
CASE WHEN n % 11 = 0 THEN '' ELSE trim(array_to_string(w[n % 3 + 2:], ' ') || ' ' || [{_LIST(_TAILS)}][n % 4 + 1]) END AS tgt, CASE WHEN n % 5 = 0 THEN 'colon' ELSE '{A.GUESSED}' END AS method FROM c),
p AS (SELECT id, generate_subscripts(x, 1) AS i, trim(replace(lower(unnest(x)), '’', ''''), '{_MARKS}') AS word FROM (SELECT id, regexp_extract_all(tgt, '[{A.WORD_LETTERS.replace("'", "''")}]+') AS x FROM lines)),
q AS (SELECT *, word IN ({_LIST(_TARGET)}) AS t, regexp_matches(word, '[{A.SOURCE_LETTERS}]') AS letter, word IN ({_LIST(A.CONNECTORS)}) AS link, regexp_matches(word, '[{TARGET_LETTERS}]') AS stop FROM p WHERE word <> ''),
k AS (SELECT *, row_number() OVER w AS place, coalesce(lag(link AND NOT stop) OVER w, false) AS joined, NOT stop AND (link OR letter OR regexp_matches(word, '^(c|d|j|l|m|n|qu|s|t)''') OR (word IN ({_LIST(_SOURCE)}) AND NOT t)) AS sure FROM q WINDOW w AS (PARTITION BY id ORDER BY i)),
g AS (SELECT *, sure OR (NOT stop AND ((length(word) >= 7 AND NOT t AND (place = 1 OR joined)) OR (joined AND length(word) >= 4 AND word NOT IN ({_LIST(A.TARGET_OPENERS)})))) AS ok FROM k),
r AS (SELECT id, coalesce(min(place) FILTER (NOT ok), max(place) + 1) - 1 AS n FROM g GROUP BY id),
runs AS (SELECT g.id, any_value(n) AS n, coalesce(bool_or(letter) FILTER (place <= n), false) AS marked, sum(t::INT)::BIGINT AS hits, coalesce(sum(t::INT) FILTER (place > n), 0)::BIGINT AS hits_behind FROM g JOIN r USING (id) GROUP BY g.id)"""


@query(f"WITH {_LINES} SELECT * FROM runs")
def prd_source_prefix(spark, sf_dir):
    return A.source_prefix(_lines(spark, sf_dir), "id", "tgt", _words(spark, _SOURCE), _words(spark, _TARGET)).drop("prefix")


_LETTERS = "len(regexp_extract_all(lower({}), '[" + TARGET_LETTERS + "]'))"
_ISSUES = f"""{_LINES}, e AS (SELECT l.*, n, marked, coalesce(hits, 0) AS hits, hits_behind, CASE WHEN regexp_extract(lower(src), '([a-zà-öø-ÿœ'']+)[^a-zà-öø-ÿœ'']*$', 1) IN ({_LIST(_ENDINGS)}) THEN 1 ELSE 0 END AS open,
trim(CASE WHEN string_split(tgt, ' ')[n::INT] LIKE '%?' THEN '? ' ELSE '' END || array_to_string(string_split(tgt, ' ')[n::INT + 1:], ' ')) AS remains FROM lines l LEFT JOIN runs r USING (id)),
i AS (SELECT id, source, src, tgt, 'target_letters_in_source' AS issue, 'high' AS confidence, '' AS suggested_tgt FROM e WHERE {_LETTERS.format('src')} > 0
UNION ALL SELECT id, source, src, tgt, 'source_prefix_in_target', CASE WHEN remains = '' OR {_LETTERS.format('remains')} + hits_behind = 0 THEN 'needs-human' WHEN n >= 2 OR marked OR open = 1 THEN 'high' ELSE 'medium' END, remains FROM e WHERE method = '{A.GUESSED}' AND n > 0
UNION ALL SELECT id, source, src, tgt, 'incomplete_source', 'medium', '' FROM e WHERE method = '{A.GUESSED}' AND coalesce(n, 0) = 0 AND open = 1
UNION ALL SELECT id, source, src, tgt, 'placeholder', 'needs-human', '' FROM e WHERE regexp_matches(src || ' | ' || tgt, '\\?{{2,}}|…|\\.{{3,}}')
UNION ALL SELECT id, source, src, tgt, 'empty_target', 'needs-human', '' FROM e WHERE trim(tgt) = ''
UNION ALL SELECT id, source, src, tgt, 'no_target_evidence', 'needs-human', '' FROM e WHERE trim(tgt) <> '' AND method = '{A.GUESSED}' AND {_LETTERS.format('tgt')} + hits = 0)
SELECT min(id) AS id, source, src, tgt, issue, min_by(confidence, id) AS confidence, min_by(suggested_tgt, id) AS suggested_tgt FROM i GROUP BY source, src, tgt, issue"""


@query(f"WITH {_ISSUES}")
def prd_audit_issues(spark, sf_dir):
    """Issues of all lines, each once for equal source, line, sides and kind."""
    found = A.audit(_lines(spark, sf_dir), "id", _words(spark, _SOURCE), _words(spark, _TARGET), incomplete_ending(F.col("src"), _ENDINGS))
    return found.select("id", "source", "src", "tgt", "issue", "confidence", "suggested_tgt")
