"""Structured sentences: generation, labels, conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import predicates as P
from quern.functions import sentences as S
from quern.functions.text import tokens
from quern.operators import rows as R
from quern.operators import sampling as Q
from quern.plans import conditions as C
from quern.queries.registry import PAIRS, pairs, query, table, words_sql

_VERBS = S.FIRST_RUN | S.SECOND_RUN


def _person(pronoun: str) -> int:
    return ("je", "tu", "il", "nous", "vous", "ils").index({"elle": "il", "elles": "ils"}.get(pronoun, pronoun))


def _forms() -> list[tuple[str, str, str, str, str, str]]:
    """(verb, pronoun, form, going, auxiliary, participle) of all verbs and persons."""
    out = []
    for verb, forms in _VERBS.items():
        for pronoun in S.PRONOUNS:
            k = _person(pronoun)
            auxiliary = (S.BEING if verb in ("aller", "venir") else S.HAVING)[k]
            out.append((verb, pronoun, forms[k], S.GOING[k], auxiliary, S.PARTICIPLES[verb]))
    return out


def _sentences(spark, sf_dir):
    """(module, pronoun, verb, french): every verb with every pronoun and region, in the five modules."""
    names = ("verb", "pronoun", "form", "going", "auxiliary", "participle")
    forms = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in _forms()])
    d = table(spark, sf_dir, "region").select(F.lower("r_name").alias("object"), F.inline(forms))
    join = lambda word, *rest: F.when((F.col("pronoun") == "je") & F.col(word).rlike("^[aeiouhéè]"), F.concat_ws(" ", F.concat(F.lit("j'"), F.col(word)), *rest)).otherwise(F.concat_ws(" ", "pronoun", word, *rest))
    plain = join("form", "object")
    texts = {"M1": plain, "M2": S.negate(plain), "M3": join("auxiliary", "participle", "object"), "M4": F.concat_ws(" ", "pronoun", "going", "verb", "object"), "M5": F.concat(F.lit("Est-ce que "), plain, F.lit("?"))}
    each = F.array(*[F.struct(F.lit(m).alias("module"), t.alias("french")) for m, t in texts.items()])
    return d.select("object", "verb", "pronoun", F.inline(each))


_FORMS_SQL = "f(verb, pronoun, form, going, auxiliary, participle) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in _forms()) + ")"
_ELIDED = "CASE WHEN pronoun = 'je' AND regexp_matches({0}, '^[aeiouhéè]') THEN 'j''' || {0} ELSE pronoun || ' ' || {0} END"
_NEGATED = "CASE WHEN pronoun = 'je' AND regexp_matches(form, '^[aeiouhéè]') THEN 'je n''' || form ELSE pronoun || ' ne ' || form END || ' pas ' || object"
_SENTENCES = f"""{_FORMS_SQL}, o AS (SELECT lower(r_name) AS object, f.* FROM region, f), s AS (
SELECT object, verb, pronoun, 'M1' AS module, {_ELIDED.format("form")} || ' ' || object AS french FROM o UNION ALL
SELECT object, verb, pronoun, 'M2', {_NEGATED} FROM o UNION ALL
SELECT object, verb, pronoun, 'M3', {_ELIDED.format("auxiliary")} || ' ' || participle || ' ' || object FROM o UNION ALL
SELECT object, verb, pronoun, 'M4', pronoun || ' ' || going || ' ' || verb || ' ' || object FROM o UNION ALL
SELECT object, verb, pronoun, 'M5', 'Est-ce que ' || {_ELIDED.format("form")} || ' ' || object || '?' FROM o)"""


@query(f"WITH {_SENTENCES} SELECT * FROM s")
def gen_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir)


@query(f"WITH {_SENTENCES} SELECT french, module AS found_module, verb AS found_verb, CASE WHEN module = 'M5' AND pronoun IN ('ils', 'elles') THEN rtrim(pronoun, 's') ELSE pronoun END AS found_pronoun FROM s")
def prd_sentence_labels(spark, sf_dir):
    """Labels read from the sentences alone; the SQL has those they were made with. Behind `que`, ils and elles are taken for glued il and elle."""
    x, m = F.col("french"), S.detect_module(F.col("french"))
    return _sentences(spark, sf_dir).select("french", m.alias("found_module"), S.detect_verb(x, m).alias("found_verb"), S.subject_pronoun(x).alias("found_pronoun"))


@query(f"WITH {_SENTENCES}, c AS (SELECT 'FULL' AS condition, * FROM s UNION ALL SELECT 'NO-M' || k, s.* FROM s, range(1, 6) t(k) WHERE substr(module, 2)::INT <> k UNION ALL SELECT 'PRONOUN-SINGULAR', * FROM s WHERE pronoun IN ('je', 'tu', 'il', 'elle') UNION ALL SELECT 'PRONOUN-PLURAL', * FROM s WHERE pronoun NOT IN ('je', 'tu', 'il', 'elle') UNION ALL SELECT CASE WHEN verb IN ({', '.join(repr(v) for v in S.FIRST_RUN)}) THEN 'VERB-FIRST-HALF' ELSE 'VERB-SECOND-HALF' END, * FROM s) SELECT condition, count(*) AS n FROM c GROUP BY condition")
def gen_ablations(spark, sf_dir):
    s = _sentences(spark, sf_dir).withColumn("m", S.module_number(F.col("module")))
    return C.ablations(s, "m", "pronoun", "verb", list(_VERBS)).groupBy("condition").agg(F.count("*").alias("n"))


_FAMILIES = " UNION ALL ".join(
    [f"SELECT 'module_loo' AS family, '{n}' AS condition, id, tgt FROM k WHERE m IN ({', '.join(map(str, ms))})" for n, ms in C.WITHOUT_MODULES.items()]
    + [f"SELECT 'module_size_ctrl', '{n}', id, tgt FROM k WHERE m IN ({', '.join(map(str, ms))}) AND a <= {most}" for n, (ms, most) in C.OF_1000_ROWS.items()]
    + [f"SELECT 'pronoun', '{n}', id, tgt FROM k WHERE pronoun IN ({', '.join(repr(x) for x in ps)})" for n, ps in C.PRONOUN_SETS.items()]
    + ["SELECT 'minimal_pairs', 'PAIRS-INTACT', id, tgt FROM k", "SELECT 'minimal_pairs', 'PAIRS-BROKEN', x.id, CASE WHEN x.m = 1 THEN x.tgt ELSE y.tgt END FROM k x JOIN k y ON x.m = y.m AND x.a = y.b"]
)


@query(f"WITH {_SENTENCES}, i AS (SELECT concat_ws('|', object, verb, pronoun, module) AS id, pronoun, substr(module, 2)::INT AS m, upper(french) AS tgt FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY md5('1|' || id), id) AS a, row_number() OVER (PARTITION BY m ORDER BY md5('2|' || id), id) AS b FROM i), "
       f"rows AS ({_FAMILIES}) SELECT family, condition, count(*) AS n, sum(('0x' || substr(md5(id || '>' || tgt), 1, 8))::BIGINT)::BIGINT AS pairs FROM rows GROUP BY family, condition")  # fmt: skip
def gen_ablation_families(spark, sf_dir):
    """Rows of each condition, and the sum of a digest of their pairs."""
    s = _sentences(spark, sf_dir).select(F.concat_ws("|", "object", "verb", "pronoun", "module").alias("id"), S.module_number(F.col("module")).alias("m"), "pronoun", "french", F.upper("french").alias("tgt"))
    rows = C.ablation_families(s, "id", "m", "pronoun", "french", "tgt")
    digest = F.conv(F.substring(F.md5(F.concat("id", F.lit(">"), "tgt")), 1, 8), 16, 10).cast("long")
    return rows.groupBy("family", "condition").agg(F.count("*").alias("n"), F.sum(digest).alias("pairs"))


_SPEC = "c(experiment, condition, r, s) AS (VALUES " + ", ".join(f"('{e}', '{n}', {r}, {s})" for e, n, r, s in C.families()) + ")"


@query(f"""WITH {_SPEC}, a AS (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem), ra AS (SELECT k, row_number() OVER (ORDER BY md5('1|' || k), k) AS n FROM a),
b AS (SELECT o_orderkey AS k, o_orderpriority AS m FROM orders), rb AS (SELECT k, dense_rank() OVER (ORDER BY m) AS o, row_number() OVER (PARTITION BY m ORDER BY md5('1|' || k), k) AS n FROM b), z AS (SELECT count(DISTINCT m) AS strata FROM b),
h AS (SELECT experiment, condition, 'random' AS pool, k FROM ra, c WHERE n <= r UNION ALL SELECT experiment, condition, 'structured', k FROM rb, c, z WHERE s = {C.ALL} OR (n <= greatest(1, s // strata) AND o <= s)),
v AS (SELECT *, row_number() OVER (PARTITION BY experiment, condition ORDER BY md5('1|' || pool || '|' || k), pool || '|' || k) AS n, count(*) OVER (PARTITION BY experiment, condition) AS total FROM h)
SELECT experiment, condition, pool, CASE WHEN n <= least(greatest(1, floor(total * 0.1)), total - 1) THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(k)::BIGINT AS keys FROM v GROUP BY ALL""")
def gen_conditions(spark, sf_dir):
    """28 conditions of two families over all lines as the random pool and all orders as the structured one, with the sums of the keys they hold."""
    a = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("m"))
    return C.assign(a, b, "k", "m").groupBy("experiment", "condition", "pool", "split").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("SELECT (c * 5 + s) * 4 + m + 1 AS job, 'C' || c AS condition, s + 1 AS seed, 'model' || m AS model FROM range(0, 7) a(c), range(0, 5) b(s), range(0, 4) d(m)")
def gen_job_grid(spark, sf_dir):
    return C.job_grid(spark, [f"C{k}" for k in range(7)], [1, 2, 3, 4, 5], [f"model{k}" for k in range(4)]).select(F.col("job").cast("long").alias("job"), "condition", F.col("seed").cast("long").alias("seed"), "model")


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ'']+') AS w FROM documents) SELECT doc_id, len(w) > 0 AND (len(w) <= 2 OR list_has_any(w, [" + ", ".join(f"'{w}'" for w in S.COMMON_FRENCH) + "])) AS french FROM w")
def prd_looks_french(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.looks_french(F.col("text")).alias("french"))


@query(f"SELECT doc_id, regexp_matches(text, '\\?{{2,}}|…|\\.{{3,}}') AS placeholder, len(regexp_extract_all(lower(text), '[{S.TARGET_LETTERS}]')) AS letters, regexp_matches(text, '[\\r\\n]') AS newline FROM documents")
def prd_audit_tests(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.has_placeholder(x).alias("placeholder"), S.target_letters(x).alias("letters"), S.embedded_newline(x).alias("newline"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' xɔ fini.' WHEN 2 THEN p_name WHEN 3 THEN p_name || '/a/b' ELSE 'xɔ te ' || p_type END AS canonical, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_name || ' sɔ fini.' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'sɔ te ' || p_type END AS alternative, CASE p_partkey % 5 WHEN 2 THEN 'no_slash' WHEN 3 THEN 'needs_review' ELSE 'normalized' END AS status FROM part")
def rsh_slash_alternatives(spark, sf_dir):
    """Two phrases, a pair of words, no slash, too many, and a pair without spaces and in the other order."""
    k, name, kind = F.col("p_partkey") % 5, F.col("p_name"), F.col("p_type")
    text = F.when(k == 0, F.concat_ws(" / ", name, kind)).when(k == 1, F.concat(name, F.lit("  sɔ / xɔ fini."))).when(k == 2, name).when(k == 3, F.concat(name, F.lit("/a/b"))).otherwise(F.concat(F.lit("xɔ/sɔ te "), kind))
    s = S.slash_alternatives(text)
    return table(spark, sf_dir, "part").select("p_partkey", s["canonical"].alias("canonical"), s["alternative"].alias("alternative"), s["status"].alias("status"))


_Q = "regexp_matches({}, '[«»\"]|<<|>>')"


@query(f"WITH {PAIRS} SELECT ord, CASE WHEN {_Q.format('src')} AND NOT {_Q.format('tgt')} THEN 'quotes_to_target' WHEN {_Q.format('tgt')} AND NOT {_Q.format('src')} THEN 'quotes_to_source' ELSE 'none' END AS change FROM pairs")
def prd_matched_quotes(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", P.matched_quotes(F.col("src"), F.col("tgt"))["change"].alias("change"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END, CASE WHEN NOT coalesce(n_chars BETWEEN 50 AND 30000, false) THEN 'length' END, CASE WHEN NOT coalesce(lang IN ('en', 'fr'), false) THEN 'language' END) AS errors FROM documents")
def prd_record_errors(spark, sf_dir):
    rules = {"text": F.trim("text") != "", "length": F.col("n_chars").between(50, 30000), "language": F.col("lang").isin("en", "fr")}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.record_errors(rules), ",").alias("errors"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('2|' || c_custkey), c_custkey) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE n <= CASE c_mktsegment WHEN 'BUILDING' THEN 30 WHEN 'MACHINERY' THEN 7 ELSE 0 END")
def smp_quotas(spark, sf_dir):
    """Quotas of 30 and 7: the feature."""
    return Q.quota_sample(table(spark, sf_dir, "customer"), "c_mktsegment", {"BUILDING": 30, "MACHINERY": 7}, "c_custkey", 2).select("c_custkey", "c_mktsegment")


@query("WITH r AS (SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) AS o, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1|' || c_custkey), c_custkey) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE n <= greatest(1, 64 // (SELECT count(DISTINCT c_mktsegment) FROM customer)) AND o <= 64")
def smp_strata_of_size(spark, sf_dir):
    """64 rows: the feature."""
    return Q.stratified(table(spark, sf_dir, "customer"), "c_mktsegment", 64, "c_custkey").select("c_custkey", "c_mktsegment")


@query("WITH d AS (SELECT doc_id, CASE WHEN n <= 80 THEN 0 WHEN n <= 200 THEN 1 ELSE 2 END AS b, md5('1|' || doc_id) AS h FROM (SELECT doc_id, len(" + words_sql("text") + ") AS n FROM documents)), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY h, doc_id) AS n FROM d) SELECT doc_id FROM r WHERE n <= 60 ORDER BY (n > 20)::INT, h, doc_id LIMIT 60")
def smp_length_bins(spark, sf_dir):
    """60 rows: the feature."""
    return Q.length_bins(table(spark, sf_dir, "documents"), F.size(tokens(F.col("text"))), 60, "doc_id", (80, 200)).select("doc_id")


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('4|' || o_orderkey), o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders) SELECT o_orderkey, o_orderpriority, CASE WHEN n <= least(greatest(1, floor(total * 0.15)), total - 1) THEN 'val' ELSE 'train' END AS split FROM r")
def smp_validation(spark, sf_dir):
    return Q.validation_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], F.col("o_orderkey"), 0.15, 4)


@query("WITH m AS (SELECT * FROM orders WHERE o_orderstatus <> 'F'), a AS (SELECT o_orderkey, o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('1|' || o_orderkey), o_orderkey) AS k FROM m), b AS (SELECT o_totalprice, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('2|' || o_orderkey), o_orderkey) AS k FROM m) SELECT o_orderkey, o_custkey, o_totalprice FROM a JOIN b USING (p, k) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def smp_shuffled_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return Q.shuffled_pairs(o, "o_orderpriority", F.col("o_orderstatus") == "F", "o_orderkey", "o_custkey", "o_totalprice").select("o_orderkey", "o_custkey", "o_totalprice")




@query()
def smp_diverse(spark, sf_dir):
    """100 rows: the feature."""
    return Q.diverse(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text", 100, 8, 1000).select("id", "cluster")


@query("WITH RECURSIVE w AS (SELECT DISTINCT doc_id, unnest(" + words_sql("lower(text)") + ") AS w FROM documents), s AS (SELECT 0 AS round, doc_id, w, 0::BIGINT AS gain, FALSE AS taken FROM w UNION ALL "
       "SELECT round + 1, doc_id, w, c, doc_id = best FROM (SELECT *, bool_or(doc_id = best) OVER (PARTITION BY w) AS seen FROM (SELECT *, first_value(doc_id) OVER (ORDER BY c DESC, doc_id) AS best FROM (SELECT round, doc_id, w, count(*) OVER (PARTITION BY doc_id) AS c FROM s WHERE NOT taken AND round < 25))) WHERE NOT seen OR doc_id = best) "
       "SELECT DISTINCT round, doc_id, gain FROM s WHERE taken")  # fmt: skip
def smp_covering(spark, sf_dir):
    """The 25 documents that together have most words: the limit is the feature."""
    return Q.covering(table(spark, sf_dir, "documents"), "doc_id", tokens(F.lower("text")), 25)


@query("SELECT c_custkey FROM customer ORDER BY md5('9|' || c_custkey), c_custkey LIMIT 25")
def smp_few_by_index(spark, sf_dir):
    """25 rows, put back in order of the key: the feature."""
    return R.sample_rows(table(spark, sf_dir, "customer").select("c_custkey"), 25, "c_custkey", 9).orderBy("c_custkey")
