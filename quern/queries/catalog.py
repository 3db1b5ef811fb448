"""Catalog matches, residues, alternative references and boundary splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators import catalog as C
from quern.queries.registry import query, table, words_sql

# Parts as a catalog: their names under brand and size; the rows asked for are names with words after them, of other sizes, or with capitals.
_CATALOG = "cat AS (SELECT p_brand, p_size % 3 AS size, lower(french) AS norm, arg_max(french, p_partkey) AS french, max(p_partkey) AS k FROM (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 4 = 0 THEN 'il ne ' || p_name || ' pas ' || p_type ELSE p_name END AS french FROM part) GROUP BY ALL)"
_ASKED = "ask AS (SELECT p_partkey, p_brand, (p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) % 3 AS size, CASE WHEN p_partkey % 8 = 0 THEN 'il ' || p_name || ' pas ' || p_type || ' et la suite' WHEN p_partkey % 4 = 0 THEN 'il ne ' || p_name || ' pas ' || p_type WHEN p_partkey % 7 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 0 THEN p_name || ' and more' WHEN p_partkey % 11 = 0 THEN 'nothing known' ELSE p_name END AS text FROM part)"
_VARIANTS = "v AS (SELECT p_brand, size, french, norm, norm AS prefix, length(french) AS n FROM cat UNION ALL SELECT p_brand, size, french, norm, regexp_replace(norm, '^(.*?) ne ', '\\1 '), length(regexp_replace(french, '^(.*?) ne ', '\\1 ')) FROM cat WHERE contains(norm, ' ne ') AND contains(norm, ' pas '))"


def _hits(keys: str, rows: str) -> str:
    return f"SELECT a.p_partkey, v.norm, v.french, CASE WHEN lower(a.text) = v.prefix THEN '' ELSE trim(substr(a.text, v.n + 1)) END AS residue FROM {rows} a JOIN v ON {keys} AND (lower(a.text) = v.prefix OR starts_with(lower(a.text), v.prefix || ' '))"


_STRICT, _WEAK = "a.p_brand = v.p_brand AND a.size = v.size", "a.p_brand = v.p_brand"


@query(f"WITH {_CATALOG}, {_ASKED}, {_VARIANTS}, h1 AS ({_hits(_STRICT, 'ask')}), h2 AS ({_hits(_WEAK, '(SELECT * FROM ask WHERE p_partkey NOT IN (SELECT p_partkey FROM h1))')}), h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2), "
       "m AS (SELECT p_partkey, max(length(norm)) AS n FROM h GROUP BY 1), b AS (SELECT h.p_partkey, count(DISTINCT norm) AS s, arg_min(french, (norm, length(residue))) AS clean, arg_min(residue, (norm, length(residue))) AS residue FROM h JOIN m ON m.p_partkey = h.p_partkey AND length(norm) = m.n GROUP BY 1) "
       "SELECT ask.p_partkey, CASE WHEN clean IS NULL THEN 'no_match' WHEN s > 1 THEN 'ambiguous' WHEN residue <> '' THEN 'moved_residue' WHEN text <> clean THEN 'fixed' ELSE 'unchanged' END AS status, CASE WHEN s = 1 THEN lower(clean) END AS clean, coalesce(CASE WHEN s = 1 THEN residue END, '') AS residue FROM ask LEFT JOIN b USING (p_partkey)")  # fmt: skip
def jon_catalog(spark, sf_dir):
    """Sentences in lower case, for of equal ones under the weaker key any spelling may stand."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name", "p_type")
    k = F.col("p_partkey")
    negative = F.concat(F.lit("il ne "), F.col("p_name"), F.lit(" pas "), F.col("p_type"))
    known = C.deduplicated(p.select("p_brand", (F.col("p_size") % 3).alias("size"), F.when(k % 4 == 0, negative).otherwise(F.col("p_name")).alias("french"), "p_partkey"), ["p_brand", "size"], "p_partkey")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("il "), F.col("p_name"), F.lit(" pas "), F.col("p_type"), F.lit(" et la suite"))).when(k % 4 == 0, negative).when(k % 7 == 0, F.upper("p_name"))
        .when(k % 3 == 0, F.concat("p_name", F.lit(" and more"))).when(k % 11 == 0, "nothing known").otherwise(F.col("p_name"))
    )
    asked = p.select("p_partkey", "p_brand", ((F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0)) % 3).alias("size"), text.alias("text"))
    m = C.matched(asked, known, ["p_brand", "size"], ["p_brand"], "p_partkey", "text")
    return m.select("p_partkey", "status", F.lower("clean").alias("clean"), "residue")


@query("SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['il ne ' || p_name || ' pas', 'il ' || p_name || ' pas'] ELSE [p_name] END) AS prefix FROM part")
def jon_negation_variants(spark, sf_dir):
    s = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("il ne "), F.col("p_name"), F.lit(" pas "))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(C.variants(s, s)).alias("v")).select("p_partkey", F.trim("v.prefix").alias("prefix"))


@query("SELECT min(p_partkey) AS first, max(p_partkey) AS kept, p_brand, lower(p_name) AS norm FROM part GROUP BY p_brand, lower(p_name)")
def ded_catalog(spark, sf_dir):
    """Of equal names of a brand the last; the first is carried along as a check."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("french"), "p_partkey")
    first = p.groupBy("p_brand", F.lower("french").alias("norm")).agg(F.min("p_partkey").alias("first"))
    return C.deduplicated(p, ["p_brand"], "p_partkey").join(first, ["p_brand", "norm"]).select("first", F.col("p_partkey").alias("kept"), "p_brand", "norm")


@query("WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN upper(split_part(p_name, ' ', 1)) ELSE p_type END AS r, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS t FROM part) SELECT p_partkey, CASE WHEN r = '' THEN t WHEN t = '' THEN r WHEN lower(t) = lower(r) OR starts_with(lower(t), lower(r) || ' ') THEN t ELSE r || ' ' || t END AS text FROM x")
def rsh_prepended(spark, sf_dir):
    k = F.col("p_partkey") % 4
    residue = F.when(k == 0, "").when(k == 1, F.upper(F.split("p_name", " ")[0])).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", C.prepended(residue, F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_name"))).alias("text"))


@query("SELECT p_partkey, p_name AS text, CASE WHEN p_partkey % 3 = 0 THEN '12' || chr(10) || 'M3' || chr(9) || p_type ELSE '' END AS record FROM part")
def rsh_embedded_records(spark, sf_dir):
    """A record of a number, a module and a text over two lines is put behind every third name, and taken out again."""
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" 12\nM3\t"), "p_type")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", C.without_record(value, "\\d+\\nM[1-5]\\t.*").alias("r")).select("p_partkey", "r.text", "r.record")


_ALTERNATIVES = "refs AS (SELECT 's' || s_suppkey AS sid, CASE WHEN s_suppkey % 5 = 0 THEN 'other' ELSE s_name END AS canonical, s_name || ' ' || (s_suppkey % 2) AS alternative FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'other' ELSE s_name END, s_name || ' x' FROM supplier WHERE s_suppkey % 6 = 0)"


def _with_references(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sid, canonical = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sentence_id"), F.when(F.col("s_suppkey") % 5 == 0, "other").otherwise(F.col("s_name")).alias("canonical")
    refs = s.filter("s_suppkey % 3 = 0").select(sid, canonical, F.concat_ws(" ", "s_name", (F.col("s_suppkey") % 2).cast("string")).alias("alternative"))
    refs = refs.unionByName(s.filter("s_suppkey % 6 = 0").select(sid, canonical, F.concat("s_name", F.lit(" x")).alias("alternative")))
    return C.with_references(s.select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("ref")), s.select(F.col("s_suppkey").alias("idx"), sid), refs)


@query(f"WITH {_ALTERNATIVES}, a AS (SELECT sid, any_value(canonical) AS canonical, list_sort(list_distinct(list(alternative))) AS alts FROM refs WHERE canonical <> alternative GROUP BY sid) SELECT s_suppkey AS idx, array_to_string(list_concat([s_name], CASE WHEN canonical = s_name THEN alts ELSE [] END), '|') AS refs, CASE WHEN canonical = s_name AND len(alts) > 0 THEN 1 ELSE 0 END::BIGINT AS used_alternative FROM supplier LEFT JOIN a ON sid = 's' || s_suppkey")
def jon_guarded_references(spark, sf_dir):
    return _with_references(spark, sf_dir).select("idx", F.array_join("refs", "|").alias("refs"), "used_alternative")


@query("WITH r AS (SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS used FROM supplier), n AS (SELECT unnest(['combined', CASE WHEN idx < 40 THEN 'structured' ELSE 'tatoeba' END]) AS subset, used FROM r) SELECT subset, count(*) AS n, sum(used)::BIGINT AS used FROM n GROUP BY subset")
def agg_alternative_usage(spark, sf_dir):
    from quern.operators.systems import by_subset

    return by_subset(_with_references(spark, sf_dir), "idx", 40, [F.count("*").alias("n"), F.sum("used_alternative").alias("used")])


@query(f"WITH en AS (SELECT DISTINCT unnest({words_sql('lower(text)')}) AS w FROM documents WHERE lang = 'en'), de AS (SELECT DISTINCT unnest({words_sql('lower(text)')}) AS w FROM documents WHERE lang = 'de'), t AS (SELECT item_id, {words_sql('lower(text)')} AS w FROM benchmark), p AS (SELECT item_id, len(w) AS n, unnest(generate_series(1, len(w))) AS i, unnest(w) AS w FROM t WHERE len(w) > 1), "
       "c AS (SELECT item_id, n, i, (CASE WHEN w IN (SELECT w FROM en) THEN 1 ELSE 0 END) - (CASE WHEN regexp_matches(w, '[äöüß]') THEN 1 ELSE 0 END) AS a, (CASE WHEN w IN (SELECT w FROM de) THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(w, '[äöüß]') THEN 1 ELSE 0 END) AS b FROM p), "
       "s AS (SELECT item_id, n, i, sum(a) OVER w + sum(b) OVER (PARTITION BY item_id) - sum(b) OVER w AS score FROM c WINDOW w AS (PARTITION BY item_id ORDER BY i)) SELECT item_id, min(i) AS at, score::DOUBLE AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS top FROM s WHERE i < n) WHERE score = top GROUP BY item_id, score")  # fmt: skip
def spl_boundary(spark, sf_dir):
    """Where each benchmark item would be cut into English and German words."""
    d = table(spark, sf_dir, "documents")
    words = lambda where: d.filter(where).select(F.explode(tokens(F.lower("text"))).alias("word"))
    return C.boundary_split(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", tokens(F.col("text")), words("lang = 'en'"), words("lang = 'de'"), "äöüß")
