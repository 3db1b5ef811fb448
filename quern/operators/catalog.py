"""Sentences matched with a catalog of clean ones, and what they carry beyond: prefixes, residues, alternative references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import collapse


def deduplicated(catalog: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, french, order) with the last row of each sentence of a key; norm is the sentence in lower case."""
    named = catalog.withColumn("norm", F.lower("french"))
    others = [c for c in named.columns if c not in (*keys, "norm")]
    return named.groupBy(*keys, "norm").agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "norm", "_r.*")


def variants(norm: Column, shown: Column) -> Column:
    """array of struct(prefix, length): a sentence, and where it has ne and pas, itself without its first ne; length is that of what is shown."""
    bare = lambda x: F.regexp_replace(x, "^(.*?) ne ", "$1 ")
    plain = F.struct(norm.alias("prefix"), F.length(shown).alias("length"))
    spoken = F.struct(bare(norm).alias("prefix"), F.length(bare(shown)).alias("length"))
    return F.when(norm.contains(" ne ") & norm.contains(" pas "), F.array(plain, spoken)).otherwise(F.array(plain))


def _longest(rows: DataFrame, catalog: DataFrame, keys: list[str], row_id: str, text: str) -> DataFrame:
    """(row_id, clean, residue, sentences): the longest sentence under the keys that opens the text up to its end or a space, and how many different ones are as long.

    Rows and sentences meet by the keys and the sentence's first word, an equality; both ends of a sentence are compared only then. Only ids and texts of matches are gathered.
    """
    first = lambda x: F.substring_index(x, " ", 1)
    known = catalog.select(*keys, "french", "norm", F.explode(variants(F.col("norm"), F.col("french"))).alias("v")).select(*keys, "french", "norm", "v.*").withColumn("_first", first(F.col("prefix")))
    asked = rows.select(row_id, *keys, collapse(F.col(text)).alias("_text")).withColumn("_low", F.lower("_text")).withColumn("_first", first(F.col("_low")))
    hits = asked.join(known, [*keys, "_first"]).filter((F.col("_low") == F.col("prefix")) | F.col("_low").startswith(F.concat("prefix", F.lit(" "))))
    residue = F.when(F.col("_low") == F.col("prefix"), "").otherwise(F.trim(F.substr("_text", F.col("length") + 1)))
    scored = hits.select(row_id, F.length("norm").alias("_n"), "norm", "french", residue.alias("residue"))
    top = scored.groupBy(row_id).agg(F.max("_n").alias("_top"), F.min_by(F.struct("french", "residue"), F.struct(-F.col("_n"), F.col("norm"), F.length("residue"))).alias("_b"))
    ties = scored.groupBy(row_id, "_n").agg(F.count_distinct("norm").alias("sentences"))
    return top.join(ties.withColumnRenamed("_n", "_top"), [row_id, "_top"]).select(row_id, F.col("_b.french").alias("clean"), "_b.residue", "sentences")


def matched(rows: DataFrame, catalog: DataFrame, keys: list[str], weaker: list[str], row_id: str, text: str) -> DataFrame:
    """(row_id, status, clean, residue): rows against the catalog by all keys, and those that find nothing by the weaker ones.

    status: unchanged, moved_residue (words after the sentence), fixed (the text differs from the catalog's), ambiguous (two sentences as long), no_match.
    """
    strict = _longest(rows, catalog, keys, row_id, text)
    left = rows.join(strict.select(row_id), row_id, "left_anti")
    found = strict.unionByName(_longest(left, catalog.dropDuplicates([*weaker, "norm"]), weaker, row_id, text))
    out = rows.select(row_id, F.col(text).alias("_text")).join(found, row_id, "left")
    status = F.when(F.col("clean").isNull(), "no_match").when(F.col("sentences") > 1, "ambiguous").when(F.col("residue") != "", "moved_residue").when(F.col("_text") != F.col("clean"), "fixed").otherwise("unchanged")
    settled = F.col("sentences") == 1
    return out.select(row_id, status.alias("status"), F.when(settled, F.col("clean")).alias("clean"), F.coalesce(F.when(settled, F.col("residue")), F.lit("")).alias("residue"))


def prepended(residue: Column, target: Column) -> Column:
    """The residue before the target, unless the target begins with it already; blank sides are left out."""
    r, t = collapse(F.coalesce(residue, F.lit(""))), collapse(F.coalesce(target, F.lit("")))
    begun = (F.lower(t) == F.lower(r)) | F.lower(t).startswith(F.concat(F.lower(r), F.lit(" ")))
    return F.when(r == "", t).when(t == "", r).when(begun, t).otherwise(F.concat_ws(" ", r, t))


def without_record(x: Column, form: str) -> Column:
    """struct(text, record): the text before the first match of form, over lines, and the match; form has no groups of its own."""
    found = F.regexp_extract(x, f"(?s){form}", 0)
    cut = F.when(found != "", F.trim(F.regexp_extract(x, f"(?s)^(.*?)(?:{form})", 1))).otherwise(x)
    return F.struct(cut.alias("text"), F.trim(found).alias("record"))


def alternatives(refs: DataFrame) -> DataFrame:
    """(sentence_id, canonical, alternatives): different alternatives of each sentence, ascending. Rows with a blank id or side, or with equal sides, go; two canonical texts of one sentence are an error."""
    t = refs.select("sentence_id", F.trim("canonical").alias("canonical"), F.trim("alternative").alias("alternative")).filter("sentence_id <> '' AND canonical <> '' AND alternative <> '' AND canonical <> alternative")
    by = t.groupBy("sentence_id").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("_other"), F.sort_array(F.collect_set("alternative")).alias("alternatives"))
    clash = F.when(F.col("canonical") != F.col("_other"), F.raise_error(F.concat(F.lit("two canonical texts of sentence "), F.col("sentence_id")))).otherwise(F.col("canonical"))
    return by.select("sentence_id", clash.cast("string").alias("canonical"), "alternatives")


def with_references(rows: DataFrame, ids: DataFrame, refs: DataFrame) -> DataFrame:
    """rows (idx, ref, ...) with refs, the row's reference and, where it is the canonical text of its sentence, the alternatives, and used_alternative (0 or 1). ids: (idx, sentence_id)."""
    known = rows.join(ids.select("idx", "sentence_id"), "idx", "left").join(alternatives(refs), "sentence_id", "left")
    more = F.when(F.col("canonical") == F.col("ref"), F.array_remove("alternatives", F.col("ref")))
    extra = F.coalesce(more, F.array().cast("array<string>"))
    return known.withColumn("refs", F.concat(F.array("ref"), extra)).withColumn("used_alternative", (F.size(extra) > 0).cast("long")).drop("canonical", "alternatives")


def boundary_split(lines: DataFrame, key: str, words: Column, source_words: DataFrame, target_words: DataFrame, target_letters: str) -> DataFrame:
    """(key, at, confidence): where a line of source and target words is cut best, after `at` words; of equal places the first. Lines of fewer than two words go.

    A word before the cut counts 1 if the source's vocabulary (word) has it, less 1 if it has a letter of the target only; behind it 1 for the target's vocabulary and 1 for such a letter.
    A line's words meet the vocabularies by equality; the scores of all cuts of a line are running sums over its words.
    """
    placed = lines.select(key, F.posexplode(F.transform(words, F.lower)).alias("i", "word"))
    known = lambda v, name: v.select(F.lower("word").alias("word")).distinct().withColumn(name, F.lit(1))
    both = placed.join(known(source_words, "s"), "word", "left").join(known(target_words, "t"), "word", "left")
    letter = F.col("word").rlike(f"[{target_letters}]").cast("int")
    scored = both.select(key, F.struct("i", (F.coalesce("s", F.lit(0)) - letter).alias("before"), (F.coalesce("t", F.lit(0)) + letter).alias("behind")).alias("x"))
    line = scored.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x")).filter(F.size("x") > 1)  # the words of one line
    total = lambda part, field: F.aggregate(part, F.lit(0), lambda a, v: a + v[field])
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("before"), total(F.col("x"), "behind").alias("behind"), F.lit(0).alias("at"), F.lit(-(10**9)).alias("best"))

    def step(s: Column, v: Column) -> Column:
        n, before, behind = s["n"] + 1, s["before"] + v["before"], s["behind"] - v["behind"]
        better = (n < F.size("x")) & (before + behind > s["best"])
        return F.struct(n.alias("n"), before.alias("before"), behind.alias("behind"), F.when(better, n).otherwise(s["at"]).alias("at"), F.when(better, before + behind).otherwise(s["best"]).alias("best"))

    found = line.select(key, F.aggregate("x", start, step).alias("f"))
    return found.select(key, F.col("f.at").cast("long").alias("at"), F.col("f.best").cast("double").alias("confidence"))
