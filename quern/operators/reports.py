"""Reports over columns, characters, vocabularies and groups of conditions: each a table, none gathered by the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import nfc, nfd
from quern.operators.ordering import quantiles


def cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, text): a row for each text that isn't null."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns])
    return df.select(key, F.inline(each)).filter("text IS NOT NULL")


def normal_form_diagnosis(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, length, nfd_length, nfc_length, has_combining, would_change) of each text; has_combining where its two normal forms differ."""
    c = cells(df, key, columns).withColumns({"_c": nfc(F.col("text")), "_d": nfd(F.col("text"))})
    return c.select(key, "column", F.length("text").alias("length"), F.length("_d").alias("nfd_length"), F.length("_c").alias("nfc_length"), (F.col("_c") != F.col("_d")).alias("has_combining"), (F.col("_c") != F.col("text")).alias("would_change"))


def normal_form_changes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, original_text, normalized_text, original_length, normalized_length, char_difference) of the texts that NFC changes."""
    c = cells(df, key, columns).withColumn("_c", nfc(F.col("text"))).filter(F.col("_c") != F.col("text"))
    n, m = F.length("text"), F.length("_c")
    return c.select(key, "column", F.col("text").alias("original_text"), F.col("_c").alias("normalized_text"), n.alias("original_length"), m.alias("normalized_length"), (n - m).alias("char_difference"))


def normal_form_summary(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, total_rows, rows_changed, percentage, total_char_diff): all rows count, those without a text too."""
    d = normal_form_diagnosis(df, key, columns)
    total = df.agg(F.count("*").alias("total_rows"))
    names = total.select("total_rows", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    change = F.col("would_change").cast("long")
    by = d.groupBy("column").agg(F.sum(change).alias("c"), F.sum(change * F.abs(F.col("length") - F.col("nfc_length"))).alias("m"))
    changed = F.coalesce("c", F.lit(0))
    return names.join(by, "column", "left").select("column", "total_rows", changed.alias("rows_changed"), F.try_divide(100.0 * changed, F.col("total_rows")).alias("percentage"), F.coalesce("m", F.lit(0)).cast("long").alias("total_char_diff"))


def mean_and_spread(values: list[str], digits: int = 1) -> list[Column]:
    """For each value its mean and sample deviation with so many digits; the deviation of one value is null, as is the mean of none."""
    return [f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", lambda c: F.round(F.avg(c), digits)), ("std", lambda c: F.round(F.stddev_samp(c), digits)))]


def filled_mean_and_spread(value: str, digits: int = 1) -> list[Column]:
    """mean and deviation of a value, 0 where one value or none leaves them undefined."""
    return [F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), digits).alias("deviation")]


def stage_summary(df: DataFrame, stage: str, value: str, failed: Column) -> DataFrame:
    """(stage, n, failed, mean, median, most) of a value by stage; nulls are left out of its statistics."""
    s = df.groupBy(stage).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    q = quantiles(df, value, {"median": 0.5}, [stage]).withColumnRenamed(stage, "_stage")
    return s.join(q, F.col(stage).eqNullSafe(F.col("_stage")), "left").drop("_stage")


def metric_summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, std) of every metric of the runs, one row each; std is the population's."""
    return runs.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value").groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def routed_by_place(place: Column, cut: int, names: tuple[str, str] = ("structured", "random")) -> Column:
    """The subset of a row by its place from 0: the first `cut` rows, or the others."""
    return F.when(place < cut, names[0]).when(place >= cut, names[1])


def routed_by_membership(df: DataFrame, text: str, members: DataFrame, member: str, names: tuple[str, str] = ("structured", "random")) -> DataFrame:
    """df with `subset`: whether its stripped text is among the members' stripped texts. Null is in the second."""
    known = members.select(F.trim(member).alias("_m")).filter("_m IS NOT NULL").distinct().withColumn("_in", F.lit(True))
    return df.join(known, F.trim(text) == F.col("_m"), "left").withColumn("subset", F.when(F.col("_in"), names[0]).otherwise(names[1])).drop("_m", "_in")


def pooled(df: DataFrame, condition: str, pools: dict[str, list[str]], values: list[str], size: str, digits: int = 1) -> DataFrame:
    """(pool, n, size, means and deviations) over all rows of each pool's conditions; a condition may be in several pools. size is the mean of the column, as a whole number."""
    held = F.array_compact(F.array(*[F.when(F.col(condition).isin(*members), F.lit(name)) for name, members in pools.items()]))
    return df.withColumn("pool", F.explode(held)).groupBy("pool").agg(F.count("*").alias("n"), F.bround(F.avg(size)).cast("long").alias("size"), *mean_and_spread(values, digits))


def character_frequencies(texts: DataFrame, text: str, rare: int = 10) -> DataFrame:
    """(ch, codepoint, n, percent, cumulative, is_rare): characters by falling count, equal ones by code point; rare ones occur fewer than `rare` times."""
    n = texts.select(F.explode(F.split(text, "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.desc("n"), "ch").rowsBetween(Window.unboundedPreceding, 0)  # characters, not texts
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy())
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("ch")), 4, "0"))
    return n.select("ch", code.alias("codepoint"), "n", share.alias("percent"), (100 * F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy())).alias("cumulative"), (F.col("n") < rare).alias("is_rare"))


def vocabulary_sets(sides: dict[str, DataFrame]) -> DataFrame:
    """Of two tables of words (word), named: one row of distinct words of each, of both, of either, and of each without the other, with shares of the second's words in percent (0 if it has none)."""
    (a, x), (b, y) = sides.items()
    tagged = lambda t, k: t.select("word").filter("word IS NOT NULL").distinct().withColumn("_k", F.lit(k))
    held = tagged(x, 1).unionByName(tagged(y, 2)).groupBy("word").agg(F.sum("_k").alias("_k"))
    count = lambda *ks: F.count_if(F.col("_k").isin(*ks))
    share = lambda c: F.coalesce(F.try_divide(100.0 * c, count(2, 3)), F.lit(0.0))
    return held.agg(
        count(1, 3).alias(f"{a}_words"), count(2, 3).alias(f"{b}_words"), count(3).alias("both"), count(1, 2, 3).alias("either"), count(1).alias(f"{a}_only"), count(2).alias(f"{b}_only"), share(count(3)).alias("both_percent"), share(count(2)).alias(f"{b}_only_percent")
    )


def words_of(sides: dict[str, DataFrame], part: str) -> DataFrame:
    """(word) of two tables of words: distinct words of `both`, of `either`, or of one side, by its name, without the other."""
    (a, x), (b, y) = ((n, t.select("word").filter("word IS NOT NULL")) for n, t in sides.items())
    return {"both": lambda: x.intersect(y), "either": lambda: x.union(y).distinct(), a: lambda: x.subtract(y), b: lambda: y.subtract(x)}[part]()


def lines(*parts: DataFrame) -> DataFrame:
    """Tables (section, part, place, line) as one; writers.ordered_lines writes it by section, part and place."""
    return reduce(DataFrame.unionByName, [p.select(F.col("section").cast("string").alias("section"), F.col("part").cast("int").alias("part"), F.col("place").cast("long").alias("place"), "line") for p in parts])


def by_section(rows: DataFrame, place: str, section: str, text: str, rule: int = 60) -> DataFrame:
    """Lines of sentences under their sections, which follow by name: a rule, the name in capitals with its sentences' number, a rule, an empty line, the numbered sentences, two empty lines. Numbers are those of `place`."""
    mark = F.lit("=" * rule)
    n = rows.groupBy(F.col(section).alias("section")).agg(F.count("*").alias("n"))
    title = F.concat(F.upper("section"), F.lit(" ("), F.col("n").cast("string"), F.lit(" sentences)"))
    frame = n.select("section", F.posexplode(F.array(mark, title, mark, F.lit(""), F.lit(""), F.lit(""))).alias("k", "line"))
    frame = frame.select("section", F.when(F.col("k") < 4, 0).otherwise(2).alias("part"), F.col("k").alias("place"), "line")
    body = rows.select(F.col(section).alias("section"), F.lit(1).alias("part"), F.col(place).alias("place"), F.concat(F.col(place).cast("string"), F.lit(". "), F.coalesce(text, F.lit(""))).alias("line"))
    return lines(frame, body)


def template(rows: DataFrame, place: str, text: str, title: str, hint: str, rule: int = 60) -> DataFrame:
    """Lines of a form to fill in: title, rule, hint, rule, an empty line, then each numbered sentence, an arrow and an empty line."""
    head = rows.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (title, "=" * rule, hint, "=" * rule, "")])).alias("place", "line"))
    said = F.array(F.concat(F.col(place).cast("string"), F.lit(". "), F.coalesce(text, F.lit(""))), F.lit("   → "), F.lit(""))
    body = rows.select(F.col(place).alias("_p"), F.posexplode(said).alias("k", "line")).select((F.col("_p") * 3 + F.col("k")).alias("place"), "line")
    return lines(head.select(F.lit("").alias("section"), F.lit(0).alias("part"), "place", "line"), body.select(F.lit("").alias("section"), F.lit(1).alias("part"), "place", "line"))


def markdown_table(rows: DataFrame, place: str, header: list[str], columns: list[Column], title: str | None = None) -> DataFrame:
    """Lines of a table in Markdown, after a title if there is one; rows follow by `place`. Bars in cells are escaped, null is a dash."""
    cell = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("—")), "\\|", "\\\\|")
    head = [*([f"## {title}", ""] if title else []), "| " + " | ".join(header) + " |", "|" + "|".join("-" * (len(h) + 2) for h in header) + "|"]
    top = rows.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in head])).alias("place", "line"))
    body = rows.select(F.col(place).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
    return lines(top.select(F.lit("").alias("section"), F.lit(0).alias("part"), "place", "line"), body.select(F.lit("").alias("section"), F.lit(1).alias("part"), "place", "line"))


def latex_table(rows: DataFrame, section: str, place: str, form: str, header: list[str], columns: list[Column], caption: str, label: str, repeated: int = 1) -> DataFrame:
    """Lines of a table in LaTeX: rows under a heading for each section, which follow by name, in order of `place`. The first `repeated` cells are left empty where they are those of the row above. columns are LaTeX already; null is a dash."""
    head = [r"\begin{table*}[t]", r"\centering\small", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{form}}}", r"\toprule", " & ".join(header) + r" \\"]
    foot = [r"\bottomrule", r"\end{tabular}", r"\end{table*}"]
    one = rows.sparkSession.range(1)
    ends = [one.select(F.posexplode(F.array(*[F.lit(x) for x in part])).alias("place", "line")).select(F.lit(s).alias("section"), F.lit(k).alias("part"), "place", "line") for s, k, part in (("", 0, head), ("\U0010ffff", 3, foot))]
    names = rows.select(F.col(section).alias("section")).distinct()
    title = F.concat(F.lit(rf"\multicolumn{{{len(header)}}}{{l}}{{\textit{{"), F.col("section"), F.lit(r"}} \\"))
    titles = names.select("section", F.posexplode(F.array(F.lit(r"\midrule"), title, F.lit(r"\midrule"))).alias("place", "line")).select("section", F.lit(1).alias("part"), "place", "line")
    text = rows.select(F.col(section).alias("section"), F.col(place).alias("place"), *[F.coalesce(c.cast("string"), F.lit("--")).alias(f"_{k}") for k, c in enumerate(columns)])
    above = Window.partitionBy("section").orderBy("place")  # rows of a printed table
    shown = [F.when(F.col(f"_{k}") == F.lag(f"_{k}").over(above), "").otherwise(F.col(f"_{k}")) if k < repeated else F.col(f"_{k}") for k in range(len(columns))]
    body = text.select("section", F.lit(2).alias("part"), "place", F.concat(F.concat_ws(" & ", *shown), F.lit(r" \\")).alias("line"))
    return lines(*ends, titles, body)
