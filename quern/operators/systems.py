"""Systems side by side: aligned predictions, spreads, selections for reports, comparisons and summaries of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(systems: dict[str, DataFrame], index: str = "idx") -> DataFrame:
    """(index, src, ref, pred_NAME ...) of rows that every system has; an error where sources or references differ."""
    tables = [t.select(index, F.col("src").alias(f"_src{k}"), F.col("ref").alias(f"_ref{k}"), F.col("pred").alias(f"pred_{name}")) for k, (name, t) in enumerate(systems.items())]
    both = reduce(lambda a, b: a.join(b, index), tables)
    same = reduce(lambda a, b: a & b, [F.col(f"_{c}{k}").eqNullSafe(F.col(f"_{c}0")) for k in range(1, len(tables)) for c in ("src", "ref")], F.lit(True))
    checked = F.when(same, F.col("_src0")).otherwise(F.raise_error(F.concat(F.lit("sources or references differ at "), F.col(index).cast("string"))).cast("string"))
    return both.select(index, checked.alias("src"), F.col("_ref0").alias("ref"), *[f"pred_{name}" for name in systems])


def widest_spread(scores: DataFrame, index: str, columns: list[str], subset: Column, each: int) -> DataFrame:
    """(subset, index, spread): of each subset the `each` rows where the systems' scores lie farthest apart, of equal ones the least index. The number is the feature."""
    spread = F.greatest(*columns) - F.least(*columns)
    w = Window.partitionBy("subset").orderBy(F.desc("spread"), index)
    return scores.select(index, subset.alias("subset"), spread.alias("spread")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each).drop("_n")


def spotlight(scores: DataFrame, index: str, chrf: str, bleu: str, from_index: int, least_chrf: float = 70, most_bleu: float = 50, n: int = 3) -> DataFrame:
    """(index, gap): from from_index on, the n rows of the widest gap among those of high chrF and low BLEU. The number is the feature."""
    wanted = scores.filter((F.col(index) >= from_index) & (F.coalesce(chrf, F.lit(0.0)) >= least_chrf) & (F.coalesce(bleu, F.lit(0.0)) < most_bleu))
    return wanted.select(index, (F.col(chrf) - F.col(bleu)).alias("gap")).orderBy(F.desc("gap"), index).limit(n)


def covering_examples(scores: DataFrame, index: str, gap: str, tags: str, count: int, least_gap: float, wanted: tuple[str, ...] = ("neg", "q", "past")) -> DataFrame:
    """(place, index): first the row of the widest gap with each wanted tag, then one of any tag, then by gap, `count` in all; rows below least_gap only if there aren't enough others.

    The candidates are the first `count` rows by gap of each tag and of all, at most count times (tags + 1): what any choice can take. The number is the feature.
    """
    high = scores.filter(F.col(gap) >= least_gap)
    pool = high if high.count() >= count else scores
    first = lambda rows: rows.orderBy(F.desc(gap), index).limit(count + len(wanted))
    near = first(pool).select(index, gap, tags)
    for tag in wanted:
        near = near.unionByName(first(pool.filter(F.array_contains(tags, tag))).select(index, gap, tags))
    rows = near.dropDuplicates([index]).orderBy(F.desc(gap), index).collect()  # count * (tags + 1) rows at most
    chosen: list = []
    for tag in (*wanted, None):
        one = next((r for r in rows if r[index] not in chosen and (tag is None or tag in r[tags])), None)
        if one is not None and len(chosen) < count:
            chosen.append(one[index])
    chosen += [r[index] for r in rows if r[index] not in chosen]
    kind = scores.schema[index].dataType.simpleString()
    return scores.sparkSession.createDataFrame(list(enumerate(chosen[:count], 1)), f"place int, {index} {kind}")


def comparison(a: DataFrame, b: DataFrame, index: str, score: str, resamples: int, seed: int = 1) -> DataFrame:
    """One row on two systems over the same references (index, ref, score): pairs, both means, delta, paired effect size, bootstrap p value; an error where references differ."""
    from quern.operators.metrics import bootstrap_wins, effect_sizes

    both = a.select(index, F.col("ref").alias("_ra"), F.col(score).alias("a")).join(b.select(index, F.col("ref").alias("_rb"), F.col(score).alias("b")), index)
    checked = F.when(F.col("_ra").eqNullSafe(F.col("_rb")), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("references differ at "), F.col(index).cast("string"))).cast("double"))
    rows = both.select(index, checked.alias("a"), "b").withColumn("_all", F.lit(1))
    means = rows.agg(F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg("b") - F.avg("a"), 6).alias("delta"))
    effect = effect_sizes(rows, "b", "a", ["_all"]).select(F.col("n").alias("pairs"), F.col("d_paired"))
    p = bootstrap_wins(rows, index, "a", "b", resamples, seed).select(F.round("p_value", 6).alias("p_value"))
    return effect.crossJoin(means).crossJoin(p)  # one row each


def cell(mean: Column, deviation: Column, n: Column) -> Column:
    """A table's cell: the mean with one digit, ± the deviation if there is one, and the number of seeds if it is under 5."""
    form = lambda x: F.format_string("%.1f", x)
    return F.concat(form(mean), F.when(deviation > 0, F.concat(F.lit("±"), form(deviation))).otherwise(""), F.when(n < 5, F.concat(F.lit(" (n="), n.cast("string"), F.lit(")"))).otherwise(""))


def robustness(runs: DataFrame, overlay: DataFrame, keys: list[str], focus: dict[str, list], metrics: list[str]) -> DataFrame:
    """keys, n, and for each metric mean, sample deviation (0 for one seed) and cell, of the runs whose keys are in focus. Runs of overlay take the place of those of the same keys and seed."""
    from quern.operators.rows import overlay as over

    whole = over(overlay, runs, [*keys, "seed"])
    for column, values in focus.items():
        whole = whole.filter(F.col(column).isin(*values))
    by = whole.groupBy(*keys).agg(F.count("*").alias("n"), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))])
    return by.select("*", *[cell(F.col(f"{m}_mean"), F.col(f"{m}_std"), F.col("n")).alias(f"{m}_cell") for m in metrics])


def mapped(old: DataFrame, new: DataFrame, mapping: list[tuple[str, str | None]], model: str = "model", recipe: str = "recipe", score: str = "score", fallback: str = "local") -> DataFrame:
    """(model, old_recipe, new_recipe, old, new, delta): each model with each pair of the mapping; a model without old scores of its own takes those of the fallback bucket."""
    pairs = F.array(*[F.struct(F.lit(a).alias("old_recipe"), F.lit(b).cast("string").alias("new_recipe")) for a, b in mapping])
    grid = new.select(model).distinct().select(model, F.inline(pairs))
    o = old.select(F.col(model), F.col(recipe).alias("old_recipe"), F.col(score).alias("own"))
    f = old.filter(F.col(model) == fallback).select(F.col(recipe).alias("old_recipe"), F.col(score).alias("shared"))
    n = new.select(F.col(model), F.col(recipe).alias("new_recipe"), F.col(score).alias("new"))
    j = grid.join(o, [model, "old_recipe"], "left").join(f, "old_recipe", "left").join(n, [model, "new_recipe"], "left").withColumn("old", F.coalesce("own", "shared"))
    return j.select(model, "old_recipe", "new_recipe", "old", "new", (F.col("new") - F.col("old")).alias("delta"))


def cascade_summary(results: DataFrame, stages: list[str], audio: Column, failed: Column) -> DataFrame:
    """One row over nested results: rows, failed ones, those with audio, and for each stage (a struct with elapsed_sec, or null) how many ran and the mean and largest time."""
    n = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(name)
    times = [x for s in stages for x in (F.count(f"{s}.elapsed_sec").alias(f"{s}_n"), F.round(F.avg(f"{s}.elapsed_sec"), 4).alias(f"{s}_mean"), F.max(f"{s}.elapsed_sec").alias(f"{s}_max"))]
    return results.agg(F.count("*").alias("n_total"), n(failed, "n_failed"), n(audio, "n_audio"), *times)


def by_subset(rows: DataFrame, index: str, end: int, aggregates: list[Column], inside: str = "structured", outside: str = "tatoeba") -> DataFrame:
    """The aggregates over all rows (combined), those with an index below `end` and those from it on; the rows are read once."""
    named = rows.withColumn("subset", F.explode(F.array(F.lit("combined"), F.when(F.col(index) < end, inside).otherwise(outside))))
    return named.groupBy("subset").agg(*aggregates)


def property_report(rows: DataFrame, name: str, text: str) -> DataFrame:
    """Per name: sentences, words, distinct words, mean, least and most words of a sentence, and distinct words a word (0 without words). Null texts have none. Words are counted before they are exchanged."""
    from quern.functions.text import tokens

    words = rows.select(name, tokens(F.lower(text)).alias("_w"))
    sizes = words.groupBy(name).agg(F.count("*").alias("sentences"), F.sum(F.size("_w")).alias("words"), F.avg(F.size("_w")).alias("mean_length"), F.min(F.size("_w")).cast("long").alias("least"), F.max(F.size("_w")).cast("long").alias("most"))
    kinds = words.select(name, F.explode("_w").alias("_x")).distinct().groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("vocabulary"))
    out = sizes.join(kinds, F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name").withColumn("vocabulary", F.coalesce("vocabulary", F.lit(0).cast("long")))
    return out.withColumn("type_token_ratio", F.coalesce(F.try_divide("vocabulary", "words"), F.lit(0.0)))
