"""Guards of splits: what is left out because it is held elsewhere, with counts, and checks that splits share nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import is_blank, strip


def side_counts(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """One row: pairs in all, those with a blank side, those with two equal sides that aren't blank, those kept."""
    blank = is_blank(F.col(src)) | is_blank(F.col(tgt))
    same = ~blank & (strip(F.col(src)) == strip(F.col(tgt)))
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return pairs.agg(F.count("*").alias("pairs"), n(blank, "empty"), n(same, "identical"), n(~blank & ~same, "kept"))


def drop_counts(parts: DataFrame, part: str, held: DataFrame, key: Column, held_key: Column) -> DataFrame:
    """(part, rows, dropped): of each part, the rows whose key is among held's. Null keys stay."""
    keys = held.select(held_key.alias("_key")).filter("_key IS NOT NULL").distinct().withColumn("_held", F.lit(1))
    marked = parts.withColumn("_key", key).join(keys, "_key", "left")
    return marked.groupBy(part).agg(F.count("*").alias("rows"), F.count("_held").alias("dropped"))


def guarded_pool(new: DataFrame, key: Column, test: DataFrame, pools: dict[str, DataFrame], held_key: Column) -> DataFrame:
    """new with `verdict`: test where its key is in the test set, else the names of the pools that have it, joined by +, else kept. A row in two pools counts for both."""
    out = new.withColumn("_key", key)
    for k, held in enumerate([test, *pools.values()]):
        keys = held.select(held_key.alias("_key")).filter("_key IS NOT NULL").distinct().withColumn(f"_in{k}", F.lit(True))
        out = out.join(keys, "_key", "left")
    named = F.concat_ws("+", *[F.when(F.col(f"_in{k + 1}"), F.lit(name)) for k, name in enumerate(pools)])
    verdict = F.when(F.col("_in0"), "test").when(named != "", named).otherwise("kept")
    return out.withColumn("verdict", verdict).drop("_key", *[f"_in{k}" for k in range(len(pools) + 1)])


def leaks(df: DataFrame, split: str, key: Column) -> DataFrame:
    """(a, b, keys): for two splits that share keys, how many. Null keys are none."""
    by = df.select(key.alias("_key"), F.col(split).alias("_s")).filter("_key IS NOT NULL").distinct().groupBy("_key").agg(F.array_sort(F.collect_set("_s")).alias("_s")).filter(F.size("_s") > 1)
    two = by.select(F.explode("_s").alias("a"), "_s").select("a", F.explode("_s").alias("b")).filter("a < b")  # splits of one key, a few
    return two.groupBy("a", "b").agg(F.count("*").alias("keys"))


def with_fallback(df: DataFrame, split: str, order: list[str], wanted: str = "dev", source: str = "train", most: int = 64) -> DataFrame:
    """df, and where no row is `wanted`, the first `most` rows of `source` in the given order once more as `wanted`: the number is the feature."""
    if not df.filter(F.col(split) == wanted).isEmpty():
        return df
    return df.unionByName(df.filter(F.col(split) == source).orderBy(*order).limit(most).withColumn(split, F.lit(wanted)))


def routed(df: DataFrame, key: Column, members: DataFrame, member_key: Column, inside: str, outside: str, name: str = "subset") -> DataFrame:
    """df with the name of the subset: inside where its key is among the members', else outside."""
    keys = members.select(member_key.alias("_key")).filter("_key IS NOT NULL").distinct().withColumn("_in", F.lit(True))
    return df.withColumn("_key", key).join(keys, "_key", "left").withColumn(name, F.when(F.col("_in"), inside).otherwise(outside)).drop("_key", "_in")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows: the number is the feature."""
    return df.orderBy(*order).limit(n)


def numbered_first(df: DataFrame, keys: list[str], order: str, prefix: str) -> DataFrame:
    """The first row of each key, with a new id: prefix and a number from 1 in that order, four digits at least. Ranks come from ranges of the order."""
    from quern.operators.rows import keep_first
    from quern.operators.ordering import ranks

    kept = keep_first(df, keys, [order])
    return ranks(kept, [order], "_n").withColumn("new_id", F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), F.greatest(F.lit(4), F.length(F.col("_n").cast("string"))), F.lit("0")))).drop("_n")


def pending(inputs: DataFrame, cache: DataFrame, content: Column) -> DataFrame:
    """inputs with `digest`, the SHA-256 of what a stage reads, that the stage's cache (digest, ...) doesn't have yet; equal contents once."""
    addressed = inputs.withColumn("digest", F.sha2(content.cast("binary"), 256))
    return addressed.join(cache.select("digest").distinct(), "digest", "left_anti").dropDuplicates(["digest"])
