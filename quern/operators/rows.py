"""Deduplication, decontamination, splits and samples, all reproducible by order columns and hashed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordering import ranks, ranks_within

__all__ = ["duplicate_flags", "group_split", "hashed", "keep_first", "keep_last", "overlay", "ranks", "sample_rows", "strata_sample", "without_keys"]


def hashed(seed: int, key: Column) -> Column:
    """A key's place in an order that seed fixes."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key. Null is a key like others. A filter on the rank prunes before the exchange."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list, order: str) -> DataFrame:
    return keep_first(df, keys, [F.desc(order)])


def duplicate_flags(df: DataFrame, keys: list[str], order: str, name: str = "is_duplicate") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1)


def without_keys(df: DataFrame, held: DataFrame, key: Column, held_key: Column) -> DataFrame:
    """Rows whose key isn't among held's. Null keys stay."""
    keys = held.select(held_key.alias("_key")).distinct()
    return df.withColumn("_key", key).join(keys, "_key", "left_anti").drop("_key")


def strata_sample(df: DataFrame, stratum: str, per_stratum: int, key: str, seed: int = 1) -> DataFrame:
    """Of each stratum the first rows by hashed key."""
    ranked = ranks_within(df.withColumn("_h", hashed(seed, F.col(key))), [stratum], ["_h", key], "_n")
    return ranked.filter(F.col("_n") <= per_stratum).drop("_h", "_n")


def group_split(df: DataFrame, group: str, test: float, validation: float, seed: int = 1, rounding: str = "floor") -> DataFrame:
    """df with `split`. Whole groups go to test, then validation, then train; sizes are shares of the number of groups, at least 1.

    Ranks come from a sort by ranges, so no task holds all groups. rounding: floor, bround or ceil.
    """
    groups = df.select(F.col(group).alias("_g")).distinct().withColumn("_h", hashed(seed, F.col("_g")))
    n = groups.agg(F.count("*").alias("_total"))
    size = lambda share: F.greatest(F.lit(1), getattr(F, rounding)(F.col("_total") * F.lit(share)).cast("long"))
    ranked = ranks(groups, ["_h", "_g"], "_rank").join(F.broadcast(n))
    split = F.when(F.col("_rank") <= size(test), "test").when(F.col("_rank") <= size(test) + size(validation), "validation").otherwise("train")
    return df.join(ranked.select("_g", split.alias("split")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows by hashed key, all if there are fewer."""
    return df.orderBy(hashed(seed, F.col(key)), key).limit(n)


def overlay(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first, and those of second whose key first doesn't have."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))
