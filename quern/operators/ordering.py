"""Places, running sums and exact quantiles in an order of rows, without a task that holds all rows or all of a group.

Rows are sorted into ranges once, and the range is stored with each row: boundaries of a range sort come from a sample and are others in the next plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import materialize

#: Rows of a range, and values of a cell of the sketch that quantiles are looked for in.
ROWS_A_RANGE, ROWS_A_CELL = 1_000_000, 1_000_000
#: Cells of the sketch.
LEAST_CELLS, MOST_CELLS = 64, 10_000
#: Leading hexadecimal digits of a digest that name a cell of rows.
DIGITS = 3
#: Rows of a table of ids, names and numbers that may be broadcast.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df, a written table of short rows, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def grouped_few(df: DataFrame) -> DataFrame:
    """A small aggregate, written and broadcast where its size allows."""
    return few(materialize(df, "groups"))


def same(a: DataFrame, b: DataFrame, keys: list[str], names: list[str] | None = None) -> Column:
    """Equality of the keys, null being a value like others."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[n]) for k, n in zip(keys, names or keys)], F.lit(True))


def parts_of(df: DataFrame, rows: int = ROWS_A_RANGE) -> int:
    """Ranges for so many rows each; with few rows, enough that all cores have some."""
    n = df.count()
    return max(1, -(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, n // 1000))


def spread_parts(df: DataFrame, times: int, rows: int = ROWS_A_RANGE) -> int:
    """Tasks of about `rows` rows each once every row of df stands `times` times."""
    n = df.count()
    return max(1, min(n, max(-(-n * times // rows), df.sparkSession.sparkContext.defaultParallelism)))


def spread(df: DataFrame, times: int, rows: int = ROWS_A_RANGE) -> DataFrame:
    """df dealt anew over tasks that get about `rows` rows each once every row stands `times` times: a small file is one task, however many rows it is made into."""
    return df.repartition(spread_parts(df, times, rows))


def in_ranges(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """df as a written table with _part, the number of a row's range in `order`, and _at, its place from 0 within. Ranges are of about equal counts, whatever the values are; only rows equal in all of `order` must share one."""
    parted = df.repartitionByRange(parts or parts_of(df), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(parted, "ranges").select(*df.columns, F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))


def ranks(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with its place from 1 in `order`. Rows equal in all of `order` have places of their own."""
    t = in_ranges(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = t.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a range
    return t.join(grouped_few(shift), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).select(*df.columns, name)


def ranks_within(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """df with its place from 1 within each group of `by`, in `order`: its place among all rows, from the first of its group on."""
    t = ranks(df, [*by, *order], "_all")
    first = grouped_few(t.groupBy(*by).agg(F.min("_all").alias("_first")).select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_first"))
    j = t.join(first, same(t, first, by, [f"_g{k}" for k in range(len(by))]))
    return j.withColumn(name, F.col("_all") - F.col("_first") + 1).select(*df.columns, name)


def _bordered(df: DataFrame, by: list[str], digest: str, take: Column) -> DataFrame:
    """df with _cell, the first digits of its digest, and of its group _border, the cell in which the place `take` (of _n, the group's count) in order of the digest lies, and _in, the places of that cell up to it. Cells are counted; no row is moved."""
    names = [f"_g{k}" for k in range(len(by))]
    d = df.withColumn("_cell", F.substring(digest, 1, DIGITS))
    whole = Window.partitionBy(*by)
    counts = materialize(d.groupBy(*by, "_cell").agg(F.count("*").alias("_c")), "digits")
    counts = counts.select("*", F.sum("_c").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_c").over(whole).alias("_n")).withColumn("_take", take)  # a row a cell
    border = counts.filter("_upto - _c < _take AND _take <= _upto").select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_cell").alias("_border"), (F.col("_take") - F.col("_upto") + F.col("_c")).alias("_in"))
    border = grouped_few(border)
    return d.join(border, same(d, border, by, names), "left")


def among_first(df: DataFrame, by: list[str], digest: str, order: list[str], take: Column, name: str) -> DataFrame:
    """df with `name`, whether a row is among the first `take` (of _n, the group's count) of its group in order of a hexadecimal digest and then `order`. Only rows of the cell in which the last of them lies are sorted."""
    d = _bordered(df, by, digest, take)
    at = F.coalesce(F.col("_cell") == F.col("_border"), F.lit(False))
    sure = d.filter(~at).withColumn(name, F.coalesce(F.col("_cell") < F.col("_border"), F.lit(False)))
    near = ranks_within(materialize(d.filter(at).select(*df.columns, "_in"), "at_border"), by, [digest, *order], "_place").withColumn(name, F.col("_place") <= F.col("_in"))
    return sure.select(*df.columns, name).unionByName(near.select(*df.columns, name))


def first_places(df: DataFrame, by: list[str], digest: str, order: list[str], most: int, name: str) -> DataFrame:
    """df with its place from 1 within its group in order of a hexadecimal digest and then `order`, at least where that is `most` or lower; null for rows of cells beyond, which aren't sorted."""
    d = _bordered(df, by, digest, F.least(F.lit(most), F.col("_n")))
    low = F.coalesce(F.col("_cell") <= F.col("_border"), F.lit(False))
    near = materialize(d.filter(low).select(*df.columns), "first")
    near = ranks_within(near, by, [digest, *order], name) if by else ranks(near, [digest, *order], name)
    return near.unionByName(d.filter(~low).select(*df.columns, F.lit(None).cast("long").alias(name)))


def running_sums(df: DataFrame, by: list[str], order: list, amount: str, name: str) -> DataFrame:
    """df with the sum of `amount` over the rows of its group up to it in `order`."""
    t = in_ranges(df, [*by, *order])
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy(*by, "_part").agg(F.sum(amount).alias("_s")).select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
    sums = grouped_few(sums)
    own = F.sum(amount).over(Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("_own", own)
    j = t.join(sums, same(t, sums, [*by, "_part"], [*[f"_g{k}" for k in range(len(by))], "_p"]))
    return j.withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, names): for each share the exact quantile of `value`, between two neighbours in proportion. Null and NaN are left out; a group of nothing else has no row, and without `by` the one row is null.

    A sketch gives the borders of cells; counts of cells tell in which one a quantile lies; values of those cells alone are counted and summed up. No buffer holds a group's values.
    """
    from pyspark.ml.feature import Bucketizer

    by = list(by or [])
    names = [f"_g{k}" for k in range(len(by))]
    x = materialize(df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)"), "values")
    cells = min(MOST_CELLS, max(LEAST_CELLS, x.count() // ROWS_A_CELL))
    borders = sorted(set(x.approxQuantile("_v", [k / cells for k in range(1, cells)], 0.5 / cells)))
    borders = [float("-inf"), *(b for b in borders if abs(b) != float("inf")), float("inf")]
    x = Bucketizer(splits=borders if len(borders) > 2 else [float("-inf"), 0.0, float("inf")], inputCol="_v", outputCol="_cell").transform(x)
    before = Window.partitionBy(*names).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(*names, "_cell").agg(F.count("*").alias("_n"))
    counts = counts.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*names)).alias("_all"))  # a row a cell
    place = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    asked = F.array(*[F.struct(F.lit(k).alias("k"), (place(p) - F.floor(place(p))).alias("part"), side(place(p)).cast("long").alias("at"), F.lit(s).alias("side")) for k, p in enumerate(shares.values()) for s, side in enumerate((F.floor, F.ceil))])
    wanted = counts.select("*", F.explode(asked).alias("q")).filter("q.at >= _before AND q.at < _before + _n").select(*names, "_cell", "q.k", "q.part", "q.side", (F.col("q.at") - F.col("_before")).alias("_in"))
    wanted = materialize(wanted, "wanted")
    held = few(materialize(wanted.select(*[F.col(n).alias(f"_h{n}") for n in names], F.col("_cell").alias("_hc")).distinct(), "cells"))
    near = x.join(held, same(x, held, [*names, "_cell"], [*[f"_h{n}" for n in names], "_hc"]), "left_semi").groupBy(*names, "_cell", "_v").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*names, "_cell").orderBy("_v"))  # different values of one cell
    near = near.withColumn("_to", upto)
    w = wanted.select(*[F.col(n).alias(f"_h{n}") for n in names], F.col("_cell").alias("_hc"), "k", "part", "side", "_in")
    hit = near.join(few(w), same(near, w, [*names, "_cell"], [*[f"_h{n}" for n in names], "_hc"]) & (F.col("_in") >= F.col("_to") - F.col("_k")) & (F.col("_in") < F.col("_to")))
    low, high = (F.max(F.when(F.col("side") == s, F.col("_v"))) for s in (0, 1))
    each = hit.groupBy(*names, "k").agg(low.alias("lo"), (low + (high - low) * F.max("part")).alias("v"))
    each = each.withColumn("v", F.when(F.abs("lo") == float("inf"), F.col("lo")).otherwise(F.col("v")))
    out = each.groupBy(*names).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(name) for k, name in enumerate(shares)])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by)], *shares)
