"""Splits and samples beyond the plain ones: quotas, length bins, diverse and pair-breaking draws. Draws are orders of hashed keys, so they repeat on any cluster."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordering import among_first, few, ranks, ranks_within
from quern.operators.rows import hashed
from quern.scratch import materialize


def validation_split(df: DataFrame, by: list[str], key: Column, ratio: float, seed: int = 1) -> DataFrame:
    """df with split val or train: in each group max(1, int(n * ratio)) rows, n - 1 at most, go to val; none for a ratio of 0 or less."""
    if ratio <= 0:
        return df.withColumn("split", F.lit("train"))
    take = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)), F.col("_n") - 1)
    held = among_first(df.withColumn("_h", hashed(seed, key)).withColumn("_k", key), by, "_h", ["_k"], take, "_held")
    return held.withColumn("split", F.when(F.col("_held"), "val").otherwise("train")).drop("_h", "_k", "_held")


def two_step_split(df: DataFrame, key: str, test: float = 0.1, dev: float = 0.1, seed: int = 1) -> DataFrame:
    """df with split: in order of the hashed key ceil(n * test) rows go to test, and ceil(rest * dev / (1 - test)) of the rest, in order of another hash, to dev. Sizes are exact."""
    def step(rows: DataFrame, s: int, share: float, name: str) -> DataFrame:
        ranked = ranks(rows.withColumn("_h", hashed(s, F.col(key))), ["_h", key], "_rank").drop("_h")
        n = rows.agg(F.ceil(F.count("*") * F.lit(share)).alias("_take"))
        return ranked.join(F.broadcast(n)).withColumn(name, F.col("_rank") <= F.col("_take")).drop("_rank", "_take")

    first = step(df, seed, test, "_test")
    second = step(first.filter("NOT _test").drop("_test"), seed + 1, dev / (1 - test), "_dev")
    return first.filter("_test").drop("_test").withColumn("split", F.lit("test")).unionByName(second.withColumn("split", F.when(F.col("_dev"), "dev").otherwise("train")).drop("_dev"))


def index_split(df: DataFrame, key: str, validation: float = 0.05, test: float = 0.05, least: int = 10, seed: int = 1) -> DataFrame:
    """df with split: in order of the hashed key train, then max(1, int(n * validation)) rows val, then test likewise. With fewer than `least` rows all are train."""
    size = lambda share: F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share))).cast("long")
    n = df.agg(F.count("*").alias("_n")).select("_n", size(validation).alias("_val"), size(test).alias("_test"))
    ranked = ranks(df.withColumn("_h", hashed(seed, F.col(key))), ["_h", key], "_rank").join(F.broadcast(n))
    split = F.when((F.col("_n") < least) | (F.col("_rank") <= F.col("_n") - F.col("_val") - F.col("_test")), "train").when(F.col("_rank") <= F.col("_n") - F.col("_test"), "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_rank", "_n", "_val", "_test")


def grouped_validation(df: DataFrame, group: str, share: float, seed: int = 1) -> DataFrame:
    """df with split: max(1, ceil(groups * share)) whole groups by hashed key are validation, the others train. Rows without a group are train."""
    groups = df.select(F.col(group).alias("_g")).filter("_g IS NOT NULL").distinct()
    ranked = ranks(groups.withColumn("_h", hashed(seed, F.col("_g"))), ["_h", "_g"], "_rank")
    take = groups.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(share))).alias("_take"))
    held = ranked.join(F.broadcast(take)).filter(F.col("_rank") <= F.col("_take")).select("_g", F.lit("validation").alias("_split"))
    return df.join(held, F.col(group) == F.col("_g"), "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_g", "_split")


def plain_validation(df: DataFrame, key: str, ratio: float, seed: int = 1) -> DataFrame:
    """df with split: max(1, int(n * ratio)) rows by hashed key are val, without a cap: one row alone is val."""
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio))).alias("_take"))
    ranked = ranks(df.withColumn("_h", hashed(seed, F.col(key))), ["_h", key], "_rank").join(F.broadcast(n))
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_take"), "val").otherwise("train")).drop("_h", "_rank", "_take")


def random_subsets(df: DataFrame, value: str, sizes: list[int], seed: int = 1) -> DataFrame:
    """(subset, value): for each size and each of the draws a, b, c that many distinct values by hashed order, each draw with a seed of its own."""
    values = df.select(F.col(value).alias("_v")).filter("_v IS NOT NULL").distinct()
    draws = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(name).alias("draw"), F.lit(str(seed + k)).alias("seed")) for n in sizes for k, name in enumerate("abc")]))
    drawn = values.select("_v", draws.alias("d")).withColumn("_h", F.md5(F.concat_ws("|", "d.seed", F.col("_v").cast("string"))))
    ranked = ranks_within(drawn.select("_v", "_h", F.col("d.n").alias("_size"), F.col("d.draw").alias("_draw")), ["_size", "_draw"], ["_h", "_v"], "_k")
    return ranked.filter(F.col("_k") <= F.col("_size")).select(F.concat_ws("-", F.col("_size").cast("string"), "_draw").alias("subset"), F.col("_v").alias(value))


def mixed(first: DataFrame, second: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """As many rows of either corpus as the smaller has, by hashed key, with `corpus` (0 or 1) and `place`, their place from 1 in a shuffled order."""
    both = first.withColumn("corpus", F.lit(0)).unionByName(second.withColumn("corpus", F.lit(1)))
    least = both.groupBy("corpus").agg(F.count("*").alias("n")).agg(F.when(F.count("*") == 2, F.min("n")).otherwise(0).alias("_least"))
    ranked = ranks_within(both.withColumn("_h", hashed(seed, F.concat_ws("|", "corpus", F.col(key).cast("string")))), ["corpus"], ["_h", key], "_rank")
    kept = ranked.join(F.broadcast(least)).filter(F.col("_rank") <= F.col("_least")).drop("_rank", "_least", "_h")
    return ranks(kept.withColumn("_h", hashed(seed + 1, F.concat_ws("|", "corpus", F.col(key).cast("string")))), ["_h", "corpus", key], "place").drop("_h")


def drawn_with_replacement(df: DataFrame, key: str, size: int, seed: int = 1) -> DataFrame:
    """(draw, key): `size` draws from all rows, each of them by a hash of its number, so a row can come again."""
    numbered = ranks(df.select(key).withColumn("_h", hashed(seed, F.col(key))), ["_h", key], "_place").select(key, "_place")
    n = numbered.agg(F.count("*").alias("_n"))
    draws = df.sparkSession.range(1, size + 1).withColumnRenamed("id", "draw").join(F.broadcast(n)).filter("_n > 0")
    return draws.withColumn("_place", F.pmod(draw_number(seed, F.col("draw")), F.col("_n")) + 1).join(numbered, "_place").select("draw", key)


def draw_number(seed: int, key: Column) -> Column:
    """A number from 0 to 2^32 - 1 that seed and key fix."""
    return F.conv(F.substring(hashed(seed, key), 1, 8), 16, 10).cast("long")


def quota_sample(df: DataFrame, stratum: str, quotas: dict, key: str, seed: int = 1) -> DataFrame:
    """Of each named stratum its quota by hashed key; strata without one go."""
    quota = F.create_map(*[F.lit(x) for item in quotas.items() for x in item])[F.col(stratum)]
    ranked = ranks_within(df.withColumn("_q", quota).filter("_q IS NOT NULL").withColumn("_h", hashed(seed, F.col(key))), [stratum], ["_h", key], "_n")
    return ranked.filter(F.col("_n") <= F.col("_q")).drop("_q", "_h", "_n")


def stratified(df: DataFrame, stratum: str, size: int, key: str, seed: int = 1) -> DataFrame:
    """max(1, size // strata) rows of each stratum by hashed key; with more strata than size, the first strata in order give one each."""
    names = ranks(df.select(F.col(stratum).alias("_s")).distinct(), ["_s"], "_o")
    names = materialize(names, "strata")
    each = max(1, size // max(1, names.count()))
    ranked = ranks_within(df.withColumn("_h", hashed(seed, F.col(key))), [stratum], ["_h", key], "_n").filter(F.col("_n") <= each)
    j = ranked.join(few(names), F.col(stratum).eqNullSafe(F.col("_s")))
    return j.filter(F.col("_o") <= size).drop("_n", "_h", "_s", "_o")


def length_bins(df: DataFrame, length: Column, size: int, key: str, edges: tuple[int, int] = (5, 9), seed: int = 1) -> DataFrame:
    """`size` rows: a third from each of three bins of length, by hashed key, then the rest in order of the hash."""
    bin_ = F.when(length <= edges[0], 0).when(length <= edges[1], 1).otherwise(2)
    h = hashed(seed, F.col(key))
    r = ranks_within(df.withColumn("_bin", bin_).withColumn("_h", h), ["_bin"], ["_h", key], "_n").filter(F.col("_n") <= size)
    return r.orderBy((F.col("_n") > size // 3).cast("int"), "_h", key).limit(size).drop("_bin", "_h", "_n")


def shuffled_pairs(df: DataFrame, stratum: str, intact: Column, key: str, src: str, tgt: str, seed: int = 1) -> DataFrame:
    """df with targets permuted within each stratum, but for intact rows: row k in order of one hash takes the target of row k in order of another."""
    move = df.filter(~intact)
    left = ranks_within(move.withColumn("_h", hashed(seed, F.col(key))), [stratum], ["_h", key], "_k").drop("_h", tgt)
    right = ranks_within(move.select(stratum, key, tgt).withColumn("_h", hashed(seed + 1, F.col(key))), [stratum], ["_h", key], "_k").select(F.col(stratum).alias("_s"), "_k", tgt)
    mixed = left.join(right, left[stratum].eqNullSafe(right["_s"]) & (left["_k"] == right["_k"])).select(*df.columns)
    return mixed.unionByName(df.filter(intact))


def context_rows(df: DataFrame, pool: DataFrame, key: str, pool_key: str, k: int, seed: int = 1) -> DataFrame:
    """(key, slot, context): min(k, pool) different rows of the pool for each row, by hash. The pool is numbered in hashed order, so that a draw is an equi-join.

    A row's draws start at a hashed place and go on by a hashed step of at most a k-th of the pool, so none comes twice.
    """
    numbered = ranks(pool.select(F.col(pool_key).alias("context")).withColumn("_h", hashed(seed, F.col("context"))), ["_h", "context"], "_place").select("context", "_place")
    n = numbered.agg(F.count("*").alias("_n"))
    rows = df.select(key).join(F.broadcast(n)).filter("_n > 0")
    start, step = F.pmod(draw_number(seed, F.col(key)), F.col("_n")), 1 + F.pmod(draw_number(seed + 1, F.col(key)), F.greatest(F.lit(1), F.floor(F.col("_n") / k)))
    slots = rows.select(key, "_n", start.alias("_start"), step.alias("_step"), F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("_n")).cast("int"))).alias("slot"))
    return slots.withColumn("_place", F.pmod(F.col("_start") + (F.col("slot") - 1) * F.col("_step"), F.col("_n")) + 1).join(numbered, "_place").select(key, "slot", "context")


def diverse(df: DataFrame, key: str, text: str, size: int, clusters: int = 20, features: int = 5000, seed: int = 1) -> DataFrame:
    """`size` rows spread over clusters of TF-IDF vectors: size // clusters of each, by hashed key, then others in order of the hash."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer

    steps = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern="\\s+"), CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=features), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_vector"), KMeans(k=clusters, seed=seed, featuresCol="_vector", predictionCol="cluster")]
    d = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    found = Pipeline(stages=steps).fit(d).transform(d).withColumn("_h", hashed(seed, F.col(key)))
    r = ranks_within(found.select(*df.columns, "cluster", "_h"), ["cluster"], ["_h", key], "_n").filter(F.col("_n") <= size)
    return r.orderBy((F.col("_n") > max(1, size // clusters)).cast("int"), "_h", key).limit(size).select(*df.columns, "cluster")


def covering(df: DataFrame, key: str, words: Column, size: int, candidates: int = 1000, candidate_words: int = 500_000) -> DataFrame:
    """(round, key, gain): `size` rows, each the one with most words that no earlier one has, of equal ones the least key; all rows if there are fewer. Where no row has a new word, rows follow by key with a gain of 0.

    Gains only fall. A pass counts every row's open words and brings the open words of the rows of largest gains, up to `candidates` rows or `candidate_words` words, to the driver, which goes on choosing among them as long as
    the best gain isn't below the last count of a row that it doesn't have. Every pass chooses one row at least, most choose many. Keys must be unique; null keys and rows without words have no gain.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_k"), words.alias("_ws")).filter("_k IS NOT NULL")
    left = materialize(rows.select("_k", F.explode(F.array_distinct("_ws")).alias("_w")), "open_words")
    chosen: list[tuple] = []
    while len(chosen) < size:
        gains = left.groupBy("_k").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "_k").limit(candidates + 1).collect()
        if not gains:
            break
        upto = [k for k, total in enumerate(accumulate(r["gain"] for r in gains)) if total <= candidate_words]
        take = max(1, min(candidates, len(upto)))
        rival = (-gains[take]["gain"], gains[take]["_k"]) if len(gains) > take else None
        held = spark.createDataFrame([(r["_k"],) for r in gains[:take]], left.select("_k").schema)
        sets = {r["_k"]: set(r["ws"]) for r in left.join(F.broadcast(held), "_k").groupBy("_k").agg(F.collect_list("_w").alias("ws")).collect()}
        heap = [(-len(ws), k) for k, ws in sets.items()]
        heapify(heap)
        new, covered = [], set()
        while heap and len(chosen) < size:
            bound, k = heappop(heap)
            gain = len(sets[k] - covered)
            if gain != -bound:
                if gain:
                    heappush(heap, (-gain, k))
                continue
            if rival and (bound, k) > rival:
                break
            chosen.append((len(chosen) + 1, k, gain))
            new.append(k)
            covered |= sets[k]
        if len(chosen) < size:
            done = spark.createDataFrame([(k,) for k in new], left.select("_k").schema)
            seen = materialize(left.join(F.broadcast(done), "_k").select("_w").distinct(), "seen_words")
            left = materialize(left.join(few(seen), "_w", "left_anti"), "open_words")
    out = spark.createDataFrame(chosen, f"round int, {key} {dict(df.dtypes)[key]}, gain bigint")
    if len(chosen) == size:
        return out
    others = rows.join(F.broadcast(out.select(F.col(key).alias("_k"))), "_k", "left_anti").orderBy("_k").limit(size - len(chosen))
    place = F.row_number().over(Window.orderBy("_k")) + len(chosen)  # `size` rows at most
    return out.unionByName(others.select(place.alias("round"), F.col("_k").alias(key), F.lit(0).cast("long").alias("gain")))
