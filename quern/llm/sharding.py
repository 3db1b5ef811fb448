"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix. DataFrame operations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import materialize

SHARDS = 40
#: Rows of a block, about, and the most blocks, whose counts the driver holds; beyond 5 * 10^9 rows blocks grow (a million narrow rows each at 5 * 10^10).
BLOCK_ROWS, MOST_BLOCKS, LEAST_BLOCKS = 100_000, 50_000, 256
#: numpy draws below this population; beyond, hypergeometric() does.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` rows drawn without replacement from good + bad are good, for populations of any size.

    Beyond numpy's limit the distribution is laid out around its mode from the exact ratios of neighbouring probabilities,
    as far as 40 standard deviations, outside of which nothing is left in a double.
    """
    if not take or not good:
        return 0
    if not bad:
        return take
    if max(good, bad) < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, take))
    low, high = max(0, take - bad), min(take, good)
    share = good / (good + bad)
    mode = min(high, max(low, int((take + 1) * (good + 1) / (good + bad + 2))))
    reach = int(40 * (take * share * (1 - share)) ** 0.5) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1)
    at = k[:-1].astype(float)  # log of p(k + 1) / p(k)
    steps = np.log(good - at) + np.log(take - at) - np.log(at + 1) - np.log((bad - take) + at + 1)
    logs = np.r_[0.0, np.cumsum(steps)]
    upto = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, np.searchsorted(upto, rng.random() * upto[-1], side="right"))])


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each shard: the counts of a uniform random permutation, without permuting.

    The first block's row is multivariate hypergeometric over the shards' places, the next over the places left, and so on.
    Sums over a row give the block, over a column the shard.
    """
    rng, left = np.random.default_rng(seed), np.array(shards, dtype=np.int64)
    out = np.zeros((len(blocks), len(shards)), dtype=np.int64)
    for k, n in enumerate(blocks):
        for s in range(len(shards)):
            rest = int(left[s + 1 :].sum())
            take = int(n - out[k, :s].sum())
            out[k, s] = hypergeometric(rng, int(left[s]), rest, take)
        left -= out[k]
    return out


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, law `rows`, shard, slot, grown_shard (null).

    Law `rows`: shard sizes differ by one at most. Blocks are hashes of the row, so a lost task deals the same rows again.
    1. count the blocks; 2. draw the matrix of counts; 3. permute each block locally (a seeded hash orders it) and cut it by its row of the matrix;
    4. exchange; 5. permute each shard again, which numbers its slots from 0 without gaps: hashed parts of the shard are numbered apart and shifted by the parts before.
    Only narrow rows move. The driver sees one count a block, at most MOST_BLOCKS. Equal rows are interchangeable and take places of their own;
    null ids and texts are dealt like others. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    key = [F.col(c) for c in (id_col, "size", "text_crc32")]
    total = docs.count()
    n_blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-total // block_rows)))
    rows = materialize(rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n_blocks)).cast("int")), "blocks")  # texts are read once
    counts = {r["_block"]: r["count"] for r in rows.groupBy("_block").count().collect()}
    blocks = sorted(counts)
    matrix = communication_matrix([counts[b] for b in blocks], [total // shards + (s < total % shards) for s in range(shards)], seed)
    upto = np.cumsum(matrix, axis=1)
    # block -> array of upper bounds; its shard is the number of bounds at or below a row's place in the block
    bounds = spark.createDataFrame(list(zip(blocks, upto.tolist())), "_block int, _upto array<long>")
    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)
    sent = (
        rows.withColumn("_place", F.row_number().over(local) - 1)
        .join(F.broadcast(bounds), "_block")  # at most MOST_BLOCKS rows of `shards` numbers
        .withColumn("shard", F.size(F.filter("_upto", lambda x: x <= F.col("_place"))))
    )
    parts = max(8, -(-total // shards // block_rows))
    # the place in the block is unique there, so the second order is total even for equal rows
    second = F.xxhash64(F.lit(seed + 2), "_block", "_place")
    sent = sent.withColumn("_mix", second).withColumn("_part", F.pmod(F.shiftrightunsigned("_mix", 20), F.lit(parts)).cast("int"))
    part_sizes = sent.groupBy("shard", "_part").count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = part_sizes.select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("shard", "_part").orderBy("_mix", "_block", "_place")
    return (
        sent.withColumn("_own", F.row_number().over(inside) - 1)
        .join(shift, ["shard", "_part"])
        .select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_own") + F.col("_shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
