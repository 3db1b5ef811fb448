"""Hard negatives by bit-sliced integer products: bit-planes of the rows, the most significant first, until a score's interval can't qualify."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import materialize

#: Rows and anchors of a block; each pair of blocks is one group.
ROW_BLOCK, ANCHOR_BLOCK = 16_384, 512
#: Blocks of rows for each core, where there are fewer by size.
BLOCKS_A_CORE = 4


def planes(ints: np.ndarray, width: int) -> np.ndarray:
    """(rows, components) in two's complement of `width` bits to (width, rows, words): one bit of every component in 64-bit words, zeros after the last."""
    n, d = ints.shape
    words = max(1, -(-d // 64))
    out = np.zeros((width, n, words * 8), dtype=np.uint8)
    for k in range(width):
        part = np.packbits((ints >> k & 1).astype(np.uint8), axis=1, bitorder="little")
        out[k, :, : part.shape[1]] = part
    return out.view("<u8")


class Products:
    """Inner products of one anchor with rows, plane by plane. acc holds what the planes so far give; the planes to come add between rest * low and rest * high."""

    def __init__(self, rows: np.ndarray, anchor: np.ndarray):
        self.rows, self.anchor, self.width = rows, anchor, len(rows)
        values = [(-1 if k == self.width - 1 else 1) << k for k in range(self.width)]
        ones = [int(np.bitwise_count(anchor[k]).sum()) for k in range(self.width)]
        # sums of the anchor's negative and positive components
        sign = anchor[-1]
        below = [int(np.bitwise_count(anchor[k] & sign).sum()) for k in range(self.width)]
        self.low = sum(v * n for v, n in zip(values, below))
        self.high = sum(v * n for v, n in zip(values, ones)) - self.low
        self.values = values

    def plane(self, k: int, at: np.ndarray) -> np.ndarray:
        bits = self.rows[k][at]
        total = np.zeros(len(at), dtype=np.int64)
        for value, mine in zip(self.values, self.anchor):
            if mine.any():
                total += value * np.bitwise_count(bits & mine).sum(axis=1, dtype=np.int64)
        return total

    def scores(self, at: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of those of the rows `at` that keep(least, most) holds at every plane."""
        acc = np.zeros(len(at), dtype=np.int64)
        for k in range(self.width - 1, -1, -1):
            if not len(at):
                break
            acc = acc + self.values[k] * self.plane(k, at)
            rest = (1 << k) - 1
            held = keep(acc + rest * self.low, acc + rest * self.high)
            at, acc = at[held], acc[held]
        return at, acc


def may_be_among(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Rows whose most isn't below the k-th largest least."""
    return lambda least, most: most >= np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else np.ones(len(least), dtype=bool)


def may_be_within(bands: list[tuple[int, int]], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Rows that may lie in some band (from, to) and there among the k highest."""

    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(least), dtype=bool)
        for a, b in bands:
            sure = least[(least >= a) & (most <= b)]
            limit = max(a, int(np.partition(sure, len(sure) - k)[len(sure) - k])) if len(sure) >= k else a
            out |= (most >= limit) & (least <= b)
        return out

    return keep


def highest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def packed(rows: DataFrame, width: int) -> DataFrame:
    """rows (row, id, label, ints) to (row, id, label, planes): bytes of (width, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ints")
            first = np.asarray(lists.offsets)
            size, flat = np.diff(first), np.asarray(lists.flatten())
            ints = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
            ints[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(first[:-1] - first[0], size)] = flat
            cut = planes(ints, width).transpose(1, 0, 2)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "id", "label")] + [pa.array([x.tobytes() for x in cut], pa.binary())], ["row", "id", "label", "planes"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id long, label {kind}, planes binary")


def _stacked(column: pa.ChunkedArray, width: int, words: int) -> np.ndarray:
    """Planes of many rows, (width, rows, words). A vector with fewer components than another is followed by zeros."""
    out = np.zeros((len(column), width, words), dtype="<u8")
    for i, x in enumerate(column.to_pylist()):
        mine = np.frombuffer(x, dtype="<u8").reshape(width, -1)
        out[i, :, : mine.shape[1]] = mine
    return np.ascontiguousarray(out.transpose(1, 0, 2))


def _by_blocks(rows: DataFrame, anchors: DataFrame, work: Callable, schema: str, parts: tuple[int, int]) -> DataFrame:
    """work(anchors, rows) on every pair of blocks of anchors and rows. A row is sent once to each block of anchors."""
    n_rows, n_anchors = parts
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = anchors.select("*", block(n_anchors).alias("_a"), spread(n_rows).alias("_r"))
    right = rows.select("*", block(n_rows).alias("_r"), spread(n_anchors).alias("_a"))
    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r")).applyInArrow(work, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor and each of its positives (the highest-scoring other rows of its label), the highest-scoring rows of other labels whose score is between `band` percent of the positive's.

    A component x counts as floor(scale * x), a score is the integer inner product with the anchor; equal scores go by id. Rows with a null id, label or vector, or with a null or non-finite component take no part.
    Vectors of unequal length are followed by zeros; an empty vector scores 0. Repeated ids are rows of their own, but an anchor's other rows are those of other ids. A positive below 0 has an empty band.
    Scores must fit 64 bits, or an error is raised. Other columns are ignored; an empty table gives an empty table.

    Every block keeps an anchor's best rows only, so that what is exchanged is the packed rows, once a block of anchors, and a few rows for each anchor and block.
    """
    spark = vectors.sparkSession
    x = lambda c: c.cast("double")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), is_anchor.alias("anchor"))
    good = good.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(x(c)) == float("inf"))))
    ints = materialize(good.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * x(c))).alias("ints")), "ints")
    n, n_anchors, low, high, size = ints.agg(F.count("*"), F.count_if("anchor"), F.min(F.array_min("ints")), F.max(F.array_max("ints")), F.max(F.size("ints"))).first()
    width = 1 + max(int(high or 0).bit_length(), int(-(low or 0) - 1).bit_length() if low and low < 0 else 0)
    if 2 * (width - 1) + int(size or 0).bit_length() > 62:
        raise ValueError("scores of these vectors don't fit 64 bits")
    words = max(1, math.ceil((size or 0) / 64))
    rows = materialize(packed(ints.select("row", "id", "label", "ints"), width), "planes")
    anchors = rows.join(ints.filter("anchor").select("row"), "row", "left_semi").select("row", "id", "label", "planes")
    anchors = materialize(anchors, "anchors")
    parts = max(-(-n // ROW_BLOCK), BLOCKS_A_CORE * spark.sparkContext.defaultParallelism), max(1, -(-n_anchors // ANCHOR_BLOCK))

    def each(mine: pa.Table, theirs: pa.Table) -> Iterator[tuple[int, int, Products, np.ndarray, np.ndarray]]:
        if mine.num_rows and theirs.num_rows:
            cut = _stacked(theirs.column("planes"), width, words)
            ids, labels = np.asarray(theirs.column("id")), np.asarray(theirs.column("label"))
            own = _stacked(mine.column("planes"), width, words).transpose(1, 0, 2)
            for i, (row, name, label) in enumerate(zip(*(mine.column(c).to_pylist() for c in ("row", "id", "label")))):
                yield i, row, Products(cut, own[i]), ids, np.flatnonzero((labels == label) & (ids != name)), np.flatnonzero(labels != label)

    def best_positives(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for _, row, products, ids, same, _ in each(mine, theirs):
            at, scores = products.scores(same, may_be_among(n_positives))
            top = highest(ids[at], scores, n_positives)
            out += zip([row] * len(top), ids[at[top]].tolist(), scores[top].tolist())
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("row", "positive_id", "positive_score"))})

    found = _by_blocks(rows, anchors, best_positives, "row long, positive_id long, positive_score long", parts)
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    positives = materialize(found.withColumn("p", nth).filter(F.col("p") <= n_positives), "positives")
    per_anchor = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).alias("positives"))
    armed = materialize(anchors.join(per_anchor, "row").select("row", "id", "label", "planes", F.col("positives.p").alias("p"), F.col("positives.positive_score").alias("scores")), "armed")

    def best_negatives(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        wanted = list(zip(mine.column("p").to_pylist(), mine.column("scores").to_pylist()))
        for i, row, products, ids, _, other in each(mine, theirs):
            bands = [(p, -(-band[0] * s // 100), band[1] * s // 100) for p, s in zip(*wanted[i])]
            bands = [(p, a, b) for p, a, b in bands if a <= b]
            if bands:
                at, scores = products.scores(other, may_be_within([(a, b) for _, a, b in bands], n_negatives))
                for p, a, b in bands:
                    inside = np.flatnonzero((scores >= a) & (scores <= b))
                    top = inside[highest(ids[at[inside]], scores[inside], n_negatives)]
                    out += zip([row] * len(top), [p] * len(top), ids[at[top]].tolist(), scores[top].tolist())
        return pa.table({c: pa.array([r[k] for r in out], pa.int64() if c != "p" else pa.int32()) for k, c in enumerate(("row", "p", "negative_id", "negative_score"))})

    negatives = _by_blocks(rows, armed, best_negatives, "row long, p int, negative_id long, negative_score long", parts)
    nth = F.row_number().over(Window.partitionBy("row", "p").orderBy(F.desc("negative_score"), "negative_id"))
    best = negatives.withColumn("rank", nth).filter(F.col("rank") <= n_negatives)
    best = best.join(positives, ["row", "p"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
