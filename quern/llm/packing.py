"""Best-fit packing by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.batches import map_texts
from quern.llm.vocabularies import MEMO_CHUNKS, vocabulary_path, word_bpe_ids, word_chunks
from quern.scratch import materialize

CAPACITY, END_ID = 4096, 1
#: Bytes of text that are chunks at a time: a chunk is an object of some 60 bytes.
SLICE_BYTES = 1 << 19
#: Pieces of one length that a task ranks at most, about.
RANKED_TOGETHER = 100_000
#: Ranks that share a key of the join with the plan: a piece meets the plan's rows of its own ranks and no others.
RANKS_TOGETHER = 64


def tokenized_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, memo_chunks: int = MEMO_CHUNKS) -> DataFrame:
    """Pieces of at most `capacity` tokens of each row: id, piece, start, length, ids_crc32, with keep_ids also ids (little-endian unsigned 32-bit bytes).

    A document is its tokens and then END_ID, so null and empty texts are one piece of one token.
    Only longer documents are cut, into pieces of `capacity`; the last may be shorter.
    Repeated rows give their pieces again. Other columns of docs are ignored. With fewer memo_chunks a process holds less and encodes more chunks again; the rows are the same.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    end, step = END_ID.to_bytes(4, "little"), 4 * capacity

    def make():
        memo = word_bpe_ids(path, memo_chunks)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            chunks = [word_chunks(t) if t else [] for t in batch.column("text").to_pylist()]
            get = memo.of(set(chain.from_iterable(chunks))).__getitem__
            row, at, crc, size, raw = [], [], [], [], []
            for k, c in enumerate(chunks):
                ids = b"".join(map(get, c)) + end
                for a in range(0, len(ids), step):
                    part = ids[a : a + step]
                    row.append(k)
                    at.append(a // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        raw.append(part)
            arrays = [batch.column("id").take(pa.array(row, pa.int32())), pa.array([a // capacity for a in at], pa.int32()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(raw, pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names)

        return work

    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = cols.schema["id"].dataType.simpleString()
    out = map_texts(cols, "text", make, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids, SLICE_BYTES)
    return out.withColumnRenamed("id", id_col)


def fullest(gap: int, counts: dict[int, int], order: list[int]) -> dict[int, int]:
    """Lengths and copies whose sum is as near to gap as any choice from counts comes, found by subset sums in the bits of an integer.

    order: lengths with a count over 0, longest first. Stops at the first exact sum.
    """
    mask, reach, steps = (1 << (gap + 1)) - 1, 1, []
    for length in order:
        if length > gap:
            continue
        left, part = min(counts[length], gap // length), 1
        while left > 0:
            n = min(part, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left -= n
            part *= 2
        if reach >> gap & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + n
            at -= length * n
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[int, dict[int, int]]]:
    """(bins, {length: copies in each}) until nothing is left.

    Each combination starts with the longest length left and takes the fullest rest; it is used for as many bins as the counts allow at once,
    so the work follows the distinct lengths (at most `capacity`) and not the number of pieces.
    """
    counts = {length: n for length, n in histogram.items() if n > 0}
    order = sorted(counts, reverse=True)
    while order:
        longest = order[0]
        counts[longest] -= 1
        bin_ = fullest(capacity - longest, counts, order)
        counts[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in bin_.items())
        yield times, bin_
        for length, n in bin_.items():
            counts[length] -= n * times
        order = [length for length in order if counts[length]]


def ranked(df: DataFrame, group: str, order: list[str], per_task: int = RANKED_TOGETHER) -> DataFrame:
    """df with a gapless `rank` from 0 within group, though one group may hold most rows: hashed parts are ranked apart and shifted by the parts before."""
    parts = max(1, -(-df.count() // per_task))
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut.groupBy(group, "_part").count().select(group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(group, "_part").orderBy(*order)
    return cut.withColumn("_own", F.row_number().over(own) - 1).join(shift, [group, "_part"]).withColumn("rank", F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset: as few sequences of `capacity` tokens as minimum bin slack finds, gapless from 0.

    pieces (id, piece, start, length, ids_crc32 and any others but `ids`) should be a written table: it is read for the histogram and again for the places.
    The driver sees the histogram, of at most `capacity` rows. Pieces of equal length are told apart by rank alone,
    in the order of id, piece and checksum; repeated rows are interchangeable. Empty input gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    used, rows, first = dict.fromkeys(histogram, 0), [], 0
    for bins, combination in minimum_bin_slack(histogram, capacity):
        offset = 0
        for length in sorted(combination, reverse=True):
            copies = combination[length]
            rows.append((length, used[length], used[length] + bins * copies, copies, first, offset))
            used[length] += bins * copies
            offset += length * copies
        first += bins
    names = ["length", "from_rank", "to_rank", "copies", "first_sequence", "first_offset"]
    plan = spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)}))  # from Python rows it would start processes of its own on the executors
    ids = [id_col, "piece", "ids_crc32"]
    bucket = lambda x: F.floor(x / RANKS_TOGETHER).cast("long")
    plan = plan.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("from_rank")), bucket(F.col("to_rank") - 1))))
    small = len(rows) + sum(histogram.values()) // RANKS_TOGETHER <= 50 * capacity  # rows of the plan, of 56 bytes
    nth = F.col("rank") - F.col("from_rank")
    return (
        ranked(pieces, "length", ids)
        .withColumn("_bucket", bucket(F.col("rank")))
        .join(F.broadcast(plan) if small else plan, ["length", "_bucket"])
        .filter((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(nth / F.col("copies")).cast("long"))
        .withColumn("offset", F.col("first_offset") + (nth % F.col("copies")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", memo_chunks: int = MEMO_CHUNKS) -> DataFrame:
    """Tokenise, write the pieces' lengths to the shared folder, and pack. See tokenized_pieces and pack."""
    return pack(materialize(tokenized_pieces(docs, path, capacity, id_col, text_col, memo_chunks=memo_chunks), "pieces"), capacity, id_col)
