"""Ranked lexical search over a bit-sliced impact index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.batches import map_texts
from quern.scratch import materialize

#: A term is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lowered, all other bytes part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Rows and entries of an index block: a task holds one block.
BLOCK_ROWS, BLOCK_ENTRIES = 16_384, 2_000_000
#: Bytes of the terms and items that go to every task; items beyond are searched in further passes.
PASS_BYTES = 32 << 20
#: Bytes of bitmaps that a task keeps opened.
OPENED = 96 << 20
#: Constants of the score.
K, SCALE, PERCENT = 8, 1_000_000_000, 75


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def counted(docs: DataFrame, places: object) -> DataFrame:
    """docs (id, text) to (id, n, term, tf): its number of terms, and of those in the broadcast dictionary `places` their numbers and how often they occur."""

    def make():
        at = places.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, times, first = [], [], [], [0]
            for t in batch.column("text").to_pylist():
                found = terms(t)
                n.append(len(found))
                some = Counter(map(at.get, found))
                some.pop(None, None)
                ids += some.keys()
                times += some.values()
                first.append(len(ids))
            offsets = pa.array(first, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, times)]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "term", "tf"])

        return work

    kind = docs.schema["id"].dataType.simpleString()
    return map_texts(docs, "text", make, f"id {kind}, n long, term array<int>, tf array<int>")


def slices(impacts: np.ndarray) -> np.ndarray:
    """Bits of the impacts, least significant first: one row of bytes a bit."""
    width = int(impacts.max()).bit_length()
    return np.packbits((impacts >> np.arange(width)[:, None] & 1).astype(np.uint8), axis=1, bitorder="little")


def opened(slots: np.ndarray, packed: np.ndarray, words: int) -> np.ndarray:
    """One bitmap over all rows of the block for each slice, in 64-bit words. slots ascend."""
    bits = np.unpackbits(packed, axis=1, count=len(slots), bitorder="little").astype(np.uint64) << (slots & 63).astype(np.uint64)
    word = slots >> 6
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros((len(packed), words), dtype=np.uint64)
    out[:, word[starts]] = np.bitwise_or.reduceat(bits, starts, axis=1)
    return out


def added(parts: list[tuple[np.ndarray, int]], depth: int) -> np.ndarray:
    """Slices of the sum of all parts, each shifted up by so many slices. Three numbers become two, a sum without carries and the carries, until two are left; those are added slice by slice."""
    words = parts[0][0].shape[1]

    def placed(part: np.ndarray, shift: int) -> np.ndarray:
        out = np.zeros((depth, words), dtype=np.uint64)
        out[shift : shift + len(part)] = part
        return out

    x, y = placed(*parts[0]), np.zeros((depth, words), dtype=np.uint64)
    for part, shift in parts[1:]:
        z = placed(part, shift)
        differ = x ^ y
        carry = (x & y) | (differ & z)
        x = differ ^ z
        y = np.zeros_like(carry)
        y[1:] = carry[:-1]
    carry = np.zeros(words, dtype=np.uint64)
    for s in range(depth):
        a, b = x[s].copy(), y[s]
        x[s] = a ^ b ^ carry
        carry = (a & b) | (carry & (a ^ b))
    return x


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.astype("<u8").view(np.uint8), bitorder="little"))


def highest(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sums) of the k largest sums above 0; of equal ones the lowest slots. From the most significant slice down: rows above the limit are sure, rows equal to it so far stay open."""
    count = lambda bitmap: int(np.bitwise_count(bitmap).sum())
    equal = np.bitwise_or.reduce(total, axis=0)
    sure = np.zeros_like(equal)
    n_sure, n_equal = 0, count(equal)
    if n_equal > k:
        for s in range(len(total) - 1, -1, -1):
            ones = equal & total[s]
            n = count(ones)
            if n_sure + n > k:
                equal, n_equal = ones, n
            else:
                sure, n_sure, equal, n_equal = sure | ones, n_sure + n, equal & ~total[s], n_equal - n
            if n_sure == k or n_sure + n_equal == k:
                break
    slots = np.append(_places(sure), _places(equal)[: k - n_sure])
    bits = total[:, slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)
    return slots, (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


def impact_index(rows: DataFrame, weights: object, n_docs: int, n_terms: int) -> DataFrame:
    """rows (id, n, term, tf) to blocks: a row (block, term, slots, bits) for each term of a block, and one of term -1 with the block's ids, ascending, nulls last.

    bits holds the slices of the term's impacts over its own rows (slots). Impacts of 0 aren't kept.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def block(parts: list[pa.RecordBatch], key: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()
        lists, n = table.column("term").chunk(0), np.asarray(table.column("n"))
        size = np.diff(np.asarray(lists.offsets))
        term, tf = (np.asarray(table.column(c).chunk(0).flatten()).astype(np.int64) for c in ("term", "tf"))
        slot = np.repeat(np.arange(len(n)), size)
        m = np.repeat(100 - PERCENT + (PERCENT * n * n_docs) // max(n_terms, 1), size)
        impact = weights.value[term] * ((SCALE * tf) // (1000 * tf + K * m))
        order = np.lexsort((slot, term))
        order = order[impact[order] > 0]
        term, slot, impact = term[order], slot[order], impact[order]
        cuts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=np.int64)
        ends = np.append(cuts[1:], len(term))
        ids = table.column("id").combine_chunks()
        names = [-1, *term[cuts].tolist()]
        slots = [None, *(slot[a:b].astype("<i4").tobytes() for a, b in zip(cuts, ends))]
        bits = [None, *(slices(impact[a:b]).tobytes() for a, b in zip(cuts, ends))]
        offsets = pa.array([0, *[len(ids)] * len(names)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([key] * len(names), pa.int64()), pa.array(names, pa.int32()), pa.array(slots, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(offsets, ids)], ["block", "term", "slots", "bits", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        kept, n, entries = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                kept.append(part)
                n, entries = n + part.num_rows, entries + len(part.column("term").flatten())
                if n >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
                    yield block(kept, key)
                    kept, n, entries, key = [], 0, 0, key + 1
        if n:
            yield block(kept, key)

    return rows.mapInArrow(run, f"block long, term int, slots binary, bits binary, ids array<{kind}>")


def searched(index: DataFrame, queries: object, k: int) -> DataFrame:
    """index and broadcast queries [(item, [(term, times)])] to (item, id, score): the k best rows of every block for every item, equal scores by id."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def work(table: pa.Table) -> pa.Table:
        names = table.column("term").to_pylist()
        ids = table.column("ids").chunk(0) if table.column("ids").num_chunks == 1 else table.column("ids").combine_chunks()
        ids = ids.slice(names.index(-1), 1).flatten()
        row = {t: r for r, t in enumerate(names) if t >= 0}
        slots, bits, words = table.column("slots"), table.column("bits"), -(-len(ids) // 64)

        @lru_cache(max(8, OPENED // (words * 8 * 36)))
        def bitmaps(term: int) -> np.ndarray:
            at = np.frombuffer(slots[row[term]].as_py(), dtype="<i4").astype(np.int64)
            return opened(at, np.frombuffer(bits[row[term]].as_py(), dtype=np.uint8).reshape(-1, -(-len(at) // 8)), words)

        items, found, scores = [], [], []
        for item, wanted in queries.value:
            here = [(bitmaps(t), times) for t, times in wanted if t in row]
            if here:
                depth = sum(times << len(b) for b, times in here).bit_length()
                at, total = highest(added([(b, s) for b, times in here for s in range(times.bit_length()) if times >> s & 1], depth), k)
                items += [item] * len(at)
                found.append(at)
                scores.append(total)
        found, scores = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found, scores))
        return pa.table({"item": pa.array(items, pa.int64()), "id": ids.take(pa.array(found)), "score": pa.array(scores, pa.int64())})

    return index.groupBy("block").applyInArrow(work, f"item long, id {kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of items: item id, rank (from 1), doc id and score of its k best rows of docs with a score above 0, equal scores by ascending id.

    Whole texts are counted; the index holds the items' terms over all rows. Blocks of the index are searched apart; each gives k rows an item at most, and the best of these are the best of all.
    Items of more than PASS_BYTES of terms are dealt into passes. Null and termless texts are found by nothing and find nothing. Null ids come last among equal scores, repeated ids and repeated items
    are rows of their own, other columns are ignored, and empty tables give an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType.simpleString()

    def split():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [Counter(terms(t)) for t in batch.column("text").to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            words, times = ([x for c in found for x in f(c)] for f in (Counter.keys, Counter.values))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column("item_id"), *lists], ["item_id", "words", "times"])

        return work

    asked = map_texts(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), "text", split, f"item_id {kind}, words array<binary>, times array<long>")
    asked = materialize(asked.filter(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    n_bytes = asked.agg(F.sum(F.expr("aggregate(words, 0L, (s, w) -> s + octet_length(w) + 64)"))).first()[0] or 0
    passes, out = -(-n_bytes // PASS_BYTES), None
    for p in range(passes):
        # at most about PASS_BYTES of terms of this pass's items
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).select("item", "words", "times").collect()
        names = sorted({bytes(w) for r in part for w in r["words"]})
        places = {w: i for i, w in enumerate(names)}
        rows = materialize(counted(texts, spark.sparkContext.broadcast(places)), "counted")
        n_docs, n_terms = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(names), dtype=np.int64)
        for t, df in rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*")).collect():  # of this pass's terms
            weights[t] = weight(n_docs, df)
        index = materialize(impact_index(rows, spark.sparkContext.broadcast(weights), n_docs, n_terms), "index")
        queries = [(r["item"], [(places[bytes(w)], n) for w, n in zip(r["words"], r["times"])]) for r in part]
        found = searched(index, spark.sparkContext.broadcast(queries), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.limit(0).select(F.lit(0).cast("long").alias("item"), "id", F.lit(0).cast("long").alias("score"))
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))).filter(F.col("rank") <= k)
    best = materialize(best, "best")
    return best.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
