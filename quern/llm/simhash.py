"""SimHash near-duplicates: fingerprints in Gray order under a hierarchy of masked bit patterns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import map_texts
from quern.llm.components import components, few
from quern.scratch import materialize

#: Fingerprints link at so many differing bits or fewer.
DIFFERING = 3
BITS, SEED = 64, 42
#: Shingles whose bits are counted at a time.
SLICE = 1 << 16
#: A pattern with more fingerprints below it is split by the bits that it leaves open, down to LEVELS patterns in a row; then at most 15 bits are open.
HOT, LEVELS = 16_384, 5
#: Fingerprints of a leaf, nodes of a node, and pairs that are compared at a time.
LEAF, FAN, PAIRS = 16, 8, 1 << 20
#: Rows of one fingerprint from which its label is spread by a broadcast.
COPIES = 10_000


def _hashes(text: str | None, k: int) -> Iterator[int]:
    words = text.encode().lower().split() if text else []
    line, n = b" ".join(words), min(k, len(words))
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return (xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (x - 1 for x in starts[n:]))) if words else iter(())


def fingerprint(text: str | None, k: int = 3) -> int:
    """Each bit is 1 if it is set in over half the hashes of the shingles of k words, repeats included. Fewer words are one shingle; without words it is 0."""
    counts, n, hashes = np.zeros(BITS, dtype=np.int64), 0, _hashes(text, k)
    while len(part := np.fromiter(islice(hashes, SLICE), dtype="<u8")):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def open_bits(fixed: int) -> list[int]:
    return [b for b in range(BITS) if not fixed >> b & 1]


def masks_below(fixed: int) -> list[int]:
    """DIFFERING + 1 masks, each of `fixed` and of its share of the other bits: two fingerprints that link and agree on `fixed` agree on one of them."""
    free = open_bits(fixed)
    return [fixed | sum(1 << b for b in free[s :: DIFFERING + 1]) for s in range(DIFFERING + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def gray_rank(c: str) -> Column:
    """Place of a word of bits in the reflected Gray sequence, as a long that sorts so."""
    x = F.col(c)
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(_signed(1 << 63)))


class Hierarchy:
    """Nodes over fingerprints that stand in Gray order below patterns; first: where each pattern's fingerprints begin.

    A leaf holds up to LEAF neighbours, a node up to FAN nodes. Every node has the bits that all below it share. Differences in bits that two nodes share only grow downwards,
    so a pair of nodes with more than DIFFERING of them is dropped with all that is below.
    """

    def __init__(self, x: np.ndarray, first: np.ndarray):
        self.x, self.levels = x, []
        ends = np.append(first[1:], len(x))
        low = high = x
        fan = LEAF
        while True:
            n = -(-(ends - first) // fan)
            at = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(at, n)
            starts = np.repeat(first, n) + fan * inner
            stops = np.minimum(starts + fan, np.repeat(ends, n))
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((starts, stops, low, ~(low ^ high)))
            first, ends, fan = at, at + n, FAN
            if n.max(initial=0) <= 1:
                break

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs one level down, of which none can be ruled out yet; level -1 are the fingerprints."""
        starts, stops, _, _ = self.levels[level + 1]
        nb = stops[b] - starts[b]
        many = (stops[a] - starts[a]) * nb
        pair = np.repeat(np.arange(len(a)), many)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        i, j = starts[a][pair] + at // nb[pair], starts[b][pair] + at % nb[pair]
        keep = i < j if level < 0 else i <= j
        i, j = i[keep], j[keep]
        if level < 0:
            differ = np.bitwise_count(self.x[i] ^ self.x[j])
        else:
            _, _, value, mask = self.levels[level]
            differ = np.bitwise_count((value[i] ^ value[j]) & mask[i] & mask[j])
        near = differ <= DIFFERING
        return i[near], j[near]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of all fingerprints below one pattern that link, a part at a time."""
        roots = np.arange(len(self.levels[-1][0]))
        most = (LEAF if len(self.levels) == 1 else FAN) ** 2
        step = max(1, PAIRS // most)
        todo = [(len(self.levels) - 1, roots[k : k + step], roots[k : k + step]) for k in range(0, len(roots), step)]
        while todo:
            level, a, b = todo.pop()
            i, j = self._below(level - 1, a, b)
            if level == 0:
                yield i, j
                continue
            step = PAIRS // (LEAF if level == 1 else FAN) ** 2
            todo += [(level - 1, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (the least place of each place's group so far) after the links (i, j)."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def pattern_links(members: DataFrame) -> DataFrame:
    """members (fixed, pattern, fp), no pattern in two partitions, sorted by pattern and Gray rank within each, to edges (u, v) that connect what links connect: one less than a group's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3

        def done(key: np.ndarray, pattern: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((key[1:] != key[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            x, label = x.view(np.uint64), np.arange(len(x))
            for i, j in Hierarchy(x, np.append(0, new)).links():
                label = joined(label, i, j)
            some = np.flatnonzero(label != np.arange(len(x)))
            return pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)), pa.array(x[label[some]].view(np.int64))], ["u", "v"])

        for batch in batches:
            kept = [np.concatenate([a, np.asarray(batch.column(c))]) for a, c in zip(kept, ("fixed", "pattern", "fp"))]
            key, pattern, _ = kept
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            if len(cuts):
                yield done(*(a[: cuts[-1]] for a in kept))
                kept = [a[cuts[-1] :] for a in kept]
        if len(kept[0]):
            yield done(*kept)

    return members.mapInArrow(run, "u long, v long")


def near_links(prints: DataFrame) -> DataFrame:
    """prints (fp), distinct, to edges (u, v) that connect all fingerprints that links connect.

    The upper nodes are patterns under masks: of four masks of 16 bits, fingerprints that link agree under one. What more than HOT fingerprints share is split by four masks of the open bits, and so on,
    so no task holds more than a bounded node; each fingerprint stands below four patterns a level.
    """
    now, fixed, edges = prints.select(F.lit(0).cast("long").alias("fixed"), "fp"), [0], None
    for level in range(LEVELS):
        below = {f: masks_below(f) for f in fixed}
        masks = F.element_at(F.create_map(*(x for f, ms in below.items() for x in (F.lit(_signed(f)), F.array(*(F.lit(_signed(m)) for m in ms))))), F.col("fixed"))
        now = now.select("fp", F.explode(masks).alias("fixed")).select("fixed", F.col("fixed").bitwiseAND(F.col("fp")).alias("pattern"), "fp")
        sizes = now.groupBy("fixed", "pattern").agg(F.count("*").alias("n")).filter("n > 1")
        hot = materialize(sizes.filter(F.col("n") > HOT).select("fixed", "pattern"), "hot_patterns") if level < LEVELS - 1 else None
        light = now.join(few(hot), ["fixed", "pattern"], "left_anti") if hot is not None and not hot.isEmpty() else now
        found = pattern_links(light.repartition("fixed", "pattern").sortWithinPartitions("fixed", "pattern", gray_rank("fp")))
        found = materialize(found, "links")
        edges = found if edges is None else edges.unionByName(found)
        if hot is None or hot.isEmpty():
            break
        now, fixed = materialize(now.join(few(hot), ["fixed", "pattern"]).select("fixed", "fp"), "split"), [m for ms in below.values() for m in ms]
    return edges


def near_duplicates(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hexadecimal digits), component_id (least id that links reach, itself included).

    Equal fingerprints are one node, so copies are never paired. Links are exact: none is lost. Null and blank texts have the fingerprint zero and link like any other.
    Rows of null id take part; a component's id ignores null unless all are. Repeated ids are rows of their own. Other columns are ignored. An empty table gives an empty table.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], ["id", "fp"])

        return work

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = materialize(map_texts(texts, "text", make, f"id {kind}, fp long"), "prints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("times")), "nodes")
    roots = materialize(components(near_links(nodes.select("fp"))), "roots")
    linked = nodes.join(few(roots), nodes["fp"] == roots["node"]).select("fp", "root", "rep", "times")
    least = materialize(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    copied = nodes.filter("times > 1").join(few(roots), nodes["fp"] == roots["node"], "left_anti").select("fp", "times", F.col("rep").alias("component_id"))
    labels = materialize(linked.join(few(least), "root").select("fp", "times", "component_id").unionByName(copied), "labels")
    # a fingerprint of many rows is spread by a broadcast; one that stands once and links with nothing needs no label
    hot = few(materialize(labels.filter(F.col("times") >= COPIES).select("fp", "component_id", F.lit(True).alias("labelled")), "hot_labels"))
    rest = few(materialize(labels.filter(F.col("times") < COPIES).select("fp", "component_id", F.lit(True).alias("labelled")), "other_labels"))
    out = rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(rest, "fp", "left"), allowMissingColumns=True)
    own = F.when(F.col("labelled"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id"))
