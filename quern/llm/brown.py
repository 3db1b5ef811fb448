"""Class-based n-gram scores: Brown classes by exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import by_bytes, map_texts
from quern.scratch import materialize

#: Classes; words with a class of their own choice, the most frequent; words whose counts travel to the tasks. Rarer words share one class, and their counts are joined.
CLASSES, CLUSTERED, CARRIED = 64, 16_384, 100_000
#: Batches of moves that are tried, at most, and the share of the likelihood that a batch has to gain for another to be tried.
ROUNDS, LEAST_GAIN = 8, 5e-4
#: Tasks that look for better classes: few words each, whatever AQE would make of so small a table.
MOVE_TASKS = 64
#: Words whose gains are computed together, with 8 * (CLASSES + 1) squared bytes each at most.
WORDS_AT_ONCE = 64
#: Weight of the class unigram in a transition, in observations.
PRIOR = 5.0
#: Distinct words or word pairs that a task gathers before it sends them on.
GATHERED = 200_000
#: The end of a text as a word; no word is empty.
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Runs without white space, A-Z lowered, and the end."""
    return [*text.encode().lower().split(), END] if text else [END]


def word_counts(rows: DataFrame) -> DataFrame:
    """rows (text) to (word, c). Tasks gather counts, so a word that stands everywhere is a row for each task and not for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def send() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "c"])
            count.clear()
            return batch

        for batch in batches:
            for part in by_bytes(batch, "text"):
                for text in part.column("text").to_pylist():
                    count.update(words_of(text))
                if len(count) > GATHERED:
                    yield send()
        if count:
            yield send()

    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _ids(texts: list[str | None], number: dict[bytes, int], other: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Ids of all words of the texts in a row, the id of the word before each (the end's at a text's start), and the words."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((number.get(w, other) for w in chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(sizes) - sizes] = number.get(END, other)
    return flat, before, words


def bigram_counts(rows: DataFrame, clustered: list[bytes]) -> DataFrame:
    """rows (text) to (pair, n): pair is first * (words + 1) + second, over the places of `clustered`; all other words are the last number."""
    base = len(clustered) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(clustered)}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            for part in by_bytes(batch, "text"):
                flat, before, _ = _ids(part.column("text").to_pylist(), number, base - 1)
                own, n = np.unique(before * base + flat, return_counts=True)
                both, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
                keys = both
                if len(keys) > GATHERED:
                    yield send()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield send()

    return rows.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def neighbours(bigrams: DataFrame, classes: np.ndarray, k: int) -> DataFrame:
    """(word, slot, n): how often `word` stands before a class (slot 0 to k) or after one (slot k + 1 on). Tasks add up their own rows first."""
    base, width = len(classes), 2 * (k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(base * width, dtype=np.int64)
        for batch in batches:
            pair, n = np.asarray(batch.column("pair")), np.asarray(batch.column("n"))
            first, second = pair // base, pair % base
            np.add.at(total, first * width + classes[second], n)
            np.add.at(total, second * width + k + 1 + classes[first], n)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((part // width).astype(np.int32)), pa.array((part % width).astype(np.int32)), pa.array(total[part])], ["word", "slot", "n"])

    return bigrams.mapInArrow(run, "word int, slot int, n long").groupBy("word", "slot").agg(F.sum("n").alias("n"))


def class_table(near: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class pairs, (k + 1) squared, from neighbours(): the driver sees so many numbers and no more."""
    spark = near.sparkSession
    own = spark.createDataFrame(list(enumerate(classes.tolist())), "word int, class int")
    table = np.zeros((k + 1, k + 1), dtype=np.int64)
    for r in near.filter(F.col("slot") <= k).join(F.broadcast(own), "word").groupBy("class", "slot").agg(F.sum("n").alias("n")).collect():  # CLUSTERED + 1 rows
        table[r["class"], r["slot"]] = r["n"]
    return table


def _f(x: np.ndarray) -> np.ndarray:
    """x log x of counts, which are whole; 0 for what is below 1."""
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the class transitions, up to what classes don't change."""
    t = table.astype(float)
    return float(_f(t).sum() - _f(t.sum(axis=1)).sum() - _f(t.sum(axis=0)).sum())


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gain in likelihood() from moving each word (a row), with `right` after it and `left` before it by class, alone from its class `own` to each class; the work grows with the classes it stands beside. (A word beside itself counts as beside its class.)"""
    t = table.astype(float)
    r, c, logs = right.astype(float), left.astype(float), _f(t)
    word = np.arange(len(own))
    out = np.zeros(r.shape)
    for counts, log, add in ((t.T, logs.T, r), (t, logs, c)):
        at, beside = np.nonzero((add > 0) & (np.arange(len(t)) != own[:, None]))  # only these counts change; the block of the two classes is below
        n, mine = add[at, beside], own[at]
        change = _f(counts[beside] + n[:, None]) - log[beside] + (_f(counts[beside, mine] - n) - log[beside, mine])[:, None]
        change[np.arange(len(at)), beside] = 0.0
        if len(at):
            rows, starts = np.unique(at, return_index=True)
            out[rows] += np.add.reduceat(change, starts, axis=0)
        sums, total = counts.sum(axis=0), add.sum(axis=1)
        out -= _f(sums + total[:, None]) - _f(sums) + (_f(sums[own] - total) - _f(sums[own]))[:, None]
    r_own, c_own = r[word, own], c[word, own]
    out += (_f(t[own, own] - r_own - c_own) - logs[own, own])[:, None] + _f(np.diag(t) + r + c) - np.diag(logs)
    out += _f(t[own] - r + c_own[:, None]) - logs[own] + _f(t.T[own] - c + r_own[:, None]) - logs.T[own]
    out[word, own] = 0.0
    return out


def best_moves(near: DataFrame, table: np.ndarray, classes: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """(gain, word, class) of the words that another class would suit better, each as if it moved alone; the largest gain first. At most CLUSTERED rows reach the driver."""
    vectors = near.filter(F.col("word") < len(classes) - 1).repartition(MOVE_TASKS, "word").groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("near"))  # 2 (k + 1) numbers a word at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(at, WORDS_AT_ONCE)
                word, lists = np.asarray(part.column("word")), part.column("near")
                beside, of = lists.flatten(), np.repeat(np.arange(len(word)), np.asarray(lists.value_lengths()))
                v = np.zeros((len(word), 2 * (k + 1)))
                v[of, np.asarray(beside.field("slot"))] = np.asarray(beside.field("n"))
                g = gains(table, v[:, : k + 1], v[:, k + 1 :], classes[word])
                g[:, k] = 0.0  # the class of rare words takes none
                best = g.max(axis=1)
                better = best > 1e-6
                yield pa.RecordBatch.from_arrays([pa.array(word[better]), pa.array(g.argmax(axis=1)[better].astype(np.int32)), pa.array(best[better])], ["word", "to", "gain"])

    return sorted(((r["gain"], r["word"], r["to"]) for r in vectors.mapInArrow(run, "word int, to int, gain double").collect()), key=lambda m: (-m[0], m[1]))


def exchange(bigrams: DataFrame, n_words: int, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each clustered word (and, last, of all others: k) and the counts of class pairs.

    Words start by rank in turn. A batch is the moves with the largest gains; gains don't add up, so the likelihood is computed anew and a batch that lowers it
    is taken back and tried again with half as many moves. The likelihood never falls. It ends after `rounds` batches, with the first that gains little, or when no move is left.
    """
    k = max(1, min(k, n_words))
    classes = np.r_[np.arange(n_words) % k, k].astype(np.int64)
    near = materialize(neighbours(bigrams, classes, k), "neighbours")
    table = class_table(near, classes, k)
    value, share = likelihood(table), 0.5
    moves = best_moves(near, table, classes, k) if rounds else []
    for turn in range(rounds):
        if not moves:
            break
        batch = moves[: max(1, int(len(moves) * share))]
        tried = classes.copy()
        tried[[w for _, w, _ in batch]] = [to for _, _, to in batch]
        near = materialize(neighbours(bigrams, tried, k), "neighbours")
        new = class_table(near, tried, k)
        gain = likelihood(new) - value
        if gain <= 0:
            if len(batch) == 1:
                break
            share /= 2
            continue
        classes, table, value = tried, new, value + gain
        if turn + 1 == rounds or gain < LEAST_GAIN * abs(value):
            break
        moves = best_moves(near, table, classes, k)
    return classes, table


def transitions(table: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log10 P(class | class before): counts smoothed by the class unigram, which gives every class something. Rows sum to 1."""
    t = table.astype(float)
    unigram = (t.sum(axis=0) + 1) / (t.sum() + len(t))
    return np.log10((t + prior * unigram) / (t.sum(axis=1, keepdims=True) + prior))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, c) of at most `most` words and the end, the end first and then by falling count. All words of a count, or of a narrow range of counts, are in or out together."""
    step = F.floor(F.log2("c") * 64).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # 64 rows for each doubling of a count
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    wanted = counts.filter((F.col("word") == F.lit(END)) | (step >= least if least is not None else F.lit(False))).toArrow()
    rows = list(zip(wanted.column("word").to_pylist(), wanted.column("c").to_pylist()))
    return sorted(rows, key=lambda x: (x[0] != END, -x[1], x[0]))


@dataclass(frozen=True)
class Model:
    """What the driver holds: words with their counts (the clustered ones first), the class of each of the clustered, counts of class pairs, all tokens and distinct words of the training rows."""

    head: list[tuple[bytes, int]]
    of: np.ndarray
    table: np.ndarray
    total: int
    kinds: int

    @property
    def rare_all(self) -> float:
        """By which a word beyond the clustered ones has (c + 1) of their class."""
        clustered = len(self.of) - 1
        return float(self.total - sum(c for _, c in self.head[:clustered]) + (self.kinds - clustered) + 1)


def fit(training: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, carried: int = CARRIED) -> tuple[Model, DataFrame]:
    """The model of training (text), and the counts (word, c) of all its words as a written table."""
    counts = materialize(word_counts(training), "words")
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    head = most_frequent(counts, carried)
    names = [w for w, _ in head[:clustered]]
    of, table = exchange(materialize(bigram_counts(training, names), "bigrams"), len(names), classes) if names else (np.zeros(1, np.int64), np.zeros((1, 1), np.int64))
    return Model(head, of, table, int(whole["n"] or 0), int(whole["v"])), counts


def class_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, clustered: int = CLUSTERED, carried: int = CARRIED) -> DataFrame:
    """Per row: id, held_out, n_tokens (words and the end), n_known, train_tokens, base_score, score (both log10 probabilities of the text).

    All rows that aren't held out train. P(word | before) is P(class | class before) P(word | class). Emissions of a clustered word are its share of its class;
    rare words share a class, where a word has (c + 1) / (count of the class + its words + 1) and any unknown word c = 0, so the probabilities sum to 1.
    Counts of the `carried` most frequent words go to the tasks, those of all rarer words are joined: none is left out.
    Null text is empty: its only token is the end. Null and repeated ids and repeated rows each give a row; null held_out is false.
    Without training rows both scores are 0: all tokens are unknown. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model, counts = fit(rows.filter("NOT held_out"), classes, clustered, carried)
    head, of, total, kinds, rare_all = model.head, model.of, model.total, model.kinds, model.rare_all
    names = [w for w, _ in head[: len(of) - 1]]
    c_head = np.array([c for _, c in head] or [0], dtype=np.int64)
    step, rare = transitions(model.table), len(model.table) - 1
    in_class = np.bincount(of[:-1], weights=c_head[: len(names)], minlength=rare + 1)
    class_of = np.full(len(head) + 1, rare, dtype=np.int64)
    class_of[: len(names)] = of[:-1]
    emission = np.zeros(len(head) + 1)
    emission[: len(names)] = np.log10(c_head[: len(names)] / in_class[of[:-1]]) if names else 0.0
    emission[len(names) : len(head)] = np.log10((c_head[len(names) :] + 1) / rare_all) if head else 0.0
    base_all = total + kinds + 1
    base = np.zeros(len(head) + 1)
    if head:
        base[: len(head)] = np.log10((c_head + 1) / base_all)
    carried_words = [w for w, _ in head]

    def make():
        number = {w: k for k, w in enumerate(carried_words)}
        other = len(carried_words)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, before, words = _ids(batch.column("text").to_pylist(), number, other)
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            doc = np.repeat(np.arange(len(words)), sizes)
            add = lambda x: np.bincount(doc, weights=x, minlength=len(words))
            known = add(flat < other).astype(np.int64)
            logs = add(step[class_of[before], class_of[flat]] + emission[flat])
            bases = add(base[flat])
            ends, rare_words, rare_times = np.cumsum(sizes), [], []
            for k, own in enumerate(words):
                few = Counter(own[j] for j in np.flatnonzero(flat[ends[k] - sizes[k] : ends[k]] == other).tolist()) if known[k] < sizes[k] else {}
                rare_words.append(list(few))
                rare_times.append(list(few.values()))
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(sizes), pa.array(known), pa.array(bases), pa.array(logs), pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_times, pa.list_(pa.int64()))],
                ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
            )

        return work

    kind = rows.schema["id"].dataType.simpleString()
    scored = map_texts(rows, "text", make, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, times array<long>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # written, so that a row's number stays
    found = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    log = lambda top, bottom: F.col("times") * F.log10(top / F.lit(float(bottom)))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(log(c + 1, base_all)).alias("b"), F.sum(log(c + 1, rare_all)).alias("s"))
    out = scored.drop("rare", "times").join(sums, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
