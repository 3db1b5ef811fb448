"""N-gram models as tables (n, gram, logprob, backoff): reading, training, scoring, and choosing among candidates. Logarithms are of base 10."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from quern.operators.ordering import few, spread_parts
from quern.scratch import materialize

#: Candidates that a task of a beam search holds before it gives them out.
MOST_CANDIDATES = 20_000
START, END, UNKNOWN = "<s>", "</s>", "<unk>"


def sectioned(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(file, section, value) of text lines: each with the last line of its file before it that matches `header`; null before the first. Header lines stay out.

    A file's parts are read by different tasks, so a line's section may begin in an earlier part: headers, of which a file has few, are gathered with their places, and every line looks up the last before its own.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = materialize(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value"), "lines")
    lines = lines.withColumn("_head", F.trim("value").rlike(header))
    heads = lines.filter("_head").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", F.trim("value").alias("section"))), asc=False).alias("heads"))  # a file's sections
    j = lines.filter("NOT _head").join(few(materialize(heads, "heads")), "file", "left")
    before = F.filter("heads", lambda h: (h["place"]["start"] < F.col("place.start")) | ((h["place"]["start"] == F.col("place.start")) & (h["place"]["at"] < F.col("place.at"))))
    return j.select("file", F.get(before, F.lit(0))["section"].alias("section"), "value")


def read_arpa(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(n, gram, logprob, backoff): the entries of an ARPA file. A section's header tells the order of its grams, so a gram of one word may hold a space. Lines without a number and a gram go.

    With check, an order whose entries aren't as many as the file's head says is an error.
    """
    lines = sectioned(spark, path, "^\\\\(data|end|\\d+-grams:).*$")
    f = lines.select("section", F.split("value", "\t").alias("f"), "value")
    gram = F.regexp_replace(F.trim(F.col("f")[1]), " +", " ")
    number = F.trim(F.col("f")[0])
    entries = f.filter(F.col("section").rlike("^\\\\\\d+-grams:") & (F.size("f") >= 2) & number.rlike("^-?[0-9.]+([eE][-+]?[0-9]+)?$"))
    n = F.regexp_extract("section", "^\\\\(\\d+)-grams:", 1).cast("int")
    entries = materialize(entries.select(n.alias("n"), gram.alias("gram"), number.cast("double").alias("logprob"), F.coalesce(F.expr("try_cast(trim(get(f, 2)) AS double)"), F.lit(0.0)).alias("backoff")), "arpa")
    if check:
        told = f.filter(F.col("section").startswith("\\data")).select(F.regexp_extract("value", "^\\s*ngram\\s+(\\d+)\\s*=\\s*(\\d+)", 1).alias("n"), F.regexp_extract("value", "=\\s*(\\d+)", 1).alias("c")).filter("n <> ''").collect()
        there = dict(map(tuple, entries.groupBy("n").agg(F.count("*")).collect()))
        if wrong := {int(n): (int(c), there.get(int(n), 0)) for n, c in told if int(c) != there.get(int(n), 0)}:
            raise ValueError(f"entries by order, told and found: {wrong}")
    return entries


def bounded(words: Column) -> Column:
    return F.concat(F.array(F.lit(START)), words, F.array(F.lit(END)))


def _ending(words: Column, at: Column, n: int) -> Column:
    return F.array_join(F.slice(words, at - n + 1, F.lit(n)), " ")


def gram_counts(texts: DataFrame, words: Column, order: int) -> DataFrame:
    """(n, gram, c) of all grams of 1 to `order` words with the marks of start and end. Null arrays give none."""
    w = texts.select(bounded(words).alias("w")).filter("w IS NOT NULL")

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(n), F.greatest(F.size("w"), F.lit(n))), lambda i: F.struct(F.lit(n).alias("n"), F.when(i <= F.size("w"), _ending(F.col("w"), i, n)).alias("gram")))

    grams = [of(n) for n in range(1, order + 1)]
    return w.select(F.explode(F.concat(*grams)).alias("g")).select("g.n", "g.gram").filter("gram IS NOT NULL").groupBy("n", "gram").agg(F.count("*").alias("c"))


def add_one(counts: DataFrame) -> DataFrame:
    """Add-one estimates from gram_counts, four digits, backoff 0: (c + 1) / (tokens + V) for words, (c + 1) / (context + V) for longer grams; V counts distinct words with both marks."""
    totals = counts.filter("n = 1").agg(F.sum("c").alias("tokens"), F.count("*").alias("v"))
    parent = counts.select((F.col("n") + 1).alias("n"), F.col("gram").alias("context"), F.col("c").alias("context_c"))
    held = counts.withColumn("context", F.when(F.col("n") > 1, F.regexp_replace("gram", " [^ ]*$", ""))).join(parent, ["n", "context"], "left")
    below = F.when(F.col("n") == 1, F.col("tokens")).otherwise(F.col("context_c")) + F.col("v")
    return held.join(F.broadcast(totals), how="cross").select("n", "gram", F.round(F.log10((F.col("c") + 1) / below), 4).alias("logprob"), F.lit(0.0).alias("backoff"))  # totals: one row


def backoff_scores(texts: DataFrame, key: str, words: Column, model: DataFrame, order: int) -> DataFrame:
    """(key, score): the sum over words and the end of the longest known gram's probability and the backoffs passed on the way to it; an unknown word takes <unk>'s, or -99. Texts without words get -99.

    Grams and contexts meet the model in two equi-joins, whatever the order; `key` must be unique.
    """
    at = texts.select(key, bounded(F.coalesce(words, F.array().cast("array<string>"))).alias("w")).filter(F.size("w") > 2)
    at = at.select(key, "w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("at"))
    long = at.select(key, "at", F.explode(F.array(*[F.when(F.col("at") >= n, F.struct(F.lit(n).alias("n"), _ending(F.col("w"), F.col("at"), n).alias("gram"))) for n in range(1, order + 1)])).alias("g"))
    long = long.filter("g IS NOT NULL").select(key, "at", "g.n", "g.gram", F.when(F.col("g.n") > 1, F.regexp_replace("g.gram", " [^ ]*$", "")).alias("context"))
    found = long.join(model.select("n", "gram", "logprob"), ["n", "gram"], "left")
    context = model.select((F.col("n") + 1).alias("n"), F.col("gram").alias("context"), "backoff")
    found = found.join(context, ["n", "context"], "left")
    hit = F.when(F.col("logprob").isNotNull(), F.struct("n", "logprob"))
    word = found.groupBy(key, "at").agg(F.max(hit).alias("hit"), F.collect_list(F.when(F.col("n") > 1, F.struct("n", F.coalesce("backoff", F.lit(0.0)).alias("b")))).alias("steps"))  # `order` steps at most
    used = F.coalesce(F.col("hit.n"), F.lit(1))
    passed = F.aggregate(F.filter("steps", lambda s: s["n"] > used), F.lit(0.0), lambda a, s: a + s["b"])
    unknown = model.filter((F.col("n") == 1) & (F.col("gram") == UNKNOWN)).agg(F.coalesce(F.max("logprob"), F.lit(-99.0)).alias("unknown"))
    scored = word.join(F.broadcast(unknown), how="cross").groupBy(key).agg(F.sum(F.coalesce("hit.logprob", "unknown") + passed).alias("score"))
    return texts.select(key).join(scored, key, "left").select(key, F.round(F.coalesce("score", F.lit(-99.0)), 6).alias("score"))


def rescore(candidates: DataFrame, key: str, alphas: list[float], betas: list[float]) -> DataFrame:
    """Of candidates (key, text, acoustic, lm), for each point of the grid the best text of each key by acoustic + alpha * lm + beta * words; of equal ones the first in order. Returns (alpha, beta, key, text)."""
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a in alphas for b in betas])
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != ""))
    # a key's candidates are brought together before they are multiplied, in tasks of about as many rows whatever the table's size
    parts = spread_parts(candidates, len(alphas) * len(betas))
    c = candidates.repartition(parts, key).withColumn("g", F.explode(grid)).withColumn("total", F.col("acoustic") + F.col("g.alpha") * F.col("lm") + F.col("g.beta") * words)
    best = c.groupBy("g.alpha", "g.beta", key).agg(F.min_by("text", F.struct((-F.col("total")).alias("t"), F.col("text"))).alias("text"))
    return best.select("alpha", "beta", key, "text")


def best_point(rescored: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """One row (alpha, beta, cer): the point of the grid of least character error rate against refs (key, ref); of equal ones the least alpha, then beta."""
    j = rescored.join(refs, key).groupBy("alpha", "beta").agg((100 * F.sum(F.levenshtein("ref", "text")) / F.greatest(F.sum(F.length("ref")), F.lit(1))).alias("cer"))
    least = F.min_by(F.struct("alpha", "beta", F.round("cer", 4).alias("cer")), F.struct("cer", "alpha", "beta")).alias("p")
    return j.agg(least).select("p.*")


def ctc_collapse(ids: Column, blank: int = 0) -> Column:
    """Frame labels with runs made one and blanks left out."""
    kept = F.filter(ids, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(ids, i - 1)))
    return F.filter(kept, lambda x: x != blank)


def greedy_labels(frames: Column, blank: int = 0) -> Column:
    """The collapsed labels of an array of frames of scores: the best label of each frame, the first of equal ones."""
    return ctc_collapse(F.transform(frames, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int")), blank)


class CharacterModel:
    """A model's entries (gram -> probability, backoff) of one character or label a word; the sum of backed-off probabilities along a sequence."""

    def __init__(self, entries: dict[tuple[str, ...], tuple[float, float]]):
        self.entries, self.order = entries, max(map(len, entries), default=1)
        self.unknown = entries.get((UNKNOWN,), (-99.0, 0.0))[0]

    def next(self, before: tuple[str, ...], label: str) -> float:
        """Probability of `label` behind `before`: that of the longest known gram, and the backoffs of the contexts passed."""
        context, passed = ((START,) + before)[-(self.order - 1) :] if self.order > 1 else (), 0.0
        while True:
            if context + (label,) in self.entries:
                return passed + self.entries[context + (label,)][0]
            if not context:
                return passed + self.unknown
            passed += self.entries.get(context, (0.0, 0.0))[1]
            context = context[1:]


def prefix_beam(scores: np.ndarray, width: int, blank: int = 0, bonus: Callable[[tuple[int, ...]], float] | None = None) -> list[tuple[tuple[int, ...], float]]:
    """(labels, natural logarithm of their probability) of up to `width` label sequences, the best first.

    A sequence's probability is the sum over all paths that collapse to it. Paths that end in a blank and paths that end in the last label are summed apart, as a repeated label grows a sequence behind a blank only.
    bonus(labels) is added where sequences are compared, not to their probability; equal ones go by their labels.
    """
    none = -math.inf
    logs = scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)
    extra = cache(bonus) if bonus else lambda labels: 0.0
    beam: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, none)}
    for frame in logs.tolist():
        grown: dict[tuple[int, ...], list[float]] = {}
        for labels, (behind_blank, behind_label) in beam.items():
            whole = _log_sum(behind_blank, behind_label)
            stay = grown.setdefault(labels, [none, none])
            stay[0] = _log_sum(stay[0], whole + frame[blank])
            last = labels[-1] if labels else None
            if labels:
                stay[1] = _log_sum(stay[1], behind_label + frame[last])
            for label, log in enumerate(frame):
                mass = behind_blank if label == last else whole
                if label != blank and mass > none:
                    longer = grown.setdefault((*labels, label), [none, none])
                    longer[1] = _log_sum(longer[1], mass + log)
        best = sorted(grown, key=lambda x: (-_log_sum(*grown[x]) - extra(x), x))[:width]
        beam = {labels: tuple(grown[labels]) for labels in best}
    return [(labels, _log_sum(*masses)) for labels, masses in beam.items()]


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a >= b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def beam_candidates(df: DataFrame, key: str, frames: str, names: list[str], width: int = 8, model: DataFrame | None = None, alpha: float = 0.5, beta: float = 0.0, blank: int = 0, most_entries: int = 2_000_000, best: int | None = None) -> DataFrame:
    """(key, rank, text, acoustic, fused): up to `width` label sequences of each row's frames (an array of arrays of scores, one for each name), the best first. text joins the labels' names by spaces.

    With a model (n, gram, logprob, backoff) whose words are names, sequences compete by acoustic + ln(10) * alpha * model + beta * labels; the end is scored last. The model goes to every task, so one of more than
    `most_entries` entries is refused: take candidates without it and use backoff_scores and rescore, which join. Rows of null or no frames have no candidate. With `best`, only so many of a row's candidates are returned.
    Tasks give out about MOST_CANDIDATES candidates at a time, however many rows a batch has.
    """
    entries = None
    if model is not None:
        n = model.count()
        if n > most_entries:
            raise ValueError(f"a model of {n} entries is too large for every task; rescore candidates instead")
        entries = df.sparkSession.sparkContext.broadcast({tuple(r["gram"].split(" ")): (r["logprob"], r["backoff"]) for r in model.select("gram", "logprob", "backoff").toLocalIterator()})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = CharacterModel(entries.value) if entries is not None else None

        @cache
        def gained(labels: tuple[int, ...]) -> float:
            if not labels:
                return 0.0
            said = tuple(names[x] for x in labels)
            return gained(labels[:-1]) + math.log(10) * alpha * lm.next(said[:-1], said[-1]) + beta

        def one(row) -> list[tuple[str, float, float]]:
            if not row:
                return []
            found = prefix_beam(np.stack([np.asarray(f, dtype=float) for f in row]), width, blank, gained if lm else None)
            if lm:
                end = lambda labels: math.log(10) * alpha * lm.next(tuple(names[x] for x in labels), END)
                found = sorted(((labels, a, a + gained(labels) + end(labels)) for labels, a in found), key=lambda r: (-r[2], r[0]))
            else:
                found = [(labels, a, a) for labels, a in found]
            gained.cache_clear()
            return [(" ".join(names[x] for x in labels), a, f) for labels, a, f in found[:best]]

        def given(keys: pa.Array, at: list[int], rows: list[list[tuple[str, float, float]]]) -> pa.RecordBatch:
            times = [len(r) for r in rows]
            text, acoustic, fused = zip(*chain.from_iterable(rows))
            columns = [keys.take(pa.array(np.repeat(at, times))), pa.array([k for n in times for k in range(1, n + 1)], pa.int32()), pa.array(text, pa.string()), pa.array(acoustic, pa.float64()), pa.array(fused, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, [key, "rank", "text", "acoustic", "fused"])

        for batch in batches:
            keys, values, at, rows, held = batch.column(0), batch.column(1), [], [], 0
            for i in range(batch.num_rows):
                if found := one(values[i].as_py()):
                    at.append(i)
                    rows.append(found)
                    held += len(found)
                if held >= MOST_CANDIDATES:
                    yield given(keys, at, rows)
                    at, rows, held = [], [], 0
            if rows:
                yield given(keys, at, rows)

    t = df.select(F.col(key), F.col(frames).alias("_frames"))
    return t.mapInArrow(candidates, StructType([t.schema[0], *[StructField(n, k) for n, k in (("rank", IntegerType()), ("text", StringType()), ("acoustic", DoubleType()), ("fused", DoubleType()))]]))


def repeated_runs(words: Column, least: int = 3) -> Column:
    """struct(word, start, length) of the first run of `least` or more equal words, from 0; null if there is none."""
    empty = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).alias("at"), F.lit(False).alias("done"))

    def step(s: Column, w: Column) -> Column:
        same = w.eqNullSafe(s["word"]) & (s["at"] > 0)
        grown = F.struct(s["word"].alias("word"), s["start"].alias("start"), (s["length"] + 1).alias("length"), (s["at"] + 1).alias("at"), F.lit(False).alias("done"))
        fresh = F.struct(w.alias("word"), s["at"].alias("start"), F.lit(1).alias("length"), (s["at"] + 1).alias("at"), F.lit(False).alias("done"))
        ended = F.struct(s["word"].alias("word"), s["start"].alias("start"), s["length"].alias("length"), s["at"].alias("at"), F.lit(True).alias("done"))
        return F.when(s["done"] | (~same & (s["length"] >= least)), ended).when(same, grown).otherwise(fresh)

    return F.aggregate(words, empty, step, lambda s: F.when(s["length"] >= least, F.struct(s["word"].alias("word"), s["start"].alias("start"), s["length"].alias("length"))))


def vocabulary(texts: DataFrame, text: str, specials: tuple[str, ...] = ("<pad>", "<unk>")) -> DataFrame:
    """(id, ch): special entries first, then all characters by code point. The rank runs over the characters of Unicode at most."""
    from pyspark.sql import Window

    chars = texts.select(F.explode(F.split(text, "")).alias("ch")).filter("ch <> ''").distinct()
    ids = chars.select((F.row_number().over(Window.orderBy("ch")) - 1 + len(specials)).cast("long").alias("id"), "ch")
    head = [F.struct(F.lit(k).cast("long").alias("id"), F.lit(s).alias("ch")) for k, s in enumerate(specials)]
    return reduce(DataFrame.unionByName, [texts.sparkSession.range(1).select(F.inline(F.array(*head))), ids])
