"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from itertools import chain, product

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.batches import held, map_texts

#: The training sample: documents of each label, and the longest text (bytes) taken into it.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 20_000
#: Bytes of each dictionary, compression level. The toxic one takes the most frequent windows of toxic texts as far as they fit, ordinary or not; the ordinary one has every window of the sample, its bound only guards a worker's memory.
TOXIC_DICTIONARY, ORDINARY_DICTIONARY, LEVEL = 1 << 17, 1 << 23, 16
#: Ids of a label that are ranked for the sample, in parts of it.
RANKED = 4
#: Calibration tries these gains, and these bytes beyond what a whole match takes.
GAINS, SLACKS = (2, 3, 4, 5, 6, 8, 10), (0, 1, 2, 3, 4, 6, 40)
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
#: Each byte stands as eight of a fixed code: a reference costs less than a letter, so a window's length counts the pieces in which a dictionary has it.
CODE = np.random.default_rng(5).integers(0, 256, (256, 8), dtype=np.uint8)


def word_windows(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def coded(word: str) -> bytes:
    return CODE[np.frombuffer(f" {word} ".encode(), dtype=np.uint8)].tobytes()


def train_dictionary(words: list[str], size: int) -> bytes:
    """A raw dictionary of at most `size` bytes: distinct coded windows, the most frequent last, where references are cheapest."""
    parts, total = [], 0
    for word in words:
        part = coded(word)
        if total + len(part) > size:
            break
        parts.append(part)
        total += len(part)
    return b"".join(reversed(parts))


@dataclass(frozen=True)
class Model:
    """Dictionaries, the gain from which and the length with the toxic dictionary up to which a window counts, and the weights of the document score."""

    toxic: bytes
    ordinary: bytes
    gain: int
    length: int
    weights: tuple[float, ...]


@cache
def _compressors(model: Model) -> tuple:
    def one(content: bytes):
        if len(content) < 8:
            return lambda data: len(data) + 9
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=params)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        return lambda data: len(c.compress(data))

    return one(model.toxic), one(model.ordinary)


class Gains(dict):
    """Of a window: bytes that the ordinary dictionary needs beyond the toxic one, and bytes with the toxic one."""

    def __init__(self, model: Model, most: int = 500_000):
        self.toxic, self.ordinary = _compressors(model)
        self.most = most

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > self.most:
            self.clear()
        data = coded(word)
        toxic = self.toxic(data)
        value = self[word] = (self.ordinary(data) - toxic, toxic)
        return value


def _gains(model: Model) -> Gains:
    return held(model, lambda: Gains(model))


def window_lengths(gains: Gains, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each text; of all windows, the gain and the length with the toxic dictionary, and the text."""
    words = [word_windows(t) if t else [] for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.array([gains[w] for w in chain.from_iterable(words)], dtype=np.int64).reshape(-1, 2)
    return n, flat, np.repeat(np.arange(len(texts)), n)


def features(n: np.ndarray, flat: np.ndarray, doc: np.ndarray, gain: int, length: int) -> np.ndarray:
    """Per text: windows that count (log), their share (per hundred, log), the largest gain of one."""
    hit = (flat[:, 0] >= gain) & (flat[:, 1] <= length)
    hits = np.bincount(doc[hit], minlength=len(n))
    top = np.zeros(len(n))
    np.maximum.at(top, doc[hit], flat[hit, 0])
    return np.stack([np.log1p(hits), np.log1p(100 * hits / np.maximum(n, 1)), np.minimum(top, 4.0 * gain) / gain], axis=1)


def _logistic(weights: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights[:-1]) + weights[-1], -30, 30)))


def _contexts(texts: list[str]) -> Counter:
    """Of each word, how many different pairs of neighbours it has: copies of a text add nothing."""
    seen = set()
    for text in texts:
        w = ["", *word_windows(text), ""]
        seen.update(zip(w, w[1:], w[2:]))
    return Counter(w for _, w, _ in seen)


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from the windows of both kinds of text, then the gain and the score calibrated on the same sample; of equally good gains and lengths the first tried holds."""
    n_toxic, n_ordinary = max(1, len(toxic)), max(1, len(ordinary))
    frequent = [[w for w, _ in sorted(_contexts(texts).items(), key=lambda x: (-x[1], x[0]))] for texts in (toxic, ordinary)]
    model = Model(train_dictionary(frequent[0], TOXIC_DICTIONARY), train_dictionary(frequent[1], ORDINARY_DICTIONARY), 1, 0, (0.0, 0.0, 0.0, 0.0))
    if not toxic or not ordinary:
        return Model(b"", b"", 1, 0, (0.0, 0.0, 0.0, -5.0 if not toxic else 5.0))
    gains, y = Gains(model, 10**7), np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    lengths = window_lengths(gains, [*toxic, *ordinary])
    whole = min((gains[w][1] for w in frequent[0]), default=0)  # a window that the toxic dictionary has in one piece
    best: tuple = ()
    for gain, slack in product(GAINS, SLACKS):
        x = features(*lengths, gain, whole + slack)
        weights = _fit(x, y)
        p = np.clip(_logistic(weights, x), 1e-6, 1 - 1e-6)
        wrong = float(-(y * np.log(p) / n_toxic + (1 - y) * np.log(1 - p) / n_ordinary).sum())
        if not best or wrong < best[0] - 1e-9:
            best = (wrong, gain, slack, weights, p)
    _, gain, slack, weights, p = best
    # calibrated threshold: shift the score so that THRESHOLD is where errors on the sample are fewest
    cuts = np.unique(np.r_[p, 0.5])
    middles = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    errors = [float(((p >= c) != (y == 1)).sum()) for c in middles]
    near = np.flatnonzero(np.array(errors) == min(errors))
    cut = float(middles[near[len(near) // 2]])
    shift = math.log(THRESHOLD / (1 - THRESHOLD)) - math.log(cut / (1 - cut))
    return Model(model.toxic, model.ordinary, gain, whole + slack, (*weights[:-1], weights[-1] + shift))


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps with a small ridge."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.diag([0.1] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge @ w
        d = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge, g)
        w -= d * min(1.0, 5 / (np.abs(d).max() + 1e-9))
    return tuple(float(v) for v in w)


def training_sample(rows: DataFrame, labels: DataFrame, id_col: str, most: int = SAMPLE_DOCS, longest: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """Texts of label 1 and of label 0 for the driver: the first `most` of each by a hash of the id; texts of over `longest` bytes train nothing.

    A label's ids are first cut at a hash below which about RANKED times `most` lie, so no task ranks all ids of a label.
    """
    marked = labels.filter("toxic IN (0, 1)").select(F.col(id_col).alias("id"), "toxic").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = rows.select("id").join(marked, "id").distinct().withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    share = F.least(F.lit(1.0), F.lit(float(RANKED * most)) / F.count("*")).alias("share")
    near = known.join(F.broadcast(known.groupBy("toxic").agg(share)), "toxic").filter(F.col("place") <= F.col("share") * float(1 << 40))
    order = F.row_number().over(Window.partitionBy("toxic").orderBy("place", "id"))
    ids = near.withColumn("n", order).filter(F.col("n") <= most).select("id", "toxic")
    got = rows.filter((F.octet_length("text") > 0) & (F.octet_length("text") <= longest)).join(F.broadcast(ids), "id").select("id", "text", "toxic").collect()
    got.sort(key=lambda r: (r["id"], r["text"]))
    return [r["text"] for r in got if r["toxic"] == 1], [r["text"] for r in got if r["toxic"] == 0]


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted (1 where score >= THRESHOLD).

    labels (id, toxic 0/1) may have a share of the ids; rows of null id, with a null or other label and held-out rows train nothing; of contradicting labels 1 holds.
    held_out is a condition on docs' columns (null: false). Null and empty texts have no window and get the score of none. Without labels of both kinds the score is constant.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(*training_sample(rows.filter("NOT held_out").select("id", "text"), labels, id_col))

    def make():
        gains = _gains(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = _logistic(model.weights, features(*window_lengths(gains, batch.column("text").to_pylist()), model.gain, model.length))
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score, pa.float64())], ["id", "held_out", "score"])

        return work

    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, "text", make, f"id {kind}, held_out boolean, score double").select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
