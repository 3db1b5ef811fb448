"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.batches import map_texts

#: Units of each direction, bytes that a window labels, bytes on either side over which state runs in, and windows that step together.
HIDDEN, WINDOW, CONTEXT, TOGETHER = 8, 128, 32, 2048
#: The training sample: whole documents of each language and their bytes, and documents of all languages together (one of each language at least).
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_ALL = 96, 300_000, 20_000
EPOCHS, MINIBATCH, RATE = 4, 128, 0.02
UNDETERMINED = "und"


@dataclass
class Network:
    """tables: input weights and biases of the three gates by byte; byte 256 pads. recurrent: of update, reset and candidate. out: from both directions."""

    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]


def windows(texts: list[bytes], size: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `size` bytes of the texts with `context` bytes before and after, 256 where the text has none, and the text of each row. Every byte is in the middle of one row."""
    counts = np.array([-(-len(t) // size) for t in texts], dtype=np.int64)
    flat, starts, at = np.full(int((counts * size).sum()) + (len(texts) + 1) * context, 256, dtype=np.int16), [], context
    for t, n in zip(texts, counts):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        starts.append(at + size * np.arange(n))
        at += int(n) * size + context
    first = np.concatenate(starts) - context if starts else np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(np.r_[flat, np.full(size + context, 256, np.int16)], size + 2 * context)[first], np.repeat(np.arange(len(texts)), counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _run(table: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each column of x (time, row, unit); with keep also what backpropagation needs."""
    h_size, (steps, n) = len(u), x.shape
    h = np.zeros((n, h_size), dtype=np.float32)
    states, kept = np.empty((steps, n, h_size), dtype=np.float32), []
    for t in range(steps):
        a = table[x[t]]
        b = h @ u
        zr = _sigmoid(a[:, : 2 * h_size] + b[:, : 2 * h_size])
        z, r, c_in = zr[:, :h_size], zr[:, h_size:], b[:, 2 * h_size :]
        c = np.tanh(a[:, 2 * h_size :] + r * c_in)
        if keep:
            kept.append((h, z, r, c, c_in))
        h = c + z * (h - c)
        states[t] = h
    return states, kept


def _states(table: np.ndarray, u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As _run, without what training needs: (time, unit, row), units apart so that every step works on contiguous rows."""
    k, n = len(u), x.shape[1]
    scale = np.r_[np.full(2 * k, 0.5), np.ones(k)].astype(np.float32)  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
    by_unit, ut = np.ascontiguousarray((table * scale).T), np.ascontiguousarray((u * scale).T)
    h, out = np.zeros((k, n), dtype=np.float32), np.empty((len(x), k, n), dtype=np.float32)
    a, b = np.empty((3 * k, n), dtype=np.float32), np.empty((3 * k, n), dtype=np.float32)
    half = np.float32(0.5)
    for t in range(len(x)):
        np.take(by_unit, x[t], axis=1, out=a, mode="clip")
        np.matmul(ut, h, out=b)
        gates, c = a[: 2 * k], a[2 * k :]
        gates += b[: 2 * k]
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        b[2 * k :] *= a[k : 2 * k]
        c += b[2 * k :]
        np.tanh(c, out=c)
        h -= c
        h *= a[:k]
        h += c
        out[t] = h
    return out


def position_probabilities(net: Network, rows: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """(time, label, row): the label distribution at every byte in the middle of the rows. Each direction has run in over the context before it."""
    x = np.ascontiguousarray(rows.T).astype(np.int64)
    k, end = net.recurrent[0].shape[0], len(x) - context
    logits = np.matmul(net.out[:k].T, _states(net.tables[0], net.recurrent[0], x[:end])[context:])
    logits += np.matmul(net.out[k:].T, _states(net.tables[1], net.recurrent[1], x[context:][::-1])[context:])[::-1]
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _back(table: np.ndarray, u: np.ndarray, x: np.ndarray, states: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of u, backwards through time."""
    h_size = len(u)
    d_u, dh, by_byte = np.zeros_like(u), np.zeros_like(d_states[0]), np.empty((*x.shape, table.shape[1]), dtype=np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c, c_in = kept[t]
        dh = dh + d_states[t]
        dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
        dr = dc * c_in * r * (1 - r)
        d_a = np.concatenate([dz, dr, dc], axis=1)
        d_b = np.concatenate([dz, dr, dc * r], axis=1)
        by_byte[t] = d_a
        d_u += h.T @ d_b
        dh = dh * z + d_b @ u.T
    d_table, order = np.zeros_like(table), np.argsort(x, axis=None, kind="stable")
    flat = x.ravel()[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    d_table[flat[starts]] = np.add.reduceat(by_byte.reshape(-1, table.shape[1])[order], starts, axis=0)
    return d_table, d_u


def train(texts: list[bytes], labels: list[str], seed: int = 3, hidden: int = HIDDEN, epochs: int = EPOCHS, size: int = WINDOW, context: int = CONTEXT) -> Network:
    """Fit by backpropagation through time: cross entropy of each byte's label, Adam steps."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    f32 = lambda x: x.astype(np.float32)
    net = Network(names, [f32(rng.normal(0, 0.3, (257, 3 * hidden))) for _ in range(2)], [f32(rng.normal(0, 0.3, (hidden, 3 * hidden))) for _ in range(2)], f32(rng.normal(0, 0.3, (2 * hidden, len(names)))), np.zeros(len(names), np.float32))
    rows, doc = windows(texts, size, context)
    goal = np.array([names.index(x) for x in labels], dtype=np.int64)[doc] if len(labels) else np.zeros(0, np.int64)
    first, second, step = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()], 0
    total = epochs * max(1, -(-len(rows) // MINIBATCH))
    for _ in range(epochs if len(names) > 1 else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), MINIBATCH):
            pick = order[at : at + MINIBATCH]
            x = np.ascontiguousarray(rows[pick].T)
            ahead, behind, middle = x[: size + context], x[context:][::-1], x[context : size + context]
            forward, kept_f = _run(net.tables[0], net.recurrent[0], ahead, True)
            backward, kept_b = _run(net.tables[1], net.recurrent[1], behind, True)
            both = np.concatenate([forward[context:], backward[context:][::-1]], axis=2)
            logits = both @ net.out + net.bias
            p = np.exp(logits - logits.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            real = (middle < 256)[..., None]
            d = p
            d[:, np.arange(len(pick)), goal[pick]] -= 1
            d *= real / np.float32(max(1, real.sum()))
            d_both = d @ net.out.T
            run_in = np.zeros((context, len(pick), hidden), np.float32)  # no label there, but state to learn from
            t0, u0 = _back(net.tables[0], net.recurrent[0], ahead, forward, kept_f, np.concatenate([run_in, d_both[..., :hidden]]))
            t1, u1 = _back(net.tables[1], net.recurrent[1], behind, backward, kept_b, np.concatenate([run_in, d_both[::-1][..., hidden:]]))
            grads = [t0, t1, u0, u1, both.reshape(-1, 2 * hidden).T @ d.reshape(-1, len(names)), d.sum(axis=(0, 1))]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for a, g, m, v in zip(net.arrays(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(text, label): the mean over all bytes of each text; zeros for empty texts."""
    rows, doc = windows(texts)
    out = np.zeros((len(texts), len(net.labels)))
    for at in range(0, len(rows), TOGETHER):
        part = rows[at : at + TOGETHER]
        p = position_probabilities(net, part)
        p *= (part[:, CONTEXT : CONTEXT + WINDOW].T < 256)[:, None, :]
        sums = p.sum(axis=0)
        for k in range(len(net.labels)):
            out[:, k] += np.bincount(doc[at : at + TOGETHER], weights=sums[k], minlength=len(texts))
    size = np.array([max(1, len(t)) for t in texts])
    return out / size[:, None]


def training_sample(rows: DataFrame, per_label: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, together: int = SAMPLE_ALL) -> tuple[list[bytes], list[str]]:
    """rows (id, text, lang) to whole texts and their labels for the driver: of each language the first documents by a hash of the id, as many as per_label and most_bytes allow, one at least.

    With many languages each has fewer documents, `together` in all, but none is left out.
    """
    known = rows.filter("lang IS NOT NULL AND id IS NOT NULL AND text <> ''")
    languages = known.select("lang").distinct().count()
    most = max(1, min(per_label, together // max(1, languages)))
    by = Window.partitionBy("lang").orderBy("h", "id")
    first = known.select("lang", "id", F.xxhash64("id").alias("h"), F.octet_length("text").alias("size")).withColumn("n", F.row_number().over(by)).filter(F.col("n") <= most)
    ids = first.withColumn("upto", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("n") == 1) | (F.col("upto") <= most_bytes)).select("id").distinct()  # `together` ids at most, and one a language
    got = known.join(F.broadcast(ids), "id", "left_semi").select("text", "lang").collect()
    pairs = sorted((r["lang"], r["text"].encode()) for r in got)  # the same network whatever the order of rows
    return [t for _, t in pairs], [lang for lang, _ in pairs]


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (the pooled probability of lang_pred).

    held_out: a condition on docs' columns; rows where it isn't true may train. Every byte of every text is labelled and pooled; state has run in over CONTEXT bytes
    before a window's first byte in either direction and isn't carried farther, so long texts cost memory in proportion to a slice only. Of equal probabilities the first language by name wins.
    Null texts and texts without a letter, and all texts where no language can be learned, get `und` and 0. With one language learned it is always that.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    net = train(*training_sample(rows.filter("NOT held_out").select("id", "text", "lang")))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.encode() if t and ok else b"" for t, ok in zip(batch.column("text").to_pylist(), batch.column("letter").to_pylist())]
            if net.labels:
                p = pooled(net, texts)
                best = p.argmax(axis=1)
                names = [net.labels[k] if t else UNDETERMINED for k, t in zip(best, texts)]
                score = np.where([bool(t) for t in texts], np.minimum(p.max(axis=1), 1.0), 0.0)
            else:
                names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

        return work

    ready = rows.select("id", "held_out", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(ready, "text", make, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
