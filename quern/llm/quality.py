"""Quality rules: word and line rules, and bands for tokeniser fertility by language, or by script where the language is unknown."""

from __future__ import annotations

import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.batches import SMALL_BYTES, map_texts
from quern.llm.vocabularies import byte_pieces, piece_chunks, piece_ids, vocabulary_path
from quern.scratch import materialize

#: Fixed values of the base rules.
MIN_WORDS, REPEAT_PERCENT, SYMBOLS = 50, 50, b"#*$%&|<>"
#: A document is rejected beyond the median of its language by so many times the distance from the median to the quartile on that side.
BAND_QUANTILE, BAND_WIDTH = 0.25, 8.0
#: A group with fewer distinct texts has its bands widened, by the root of what it lacks.
MIN_GROUP = 200
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: Quantiles are those of the measures in steps of one part in so many.
GRID = 10_000
_SPACE = b" \t\n\v\f\r"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each list: words that stand in a 3-word window found twice or more in the list."""
    ids: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    out = np.zeros(len(words), dtype=np.int64)
    if len(flat) < 4:
        return out
    start = np.flatnonzero(doc[:-2] == doc[2:])
    if not len(start):
        return out
    pairs = np.unique(flat[start] * len(ids) + flat[start + 1], return_inverse=True)[1]  # exact numbers, no hashes
    triples = np.unique(pairs * len(ids) + flat[start + 2], return_inverse=True)[1]
    order = np.lexsort((doc[start], triples))
    t, d = triples[order], doc[start][order]
    same = (t[1:] == t[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(flat), dtype=bool)
    at = start[order[twice]]
    for k in range(3):
        hit[at + k] = True
    return np.bincount(doc[hit], minlength=len(words)).astype(np.int64)


class _Scripts(dict):
    def __missing__(self, char: str) -> str:
        name = unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""
        value = self[char] = {"HIRAGANA": "KANA", "KATAKANA": "KANA"}.get(name, name)
        return value


def dominant_script(text: str, scripts: _Scripts) -> str:
    """The script of most letters, as their Unicode names begin; of equals the first by name, "" without letters."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else ""
    times: Counter = Counter()
    for char, n in Counter(text).items():
        times[scripts[char]] += n
    del times[""]
    return min(times, key=lambda s: (-times[s], s), default="")


def text_measures(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", extra: list[str] | None = None) -> DataFrame:
    """Per row: id, lang, script (null where lang is known), the base counts, n_tokens and the three measures of fertility (null without tokens).

    chars_per_token: characters by tokens of the public vocabulary; byte_share: tokens that are bytes of a character outside it
    (line feeds apart); token_entropy: bits of the document's token distribution, by the most that its length allows.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")
    keep = extra or []

    def make():
        memo, is_byte, scripts = piece_ids(path), byte_pieces(path).copy(), _Scripts()
        from quern.llm.vocabularies import piece_model

        is_byte[piece_model(path).piece_to_id("<0x0A>")] = False

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            script = [dominant_script(t, scripts) if lang is None else None for t, lang in zip(texts, batch.column("lang").to_pylist())]
            raw = [t.encode() for t in texts]
            words = [b.split() for b in raw]
            dup = []
            for b in raw:
                lines = [x for x in b.split(b"\n") if x.strip()]
                dup.append(len(lines) - len(set(lines)))
            chunks = [piece_chunks(t) for t in texts]
            get = memo.of(set(chain.from_iterable(chunks))).__getitem__
            ids = [b"".join(map(get, c)) for c in chunks]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
            doc = np.repeat(np.arange(len(texts)), n)
            in_bytes = np.bincount(doc, weights=is_byte[flat], minlength=len(texts))
            kinds, times = np.unique((doc << 32) | flat, return_counts=True)
            share = times / n[kinds >> 32]
            bits = np.bincount(kinds >> 32, weights=-share * np.log2(share), minlength=len(texts))
            some = n > 0
            part = np.where(some, n, 1)
            masked = lambda x: pa.array(x, pa.float64(), mask=~some)
            columns = {
                "n_words": [len(w) for w in words], "word_chars": [len(b.translate(None, _NOT_COUNTED)) for b in raw],
                "n_symbols": [len(b) - len(b.translate(None, SYMBOLS)) for b in raw], "n_dup_lines": dup, "n_repeat_words": repeated_words(words), "n_tokens": n,
            }
            arrays = [batch.column(c) for c in ("id", "lang", *keep)] + [pa.array(script, pa.string())] + [pa.array(x, pa.int64()) for x in columns.values()]
            arrays += [masked(np.array([len(t) for t in texts]) / part), masked(in_bytes / part), masked(bits / np.log2(part + 1))]
            return pa.RecordBatch.from_arrays(arrays, ["id", "lang", *keep, "script", *columns, *MEASURES])

        return work

    cols = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), *keep)
    kind = lambda c: cols.schema[c].dataType.simpleString()
    own = "".join(f", `{c}` {kind(c)}" for c in keep)
    return map_texts(cols, "text", make, f"id {kind('id')}, lang string{own}, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double", SMALL_BYTES).withColumnRenamed("id", id_col)


def fertility_bands(measures: DataFrame, quantile: float = BAND_QUANTILE, width: float = BAND_WIDTH, min_group: int = MIN_GROUP) -> DataFrame:
    """band_group with low and high of each measure, over its distinct texts (text_hash) that pass the base rules.

    Quantiles come from counts of the values, in steps of 1 / GRID, so they are the same however the rows are split.

    A band reaches from the median by `width` times the distance to the quantile on that side, and at least as far as that of the mean distance of all groups
    (by their texts, and in parts of each median but for byte_share) and a twentieth of the median (a hundredth for byte_share). The fewer than min_group texts, the wider.
    """
    texts = measures.filter("NOT base_failed").select("band_group", "text_hash", *MEASURES).dropDuplicates(["band_group", "text_hash"])
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * GRID).cast("long").alias("value")) for m in MEASURES]))
    counts = texts.select("band_group", values.alias("x")).select("band_group", "x.*").filter("value IS NOT NULL").groupBy("band_group", "measure", "value").agg(F.count("*").alias("n"))
    one = Window.partitionBy("band_group", "measure")
    placed = counts.withColumn("upto", F.sum("n").over(one.orderBy("value"))).withColumn("all", F.sum("n").over(one))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("value"))) / GRID
    middle = placed.groupBy("band_group", "measure").agg(F.array(at(quantile), at(0.5), at(1 - quantile)).alias("q"), F.max("all").alias("n"))
    groups = materialize(middle.groupBy("band_group").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m in MEASURES]), "groups")
    spreads = []
    for m in MEASURES:
        mid = F.col(m)[1]
        part = F.lit(1.0) if m == "byte_share" else mid
        spreads += [F.try_divide(F.sum(F.col("n") * F.try_divide(d, part)), F.sum("n")).alias(f"{m}_{side}_spread") for side, d in (("low", mid - F.col(m)[0]), ("high", F.col(m)[2] - mid))]
    out = groups.crossJoin(F.broadcast(groups.agg(*spreads))).withColumn("_wider", F.sqrt(F.greatest(F.lit(1.0), F.lit(min_group) / F.col("n"))) * width)
    for m in MEASURES:
        low, mid, high = (F.col(m)[k] for k in range(3))
        part, least = (F.lit(1.0), F.lit(0.01)) if m == "byte_share" else (mid, mid * 0.05)
        reach = lambda d, side: F.greatest(d * F.col("_wider"), F.col(f"{m}_{side}_spread") * part * F.col("_wider"), least)  # noqa: B023, E731
        out = out.withColumn(f"{m}_low", mid - reach(mid - low, "low")).withColumn(f"{m}_high", mid + reach(high - mid, "high"))
    return out.select("band_group", *[f"{m}_{side}" for m in MEASURES for side in ("low", "high")])


def quality_rules(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", extra: list[str] | None = None) -> DataFrame:
    """Per row: id, base counts, base_failed, the fertility measures and kept.

    kept is false where the base rules fail, else the verdict of the bands of the row's language, or where that is null of the unlabelled texts of its dominant script.
    No row is judged by bands of another language; few texts widen their own. Copies count once in the bands.
    Null text has no words and fails. `extra` names columns of docs to carry through (pipeline). Repeated rows each give a row; an empty table gives an empty one.
    """
    hashed = docs.withColumn("_text_hash", F.xxhash64(text_col))
    measured = text_measures(hashed, path, id_col, text_col, lang_col, [*(extra or []), "_text_hash"]).withColumnRenamed("_text_hash", "text_hash")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    group = F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"))
    table = materialize(measured.withColumn("base_failed", failed).withColumn("band_group", group), "quality")
    bands = materialize(fertility_bands(table), "bands")
    small = bands.count() <= 10_000
    own = table.join(F.broadcast(bands) if small else bands, "band_group", "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return own.withColumn("kept", ~F.col("base_failed") & inside).select(id_col, *(extra or []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *MEASURES)
