"""Ranked search against plain loops."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from quern.llm import lexical
from tests.llm.cases import documents, empty, lower, multiset

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def plain_terms(text: str | None) -> list[str]:
    return TERM.findall(lower(text or ""))


def plain_ranks(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    split = [Counter(plain_terms(t)) for _, t in docs]
    size = [sum(c.values()) for c in split]
    n_docs, n_terms, df = sum(n > 0 for n in size), sum(size), Counter(t for c in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, _), c, n in zip(docs, split, size):
            if n:
                m = 25 + (75 * n * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
                if s > 0:
                    scored.append((-s, i is None, i, s))
        out += [(item, r + 1, x[2], x[3]) for r, x in enumerate(sorted(scored, key=lambda x: (x[:2], x[2] or 0))[:k])]
    return out


def items_of(spark, texts: list[str | None]):
    rows = [(k, t) for k, t in enumerate(texts)]
    picked = [(10, rows[7][1]), (11, rows[12][1]), (11, rows[12][1]), (12, None), (13, " ,;"), (14, "nowheretobefound"), (15, "SAME same line, Here-here same"), (16, "é 漢字 🙂 one"), (None, rows[40][1]), (17, rows[30][1])]
    return picked, spark.createDataFrame(picked, "item_id long, text string").selectExpr("*", "'x' AS rank", "'x' AS score", "'x' AS item")


def test_ranks(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    picked, items = items_of(spark, [t for _, t in rows])
    got = lexical.ranked(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert multiset(got.collect()) == multiset(plain_ranks(rows, picked))
    assert lexical.ranked(empty(spark), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs, items.filter("item_id = 13")).count() == 0


def test_small_blocks_and_many_passes(spark, monkeypatch):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    picked, items = items_of(spark, [t for _, t in rows])
    monkeypatch.setattr(lexical, "PASS_BYTES", 4_000)
    assert multiset(lexical.ranked(docs.coalesce(1), items, k=3).collect()) == multiset(plain_ranks(rows, picked, 3))


def test_blocks_are_closed_by_rows_and_entries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 500)) for k in range(4_000)]
    items = [(k, rows[k * 37][1]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = multiset(plain_ranks(rows, items))
    assert multiset(lexical.ranked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == want
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 700)
    assert multiset(lexical.ranked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == want


def test_slices_add_up():
    rng = np.random.default_rng(9)
    n, words = 300, 5
    total, parts = np.zeros(n, dtype=np.int64), []
    for k in range(23):
        slots = np.sort(rng.choice(n, int(rng.integers(1, n)), replace=False))
        values = rng.integers(1, 1 << int(rng.integers(1, 34)), len(slots))
        total[slots] += values << (k % 3)
        parts.append((lexical.opened(slots, lexical.slices(values), words), k % 3))
    depth = int(total.sum()).bit_length()
    summed = lexical.added(parts, depth)
    for k in (1, 7, 299, 400):
        slots, sums = lexical.highest(summed, k)
        want = sorted(((-int(s), i) for i, s in enumerate(total) if s > 0))[:k]
        assert sorted((-int(s), int(i)) for i, s in zip(slots, sums)) == want


def test_ties_go_to_the_lowest_rows():
    slots = np.arange(100)
    total = lexical.added([(lexical.opened(slots, lexical.slices(np.full(100, 5)), 2), 0)], 4)
    at, sums = lexical.highest(total, 10)
    assert at.tolist() == list(range(10)) and set(sums.tolist()) == {5}
