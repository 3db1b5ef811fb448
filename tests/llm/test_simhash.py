"""Fingerprints and their groups against plain loops."""

from __future__ import annotations

import numpy as np
import xxhash

from quern.llm import simhash
from tests.llm.cases import documents, empty, lower, multiset, words


def plain_print(text: str | None, k: int = 3) -> int:
    w = words(lower(text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: list[int]) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [plain_print(t) for _, t in rows]
    group, least = plain_groups(prints), {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = [(i, format(p, "016x"), least[g]) for (i, _), p, g in zip(rows, prints, group)]
    assert multiset(simhash.near_duplicates(docs).collect()) == multiset(want)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "other words stand in here")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(alone).collect()] == [None] * 3


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = " ".join(f"w{k % 700}" for k in range(5_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 97)
    assert simhash.fingerprint(text) == whole == plain_print(text)


def crowd(rng, n: int) -> list[int]:
    """Fingerprints in clusters around centres, and alone; the bits that differ lie close or far apart."""
    out = set()
    for c in rng.integers(0, 2**64, n // 40, dtype=np.uint64).tolist():
        spread = rng.integers(0, 64, int(rng.integers(3, 20)))
        for _ in range(int(rng.integers(1, 60))):
            x = c
            for b in rng.choice(spread, int(rng.integers(0, 5))):
                x ^= 1 << int(b)
            out.add(x)
    return list(out | set(rng.integers(0, 2**64, n // 4, dtype=np.uint64).tolist()))


def grouped(spark, prints: list[int]) -> list[int]:
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    at = {x: k for k, x in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash.near_links(frame).collect():
        a, b = (find(at[x % (1 << 64)]) for x in (r["u"], r["v"]))
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_no_link_is_lost(spark):
    prints = crowd(np.random.default_rng(5), 1500)
    assert grouped(spark, prints) == plain_groups(prints)


def test_crowded_patterns_are_split(spark, monkeypatch):
    """Patterns that more fingerprints share than a task may hold, and thousands that differ in a few bits only."""
    monkeypatch.setattr(simhash, "HOT", 40)
    prints = crowd(np.random.default_rng(6), 1200)
    assert grouped(spark, prints) == plain_groups(prints)
    close = sorted({0xDEADBEEF00000000 | x for x in np.random.default_rng(7).integers(0, 1 << 16, 600).tolist()})
    assert grouped(spark, close) == plain_groups(close)


def test_hierarchy_prunes():
    """Every linking pair is given once, over levels of several patterns."""
    rng = np.random.default_rng(8)
    x = np.array(crowd(rng, 3000), dtype=np.uint64)
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    x = x[np.argsort(rank)]
    first = np.array([0, 1, 5, 900, 901])
    part = np.searchsorted(first, np.arange(len(x)), side="right")
    want = {(i, j) for i in range(len(x)) for j in np.flatnonzero((np.bitwise_count(x ^ x[i]) <= 3) & (part == part[i])).tolist() if i < j}
    got = [(a, b) for i, j in simhash.Hierarchy(x, first).links() for a, b in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
