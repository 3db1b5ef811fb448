"""Buckets of one group of near copies are compared once, not once a band."""

from __future__ import annotations

import numpy as np

from quern.llm import minhash


def test_rest_of_a_group_is_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"b{j}" for j in range(150)]
    rows = []
    for k in range(160):
        words = list(base)
        for j in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            words[j] = f"n{k}x{j}"
        rows.append((k, " ".join(words)))
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 85 * len(x | y) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    handed, likely = [], minhash.likely_members
    monkeypatch.setattr(minhash, "likely_members", lambda d, percent: handed.append(d.count()) or likely(d, percent))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root)) and 10 < len(set(root)) < 150
    assert 0 < sum(handed) <= 3 * len(rows)
