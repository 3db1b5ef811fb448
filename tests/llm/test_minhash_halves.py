"""What goes to the sets of shingles: pairs and members that their signatures leave."""

from __future__ import annotations

import numpy as np

from quern.llm import minhash


def test_halves_keep_what_whole_values_keep():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**32, (300, minhash.HASHES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < np.linspace(0.3, 1, 300)[:, None], a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    whole, halves = (set(minhash.survivors(x, y, 0.85).tolist()) for x, y in ((a, b), (a.astype("<u2"), b.astype("<u2"))))
    assert 0 < len(whole) < 300 and whole <= halves


def test_sets_go_to_likely_pairs_alone(spark, monkeypatch):
    """Groups of texts with one long header share bands; only copies but for a word need their sets."""
    rng = np.random.default_rng(5)
    head = " ".join(f"h{j}" for j in range(60))
    rows = [(k, head + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 40))) for k in range(40)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(3)]
    handed, pairs, blocks = [], minhash.linked_pairs, minhash.verified_blocks
    monkeypatch.setattr(minhash, "linked_pairs", lambda d, percent: handed.append(d.count()) or pairs(d, percent))
    monkeypatch.setattr(minhash, "verified_blocks", lambda d, percent: handed.append(d.count()) or blocks(d, percent))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 100 for k, _ in rows}
    assert sum(handed) < 40
