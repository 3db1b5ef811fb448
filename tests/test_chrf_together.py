"""chrF's counts of many pairs at a time against counts pair by pair."""

from __future__ import annotations

import random

import pandas as pd

from quern.operators import scores as K

FEW = ["", " ", "a", "ab ab", "the cat, the cat sat.", "aaaa aaaa aaa", "été (été)!", "x y z x y z x", "\U0001f600 \U0001f600!"]


def plain(h, r):
    return K._chrf_counts(K._chrf_grams(h), K._chrf_grams(r))


def test_pairs_are_counted_together(monkeypatch):
    """Rows of one reference make no counters of their own; null candidates, references and arrays are empty texts."""
    rows = [(h, [r]) for h in [*FEW, None] for r in [*FEW, None]] + [(h, rs) for h in FEW for rs in (None, [])]
    want = [plain(h or "", (rs or [None])[0] or "") for h, rs in rows]
    many = [("the cat sat", ["the cat", "a cat sat"]), (None, ["", None])]
    best = [tuple(max((plain(h or "", r or "") for r in rs), key=lambda c: K._chrf_of(c, k)) for k in (0, 2)) for h, rs in many]
    made = []
    monkeypatch.setattr(K, "_chrf_grams", lambda t, f=K._chrf_grams: made.append(t) or f(t))
    everything = [many[0], *rows, many[1]]
    got = K.chrf_counts.func(pd.Series([h for h, _ in everything]), pd.Series([r for _, r in everything]))
    assert len(made) == 6
    assert [tuple(x) for x in zip(got["c"], got["p"])] == [best[0], *((w, w) for w in want), best[1]]
    assert K.chrf_counts.func(pd.Series([], dtype=object), pd.Series([], dtype=object)).empty


def test_many_different_characters(monkeypatch):
    """Numbers of grams outgrow 62 bits and are ranked anew; slices end anywhere."""
    draw = random.Random(5)
    text = lambda: "".join(draw.choice([" ", chr(draw.randrange(0x4E00, 0x9FA5)), chr(draw.randrange(0x1F300, 0x1F5FF)), "ab"]) for _ in range(draw.randrange(400)))
    pairs = [(t, t[k:] + text()[:k]) for k in range(60) for t in [text()]]
    want = [plain(*p) for p in pairs]
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(K, "COUNTED_TOGETHER", size)
        assert K._chrf_slices(pairs) == want
