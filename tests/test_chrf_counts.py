"""Counts of chrF: the best reference by chrF and by chrF++, with each text's grams counted once."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from quern.operators import scores as K


def plain(h, r):
    out = []
    for a, b, order in (("".join(h.split()), "".join(r.split()), 6), (K._apart(h), K._apart(r), 2)):
        for n in range(1, order + 1):
            x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
            out += [sum(x.values()), sum(y.values()), sum((x & y).values())]
    return out


TEXTS = ["", "a", "the cat, the cat sat.", "The cat sat on a mat", "aaaa aaaa aaa", "\u00e9t\u00e9 (\u00e9t\u00e9)!", "x y z x y z x"]


def test_counts(spark, monkeypatch):
    rows = [(h, [r, s]) for h in TEXTS for r in TEXTS for s in TEXTS]
    for h, (r, s) in rows:
        assert K._chrf_counts(K._chrf_grams(h), K._chrf_grams(r)) == plain(h, r)
    made = []
    monkeypatch.setattr(K, "_chrf_grams", lambda t, f=K._chrf_grams: made.append(t) or f(t))
    import pandas as pd

    got = K.chrf_counts.func(pd.Series([h for h, _ in rows]), pd.Series([r for _, r in rows]))
    assert len(made) == 3 * len(rows)
    for (h, rs), c, p in zip(rows, got["c"], got["p"]):
        each = [plain(h, r) for r in rs]
        assert c == max(each, key=lambda x: K._chrf_of(x, 0)) and p == max(each, key=lambda x: K._chrf_of(x, 2))


def test_one_reference_is_the_best(spark):
    """With one reference chrF and chrF++ have the same counts, from one call."""
    d = spark.createDataFrame([(h, [r]) for h in TEXTS for r in TEXTS], "h string, r array<string>")
    for x in d.select("h", "r", K.chrf_counts(F.col("h"), F.col("r")).alias("f")).collect():
        assert x.f.c == x.f.p == plain(x.h, x.r[0])
