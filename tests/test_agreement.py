"""Agreement against all pairs in plain loops, tails against known values, speed and batches."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import agreement as N
from quern.operators import audio as A


def plain_alpha(units: dict, level: str) -> float:
    units = {u: v for u, v in units.items() if len(v) > 1}
    every = [x for v in units.values() for x in v]
    n, count = len(every), Counter(every)
    mid = {x: sum(c for y, c in count.items() if y < x) + count[x] / 2 for x in count}
    apart = {"nominal": lambda a, b: float(a != b), "interval": lambda a, b: (a - b) ** 2, "ordinal": lambda a, b: (mid[a] - mid[b]) ** 2}[level]
    seen = sum(apart(a, b) / (len(v) - 1) for v in units.values() for i, a in enumerate(v) for j, b in enumerate(v) if i != j) / n
    chance = sum(apart(a, b) * count[a] * (count[b] - (a == b)) for a in count for b in count) / (n * (n - 1))
    return 1 - seen / chance


def test_krippendorff(spark):
    rng = np.random.default_rng(1)
    units = {u: [int(x) for x in np.clip(rng.normal(u % 5, 1.2, int(rng.integers(0, 6))).round(), 0, 6)] for u in range(120)}
    rows = [(u, float(x), "a") for u, v in units.items() for x in v] + [(5, None, "a"), (None, 3.0, "b"), (None, 3.0, "b")]
    d = spark.createDataFrame(rows, "u int, x double, k string")
    for level in ("nominal", "interval", "ordinal"):
        got = N.krippendorff(d.filter("k = 'a'"), "u", "x", level).collect()
        assert len(got) == 1 and math.isclose(got[0]["alpha"], plain_alpha(units, level), rel_tol=1e-9), level
        assert got[0]["n"] == sum(len(v) for v in units.values() if len(v) > 1)
        by = {r["k"]: r["alpha"] for r in N.krippendorff(d, "u", "x", level, ["k"]).collect()}
        assert math.isclose(by["a"], got[0]["alpha"]) and by["b"] is None  # one value only
    # three raters of fifteen units, some ratings missing: a known example
    known = {"A": "*****34121133*3", "B": "1*213343*******", "C": "**21344*21133*4"}
    pairs = [(k, int(c)) for v in known.values() for k, c in enumerate(v) if c != "*"]
    e = spark.createDataFrame(pairs, "u int, x int")
    plain = {u: [x for v, x in pairs if v == u] for u in range(15)}
    alpha = N.krippendorff(e, "u", "x").first()["alpha"]
    assert math.isclose(alpha, plain_alpha(plain, "nominal"), rel_tol=1e-9) and round(alpha, 3) == 0.691 and round(N.krippendorff(e, "u", "x", "interval").first()["alpha"], 3) == 0.811
    with pytest.raises(ValueError):
        N.krippendorff(e, "u", "x", "ratio")


def test_kappa_and_chi_square(spark):
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")]
    d = spark.createDataFrame(rows, "a string, b string")
    got = N.cohen_kappa(d, "a", "b").first()
    assert got["n"] == 50 and math.isclose(got["agreed"], 0.7) and math.isclose(got["kappa"], 0.4)
    assert N.cohen_kappa(d.filter("a = 'y' AND b = 'y'"), "a", "b").first()["kappa"] is None
    x = N.chi_square(d, "a", "b").first()
    assert x["freedom"] == 1 and math.isclose(x["chi_square"], 50 * (20 * 15 - 5 * 10) ** 2 / (25 * 25 * 30 * 20), rel_tol=1e-12)
    assert math.isclose(x["p_value"], math.erfc(math.sqrt(x["chi_square"] / 2)), rel_tol=1e-12)
    assert N.chi_square(d.filter("a = 'y'"), "a", "b").first()["p_value"] is None


def test_tails():
    """Table values: 5 % and 1 % points, and finite sums where the degrees are even."""
    for freedom, five, one in ((1, 3.841459, 6.634897), (2, 5.991465, 9.210340), (5, 11.070498, 15.086272), (10, 18.307038, 23.209251), (100, 124.342113, 135.806723)):
        assert math.isclose(N.gamma_tail(freedom / 2, five / 2), 0.05, rel_tol=1e-5) and math.isclose(N.gamma_tail(freedom / 2, one / 2), 0.01, rel_tol=1e-5)
    for freedom in (2, 8, 40):
        for x in (0.1, 3.0, 30.0, 90.0):
            want = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
            assert math.isclose(N.gamma_tail(freedom / 2, x / 2), want, rel_tol=1e-9)
    assert N.gamma_tail(1.0, 0.0) == 1.0


def test_speed(spark):
    """A tone keeps its frequency times the factor and its level; what the lower rate can't hold goes."""
    rate = 16_000
    t = np.arange(rate) / rate
    for factor in (0.9, 1.1, 1.5):
        for tone in (440.0, 3_000.0):
            y = A.sinc_resampled(np.sin(2 * np.pi * tone * t), int(rate * factor), rate)
            assert len(y) == math.ceil(rate * rate / int(rate * factor))
            middle = y[500:-500] * np.hanning(len(y) - 1000)
            top = np.argmax(np.abs(np.fft.rfft(middle, 1 << 18))) * rate / (1 << 18)
            assert abs(top - tone * factor) < 1.0 and 0.97 < np.abs(y[500:-500]).max() < 1.03
    high = A.sinc_resampled(np.sin(2 * np.pi * 7_500 * t), int(rate * 1.5), rate)
    assert np.abs(high[500:-500]).max() < 0.02
    whole = A.sinc_resampled(np.random.default_rng(1).normal(size=70_000), 9, 10)
    assert len(whole) == 77_778 and np.isfinite(whole).all()
    got = spark.createDataFrame([([1.0, 2.0],), ([],), (None,)], "x array<float>").coalesce(1).select(A.sped("x", 10, 1.0)).collect()
    assert [r[0] for r in got] == [[1.0, 2.0], [], None]


def test_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=int(n))], list(range(k % 4))) for k, n in enumerate(rng.integers(0, 400, 500))] + [(900, None, None)]
    df = spark.createDataFrame(rows, "k int, x array<float>, y array<int>")
    got = A.collated(df, "k", "x", "y", 16).collect()
    by = {k: (x or [], y or []) for k, x, y in rows}
    assert sorted(k for r in got for k in r["keys"]) == sorted(by)
    padding = cells = 0
    for r in got:
        assert r["lengths"] == sorted((len(by[k][0]) for k in r["keys"]), reverse=True) and len(r["keys"]) <= 16
        for k, wave, n, target, m, mask in zip(r["keys"], r["waveforms"], r["lengths"], r["targets"], r["target_lengths"], r["mask"]):
            assert np.allclose(wave[:n], by[k][0]) and not any(wave[n:]) and len(wave) == r["lengths"][0] and mask == [i < n for i in range(len(wave))]
            assert target[:m] == by[k][1] and not any(target[m:])
            padding, cells = padding + len(wave) - n, cells + len(wave)
    assert padding < 0.05 * cells
    assert A.collated(df.limit(0), "k", "x", "y", 16).count() == 0
