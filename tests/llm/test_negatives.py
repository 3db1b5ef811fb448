"""Hard negatives against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import negatives
from tests.llm.cases import multiset


def plain_negatives(rows: list[tuple], n_positives: int = 5, n_negatives: int = 10) -> list[tuple]:
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, mine in (r for r in good if r[0] % 100 == 0):
        scored = [(i, other == label, sum(x * y for x, y in zip(mine, v))) for i, other, v in good if i != a]
        order = sorted(scored, key=lambda r: (-r[2], r[0]))
        for p, _, ps in [r for r in order if r[1]][:n_positives]:
            found = [(i, s) for i, same, s in order if not same and 30 * ps <= 100 * s <= 90 * ps][:n_negatives]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(found)]
    return out


def vectors(d: int, n: int = 700, seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(k, [float(x) for x in np.float32(0.3 * centres[k % 6] + rng.normal(size=d) * 0.1)], k % 4) for k in range(n)]
    rows += [(n + k, rows[100][1], k % 3) for k in range(20)]  # equal vectors
    rows += [(900, None, 1), (1000, [None, 0.1], 1), (1001, [float("nan")] * d, 1), (1100, [float("inf")] * d, 1), (1002, rows[5][1], None), (None, rows[5][1], 1), (1200, [], 1), (1300, [-0.5] * (d + 3), 2), (1003, [0.0] * d, 1)]
    rows += [rows[100], rows[101]]  # repeated rows
    return rows


@pytest.mark.parametrize("d", [3, 64, 70])
def test_hard_negatives(spark, monkeypatch, d):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    rows = vectors(d)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS row", "'x' AS p", "'x' AS rank", "'x' AS id", "'x' AS ints")
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # the float of a component is what counts
    want = plain_negatives([(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert want and multiset(got.collect()) == multiset(want)
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-(2**18), 2**18, 9) / 8], int(k % 3)) for k in range(300)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0)
    assert multiset(got.collect()) == multiset(plain_negatives(rows))
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e12], 1)], "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0)


def test_intervals_hold_and_rows_are_dropped():
    rng = np.random.default_rng(6)
    ints = rng.integers(-200, 200, (2000, 64))
    cut = negatives.planes(ints, 9)
    exact = ints @ ints[0]
    products, seen = negatives.Products(cut, cut[:, 0]), []

    def keep(least, most):
        seen.append(len(least))
        return negatives.may_be_among(5)(least, most)

    at, scores = products.scores(np.arange(2000), keep)
    assert (exact[at] == scores).all() and set(np.argsort(-exact)[:5]) <= set(at.tolist())
    assert seen == sorted(seen, reverse=True) and seen[-1] < 100
    for k in range(8, -1, -1):
        part = sum(products.values[b] * products.plane(b, np.arange(2000)) for b in range(8, k - 1, -1))
        assert (part + ((1 << k) - 1) * products.low <= exact).all() and (exact <= part + ((1 << k) - 1) * products.high).all()
