"""Krippendorff's alpha from sums of units."""

from __future__ import annotations


def test_units_are_not_joined(spark):
    """Sums of units need no join of ratings with their units' sizes; units of one rating count nowhere, nor do their values."""
    import math
    from itertools import permutations

    from quern.operators import agreement

    rows = [(u, v) for u in range(60) for v in ([u % 5, (u * u) % 7, (u // 3) % 5][: 1 + u % 3] + [None])] + [(99, 100), (98, 3)]
    d = spark.createDataFrame(rows, "u int, v int")
    units = [[v for w, v in rows if w == u and v is not None] for u in {u for u, _ in rows}]
    units = [x for x in units if len(x) > 1]
    flat = [v for x in units for v in x]
    rank = {v: sum(x < v for x in flat) + flat.count(v) / 2 for v in flat}
    tests = {"nominal": lambda a, b: float(a != b), "interval": lambda a, b: (a - b) ** 2, "ordinal": lambda a, b: (rank[a] - rank[b]) ** 2}
    for level, far in tests.items():
        got = agreement.krippendorff(d, "u", "v", level)
        observed = sum(far(a, b) / (len(x) - 1) for x in units for a, b in permutations(x, 2))
        r = got.first()
        assert r.n == len(flat) and math.isclose(r.alpha, 1 - observed * (len(flat) - 1) / sum(far(a, b) for a, b in permutations(flat, 2)), rel_tol=1e-9)
        assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString() and got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1, level
