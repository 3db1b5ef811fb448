"""Splits and first places by digests: only rows near the border are sorted, and the rows taken are those of a full sort."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quern.operators import ordering as O
from quern.operators.rows import hashed
from quern.operators.sampling import validation_split
from quern.plans import conditions as C


def _sorted_rows(monkeypatch):
    seen, ranges = [], O.in_ranges
    monkeypatch.setattr(O, "in_ranges", lambda df, *a: seen.append(df.count()) or ranges(df, *a))
    return seen


def _digest(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def test_split_sorts_the_border_alone(spark, monkeypatch):
    rows = [(k, "a" if k % 3 else None) for k in range(20_000)] + [(-1, "one"), (-2, "two"), (-3, "two")] + [(5, "copies")] * 50
    want, groups = defaultdict(list), defaultdict(list)
    for k, g in rows:
        groups[g].append((_digest(1, k), str(k), k))
    for g, xs in groups.items():
        take = min(max(1, int(len(xs) * 0.1)), len(xs) - 1)
        want[g] = sorted(k for _, _, k in sorted(xs)[:take])
    seen = _sorted_rows(monkeypatch)
    got = validation_split(spark.createDataFrame(rows, "k long, g string"), ["g"], F.col("k"), 0.1).collect()
    assert len(got) == len(rows) and {g: sorted(r.k for r in got if r.g == g and r.split == "val") for g in groups} == want
    assert sum(seen) < 1_000
    assert validation_split(spark.createDataFrame([], "k long, g string"), ["g"], F.col("k"), 0.1).count() == 0


def test_first_places(spark, monkeypatch):
    t = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g")).withColumn("h", hashed(1, F.col("k")))
    seen = _sorted_rows(monkeypatch)
    for by in ([], ["g"]):
        got = {r.k: r.p for r in O.first_places(t, by, "h", ["k"], 100, "p").collect()}
        assert len(got) == 20_000
        for g in (0, 1) if by else (None,):
            mine = sorted((k for k in range(20_000) if g is None or k % 2 == g), key=lambda k: _digest(1, k))
            assert [got[k] for k in mine[:100]] == list(range(1, 101)) and all(got[k] in (None, n) for n, k in enumerate(mine, 1))
    assert sum(seen) < 1_000


def test_conditions_sort_few_rows(spark, monkeypatch):
    a, b = spark.range(9_000).select(F.col("id").alias("k")), spark.range(6_000).select(F.col("id").alias("k"), F.pmod("id", F.lit(3)).alias("m"))
    spec = [("e", "ALL", C.ALL, C.ALL), ("e", "SOME", 40, 30), ("e", "NONE", 0, C.ALL)]
    seen = _sorted_rows(monkeypatch)
    got = {(r.condition, r.pool, r.split): r["count"] for r in C.assign(a, b, "k", "m", spec).groupBy("condition", "pool", "split").count().collect()}
    n = {c: sum(x for (d, p, _), x in got.items() if (d, p) == c) for c in {k[:2] for k in got}}
    assert n == {("ALL", "random"): 9_000, ("ALL", "structured"): 6_000, ("SOME", "random"): 40, ("SOME", "structured"): 30, ("NONE", "structured"): 6_000}
    assert {c: sum(x for (d, _, s), x in got.items() if (d, s) == (c, "val")) for c in ("ALL", "SOME", "NONE")} == {"ALL": 1_500, "SOME": 7, "NONE": 600}
    assert sum(seen) < 1_000
