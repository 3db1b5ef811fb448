"""Places, running sums and quantiles against numpy; files that align."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.operators import ordering as O
from quern.operators import sampling as S
from quern.sources import readers, writers


def test_ranks_follow_the_data(spark):
    """One value far from all others doesn't put them into one range, and equal rows are spread over places."""
    rows = [(k, "a" if k % 3 else None) for k in range(20_000)] + [(10**15, "b"), (7, "a"), (7, "a")]
    t = spark.createDataFrame(rows, "x long, g string")
    got = O.ranks(t, ["x"], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(1, len(rows) + 1))
    assert [r["x"] for r in sorted(got, key=lambda r: r["n"])] == sorted(x for x, _ in rows)
    sizes = [r["count"] for r in O.in_ranges(t, ["x"]).groupBy("_part").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 0.5 * len(rows)
    within = O.ranks_within(t, ["g"], ["x"], "n").collect()
    for g in ("a", None, "b"):
        mine = sorted((r["n"], r["x"]) for r in within if r["g"] == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, x in mine] == sorted(x for x, h in rows if h == g)
    assert O.ranks(t.limit(0), ["x"], "n").count() == 0 and O.ranks_within(t.limit(0), ["g"], ["x"], "n").count() == 0


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(x), int(v)) for g, x, v in zip(rng.integers(0, 3, 9_000), rng.normal(size=9_000), rng.integers(0, 9, 9_000))]
    got = O.running_sums(spark.createDataFrame(rows, "g int, x double, v long"), ["g"], ["x"], "v", "s").collect()
    for g in range(3):
        mine = sorted((r["x"], r["v"], r["s"]) for r in got if r["g"] == g)
        assert [s for _, _, s in mine] == np.cumsum([v for _, v, _ in mine]).tolist()


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    values = {"reals": rng.normal(size=15_000), "one value for half": np.where(rng.random(6_001) < 0.5, 3.25, rng.lognormal(size=6_001)), "far": np.append(rng.random(500), [1e300, -1e300]), "single": np.array([5.0]), "two": np.array([1.0, 4.0]), "endless": np.array([1.0, 2.0, float("inf")])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("none", None), ("nan", float("nan")), ("two", None), (None, 2.0)]
    shares = {"low": 0.0, "q": 0.05, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = {r["g"]: r for r in O.quantiles(spark.createDataFrame(rows, "g string, x double"), "x", shares, ["g"]).collect()}
    assert set(got) == {*values, None}
    for g, xs in values.items():
        for name, p in shares.items():
            if g == "endless":  # numpy takes infinity times 0
                assert got[g][name] == {"low": 1.0, "q": 1.1, "mid": 2.0}.get(name, float("inf"))
            else:
                assert np.isclose(got[g][name], np.quantile(xs, p), rtol=1e-12), (g, name)
    whole = O.quantiles(spark.createDataFrame(rows, "g string, x double").filter("g = 'reals'"), "x", {"mid": 0.5}).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["mid"], np.median(values["reals"]))
    empty = spark.createDataFrame([], "g int, x double")
    assert O.quantiles(empty, "x", {"mid": 0.5}).collect() == [(None,)] and O.quantiles(empty, "x", {"mid": 0.5}, ["g"]).count() == 0


def test_files_align_beyond_the_sample(spark, tmp_path):
    """A million rows in 16 ranges: file k of each column has the same rows in the same order."""
    n = 1_000_000
    t = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(10**12)).alias("x"), "id").withColumns({"a": F.col("id").cast("string"), "b": F.concat(F.lit("text\n"), F.col("id").cast("string")), "c": F.when(F.col("id") % 5 > 0, F.col("id"))})
    writers.aligned(t.repartition(24), "x", ["a", "b", "c"], str(tmp_path / "out"), parts=16)
    files = {c: sorted(str(p.relative_to(tmp_path / "out" / c).parent) for p in (tmp_path / "out" / c).rglob("part-*")) for c in "abc"}
    assert files["a"] == files["b"] == files["c"] == sorted(f"_part={k}" for k in range(16))
    lines = {(c, k): next((tmp_path / "out" / c / f"_part={k}").glob("part-*")).read_text().split("\n")[:-1] for c in "abc" for k in range(16)}
    assert sum(len(lines["a", k]) for k in range(16)) == n
    for k in range(16):
        assert lines["b", k] == [f"text\\n{x}" for x in lines["a", k]]
        assert lines["c", k] == [x if int(x) % 5 else "" for x in lines["a", k]]
    read = readers.aligned_lines(spark, str(tmp_path / "out"), ["a", "b", "c"])
    assert read.filter(F.col("b") != F.concat(F.lit("text\\n"), "a")).count() == 0 and read.count() == n


def test_draws_rank_no_stratum_whole(spark):
    t = spark.range(9_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("s"))
    assert {r["s"]: r["count"] for r in S.stratified(t, "s", 5_000, "k").groupBy("s").count().collect()} == {"big": 2500, "small": 2500}
    assert {r["s"]: r["count"] for r in S.quota_sample(t, "s", {"big": 4_000}, "k").groupBy("s").count().collect()} == {"big": 4_000}
    held = S.grouped_validation(t.withColumn("g", F.when(F.col("k") > 5, F.col("k") % 50)), "g", 0.1)
    by = held.filter("g IS NOT NULL").groupBy("g").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r["s"]) == 1 for r in by) and sum(r["s"] == ["validation"] for r in by) == 5 and held.count() == 9_000
