"""Rows that are multiplied are dealt over tasks by what they become."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ordering
from quern.operators.scores import bootstrap_interval


def test_spread(spark):
    d = spark.range(1000).coalesce(1)
    s = ordering.spread(d, 50, 1000)
    sizes = [n for n, in s.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert s.count() == 1000 and len(sizes) == 50 and max(sizes) < 60
    assert ordering.spread(d.limit(0), 50).count() == 0


def test_interval_of_one_file(spark):
    """The resamples of a table in one file are drawn in many tasks."""
    d = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("v")).coalesce(1)
    plan = bootstrap_interval(d, "id", "v", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_rescoring_of_one_file(spark):
    """Candidates are dealt by their key before the grid multiplies them, and the best of each point and key are the same."""
    from quern.operators import ngram_models as L

    c = spark.range(600).coalesce(1).select((F.col("id") % 200).alias("k"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("text"), F.sin("id").alias("acoustic"), F.cos("id").alias("lm"))
    r = L.rescore(c, "k", [0.0, 0.5], [0.0, 1.0])
    assert "RepartitionByExpression" in r._jdf.queryExecution().optimizedPlan().toString()
    rows, want = c.collect(), {}
    for x in rows:
        for a in (0.0, 0.5):
            for b in (0.0, 1.0):
                at = (-(x.acoustic + a * x.lm + b), x.text)
                want[a, b, x.k] = min(want.get((a, b, x.k), at), at)
    assert {(x.alpha, x.beta, x.k): x.text for x in r.collect()} == {k: v[1] for k, v in want.items()}
