"""Sets of shingles are made distinct only where ids are repeated; buckets that are shared are known before rows are sent."""

from __future__ import annotations

import pytest

from quern.llm import minhash


@pytest.mark.parametrize("repeated", [False, True])
def test_sets_are_distinct(spark, monkeypatch, repeated):
    rows = [(k, " ".join(f"w{(k // 3) * 50 + j}" for j in range(40)) + (f" x{k}" if k % 3 else "")) for k in range(30)]
    rows += [(k, t) for k, t in rows[:6]] + [(7, "another text with the id of a group's member")] if repeated else []
    made = []
    monkeypatch.setattr(minhash, "materialize", lambda df, name, f=minhash.materialize: made.append(name) or f(df, name))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(d).collect()}
    assert got == {(k, k - k % 3) for k in range(30)} | ({(7, 7)} if repeated else set())
    assert "shared" in made and ("distinct_sets" in made) == repeated
