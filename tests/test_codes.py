"""Codes of samples whose product with a scale is whole in single precision only, against SQL."""

from __future__ import annotations

import duckdb
import pytest

from quern.queries import ORACLE_SQL, QUERIES

#: In double precision each of them times 10, 100 and 1000 stays just below the whole number (or one of these does).
VALUES = [0.29, 0.58, 0.57, 0.7, 0.9, 0.069, 0.138, 0.276]


@pytest.mark.parametrize("name", ["aud_codes_round_trip", "met_ctc_collapse", "ded_frames", "spl_codec_ids"])
def test_codes(spark, tmp_path, name):
    rows = [(k, [VALUES[(k + i) % len(VALUES)] * (-1) ** i for i in range(64)]) for k in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
