"""Characters of odd texts, against the SQL."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.queries import ORACLE_SQL, QUERIES

TEXTS = {
    "empty": ["", "ab", "", None],
    "only_empty": ["", ""],
    "null": [None],
    "marks": ["cafe\u0301 \U0001f468\u200d\U0001f469", "\U0001f1eb\U0001f1f7\r\n\x00", "\u1100\u1161", " "],
    "dotted": ["\u0130stanbul", "I\u0307i\u0131"],
    "unicode": ["".join(map(chr, range(a, min(a + 5000, 0x110000)))) for a in (*range(0, 0xD000, 5000), 0xE000, *range(0xF000, 0x110000, 5000))],
}


@pytest.mark.parametrize("name", TEXTS)
def test_agg_characters(spark, tmp_path, name):
    """What SQL counts: an empty text as one empty character, no character in two."""
    texts = [t and "".join(c for c in t if not "\ud800" <= c <= "\udfff") for t in TEXTS[name]]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(ORACLE_SQL["agg_characters"]).fetchall()
    got = [(r["ch"], r["n"]) for r in QUERIES["agg_characters"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
