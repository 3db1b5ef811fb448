"""Where queries and their SQL are kept, and the tables that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, conv_id, src, tgt): each user turn and the assistant's answer."""
    t = table(spark, sf_dir, "conversations")
    u = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    a = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "conv_id", "src", "tgt")


PAIRS = """pairs AS (SELECT u.conv_id * 1000 + u.turn AS ord, u.conv_id, u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '\\s+'), lambda w: w <> '')"
