"""The last word of a text, whose time grows with the text and not with its square."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from quern.functions.sentences import incomplete_ending

WORDS = ("de", "la", "que", "the", "of", "et", "été")


def test_endings(spark):
    texts = {"the end of the": "the", "The End OF?!\n": "of", "la": "la", " 12 ": None, "": None, "de 1": "de", "mode": None, "a été": "été", "x-la": "la", "d'la": None, "of\n\n": "of", "😀 que 😀": "que", None: None}
    got = {r["t"]: r["e"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", incomplete_ending(F.col("t"), WORDS).alias("e")).collect()}
    assert got == texts


def test_long_words_take_no_square(spark):
    x = F.concat(F.repeat(F.lit("a"), F.lit(300_000)), F.lit(" 1 of"))
    start = time.time()
    assert spark.range(1).select(incomplete_ending(F.concat(F.col("id").cast("string"), x), WORDS).alias("e")).collect() == [("of",)]
    assert time.time() - start < 20
