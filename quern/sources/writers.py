"""Writers of pair tables and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import escape_controls
from quern.operators.ordering import in_ranges


def pair_files(df: DataFrame, path: str) -> None:
    """All columns as CSV with a header under path/csv, src and tgt as TSV without one under path/tsv."""
    df.write.csv(f"{path}/csv", header=True, escape='"')
    escaped_tsv(df.select("src", "tgt"), f"{path}/tsv", header=False)


def escaped_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated lines; line feeds, carriage returns and tabs inside values are escapes of two characters."""
    df.select(*[escape_controls(F.col(c).cast("string")).alias(c) for c in df.columns]).write.csv(path, sep="\t", quote="", header=header, emptyValue="", nullValue="")


def by_run(df: DataFrame, path: str) -> None:
    """JSON lines in folders experiment, condition and seed; nulls are left out of each record."""
    df.write.partitionBy("experiment", "condition", "seed").json(path, ignoreNullFields=True)


def guarded(df: DataFrame, review: DataFrame, path: str, allow: bool = False) -> bool:
    """Write df as Parquet unless rows wait for review; whether it was written."""
    if not allow and not review.isEmpty():
        return False
    df.write.parquet(path)
    return True


def chat(prompt: str, answer: str, system: str | None = None) -> Column:
    """A JSON record of messages: system if given, user, assistant."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = [said("system", F.lit(system))] if system else []
    return F.to_json(F.struct(F.array(*head, said("user", F.col(prompt)), said("assistant", F.col(answer))).alias("messages")))


def turns(prompt: str, answer: str) -> Column:
    """The other dialect: contents of user and model with parts."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.col(text).alias("text"))).alias("parts"))
    return F.to_json(F.struct(F.array(said("user", prompt), said("model", answer)).alias("contents")))


def json_lines(df: DataFrame, record: Column, path: str) -> None:
    df.select(record.alias("value")).write.text(path)


def speech_manifest(df: DataFrame, path: str) -> None:
    """JSON lines (audio_filepath, duration, text)."""
    json_lines(df, F.to_json(F.struct("audio_filepath", "duration", "text")), path)


def aligned(df: DataFrame, index: str, columns: list[str], path: str, parts: int | None = None) -> None:
    """One folder a column, in it a folder _part=k with one file for each range of the index. File k of every column has the same rows in the same order.

    Ranges are drawn once and stored with the rows, so that every column is written by the same ones. Null is an empty line; line feeds inside values are escaped.
    """
    whole = in_ranges(df.select(index, *columns), [index], parts)
    for c in columns:
        line = escape_controls(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("value")
        whole.select("_part", "_at", line).repartition("_part").sortWithinPartitions("_part", "_at").select("_part", "value").write.partitionBy("_part").text(f"{path}/{c}")


def ordered_lines(rows: DataFrame, path: str) -> None:
    """(section, part, place, line) as text, part files in order; line feeds inside a line are escaped. A report of few rows is one file."""
    rows.orderBy("section", "part", "place").select(escape_controls(F.col("line")).alias("value")).write.text(path)


def paragraph(df: DataFrame, order: str, text: str, path: str) -> None:
    """All texts that aren't blank, stripped, in order and joined by spaces. Part files follow each other; each ends with the space before the next."""
    said = F.regexp_replace(F.col(text), "^\\s+|\\s+$", "").alias("value")
    df.select(order, said).filter("value <> ''").orderBy(order).select("value").write.option("lineSep", " ").text(path)


def checkpointed(done: DataFrame, url: str, path: str) -> None:
    """Add the urls of what is done to a checkpoint, a folder of text lines that only grows; a lost run's files aren't committed."""
    done.select(F.trim(url).alias("value")).filter("value <> ''").write.mode("append").text(path)


def arpa(model: DataFrame, path: str) -> None:
    """A model (n, gram, logprob, backoff) as one file: counts, then a section for each order. Entries are sorted by ranges and written by one task after the sort, as a file has an order."""
    order = model.groupBy("n").agg(F.count("*").alias("c"))
    head = order.select(F.col("n").cast("int").alias("s"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("ngram "), F.col("n").cast("string"), F.lit("="), F.col("c").cast("string")).alias("value")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("\\"), F.col("n").cast("string"), F.lit("-grams:")).alias("value")))).alias("e"))
    head = head.select(F.when(F.col("e.k") == 0, 0).otherwise(F.col("s")).alias("section"), F.col("e.k").alias("k"), F.when(F.col("e.k") == 0, F.col("s").cast("string")).otherwise("").alias("gram"), "e.value")
    entry = F.concat_ws("\t", F.col("logprob").cast("string"), "gram", F.when(F.col("backoff") != 0, F.col("backoff").cast("string")))
    rows = model.select(F.col("n").cast("int").alias("section"), F.lit(2).alias("k"), "gram", entry.alias("value"))
    ends = model.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("k"), F.lit("").alias("gram"), F.lit(v).alias("value")) for s, k, v in ((-1, 0, "\\data\\"), (1 << 30, 0, "\\end\\"))])))
    head.unionByName(rows).unionByName(ends).orderBy("section", "k", "gram").select("value").coalesce(1).write.text(path)


def piped(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="|", header=header, quote="")


def union_of_keys(tables: list[DataFrame], path: str) -> None:
    """All rows as CSV with the sorted union of their columns; a missing cell is empty."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    whole.select(*sorted(whole.columns)).write.csv(path, header=True, escape='"', emptyValue="", nullValue="")


def summary(df: DataFrame, by: str) -> DataFrame:
    """One JSON document: rows in all and for each value of `by`."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("key"), F.col("n").alias("value"))))  # groups, not rows
    return n.agg(F.to_json(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(entries).alias("by"))).alias("value"))


def mean_and_deviation(mean: Column, deviation: Column, digits: int = 2) -> Column:
    """A table's cell: mean±deviation, a dash without a mean."""
    form = lambda x: F.format_string(f"%.{digits}f", x)
    return F.when(mean.isNull(), "-").when(deviation.isNull(), form(mean)).otherwise(F.concat(form(mean), F.lit("±"), form(deviation)))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\|", "\\\\|") for c in cells]), F.lit(" |"))
