"""Readers of pair tables, predictions and manifests. Schemas are given or found from the header, never from the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import is_blank

#: Headers that mean the source and the target.
SOURCE_NAMES, TARGET_NAMES = ("French", "french", "src", "source"), ("Translation", "adja_translation", "tgt", "target")


def pick(columns: list[str], names: tuple[str, ...]) -> str:
    """The first of names that is a column; an error if none is."""
    for name in names:
        if name in columns:
            return name
    raise ValueError(f"none of {names} among {columns}")


def pair_csv(spark: SparkSession, path: str, source: tuple[str, ...] = SOURCE_NAMES, target: tuple[str, ...] = TARGET_NAMES) -> DataFrame:
    """(src, tgt, ...) of a CSV with a header. Null sides and blank targets go; a blank source stays."""
    t = spark.read.csv(path, header=True, multiLine=True, escape='"')
    t = t.withColumnsRenamed({pick(t.columns, source): "src", pick(t.columns, target): "tgt"})
    return t.filter(F.col("src").isNotNull() & ~is_blank(F.col("tgt")))


def pair_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt) of a TSV without a header; both sides are filled. NA and null are texts."""
    t = spark.read.schema("src string, tgt string").csv(path, sep="\t", quote="", nullValue="\u0001")
    return t.filter(~is_blank(F.col("src")) & ~is_blank(F.col("tgt")))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(src, ref, pred) of lines with three fields or more; shorter lines go."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 3)
    return f.select(*[F.col("f")[k].alias(n) for k, n in enumerate(("src", "ref", "pred"))])


def tagged_union(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files under path with the name of each row's file in _source."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("_source", F.col("_metadata.file_name"))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df


def pick_any_case(columns: list[str]) -> tuple[str, str]:
    """The source and target columns by name in any case, else the first two."""
    low = {c.lower().strip(): c for c in columns}
    found = [next((low[n.lower()] for n in names if n.lower() in low), None) for names in (SOURCE_NAMES, TARGET_NAMES)]
    if None not in found:
        return found[0], found[1]
    if len(columns) < 2:
        raise ValueError("two columns are needed")
    return columns[0], columns[1]


def tabular(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV with a header, by suffix, as strings; nulls are the text nan."""
    if not path.endswith((".csv", ".tsv")):
        raise ValueError(f"no reader for {path}")
    t = spark.read.csv(path, header=True, multiLine=True, escape='"', sep="\t" if path.endswith(".tsv") else ",")
    return t.select(*[F.coalesce(F.col(c), F.lit("nan")).alias(c) for c in t.columns])


def records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """JSON, JSON lines, CSV or TSV by suffix; an error for a missing column or no rows."""
    t = tabular(spark, path) if path.endswith((".csv", ".tsv")) else spark.read.json(path, multiLine=not path.endswith(".jsonl"))
    if required(t, columns).isEmpty():
        raise ValueError(f"no rows in {path}")
    return t


def last_by_index(spark: SparkSession, path: str, index: str = "idx") -> DataFrame:
    """JSON lines, the last line of each index. Lines of one file are ordered by their place in it."""
    t = spark.read.json(path).withColumn("_at", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    names = [c for c in t.columns if c not in (index, "_at")]
    return t.groupBy(index).agg(F.max_by(F.struct(*names), "_at").alias("_r")).select(index, "_r.*")


def metric_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """JSON files root/model/experiment/condition/seedN/name with what their paths say; others are skipped."""
    t = spark.read.json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter=name)
    return with_run(t.withColumn("_path", F.col("_metadata.file_path"))).drop("_path")


def with_run(df: DataFrame, path: str = "_path") -> DataFrame:
    """df with model, experiment, condition and seed of a path .../model/experiment/condition/seedN/file; rows of other paths go."""
    form = "([^/]+)/([^/]+)/([^/]+)/seed_?(\\d+)/[^/]+$"
    part = lambda k: F.regexp_extract(path, form, k)
    return df.filter(F.col(path).rlike(form)).withColumns({"model": part(1), "experiment": part(2), "condition": part(3), "seed": part(4).cast("int")})


def with_result(df: DataFrame, models: list[str], path: str = "_path", root: str = "results", local: str = "paper-local") -> DataFrame:
    """df with model, direction, experiment, condition and seed of a path .../results/[model/][reverse/]experiment/condition/seedN/file; rows of other paths go.

    The first folder below the root is the model if it is a known one, else the model is `local`; a folder named reverse follows, or the direction is forward.
    """
    form = f"(?:^|/){root}/(?:({'|'.join(models)})/)?(?:(reverse)/)?([^/]+)/([^/]+)/seed_?(\\d+)/[^/]+$"
    part = lambda k: F.regexp_extract(path, form, k)
    named = lambda k, default: F.coalesce(F.nullif(part(k), F.lit("")), F.lit(default))
    return df.filter(F.col(path).rlike(form)).withColumns({"model": named(1, local), "direction": named(2, "forward"), "experiment": part(3), "condition": part(4), "seed": part(5).cast("int")})


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of first, else that of second; columns that one lacks are null."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """TSV with a header; lines in which one of the columns is missing or blank go."""
    t = required(spark.read.csv(path, header=True, sep="\t", quote="", mode="PERMISSIVE"), columns)
    for c in columns:
        t = t.filter(~is_blank(F.col(c)))
    return t


def listed(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, length) of the files below root whose path ends so. Folders are listed by tasks where there are many, names are filtered before anything is opened, and no content is read."""
    name = suffix.rsplit("/", 1)[-1]
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{name}").load(root)
    return t.select("path", "length").filter(F.col("path").endswith(suffix))


#: Types of which each holds all values of those before.
WIDTHS = ("tinyint", "smallint", "int", "bigint", "double")


def wider(types: list[str]) -> str:
    """A type for the values of all: the widest of numbers, else string."""
    kinds = {"double" if t == "float" else t for t in types}
    if len(kinds) == 1:
        return kinds.pop()
    if kinds == {"date", "timestamp"}:
        return "timestamp"
    return WIDTHS[max(map(WIDTHS.index, kinds))] if kinds <= set(WIDTHS) else "string"


def by_schema(spark: SparkSession, files: list[str]) -> list[tuple[list[str], dict[str, str]]]:
    """Runs of files, by name, whose schemas go together, and the columns of each. Tasks read the footers of a run; a run that doesn't go together is halved, so that the jobs follow the number of changes and not of files."""
    try:
        return [(files, dict(spark.read.option("mergeSchema", True).parquet(*files).dtypes))]
    except AnalysisException as e:
        unlike = e
    except Exception as e:  # an error of the task that merges footers comes as that of its job
        if "CANNOT_MERGE" not in str(e) and "Failed merging schema" not in str(e):
            raise
        unlike = e
    if len(files) == 1:
        raise unlike
    half = len(files) // 2
    return by_schema(spark, files[:half]) + by_schema(spark, files[half:])


def drifting(spark: SparkSession, path: str, extra: str = "__index_level_0__") -> DataFrame:
    """Parquet files whose schemas differ by columns and types, without the index column that some writers leave.

    Files of one schema are read together by their own; a column has a type that holds all its forms (numbers the widest, others text), and is null where a file lacks it.
    """
    files = sorted(r["path"] for r in listed(spark, path, ".parquet").select("path").toLocalIterator())
    if not files:
        return spark.read.parquet(path)
    groups: dict[tuple, list[str]] = {}
    for part, columns in by_schema(spark, files):
        groups.setdefault(tuple((c, t) for c, t in columns.items() if c != extra), []).extend(part)
    names = dict.fromkeys(c for g in groups for c, _ in g)
    kinds = {c: wider([t for g in groups for d, t in g if d == c]) for c in names}
    whole = [spark.read.option("mergeSchema", True).parquet(*part).select(*[(F.col(c) if c in dict(g) else F.lit(None)).cast(kinds[c]).alias(c) for c in names]) for g, part in groups.items()]
    return reduce(DataFrame.unionByName, whole)


def unfinished(records: DataFrame, url: str, checkpoint: str) -> DataFrame:
    """Records whose trimmed url isn't blank nor in the checkpoint that writers.checkpointed adds to; all of them where there is none yet."""
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    wanted = records.withColumn("_url", F.trim(url)).filter("_url <> ''")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        done = spark.read.text(checkpoint).select(F.trim("value").alias("_url")).filter("_url <> ''").distinct()
        wanted = wanted.join(done, "_url", "left_anti")
    return wanted.drop("_url")


def usable_texts(spark: SparkSession, path: str, names: tuple[str, ...] = ("text", "target_text", "prompt")) -> DataFrame:
    """(text, entry) of JSON lines: the first of the names that has a text which isn't empty. Entries that aren't JSON objects, or have none, go."""
    t = spark.read.text(path).select(F.col("value").alias("entry"), F.from_json("value", ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE"}).alias("e"))
    return t.select(F.coalesce(*[F.nullif(F.col(f"e.{n}"), F.lit("")) for n in names]).alias("text"), "entry").filter(F.col("text").isNotNull() & F.trim("entry").startswith("{"))


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def paragraph_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(src, tgt) of text lines `source : target`, without list numbers, cut at the last colon; lines without one go."""
    from quern.functions.predicates import last_colon
    from quern.functions.text import strip_number

    cut = spark.read.text(path).select(last_colon(strip_number(F.col("value"))).alias("c")).filter("c IS NOT NULL")
    return cut.select(F.col("c.left").alias("src"), F.regexp_replace("c.right", "^[-–—|\\s]+", "").alias("tgt")).filter("src <> '' AND tgt <> ''")


def waveforms(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, rate) of WAV files under path; null samples for files that can't be decoded."""
    from quern.operators.audio import decode_wav

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return f.select("path", decode_wav("content").alias("w")).select("path", "w.samples", "w.rate")


def aligned_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(_part, line, one column each) of folders that writers.aligned has written: line k of file k of every folder is one row."""
    first, rest = None, []
    for c in columns:
        t = spark.read.schema("value string, _part int").text(f"{path}/{c}").select("_part", F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias(c))
        t = t.withColumn("line", F.row_number().over(Window.partitionBy("_part").orderBy("_s", "_i"))).drop("_s", "_i")  # a range, not all rows
        first, rest = (t, rest) if first is None else (first, [*rest, t])
    for t in rest:
        first = first.join(t, ["_part", "line"], "full")
    return first
