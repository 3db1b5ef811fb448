"""Tables written by each writer into the shared folder and read again by each reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.ngram_models import read_arpa
from quern.queries.measures import GRAMS, model
from quern.queries.registry import PAIRS, pairs, query, table
from quern.scratch import scratch_path
from quern.sources import containers as C
from quern.sources import readers as R
from quern.sources import writers as W


def _folder(spark, name):
    return scratch_path(spark, name)


_PAIRS = f"WITH {PAIRS} SELECT {{}} FROM pairs WHERE trim(src) <> '' AND trim(tgt) <> ''"


@query(_PAIRS.format("src, tgt, ord::VARCHAR AS ord"))
def snk_pair_files(spark, sf_dir):
    """Quotes and line feeds survive the CSV."""
    path = _folder(spark, "pairs")
    W.pair_files(pairs(spark, sf_dir).select("ord", "src", "tgt"), path)
    return R.pair_csv(spark, f"{path}/csv").select("src", "tgt", "ord")


@query(_PAIRS.format("replace(replace(replace(src, chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') AS src, replace(replace(replace(tgt, chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') AS tgt"))
def src_pair_tsv(spark, sf_dir):
    path = _folder(spark, "pairs")
    W.pair_files(pairs(spark, sf_dir).select("ord", "src", "tgt"), path)
    return R.pair_tsv(spark, f"{path}/tsv")


@query("SELECT n_name AS src, r_name AS tgt FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_pick_any_case(spark, sf_dir):
    """Columns SOURCE and Target are found in any case."""
    path = _folder(spark, "cased")
    r = table(spark, sf_dir, "region")
    table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("Target"), F.col("n_name").alias("SOURCE")).write.csv(path, header=True)
    t = spark.read.csv(path, header=True)
    a, b = R.pick_any_case(t.columns)
    return t.select(F.col(a).alias("src"), F.col(b).alias("tgt"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def src_tagged_union(spark, sf_dir):
    """One folder of files, each row with the name of its file; all names are those of written parts."""
    path = _folder(spark, "union")
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(3).write.csv(path, header=True)
    t = R.tagged_union(spark, path)
    return t.filter(F.col("_source").rlike("^part-.*[.]csv$")).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part")
def src_records(spark, sf_dir):
    path = _folder(spark, "records") + ".jsonl"
    W.json_lines(table(spark, sf_dir, "part"), F.to_json(F.struct("p_partkey", "p_name")), path)
    return R.records(spark, path, ["p_partkey", "p_name"]).select("p_partkey", "p_name")


@query("SELECT p_name AS src, p_type AS ref, p_brand AS pred FROM part WHERE p_partkey % 4 <> 0")
def src_predictions(spark, sf_dir):
    """Every fourth line has two fields only and goes."""
    path = _folder(spark, "predictions")
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat_ws("\t", "p_name", "p_type")).otherwise(F.concat_ws("\t", "p_name", "p_type", "p_brand", F.lit("more")))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return R.predictions(spark, path)


@query("SELECT s_nationkey::BIGINT AS idx, max(s_suppkey) AS key FROM supplier GROUP BY 1")
def src_last_by_index(spark, sf_dir):
    """Lines of one file in the order of their keys; the last of each index stays."""
    path = _folder(spark, "indexed")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_nationkey").alias("idx"), F.col("s_suppkey").alias("key"))).alias("value"))
    s.coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)  # one file on purpose: lines of a file have an order
    return R.last_by_index(spark, path).select("idx", "key")


@query("SELECT 'a' || p_partkey AS id, p_name AS text FROM part WHERE p_partkey % 5 <> 0")
def src_manifest(spark, sf_dir):
    """Every fifth line has a blank text and goes."""
    path = _folder(spark, "manifest")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_name")).alias("text"))
    W.escaped_tsv(p, path)
    return R.manifest(spark, path, ["id", "text"]).select("id", "text")


@query("SELECT r_regionkey, r_name FROM region")
def src_first_column(spark, sf_dir):
    """The text's column is the first candidate that is there."""
    t = table(spark, sf_dir, "region")
    return t.select("r_regionkey", F.col(R.first_column(t, ["sentence", "r_name", "r_comment"])).alias("r_name"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 100)::VARCHAR WHEN c_custkey % 3 = 1 THEN 'n' || c_custkey END AS code, CASE c_custkey % 3 WHEN 0 THEN c_nationkey ELSE c_custkey END::DOUBLE AS number FROM customer")
def src_drifting(spark, sf_dir):
    """Files with and without a column, of which two are numbers in one file and text or fractions in the next, and one with an index that its writer left."""
    path = _folder(spark, "drift")
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    c.filter(k % 3 == 0).select("c_custkey", "c_name", (k % 100).cast("int").alias("code"), F.col("c_nationkey").cast("int").alias("number")).write.parquet(path)
    c.filter(k % 3 == 1).select("c_custkey", "c_name", F.concat(F.lit("n"), k.cast("string")).alias("code"), k.cast("double").alias("number"), F.lit(0).alias("__index_level_0__")).write.mode("append").parquet(path)
    c.filter(k % 3 == 2).select("c_custkey", "c_name", k.cast("long").alias("number")).write.mode("append").parquet(path)
    return R.drifting(spark, path).select("c_custkey", "c_name", "code", "number")


@query("SELECT p_name AS src, CASE WHEN p_partkey % 10 = 0 THEN 'nan' WHEN p_partkey % 10 = 1 THEN p_size::VARCHAR ELSE p_type END AS tgt FROM part")
def src_sheets(spark, sf_dir):
    """Workbooks of 500 rows each, with numbers and absent cells; their bytes are read as those of files are. Columns are found by name in every second one, by place in the others."""
    target = F.when(F.col("p_partkey") % 10 == 1, F.col("p_size").cast("string")).when(F.col("p_partkey") % 10 != 0, F.col("p_type"))
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 500).alias("book"), "p_name", target.alias("t"), (F.col("p_partkey") % 10 == 1).alias("number"))

    def book(pdf):
        import pandas as pd

        named = int(pdf["book"].iloc[0]) % 2 == 0
        lines = [[7, int(t) if n else t, name] if named else [name, int(t) if n else t] for name, t, n in zip(pdf["p_name"], pdf["t"], pdf["number"])]
        return pd.DataFrame({"path": [f"book{pdf['book'].iloc[0]}"], "content": [C.sheet_bytes([["id", "Target", " SOURCE"] if named else ["a", "b"], *lines])]})

    books = rows.groupBy("book").applyInPandas(book, "path string, content binary")  # 500 rows a group
    return C.sheet_pairs(C.parts(books)).select("src", "tgt")


@query("SELECT 'pairs' AS kind, p_name AS src, p_brand AS tgt FROM part WHERE (p_partkey // 500) % 3 <> 2 OR p_partkey % 5 <> 4 UNION ALL SELECT 'doubtful', p_name, split_part(p_name, ' ', 1) FROM part WHERE (p_partkey // 500) % 3 = 2 AND p_partkey % 5 = 4")
def src_documents(spark, sf_dir):
    """Documents of 500 rows each: tables, lines with colons, and lines that only the words' languages can part. Every fifth of the last has words of one side only and stays doubtful."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.floor(F.col("p_partkey") / 500).alias("book"), "p_partkey", "p_name", "p_brand")

    def document(pdf):
        import pandas as pd

        k = int(pdf["book"].iloc[0])
        pairs = list(zip(pdf["p_partkey"], pdf["p_name"], pdf["p_brand"]))
        if k % 3 == 0:
            content = C.document_bytes([[["Source", "Target"], *[[a, b] for _, a, b in pairs]]], ["a paragraph: not read"])
        elif k % 3 == 1:
            content = C.document_bytes([], [f"{n + 1}. 2) {a} - : {b}" for n, (_, a, b) in enumerate(pairs)])
        else:
            content = C.document_bytes([], [f"{n + 1}) {a} {a.split(' ')[0] if key % 5 == 4 else b}" for n, (key, a, b) in enumerate(pairs)])
        return pd.DataFrame({"path": [f"document{k}"], "content": [content]})

    books = rows.groupBy("book").applyInPandas(document, "path string, content binary")  # 500 rows a group
    words = lambda c: part.select(F.explode(F.split(c, " ")).alias("word"))
    pairs, doubtful = C.document_pairs(C.parts(books), words("p_name"), words("p_brand"), "#", least=3.0)
    # a name with its first word again is all of the source's words: the best cut leaves one for the target
    said = doubtful.select(F.lit("doubtful").alias("kind"), F.regexp_replace("line", " \\S+$", "").alias("src"), F.regexp_extract("line", "(\\S+)$", 1).alias("tgt"))
    return pairs.select(F.lit("pairs").alias("kind"), "src", "tgt").unionByName(said)


@query("SELECT 'c' || (s_nationkey % 3) AS condition, (s_suppkey % 4)::INT AS seed, count(*) AS n FROM supplier GROUP BY ALL")
def src_listed(spark, sf_dir):
    """Metrics of runs in a tree of folders, beside other files: paths are listed by suffix and say the run, then their files are read."""
    path = _folder(spark, "tree")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), (F.col("s_nationkey") % 3).cast("string")).alias("condition"), (F.col("s_suppkey") % 4).alias("seed"))
    runs = s.groupBy("condition", "seed").agg(F.count("*").alias("n"))
    row = runs.select("condition", F.concat(F.lit("seed"), F.col("seed").cast("string")).alias("seed"), F.to_json(F.struct("n")).alias("value"))
    row.repartition("condition", "seed").write.partitionBy("condition", "seed").text(path)
    row.repartition("condition", "seed").write.mode("append").partitionBy("condition", "seed").option("compression", "gzip").text(path)
    found = R.listed(spark, path, ".txt").withColumn("_path", F.regexp_replace("path", "/(condition|seed)=", "/"))
    found = R.with_run(found).select("condition", "seed", F.substring_index("path", "/", -1).alias("name"))
    said = spark.read.schema("n long").option("pathGlobFilter", "*.txt").json(path).select(F.col("_metadata.file_name").alias("name"), "_metadata.file_path", "n")
    return said.select("n", F.regexp_extract("file_path", "condition=([^/]+)/seed=seed(\\d+)/", 1).alias("condition"), F.regexp_extract("file_path", "seed=seed(\\d+)/", 1).cast("int").alias("seed")).join(found.select("condition", "seed").distinct(), ["condition", "seed"])


@query(f"WITH {GRAMS} SELECT * FROM m WHERE n < 3")
def src_arpa(spark, sf_dir):
    """A model written as one file of sections, with its counts, and read again; the counts are checked."""
    path = _folder(spark, "arpa")
    W.arpa(model(spark, sf_dir).filter("n < 3"), path)
    return read_arpa(spark, path).select(F.col("n").cast("long").alias("n"), "gram", "logprob")


@query("SELECT c_name AS text FROM customer WHERE c_custkey % 4 < 2 UNION ALL SELECT c_mktsegment FROM customer WHERE c_custkey % 4 = 2")
def src_usable_texts(spark, sf_dir):
    """Entries whose text stands under one of three names, an empty one giving way to the next; every fourth line isn't an object and goes."""
    path = _folder(spark, "entries")
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    line = F.when(k == 0, F.to_json(F.struct(name.alias("text")))).when(k == 1, F.to_json(F.struct(F.lit("").alias("text"), name.alias("target_text")))).when(k == 2, F.to_json(F.struct(F.lit("").alias("text"), F.col("c_mktsegment").alias("prompt"))))
    table(spark, sf_dir, "customer").select(F.coalesce(line, F.concat(F.lit('{"text": "'), name)).alias("value")).write.text(path)
    return R.usable_texts(spark, path).select("text")


@query("SELECT n_nationkey, 'seed' || (n_nationkey % 3) AS condition, (n_nationkey % 5)::INT AS seed, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM nation")
def snk_by_run(spark, sf_dir):
    """Records in folders of their run; nulls aren't written."""
    path = _folder(spark, "runs")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("e").alias("experiment"), F.concat(F.lit("seed"), (F.col("n_nationkey") % 3).cast("string")).alias("condition"), (F.col("n_nationkey") % 5).alias("seed"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"))
    W.by_run(n, path)
    return spark.read.schema("n_nationkey bigint, name string, experiment string, condition string, seed int").json(path).select("n_nationkey", "condition", "seed", "name")


@query("SELECT 'refused' AS outcome, count(*) AS rows FROM region UNION ALL SELECT 'written', count(*) FROM nation")
def snk_guarded(spark, sf_dir):
    """With rows for review nothing is written, without them or when allowed all is."""
    path, r, n = _folder(spark, "guarded"), table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    refused = not W.guarded(n, r, path)
    written = W.guarded(n, r.limit(0), path) and not W.guarded(n, r, f"{path}-2") and W.guarded(n, r, f"{path}-3", allow=True)
    return r.agg(F.lit("refused" if refused else "no").alias("outcome"), F.count("*").alias("rows")).unionByName(spark.read.parquet(path).agg(F.lit("written" if written else "no").alias("outcome"), F.count("*").alias("rows")))


@query("SELECT (SELECT count(*) FROM orders) AS total, count(*) AS n, o_orderpriority AS key FROM orders GROUP BY o_orderpriority")
def snk_summary(spark, sf_dir):
    """The JSON document of counts, taken apart again."""
    s = W.summary(table(spark, sf_dir, "orders"), "o_orderpriority").select(F.from_json("value", "total bigint, by map<string,bigint>").alias("s"))
    return s.select("s.total", F.explode("s.by").alias("key", "n"))


@query("SELECT p_name AS audio_filepath, p_retailprice AS duration, p_type AS text FROM part")
def snk_speech_manifest(spark, sf_dir):
    path = _folder(spark, "speech")
    W.speech_manifest(table(spark, sf_dir, "part").select(F.col("p_name").alias("audio_filepath"), F.col("p_retailprice").alias("duration"), F.col("p_type").alias("text")), path)
    return spark.read.schema("audio_filepath string, duration double, text string").json(path)


@query("SELECT c_name AS audio_file, c_mktsegment AS text FROM customer")
def snk_piped(spark, sf_dir):
    path = _folder(spark, "piped")
    W.piped(table(spark, sf_dir, "customer").select(F.col("c_name").alias("audio_file"), F.col("c_mktsegment").alias("text")), path)
    return spark.read.csv(path, sep="|", header=True)


@query("SELECT r_name, NULL AS n_name, r_regionkey::VARCHAR AS key FROM region UNION ALL SELECT NULL, n_name, n_nationkey::VARCHAR FROM nation")
def snk_union_of_keys(spark, sf_dir):
    path = _folder(spark, "keys")
    W.union_of_keys([table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("key")), table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("key"))], path)
    t = spark.read.csv(path, header=True)
    assert t.columns == sorted(t.columns)
    return t.select("r_name", "n_name", "key")


@query("SELECT p_partkey::VARCHAR AS a, p_name AS b FROM part")
def snk_aligned(spark, sf_dir):
    """Two files of each range with the same lines in the same order, put side by side by place."""
    path = _folder(spark, "aligned")
    W.aligned(table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("a"), F.col("p_name").alias("b")), "p_partkey", ["a", "b"], path, parts=7)
    return R.aligned_lines(spark, path, ["a", "b"]).select("a", "b")


@query("SELECT 'model-b' AS model, 'exp' || (s_nationkey % 2) AS experiment, 'C' || (s_nationkey % 4) AS condition, (s_suppkey % 5)::INT AS seed, s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def src_run_paths(spark, sf_dir):
    """Listed paths of which every third has no seed and goes."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/r/model-b/exp"), (F.col("s_nationkey") % 2).cast("string"), F.lit("/C"), (F.col("s_nationkey") % 4).cast("string"), F.when(k % 3 == 0, "/test_metrics.json").otherwise(F.concat(F.lit("/seed"), (k % 5).cast("string"), F.lit("/test_metrics.json"))))
    return R.with_run(table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("_path"))).select("model", "experiment", "condition", "seed", "s_suppkey")


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'nllb' ELSE 'paper-local' END AS model, CASE WHEN s_suppkey % 4 = 0 THEN 'reverse' ELSE 'forward' END AS direction, 'C' || (s_nationkey % 4) AS condition, (s_suppkey % 5)::INT AS seed, s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0")
def src_result_paths(spark, sf_dir):
    """Listed paths of two layouts below a result root, with a folder for the reverse direction; others go."""
    k = F.col("s_suppkey")
    part = lambda test, text: F.when(test, F.lit(text)).otherwise("")
    path = F.concat(F.when(k % 7 == 0, "/elsewhere/").otherwise("/data/results/"), part(k % 3 == 0, "nllb/"), part(k % 4 == 0, "reverse/"), F.lit("exp1/C"), (F.col("s_nationkey") % 4).cast("string"), F.lit("/seed_"), (k % 5).cast("string"), F.lit("/metrics.json"))
    return R.with_result(table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("_path")), ["nllb", "mt5"]).select("model", "direction", "condition", "seed", "s_suppkey")
