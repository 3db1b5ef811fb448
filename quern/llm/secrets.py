"""Secret scans over an incremental ledger of blobs. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.scratch import materialize


@dataclass(frozen=True)
class Rule:
    """pattern in Java's syntax, without capturing groups. Where shorter matches can't hide a finding, the pattern has the least length itself."""

    kind: str
    pattern: str
    least: int
    #: Of a match, what `least` is measured on: "" the whole, else a pattern whose first group is measured.
    part: str = ""
    base: bool = True
    #: Lower-case strings of which every text with a match has one.
    marks: tuple[str, ...] = ()


_WORDS, _VALUE = "(?:password|passwd|secret|token|api_?key)", "[A-Za-z0-9+/_.=-]"
_ASSIGN = f"""(?i:{_WORDS})["']?\\x20*[:=]\\x20*["']?"""
#: A private key from BEGIN through END, or, without END, header lines and base64 up to where they stop: runs of 16 or more, then a shorter one that is padded or a line of its own.
#: Between runs are white space, quotes, marks of quoted lines, or line feeds that are written as escapes. No step backs into the one before it, so long texts cost one pass.
_BREAK = r"""(?:[\s>"',#*|]|\\+[nrt])"""
_TO_END = r"(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
_HEADERS = rf"(?:{_BREAK}*+[A-Za-z][A-Za-z0-9-]*+:\x20[^\n\\]*+(?=\n|\\)){{0,8}}+"
_RUNS = rf"(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)"
_LAST = rf"(?:{_BREAK}*+[A-Za-z0-9+/]{{1,15}}+={{1,2}}|{_BREAK}*+(?<=\n)[A-Za-z0-9+/]{{1,15}}+(?=[\x20\t\r]*+(?:\n|\z)))"
_PRIVATE = f"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_HEADERS}{_RUNS}++{_LAST}?+)?+"
#: The kinds in the order that ties of a start follow. Base kinds first, then those that the method adds.
RULES = (
    Rule("assign", f"{_ASSIGN}{_VALUE}+", 8, f"^{_ASSIGN}({_VALUE}+)$", marks=("passw", "secret", "token", "api")),
    Rule("access", "AKIA[A-Z0-9]{12,}", 16, marks=("akia",)),
    Rule("hex", "[0-9a-f]{32,}", 32),
    Rule("private_key", _PRIVATE, 1, base=False, marks=("private key-----",)),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40, base=False, marks=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20, base=False, marks=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30, base=False, marks=("eyj",)),
)
RULE_VERSION = "1.1"
#: Hashes of blobs, of some 30 bytes, and blobs with findings that may be broadcast.
BROADCAST_HASHES, BROADCAST_FINDINGS = 4_000_000, 200_000
LEDGER_SCHEMA = "blob string, rule_version string, findings array<struct<kind:string,ord:int,base:boolean,start:int,end:int>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Findings of one rule: leftmost matches that don't overlap, in code points, from the pieces between matches and the matches."""
    pattern = f"(?:{rule.pattern})"
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("match"))
    ok = lambda m: F.length(F.regexp_extract(m, rule.part, 1) if rule.part else m) >= rule.least
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,ord:int,base:boolean,start:int,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:  # the last piece has a gap and no match
        start = s["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(F.lit(rule.kind).alias("kind"), F.lit(order).alias("ord"), F.lit(rule.base).alias("base"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(ok(x["match"]), F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, state, step, lambda s: s["out"])


def _possible(text: Column, lowered: Column, rule: Rule) -> Column:
    """Cheap tests first: few texts have a rule's marks, and fewer its pattern."""
    has = text.rlike(rule.pattern)
    for k, mark in enumerate(rule.marks):
        any_ = lowered.contains(mark) if not k else any_ | lowered.contains(mark)
    return any_ & has if rule.marks else has


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """blobs (blob, text) to LEDGER_SCHEMA. findings are sorted by start, then by the rules' order. Null text has none."""
    text, lowered = F.col("text"), F.col("_lowered")
    blobs = blobs.select("blob", "text", F.lower("text").alias("_lowered"))
    quick = [F.when(_possible(text, lowered, r), _spans(text, r, k)) for k, r in enumerate(rules)]
    empty = F.array().cast("array<struct<kind:string,ord:int,base:boolean,start:int,end:int>>")
    all_ = F.concat(*[F.coalesce(q, empty) for q in quick])
    key = lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["base"].alias("base"), x["end"].alias("end"))
    back = lambda x: F.struct(x["kind"].alias("kind"), x["ord"].alias("ord"), x["base"].alias("base"), x["start"].alias("start"), x["end"].alias("end"))
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), F.transform(F.array_sort(F.transform(all_, key)), back).alias("findings"))


def address(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """path, blob: the content address (sha-256 of the UTF-8 bytes) of each version; null text is the empty blob."""
    return versions.select(path_col, *(extra or []), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("blob"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """Ledger rows to append: one for each blob of versions that the ledger doesn't have under this rule version.

    Addresses alone are counted and compared with the ledger, whatever its size. Texts of unseen blobs are picked where they are read, by a broadcast of the hashes of their addresses, or of known addresses where those are few;
    those of blobs that one path has are scanned there too. Only texts of shared blobs are exchanged, so that each is scanned once: copies meet within their task first, and a blob of a third of all rows is a row for each task.
    Beyond BROADCAST_HASHES unseen blobs in one delivery, and more than a few known ones among its paths, its unseen texts are picked by an exchange; beyond as many shared blobs all of them go the way of shared ones.
    """
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    counts = address(versions, text_col, text_col).groupBy("blob").agg(F.count("*").alias("n"))
    rows = versions.select(blob.alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        ledgered = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct().withColumn("_known", F.lit(True))
        counts = materialize(counts.join(ledgered, "blob", "left").select("blob", "n", F.coalesce("_known", F.lit(False)).alias("known")), "counts")
        known, unseen = counts.filter("known").select("blob"), counts.filter("NOT known")
        if known.count() <= BROADCAST_HASHES // 8:
            rows = rows.join(F.broadcast(known), "blob", "left_anti")
        elif unseen.count() <= BROADCAST_HASHES:
            # a known blob whose hash an unseen one has by chance is scanned again; the ledger's readers take each blob once
            rows = rows.withColumn("_h", F.xxhash64("blob")).join(F.broadcast(unseen.select(F.xxhash64("blob").alias("_h")).distinct()), "_h", "left_semi").drop("_h")
        else:
            rows = rows.join(unseen.select("blob"), "blob", "left_semi")
        counts = unseen
    # a hash of the address tells rows apart well enough here: one that shares it by chance is exchanged like a copy
    shared = materialize(counts.filter("n > 1").select(F.xxhash64("blob").alias("_h")).distinct(), "shared")
    if shared.count() > BROADCAST_HASHES:
        return scan_blobs(rows.dropDuplicates(["blob"]), rules, rule_version)
    rows = rows.withColumn("_h", F.xxhash64("blob"))
    alone = rows.join(F.broadcast(shared), "_h", "left_anti").drop("_h")
    copies = rows.join(F.broadcast(shared), "_h", "left_semi").drop("_h").dropDuplicates(["blob"])
    return scan_blobs(alone, rules, rule_version).unionByName(scan_blobs(copies, rules, rule_version))


def _sized(df: DataFrame, most: int) -> DataFrame:
    """df, a written table, to be broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def append(versions: DataFrame, path: str, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """Scan what the ledger in the folder `path` lacks and append it there; the whole ledger. A folder without a table is an empty ledger, begun here.

    Appended rows are those of one write, so a run that fails leaves the ledger as it was.
    """
    spark = versions.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    begun = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(path) if begun else None
    update_ledger(versions, ledger, rule_version=rule_version, text_col=text_col).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def join_findings(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, path_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """path, extra columns and findings of every version. Only blobs with findings are joined, by a broadcast up to BROADCAST_FINDINGS of them; beyond, AQE splits what copies skew."""
    known = _sized(materialize(_with_findings(ledger, rule_version), "findings"), BROADCAST_FINDINGS)
    empty = F.array().cast("array<struct<kind:string,ord:int,base:boolean,start:int,end:int>>")
    return address(versions, path_col, text_col, extra).join(known, "blob", "left").withColumn("findings", F.coalesce("findings", empty)).drop("blob")


def _with_findings(ledger: DataFrame, rule_version: str) -> DataFrame:
    return ledger.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])


def _joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Blobs that `ledger` has, or the ledger kept in the folder `path`, aren't scanned again; what is new is appended to the latter.
    Spans are kind:start:end in code points, end exclusive, by start and then by the order of RULES, joined by commas; base_sha256 is the digest of those of base kinds.
    Null text is the empty blob without spans. Null, repeated ids and repeated rows each give a row. Other columns of docs are ignored. An empty table gives an empty one.
    """
    if path is not None:
        known = append(docs, path, text_col=text_col)
    else:
        new = materialize(update_ledger(docs, ledger, text_col=text_col), "ledger")
        known = new if ledger is None else ledger.unionByName(new)
    f = F.col("findings")
    count = lambda kind: F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.filter(f, lambda x: x["base"]))
    return join_findings(docs, known, path_col=id_col, text_col=text_col).select(
        id_col, count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(f).alias("spans")
    )


def redact(versions: DataFrame, columns: list[str], ledger: DataFrame | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """versions with every finding in text replaced by `mark`; overlapping findings are one. Rows without findings stay as they are."""
    new = materialize(update_ledger(versions, ledger, text_col=text_col), "ledger")
    known = new if ledger is None else ledger.unionByName(new)
    found = _sized(materialize(_with_findings(known, RULE_VERSION).select(F.col("blob").alias("_blob"), F.col("findings").alias("_findings")), "findings"), BROADCAST_FINDINGS)
    text = F.col(text_col)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hidden = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), hidden.alias("out"))

    cut = F.aggregate("_findings", state, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    blob = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    joined = versions.withColumn("_blob", blob).join(found, "_blob", "left")
    return joined.withColumn(text_col, F.when(F.col("_findings").isNotNull(), cut).otherwise(text)).select(*columns)
