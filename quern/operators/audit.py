"""An audit of split lines: source words that were left at the start of the target side, and what else is wrong with a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.sentences import TARGET_LETTERS, has_placeholder, target_letters
from quern.functions.text import strip
from quern.operators.rows import keep_first

#: What a word is made of; letters that mark a source word; what is elided before an apostrophe; words that join a source phrase; short words that open a target phrase.
WORD_LETTERS = f"A-Za-zÀ-ÖØ-öø-ÿƷƸ{TARGET_LETTERS}'’.-"
SOURCE_LETTERS = "àâçéèêëîïôùûüÿœæ"
ELISIONS = ("c", "d", "j", "l", "m", "n", "qu", "s", "t")
CONNECTORS = (
    "a", "à", "au", "aux", "avec", "ce", "ces", "cet", "cette", "comme", "contre", "d", "dans", "de", "des", "du", "en", "et", "la", "le", "les", "lui", "ma", "me", "mes", "mon",
    "nous", "ou", "où", "pas", "pour", "qu", "que", "sa", "sans", "se", "ses", "son", "sur", "te", "ton", "une", "un",
)
TARGET_OPENERS = ("a", "be", "da", "de", "e", "ji", "le", "mi", "na", "nɔ", "sa", "se", "va", "wo", "yi")
#: The parse method that guesses the boundary; the others are told where it is.
GUESSED = "lexicon_split"
#: Names of the issues, in the order in which a row's issues stand; a caller may give others.
LABELS = {
    "letters": "target_letters_in_source", "prefix": "source_prefix_in_target", "incomplete": "incomplete_source", "placeholder": "placeholder", "empty": "empty_target", "evidence": "no_target_evidence",
}
ISSUE_KEY = ["source", "raw", "src", "tgt", "issue"]


def _word(piece: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.regexp_replace(piece, f"^[^{WORD_LETTERS}]+", "")), F.lit("’"), F.lit("'")), "^[.,;:!?()\\[\\]{}\"“”]+|[.,;:!?()\\[\\]{}\"“”]+$", "")


def source_prefix(lines: DataFrame, key: str, text: str, source_words: DataFrame, target_words: DataFrame) -> DataFrame:
    """(key, prefix, n, marked, hits, hits_behind): the run of source words at the start of each text, its number of words, whether one has a source letter, and the target's words in the text and behind the run.

    Whether a word goes on with the run depends on itself and on the word before: a connector, a word with a source letter or an elision, and one that only the source's vocabulary (word) has always do;
    a word of seven letters that the target's vocabulary lacks does at the start and after a connector; one of four does after a connector, unless it opens target phrases. A target letter ends the run.
    Words meet the vocabularies by equality. Texts without words, and null ones, are left out. key is unique.
    """
    pieces = lines.select(key, F.regexp_extract_all(text, F.lit(f"[^{WORD_LETTERS}]*[{WORD_LETTERS}]+"), F.lit(0)).alias("p"))
    placed = pieces.select(key, F.posexplode("p").alias("i", "piece")).withColumn("word", _word(F.col("piece"))).filter("word <> ''")
    known = lambda v, name: v.select(F.lower("word").alias("word")).distinct().withColumn(name, F.lit(True))
    both = placed.join(known(source_words, "s"), "word", "left").join(known(target_words, "t"), "word", "left")
    w, s, t = F.col("word"), F.coalesce("s", F.lit(False)), F.coalesce("t", F.lit(False))
    letter, link = w.rlike(f"[{SOURCE_LETTERS}]"), w.isin(*CONNECTORS)
    kind = (
        F.when(w.rlike(f"[{TARGET_LETTERS}]"), "stop").when(link, "link").when(letter | w.rlike(f"^({'|'.join(ELISIONS)})'") | (s & ~t), "sure")
        .when((F.length(w) >= 7) & ~t, "long").when((F.length(w) >= 4) & ~w.isin(*TARGET_OPENERS), "some").otherwise("stop")
    )
    words = both.select(key, F.struct("i", kind.alias("kind"), letter.alias("letter"), t.cast("long").alias("hit")).alias("x"))
    line = words.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))  # the words of one line

    def goes_on(v: Column, i: Column) -> Column:
        after = F.coalesce(F.get(F.col("x"), i - 1)["kind"] == "link", F.lit(False))
        return v["kind"].isin("link", "sure") | ((v["kind"] == "long") & ((i == 0) | after)) | ((v["kind"] == "some") & after)

    first = F.array_position(F.transform("x", goes_on), False)
    n = F.when(first > 0, first - 1).otherwise(F.size("x")).cast("int")
    hits = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + v["hit"])
    run = line.withColumn("n", n).withColumn("_run", F.slice("x", 1, F.col("n")))
    found = run.select(
        key, F.col("n").cast("long").alias("n"), F.exists("_run", lambda v: v["letter"]).alias("marked"), hits(F.col("x")).alias("hits"),
        (hits(F.col("x")) - hits(F.col("_run"))).alias("hits_behind"), F.coalesce(F.element_at(F.when(F.size("_run") > 0, F.col("_run")), -1)["i"] + 1, F.lit(0)).alias("_last"),
    )
    return found.join(pieces, key).select(key, F.array_join(F.slice("p", 1, F.col("_last")), "").alias("prefix"), "n", "marked", "hits", "hits_behind")


def moved(src: Column, tgt: Column, prefix: Column) -> Column:
    """struct(src, tgt) after the prefix, with closing brackets behind it, has moved from the target to the source."""
    rest = F.substr(tgt, F.length(prefix) + 1)
    closing = F.regexp_extract(rest, "^[)\\]}]*", 0)
    left = F.regexp_replace(F.substr(rest, F.length(closing) + 1), "^[ \\t\\-—–|]+|[ \\t\\-—–|]+$", "")
    return F.struct(strip(F.concat(src, F.lit(" "), strip(F.concat(prefix, closing)))).alias("src"), left.alias("tgt"))


def confidence(n: Column, marked: Column, left: Column, evidence: Column, ending: Column) -> Column:
    """How sure a move is: high with evidence of the target in what is left and two words, a source letter or an ending that can't end a sentence; medium with evidence; else for a human."""
    return F.when((left != "") & (evidence > 0), F.when((n >= 2) | marked | ending.isNotNull(), "high").otherwise("medium")).otherwise("needs-human")


def audit(rows: DataFrame, key: str, source_words: DataFrame, target_words: DataFrame, ending: Column, labels: dict[str, str] | None = None) -> DataFrame:
    """rows (key, source, raw, src, tgt, method, ...) to issues: key, source, raw, src, tgt, issue, suggested_src, suggested_tgt, confidence, detail; of equal ISSUE_KEY the least key's.

    ending: the source's last word where it can't end a sentence, else null. Boundaries are judged only where the method guessed them. Null sides are empty. key is unique.
    labels: other names for some of LABELS.
    """
    labels = LABELS | (labels or {})
    rows = rows.select(key, "source", "raw", *[F.coalesce(c, F.lit("")).alias(c) for c in ("src", "tgt")], "method")
    runs = source_prefix(rows.filter(F.col("method") == GUESSED), key, "tgt", source_words, target_words)
    r = rows.withColumn("_ending", ending).join(runs, key, "left").withColumn("_moved", moved(F.col("src"), F.col("tgt"), F.coalesce("prefix", F.lit(""))))
    guessed, begun, letters = F.col("method") == GUESSED, F.coalesce(F.col("n") > 0, F.lit(False)), target_letters(F.col("src"))
    left, none = F.col("_moved.tgt"), F.lit("")
    sure = confidence(F.col("n"), F.col("marked"), left, target_letters(left) + F.col("hits_behind"), F.col("_ending"))
    issue = lambda test, name, conf, detail, src=none, tgt=none: F.when(test, F.struct(F.lit(name).alias("issue"), src.alias("suggested_src"), tgt.alias("suggested_tgt"), conf.alias("confidence"), detail.alias("detail")))
    unsure, empty = F.lit("needs-human"), strip(F.col("tgt")) == ""
    found = F.array_compact(F.array(
        issue(letters > 0, labels["letters"], F.lit("high"), letters.cast("string")),
        issue(guessed & begun, labels["prefix"], sure, strip(F.col("prefix")), F.col("_moved.src"), left),
        issue(guessed & ~begun & F.col("_ending").isNotNull(), labels["incomplete"], F.lit("medium"), F.col("_ending")),
        issue(has_placeholder(F.concat_ws(" | ", "raw", "src", "tgt")), labels["placeholder"], unsure, none),
        issue(empty, labels["empty"], unsure, none),
        issue(~empty & guessed & (target_letters(F.col("tgt")) + F.coalesce("hits", F.lit(0)) == 0), labels["evidence"], unsure, none),
    ))
    issues = r.select(key, "source", "raw", "src", "tgt", F.explode(found).alias("_i")).select(key, "source", "raw", "src", "tgt", "_i.*")
    return keep_first(issues, ISSUE_KEY, [key])
