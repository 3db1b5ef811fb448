"""Benchmark decontamination by spaced seeds. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.scratch import materialize

#: Positions of a window of words that a seed reads (1) or ignores (0): fixed masks. They have the first two positions in common and no run of three.
MASKS = ("1101101", "1100101001")
#: A word that agrees counts 1, one that differs MISMATCH; the best run of an overlap has to reach SCORE.
SCORE, MISMATCH = 10, -1
#: An item stands in a text, too, if of its words in place no more than one in CHANGED differs: under CHANGED words none.
CHANGED = 6
#: Runs of equal words that such an item leaves at least, by its length: (span, fewest words, most words). Longer items that keep so many words reach SCORE.
RUNS = ((3, 6, 7), (4, 8, 18))
#: Seeds and keys that may be broadcast, of some 40 bytes.
BROADCAST_ROWS = 1_000_000
#: Bits of the sets that texts' windows are tested against before they are looked up: so many for each hash of the benchmark, and at most. A fuller set lets more windows through to the lookup and leaves none out.
BITS_EACH, MOST_BITS = 16, 1 << 24
#: Words are runs of other characters than these.
SEPARATORS = "[\\x00-\\x2F:;<=>?@\\[\\\\\\]^_`{|}~]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words. An empty word can stand at either end, and is all that null and blank texts have."""
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: F.xxhash64(w))


def _read(mask: str, salt: int, at: Column) -> Column:
    return F.xxhash64(F.lit(salt), *[F.get(F.col("h"), at + k) for k, c in enumerate(mask) if c == "1"])


def families(lengths: list[int]) -> list[tuple[str, Column]]:
    """Masks and the items that each seeds, by their number of words. lengths: those under CHANGED that occur, which are seeded whole."""
    size = F.size("h")
    return [*[(m, size >= len(m)) for m in MASKS], *[("1" * span, size.between(least, most)) for span, least, most in RUNS], *[("1" * n, size == n) for n in sorted(lengths)]]


def windows(span: int) -> Column:
    """First places of the windows of h; none in shorter texts."""
    return F.when(F.size("h") >= span, F.sequence(F.lit(0), F.size("h") - span)).otherwise(F.array().cast("array<int>"))


def _opening(at: Column) -> Column:
    return _read("11", -1, at)


def item_seeds(items: DataFrame, masks: list[tuple[str, Column]]) -> DataFrame:
    """items (item, h) to (seed, opening, item, item_at): a row for each window of each mask that seeds the item. opening: the hash of its first two words, null for masks of one."""

    def of_mask(k: int, mask: str) -> Column:
        opening = _opening if len(mask) > 1 else lambda i: F.lit(None).cast("long")
        return F.transform(windows(len(mask)), lambda i: F.struct(_read(mask, k, i).alias("seed"), opening(i).alias("opening"), i.alias("item_at")))

    parts = [items.filter(of).select("item", F.explode(of_mask(k, mask)).alias("_s")).select("_s.seed", "_s.opening", "item", "_s.item_at") for k, (mask, of) in enumerate(masks)]
    return reduce(DataFrame.unionByName, parts)


def bitmap(df: DataFrame, column: str) -> Column:
    """A bit set, as an array of longs, of the values of column, BITS_EACH bits a value and MOST_BITS at most. The driver sees the longs that aren't 0, at most MOST_BITS / 64."""
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_EACH * df.count()):
        bits *= 2
    place = F.pmod(F.col(column), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    got = df.filter(F.col(column).isNotNull()).groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    words = [0] * (bits // 64)
    for r in got:
        words[r["word"]] = r["bits"]
    return F.from_json(F.lit(str(words)), "array<bigint>")  # one literal, folded before the query runs


def _may_have(bits: Column, value: Column) -> Column:
    """Whether the bit of value is set: for all values of the set, and few others."""
    place = F.pmod(value, F.size(bits).cast("long") * 64)
    return F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1


def text_seeds(texts: DataFrame, masks: list[str], openings: Column, seeds: Column) -> DataFrame:
    """texts (key, h) to (key, seed, at) in one pass: a row for each mask and window whose first two words are in the bit set openings (masks of one word have no such test) and whose seed is in the bit set seeds."""

    def of_masks(at: Column, own: list[tuple[int, str]]) -> Column:
        one = lambda i, k, m: F.struct(F.when(i + len(m) <= F.size("h"), _read(m, k, i)).alias("seed"), i.alias("at"))
        return F.flatten(F.transform(at, lambda i: F.array(*[one(i, k, m) for k, m in own])))

    numbered = list(enumerate(masks))
    opened = F.filter(windows(2), lambda i: _may_have(openings, _opening(i)))
    parts = [of_masks(opened, [(k, m) for k, m in numbered if len(m) > 1])]
    if any(len(m) == 1 for m in masks):
        parts.append(of_masks(windows(1), [(k, m) for k, m in numbered if len(m) == 1]))
    made = F.filter(F.concat(*parts), lambda s: _may_have(seeds, s["seed"]))  # null beyond the text's end
    return texts.select("key", F.explode(made).alias("_s")).select("key", "_s.seed", "_s.at")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """Per row of docs: id, extra columns, contaminated, n_items, item_ids (ascending), best_score.

    A seed that a document and an item share puts them on a diagonal. Along it all words of the item are compared with the document's:
    a run's score counts equal words and takes away 1 for each that differs. Runs of SCORE are contamination, and so is an item of which no more than one word in CHANGED differs.
    No run of SCORE is without two equal words in a row, with which all masks begin. Items of fewer words than CHANGED are seeded whole, by a contiguous mask of their length;
    those of up to 18 words also by runs that CHANGED can't all break, so none is missed. Items and texts that are null or blank match nothing.
    Null item ids count as an item in n_items' place only once and aren't listed. Texts are told apart by content, so repeated ids and copies are safe.
    An empty table on either side gives no contamination.
    """
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    raw = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    texts = raw.select("key", word_hashes(F.col("text")).alias("h"))
    items = materialize(benchmark.select(F.col(item_col).alias("item"), F.array_remove(word_hashes(F.col(item_text_col)), F.xxhash64(F.lit(''))).alias("ih")).filter(F.size("ih") > 0), "items")
    size = F.size("ih")
    lengths = [r[0] for r in items.filter(size < CHANGED).select(size).distinct().collect()]  # CHANGED - 1 numbers at most
    masks = families(lengths)
    theirs = materialize(item_seeds(items.withColumnRenamed("ih", "h"), masks), "seeds")
    ours = text_seeds(texts, [m for m, _ in masks], bitmap(theirs, "opening"), bitmap(theirs, "seed"))
    few = theirs.count() <= BROADCAST_ROWS
    theirs = theirs.select("seed", "item", "item_at")
    hits = ours.join(F.broadcast(theirs) if few else theirs, "seed").select("key", "item", (F.col("at") - F.col("item_at")).alias("diagonal"))
    hits = materialize(hits.distinct(), "hits")
    keys = hits.select("key").distinct()
    few = keys.count() <= BROADCAST_ROWS
    near = raw.join(F.broadcast(keys) if few else keys, "key", "left_semi").dropDuplicates(["key"]).select("key", word_hashes(F.col("text")).alias("h"))
    pairs = hits.join(near, "key").join(items, hits["item"].eqNullSafe(items["item"])).select("key", hits["item"], "diagonal", "ih", F.slice("h", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.size("ih")).alias("part"))
    pairs = pairs.withColumn("skip", F.greatest(-F.col("diagonal"), F.lit(0)))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("same"))

    def step(s: Column, i: Column) -> Column:
        equal = F.get("ih", i + F.col("skip")) == F.get("part", i)
        now = F.greatest(s["now"] + F.when(equal, 1).otherwise(MISMATCH), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"), (s["same"] + equal.cast("int")).alias("same"))

    n = F.least(F.size("part"), F.size("ih") - F.col("skip"))
    run = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), state, step))
    scored = pairs.select("key", "item", "ih", run.alias("run")).filter((F.col("run.best") >= SCORE) | (F.col("run.same") >= size - F.floor(size / CHANGED))).select("key", "item", F.col("run.best").alias("score"))
    found = scored.groupBy("key").agg(F.count_distinct(F.struct("item")).alias("n_items"), F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("score").alias("best_score"))
    out = docs.select(id_col, *(extra or []), key.alias("key")).join(found, "key", "left")
    none = F.array().cast(found.schema["item_ids"].dataType)
    return out.select(id_col, *(extra or []), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("best_score", F.lit(0)).cast("int").alias("best_score"))
