"""Row-wise statistics of candidate and reference texts, and the scores that sums of them give.

An Arrow function counts within each row, so that n-grams never cross an exchange; sentence scores are expressions over a row's counts, corpus scores the same expressions over summed counts. Null texts count as empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quern.operators.ordering import running_sums, spread

CHAR_ORDER, WORD_ORDER = 6, 2
_COUNTS = ArrayType(LongType())
#: The public definition of the 13a tokenizer, in order.
_ENTITIES = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_SPLITS = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def words_13a(text: str | None) -> list[str]:
    text = text or ""
    for old, new in _ENTITIES:
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, by in _SPLITS:
        text = re.sub(pattern, by, text)
    return text.split()


def _counts(items, n: int) -> Counter:
    return Counter(zip(*(items[i:] for i in range(n))))


def _apart(text: str) -> list[str]:
    """Words with a mark at their end, or else at their start, set apart."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


@F.pandas_udf(_COUNTS)
def bleu_counts(hyp: pd.Series, refs: pd.Series) -> pd.Series:
    """Of a candidate and an array of references: its length, that of the nearest reference (the shorter of two), then matches and candidates of 1 to 4 words."""

    def one(h, rs):
        h, rs = words_13a(h), [words_13a(r) for r in (rs if rs is not None and len(rs) else [""])]
        out = [len(h), min((abs(len(r) - len(h)), len(r)) for r in rs)[1]]
        for n in range(1, 5):
            most = _counts(rs[0], n)
            for r in rs[1:]:
                most |= _counts(r, n)
            out += [_shared(_counts(h, n), most), max(0, len(h) - n + 1)]
        return out

    return pd.Series([one(h, r) for h, r in zip(hyp, refs)])


def _chrf_grams(text: str) -> list[tuple[int, Counter]]:
    """Number and counts of grams of 1 to 6 characters, then of 1 and 2 words."""
    s, w = "".join(text.split()), _apart(text)
    chars = [Counter(s), *(Counter([s[i : i + n] for i in range(len(s) - n + 1)]) for n in range(2, CHAR_ORDER + 1))]
    words = [Counter(w), *(Counter(zip(*(w[i:] for i in range(n)))) for n in range(2, WORD_ORDER + 1))]
    return [(max(0, len(x) - n), c) for x, cs in ((s, chars), (w, words)) for n, c in enumerate(cs)]


def _shared(x: Counter, y: Counter) -> int:
    """Items of both, each as often as the rarer side has it."""
    if len(y) < len(x):
        x, y = y, x
    return sum([k if k < (m := y[g]) else m for g, k in x.items() if g in y])


def _chrf_counts(h: list[tuple[int, Counter]], r: list[tuple[int, Counter]]) -> list[int]:
    return [v for (a, x), (b, y) in zip(h, r) for v in (a, b, _shared(x, y))]


def _chrf_of(counts: list[int], words: int, beta: float = 2.0) -> float:
    have = [counts[3 * k : 3 * k + 3] for k in range(CHAR_ORDER + words) if counts[3 * k] and counts[3 * k + 1]]
    p, r = (sum(x[2] / x[side] for x in have) / len(have) if have else 0.0 for side in (0, 1))
    return (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


#: Characters of pairs that are counted together, about.
COUNTED_TOGETHER = 1 << 17


def _chrf_slices(pairs: list[tuple[str, str]]) -> list[list[int]]:
    """_chrf_counts of each pair, many pairs at a time."""
    out, start, size = [], 0, 0
    for k, (h, r) in enumerate(pairs):
        size += len(h) + len(r)
        if size > COUNTED_TOGETHER or k + 1 == len(pairs):
            out += _chrf_together(pairs[start : k + 1])
            start, size = k + 1, 0
    return out


def _chrf_together(pairs: list[tuple[str, str]]) -> list[list[int]]:
    """_chrf_counts of each pair. Texts follow each other, candidates first in each pair."""
    texts = [t for pair in pairs for t in pair]
    chars = ["".join(t.split()) for t in texts]
    codes = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    words = [_apart(t) for t in texts]
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for ws in words for w in ws], dtype=np.int64)
    parts = [_gram_counts(x, np.array([len(t) for t in own], dtype=np.int64), order) for x, own, order in ((codes, chars, CHAR_ORDER), (flat, words, WORD_ORDER))]
    return np.concatenate(parts, axis=1).tolist()


def _gram_counts(items: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """For each pair of texts: grams of the first, of the second and of both, each as often as the rarer side has it, for 1 to `order` items. sizes: items of each text, two texts a pair.

    A gram is the rank of the gram one shorter and the item behind it; numbers that outgrow 62 bits are ranked anew, so grams are told apart exactly whatever the items are.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes) // 2, 3 * order), dtype=np.int64)
    first = np.unique(items, return_inverse=True)[1] if len(items) else items
    kinds, grams, at = int(first.max(initial=0)) + 1, first, np.arange(len(items))
    width, most = kinds, 2**61 // max(1, len(sizes))  # grams are below width; with a pair's number in front they fit 62 bits
    for n in range(order):
        out[:, 3 * n], out[:, 3 * n + 1] = (np.maximum(sizes[side::2] - n, 0) for side in (0, 1))
        if n:
            if width * kinds > most:
                grams = np.unique(grams, return_inverse=True)[1]
                width = int(grams.max(initial=0)) + 1
            goes_on = at + n < len(items)
            goes_on[goes_on] = text[at[goes_on]] == text[at[goes_on] + n]
            at, grams, width = at[goes_on], grams[goes_on] * kinds + first[at[goes_on] + n], width * kinds
        if not len(at):
            continue
        s = np.sort(((text[at] >> 1) * width + grams) * 2 + (text[at] & 1))  # grams of a pair stand together
        start = np.flatnonzero(np.r_[True, s[1:] >> 1 != s[:-1] >> 1])
        second = np.add.reduceat(s & 1, start)
        both = np.minimum(second, np.diff(np.r_[start, len(s)]) - second)
        out[:, 3 * n + 2] = np.bincount((s[start] >> 1) // width, weights=both, minlength=len(out))
    return out


@F.pandas_udf(StructType([StructField("c", _COUNTS), StructField("p", _COUNTS)]))
def chrf_counts(hyp: pd.Series, refs: pd.Series) -> pd.DataFrame:
    """Candidates, references and matches of 1 to 6 characters (white space left out), then of 1 and 2 words, against that reference which gives the highest chrF (c) and chrF++ (p), the first of equal ones. Grams of a text are counted once."""

    many = [k for k, rs in enumerate(refs) if rs is not None and len(rs) > 1]
    single = [k for k, rs in enumerate(refs) if rs is None or len(rs) < 2]
    out = [None] * len(refs)
    for k in many:
        mine = _chrf_grams(hyp.iloc[k] or "")
        each = [_chrf_counts(mine, _chrf_grams(r or "")) for r in refs.iloc[k]]
        out[k] = tuple(max(each, key=lambda c: _chrf_of(c, w)) for w in (0, WORD_ORDER))
    texts = [(hyp.iloc[k] or "", (refs.iloc[k][0] if refs.iloc[k] is not None and len(refs.iloc[k]) else None) or "") for k in single]
    for k, c in zip(single, _chrf_slices(texts)):
        out[k] = (c, c)
    return pd.DataFrame(out, columns=["c", "p"])


def bleu_score(c: Column, effective: bool = False) -> Column:
    """BLEU in percent from counts; an order without a match counts half, a quarter and so on. effective: only orders that the candidate has (for sentences)."""
    logs, halves, orders = F.lit(0.0), F.lit(1.0), F.lit(0)
    for n in range(4):
        match, total = c[2 + 2 * n], c[3 + 2 * n]
        zero = (match == 0) & (total > 0)
        halves = F.when(zero, halves * 2).otherwise(halves)
        logs = logs + F.when(total > 0, F.log(F.when(zero, 1.0 / (halves * total)).otherwise(match / total))).otherwise(0.0)
        orders = orders + F.when(total > 0, 1).otherwise(0)
    brevity = F.when(c[0] >= c[1], 0.0).otherwise(1 - F.try_divide(c[1], c[0]))
    whole = orders > 0 if effective else orders == 4
    return F.when(whole & (c[2] > 0), 100 * F.exp(brevity + logs / orders)).otherwise(0.0)


def chrf_score(c: Column, words: int = 0, beta: float = 2.0) -> Column:
    """chrF in percent from counts, chrF++ with words=2: F of mean precision and mean recall over the orders that both sides have."""
    orders = F.transform(F.sequence(F.lit(0), F.lit(CHAR_ORDER + words - 1)), lambda k: F.slice(c, 3 * k + 1, F.lit(3)))
    both = F.filter(orders, lambda t: (t[0] > 0) & (t[1] > 0))
    have = F.size(both)
    mean = lambda side: F.try_divide(F.aggregate(both, F.lit(0.0), lambda a, t: a + t[2] / t[side]), have)
    p, r, b = mean(0), mean(1), beta * beta
    return F.when((have > 0) & (p + r > 0), 100 * (1 + b) * p * r / (b * p + r)).otherwise(0.0)


def sentence_scores(pairs: DataFrame, hyp: str, ref: str) -> DataFrame:
    """pairs with sentence_bleu, sentence_chrf, sentence_chrfpp; null where the reference is null."""
    out = pairs.withColumn("_b", bleu_counts(F.col(hyp), F.array(ref))).withColumn("_c", chrf_counts(F.col(hyp), F.array(ref))["c"])
    known = lambda x: F.when(F.col(ref).isNotNull(), F.round(x, 6))
    b, c = F.col("_b"), F.col("_c")
    return out.withColumns({"sentence_bleu": known(bleu_score(b, True)), "sentence_chrf": known(chrf_score(c)), "sentence_chrfpp": known(chrf_score(c, WORD_ORDER))}).drop("_b", "_c")


def corpus_scores(pairs: DataFrame, hyp: str, refs: str, keys: list[str]) -> DataFrame:
    """(keys, n, bleu, chrf, chrfpp). refs is an array of references: BLEU's n-grams may match any, chrF takes for each row the reference of the highest score; corpus scores come from summed counts."""
    d = pairs.select(*keys, bleu_counts(F.col(hyp), F.col(refs)).alias("b"), chrf_counts(F.col(hyp), F.col(refs)).alias("f")).select(*keys, "b", "f.c", "f.p")
    sums = lambda name, k: F.array(*[F.sum(F.col(name)[i]) for i in range(k)]).alias(name)
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), sums("b", 10), sums("c", 3 * CHAR_ORDER), sums("p", 3 * (CHAR_ORDER + WORD_ORDER)))
    scores = {"bleu": bleu_score(F.col("b")), "chrf": chrf_score(F.col("c")), "chrfpp": chrf_score(F.col("p"), WORD_ORDER)}
    return s.select(*keys, "n", *[F.round(v, 4).alias(k) for k, v in scores.items()])


def _table(a: list, b: list) -> np.ndarray:
    """Edit distances of all prefixes, row by row; insertions within a row come from running minima."""
    d = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int64)
    steps = np.arange(len(b) + 1)
    d[0] = steps
    ids = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    target = np.array([ids[w] for w in b], dtype=np.int64)
    for i, w in enumerate(a, 1):
        row = d[i - 1] + 1
        row[1:] = np.minimum(row[1:], d[i - 1, :-1] + (target != ids[w]))
        d[i] = np.minimum.accumulate(row - steps) + steps
    return d


def _operations(ref: list, hyp: list) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions on a shortest path; of equal ones a substitution before an insertion before a deletion."""
    d, i, j = _table(ref, hyp), len(ref), len(hyp)
    s = ins = dele = 0
    while i or j:
        same = i and j and ref[i - 1] == hyp[j - 1]
        if i and j and d[i, j] == d[i - 1, j - 1] + (not same):
            s, i, j = s + (not same), i - 1, j - 1
        elif j and d[i, j] == d[i, j - 1] + 1:
            ins, j = ins + 1, j - 1
        else:
            dele, i = dele + 1, i - 1
    return s, ins, dele


@F.pandas_udf(_longs("substitutions", "insertions", "deletions", "ref_words"))
def word_operations(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [(*_operations((r or "").split(), (h or "").split()), len((r or "").split())) for r, h in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=["substitutions", "insertions", "deletions", "ref_words"])


@F.pandas_udf(DoubleType())
def rouge_l(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """F1 in percent of the longest common subsequence of lower-case words [a-z0-9]+."""

    def one(r, h):
        r, h = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (r, h))
        ids = {w: k for k, w in enumerate(dict.fromkeys([*r, *h]))}
        target, best = np.array([ids[w] for w in h], dtype=np.int64), np.zeros(len(h) + 1, dtype=np.int64)
        for w in r:
            new = best.copy()
            new[1:] = np.maximum(new[1:], best[:-1] + (target == ids[w]))
            best = np.maximum.accumulate(new)
        common = int(best[-1])
        return 200.0 * common / (len(r) + len(h)) if common else 0.0

    return pd.Series([one(r, h) for r, h in zip(ref, hyp)], dtype="float64")


#: Fixed values of the published edit rate: longest span, farthest way and candidates of a shift, half the width of the table's band.
LONGEST_SHIFT, FARTHEST_SHIFT, MOST_SHIFTS, BAND = 10, 50, 1000, 25


def _banded(candidates: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Tables of edits (candidates, words + 1, reference words + 1) of candidates of one length against a reference, all at once. Cells far from the diagonal stay out of reach."""
    n, size, width = len(candidates), candidates.shape[1], len(ref)
    steps, far = np.arange(width + 1), 1 << 40
    ratio = width / size if size else 1.0
    band = math.ceil(ratio / 2 + BAND) if ratio / 2 > BAND else BAND
    table = np.full((n, size + 1, width + 1), far, dtype=np.int64)
    table[:, 0] = steps
    for i in range(1, size + 1):
        middle = math.floor(i * ratio)
        a, b = max(0, middle - band), width + 1 if i == size else min(width + 1, middle + band)
        row = table[:, i - 1, a:b] + 1
        first = max(a, 1)
        kept = table[:, i - 1, first - 1 : b - 1] + (candidates[:, i - 1, None] != ref[first - 1 : b - 1])
        row[:, first - a :] = np.minimum(row[:, first - a :], kept)
        table[:, i, a:b] = np.minimum.accumulate(row - steps[a:b], axis=1) + steps[a:b]
    return table


def _alignment(table: np.ndarray, hyp: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the candidate for each reference word, wrong candidate words, wrong reference words) of a shortest path; of equal ones a kept or replaced word before a dropped one before an added one."""
    i, j = len(hyp), len(ref)
    at, hyp_wrong, ref_wrong = np.zeros(j, dtype=np.int64), np.ones(i, dtype=np.int64), np.ones(j, dtype=np.int64)
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (hyp[i - 1] != ref[j - 1]):
            i, j = i - 1, j - 1
            at[j] = i
            hyp_wrong[i] = ref_wrong[j] = hyp[i] != ref[j]
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
            at[j] = i - 1
    return at, hyp_wrong, ref_wrong


def _shifts(hyp: list[int], ref: list[int], at: np.ndarray, hyp_wrong: np.ndarray, ref_wrong: np.ndarray) -> list[tuple[int, int, int, list[int]]]:
    """(length, start, goal, shifted candidate) of the shifts worth a trial: a span that the reference has elsewhere, where the alignment errs on both sides, to each place that the reference's words around it are aligned to."""
    starts: dict[int, list[int]] = {}
    for j, w in enumerate(ref):
        starts.setdefault(w, []).append(j)
    wrong_h, wrong_r, out = np.append(0, np.cumsum(hyp_wrong)), np.append(0, np.cumsum(ref_wrong)), []
    for i in range(len(hyp)):
        for j in starts.get(hyp[i], ()):
            if abs(j - i) > FARTHEST_SHIFT:
                continue
            for n in range(1, LONGEST_SHIFT + 1):
                if i + n > len(hyp) or j + n > len(ref) or hyp[i + n - 1] != ref[j + n - 1]:
                    break
                if wrong_h[i + n] == wrong_h[i] or wrong_r[j + n] == wrong_r[j] or i <= at[j] < i + n:
                    continue
                before = None
                for k in range(j - 1, j + n):
                    goal = 0 if k < 0 else int(at[k]) + 1
                    if goal == before:
                        continue
                    before = goal
                    rest, place = hyp[:i] + hyp[i + n :], goal if goal <= i + n else goal - n
                    out.append((n, i, goal, rest[:place] + hyp[i : i + n] + rest[place:]))
                    if len(out) >= MOST_SHIFTS:
                        return out
    return out


def shifted_edits(hyp: list[str], ref: list[str]) -> int:
    """Edits with shifts at the cost of one each, by the published greedy search: of all trials the one that saves most edits is made, of equal ones the longest span, then the first start, then the first goal; as long as one saves and fewer than MOST_SHIFTS were tried in all."""
    ids: dict[str, int] = {}
    words, target = ([ids.setdefault(w, len(ids)) for w in x] for x in (hyp, ref))
    goal = np.array(target, dtype=np.int64)
    if not words or not target:
        return max(len(words), len(target))
    shifts = tried = 0
    table = _banded(np.array([words]), goal)[0]
    while cost := int(table[-1, -1]):
        trials = _shifts(words, target, *_alignment(table, np.array(words), goal))
        tried += len(trials)
        if not trials or tried >= MOST_SHIFTS:
            break
        tables = _banded(np.array([t[3] for t in trials]), goal)
        saved = cost - tables[:, -1, -1]
        k = max(range(len(trials)), key=lambda k: (saved[k], trials[k][0], -trials[k][1], -trials[k][2], trials[k][3]))
        if saved[k] <= 0:
            break
        words, table, shifts = trials[k][3], tables[k], shifts + 1
    return int(table[-1, -1]) + shifts


@F.pandas_udf(_longs("edits", "ref_words"))
def translation_edits(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [(shifted_edits((h or "").lower().split(), (r or "").lower().split()), len((r or "").split())) for h, r in zip(hyp, ref)]
    return pd.DataFrame(rows, columns=["edits", "ref_words"])


def translation_edit_rate(pairs: DataFrame, hyp: str, ref: str, keys: list[str]) -> DataFrame:
    """(keys, ter): edits with shifts by reference words, in percent; null where references have no words."""
    d = pairs.select(*keys, translation_edits(F.col(hyp), F.col(ref)).alias("e"))
    return d.groupBy(*keys).agg(F.round(100 * F.sum("e.edits") / F.nullif(F.sum("e.ref_words"), F.lit(0)), 4).alias("ter"))


@F.pandas_udf(DoubleType())
def _wilcoxon_p(n: pd.Series, plus: pd.Series, ties: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n, plus, ties, dropped):
        if n < 1:
            return 1.0
        total = n * (n + 1) / 2
        low = min(plus, total - plus)
        if n <= 50 and not ties and not dropped:
            ways = np.zeros(int(total) + 1)
            ways[0] = 1.0
            for k in range(1, int(n) + 1):
                ways[k:] = ways[k:] + ways[:-k]
            return min(1.0, 2 * float(ways[: int(low) + 1].sum()) / 2.0**n)
        spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
        return math.erfc(abs(low - total / 2) / spread / math.sqrt(2)) if spread else 1.0

    return pd.Series([one(*x) for x in zip(n, plus, ties, dropped)], dtype="float64")


def wilcoxon(scores: DataFrame, a: str, b: str, keys: list[str], least: int = 5) -> DataFrame:
    """(keys, n, w_plus, p_value) of the signed-rank test, two-sided; null p under `least` pairs. Zero differences go, equal ones share their mean rank.

    Exact up to 50 pairs without ties and zeros, else by the normal law with its correction for ties. Ranks are running sums over the counts of distinct differences, range by range, so no task holds a key.
    """
    d = scores.select(*keys, (F.col(a) - F.col(b)).alias("_d")).filter("_d IS NOT NULL")
    zeros = d.groupBy(*keys).agg(F.count("*").alias("_pairs"), F.sum((F.col("_d") == 0).cast("long")).alias("_dropped"))
    by = d.filter("_d <> 0").groupBy(*keys, F.abs("_d").alias("_size")).agg(F.count("*").alias("_k"), F.sum((F.col("_d") > 0).cast("long")).alias("_up"))
    k = F.col("_k")
    ranked = running_sums(by, keys, ["_size"], "_k", "_upto").withColumn("_rank", F.col("_upto") - (k - 1) / 2)
    s = ranked.groupBy(*keys).agg(F.sum(k).alias("n"), F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"), F.sum(k * k * k - k).alias("_ties"))
    same = reduce(lambda x, y: x & y, [zeros[c].eqNullSafe(s[c]) for c in keys])
    j = zeros.join(s, same, "left").select(*[zeros[c] for c in keys], "_pairs", "_dropped", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "_ties")], F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"))
    p = F.when(F.col("_pairs") >= least, F.round(_wilcoxon_p(F.col("n").cast("double"), F.col("w_plus"), F.col("_ties").cast("double"), F.col("_dropped").cast("double")), 8))
    return j.select(*keys, "n", "w_plus", p.alias("p_value"))


def bootstrap_interval(values: DataFrame, key: str, value: str, resamples: int, level: float = 0.95, seed: int = 1) -> DataFrame:
    """One row (lo, hi): percentiles of the mean over resamples of a Poisson bootstrap with hashed draws; sums are combined before the exchange."""
    from quern.operators.metrics import poisson_weight
    from quern.operators.sampling import draw_number

    weight = poisson_weight(draw_number(seed, F.concat_ws("|", "resample", F.col(key).cast("string"))))
    drawn = spread(values.filter(F.col(value).isNotNull()).select(key, value), resamples).withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    means = drawn.groupBy("resample").agg((F.sum(weight * F.col(value)) / F.nullif(F.sum(weight), F.lit(0))).alias("m"))
    return means.agg(F.percentile("m", (1 - level) / 2).alias("lo"), F.percentile("m", (1 + level) / 2).alias("hi"))
