"""Tests of rows and pairs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import is_blank, strip, tokens

#: What French questions start with.
OPENERS = (
    "pourquoi", "comment", "est-ce", "quel", "quelle", "quels", "quelles", "où", "quand", "qui", "que", "quoi", "combien", "lequel", "laquelle", "lesquels", "lesquelles",
    "avez-vous", "as-tu", "puis-je", "peut-on", "devrait", "veux-tu", "voulez-vous", "peux-tu", "pouvez-vous", "sais-tu", "savez-vous", "vois-tu", "voyez-vous",
    "es-tu", "êtes-vous", "a-t-il", "a-t-elle", "ont-ils", "ont-elles", "suis-je", "sommes-nous", "y a-t-il", "n'y a-t-il",
)


def n_tokens(x: Column) -> Column:
    return F.size(tokens(x)).cast("long")


def length_ratio(src: Column, tgt: Column) -> Column:
    return F.greatest(n_tokens(src), F.lit(1)) / F.greatest(n_tokens(tgt), F.lit(1))


def _characters(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))


def character_jaccard(a: Column, b: Column) -> Column:
    """Shared distinct characters by all; 0 for two empty texts."""
    both, all_ = F.size(F.array_intersect(_characters(a), _characters(b))), F.size(F.array_union(_characters(a), _characters(b)))
    return F.when(all_ > 0, both / all_).otherwise(0.0)


def untranslated(src: Column, tgt: Column) -> Column:
    a, b = F.lower(strip(src)), F.lower(strip(tgt))
    return (a == b) | ((F.length(a) > 5) & (character_jaccard(a, b) > 0.8))


def too_short(src: Column, tgt: Column, least: int = 2) -> Column:
    return (n_tokens(src) < least) | (n_tokens(tgt) < least)


def either_empty(src: Column, tgt: Column) -> Column:
    return is_blank(src) | is_blank(tgt)


def reasons(flags: dict[str, Column]) -> Column:
    """Names of the true flags, in order, joined by a comma and a space."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])), ", ")


def likely_question(x: Column) -> Column:
    return F.lower(strip(x)).rlike("^(" + "|".join(OPENERS) + ")")


def has_quotes(x: Column) -> Column:
    return x.rlike("[«»\"]|<<|>>")


def final_marks(x: Column) -> Column:
    """The run of .!? at the end, before a closing quote if there is one."""
    return F.regexp_extract(F.rtrim(x), "([.!?]+)[\"»]?$", 1)


def matched_marks(src: Column, tgt: Column) -> Column:
    """struct(src, tgt, change): the final mark that one side lacks. Rules in order, the first that holds: ? to the target; ? to the source if it asks, else flagged; ! either way."""
    s, t = final_marks(src), final_marks(tgt)
    ends = lambda m, c: m.contains(c)
    put = lambda x, c: F.concat(F.regexp_replace(F.rtrim(x), "[.!?]+$", ""), F.lit(c))
    out = lambda a, b, c: F.struct(a.alias("src"), b.alias("tgt"), F.lit(c).alias("change"))
    return (
        F.when(ends(s, "?") & ~ends(t, "?"), out(src, put(tgt, "?"), "question_to_target"))
        .when(ends(t, "?") & ~ends(s, "?") & likely_question(src), out(put(src, "?"), tgt, "question_to_source"))
        .when(ends(t, "?") & ~ends(s, "?"), out(src, tgt, "flag"))
        .when(ends(s, "!") & ~ends(t, "!"), out(src, put(tgt, "!"), "exclamation_to_target"))
        .when(ends(t, "!") & ~ends(s, "!"), out(put(src, "!"), tgt, "exclamation_to_source"))
        .otherwise(out(src, tgt, "none"))
    )


def tags(x: Column) -> Column:
    """Of a French sentence: neg, q, past, as far as they hold."""
    low = F.lower(strip(x))
    spaced = F.concat(F.lit(" "), low)
    neg = low.contains(" pas ") | low.endswith(" pas") | low.contains(" ne ")
    past = spaced.contains(" j'") | spaced.contains(" ai ") | spaced.contains(" as ")
    return F.array_compact(F.array(F.when(neg, F.lit("neg")), F.when(low.endswith("?") | low.startswith("est-ce que"), F.lit("q")), F.when(past, F.lit("past"))))


def last_colon(x: Column) -> Column:
    """struct(left, right) at the last colon; null where there is none."""
    return F.when(x.contains(":"), F.struct(F.trim(F.regexp_extract(x, "(?s)^(.*):([^:]*)$", 1)).alias("left"), F.trim(F.regexp_extract(x, "(?s)^(.*):([^:]*)$", 2)).alias("right")))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that rejects the row, in order; null for a row to keep."""
    return reduce(lambda rest, item: F.when(item[1], F.lit(item[0])).otherwise(rest), reversed(list(rules.items())), F.lit(None).cast("string"))


def matched_quotes(src: Column, tgt: Column) -> Column:
    """struct(src, tgt, change): where one side alone has quotes, the other is put in the same kind: guillemets, double angles, else straight ones."""
    both = lambda x, a, b: x.contains(a) & x.contains(b)
    wrap = lambda x, like: F.when(both(like, "«", "»"), F.concat(F.lit("«"), x, F.lit("»"))).when(both(like, "<<", ">>"), F.concat(F.lit("<<"), x, F.lit(">>"))).otherwise(F.concat(F.lit('"'), x, F.lit('"')))
    out = lambda a, b, c: F.struct(a.alias("src"), b.alias("tgt"), F.lit(c).alias("change"))
    s, t = has_quotes(src), has_quotes(tgt)
    return F.when(s & ~t, out(src, wrap(tgt, src), "quotes_to_target")).when(t & ~s, out(wrap(src, tgt), tgt, "quotes_to_source")).otherwise(out(src, tgt, "none"))


def numbered_lines(x: Column) -> Column:
    """The items of a numbered list, one a line, without numbers; other lines go."""
    items = F.filter(F.split(x, "\n"), lambda line: line.rlike("^\\s*\\d+\\s*[.)]\\s*\\S"))
    return F.transform(items, lambda line: strip(F.regexp_replace(line, "^\\s*\\d+\\s*[.)]\\s*", "")))


def targets(x: Column) -> Column:
    """Of `target[:label],...` an array of struct(target, label): the label stands after the last colon that isn't a scheme's, else it is the last part of the path."""
    form = "^(.*[^:/]):([^:/]+)$"
    one = lambda t: F.struct(F.when(t.rlike(form), F.regexp_extract(t, form, 1)).otherwise(t).alias("target"), F.when(t.rlike(form), F.regexp_extract(t, form, 2)).otherwise(F.regexp_extract(t, "([^/]*)/*$", 1)).alias("label"))
    return F.transform(F.filter(F.transform(F.split(x, ","), lambda t: F.trim(t)), lambda t: t != ""), one)


def codec_ids(x: Column, tag: str) -> Column:
    """The numbers of all tags <|tag_N|>."""
    return F.transform(F.regexp_extract_all(x, F.lit(f"<\\|{tag}_(\\d+)\\|>"), F.lit(1)), lambda n: n.cast("int"))


def record_errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that a record breaks, in order; a rule that gives null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def spacing_changes(before: Column, after: Column) -> Column:
    """struct(double_spaces, spaces_before_marks, clicks): what the text before has of each, 0 where cleaning changed nothing."""
    changed = ~before.eqNullSafe(after)
    count = lambda form: F.when(changed, F.regexp_count(before, F.lit(form))).otherwise(0).cast("long")
    return F.struct(count(" {2,}").alias("double_spaces"), count("\\s+[.,!?;:]").alias("spaces_before_marks"), (changed & before.contains("ǃ")).cast("long").alias("clicks"))


def change_kinds(before: Column, after: Column) -> Column:
    """What cleaning did to a text, in order: marks and quotes added, double spaces removed."""
    added = lambda c: after.contains(c) & ~before.contains(c)
    kinds = {"? added": added("?"), "! added": added("!"), "quotes added": added('"'), "double spaces removed": before.contains("  ") & ~after.contains("  ")}
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in kinds.items()]))
