"""French sentences of a structured corpus: clean-up, grammatical module, subject pronoun and verb, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import collapse, strip, tokens

#: Present forms of the verbs of the two generation runs, for je, tu, il/elle, nous, vous, ils/elles.
FIRST_RUN = {
    "manger": ("mange", "manges", "mange", "mangeons", "mangez", "mangent"),
    "boire": ("bois", "bois", "boit", "buvons", "buvez", "boivent"),
    "voir": ("vois", "vois", "voit", "voyons", "voyez", "voient"),
    "aller": ("vais", "vas", "va", "allons", "allez", "vont"),
    "venir": ("viens", "viens", "vient", "venons", "venez", "viennent"),
    "faire": ("fais", "fais", "fait", "faisons", "faites", "font"),
    "avoir": ("ai", "as", "a", "avons", "avez", "ont"),
    "prendre": ("prends", "prends", "prend", "prenons", "prenez", "prennent"),
    "donner": ("donne", "donnes", "donne", "donnons", "donnez", "donnent"),
    "vouloir": ("veux", "veux", "veut", "voulons", "voulez", "veulent"),
}
SECOND_RUN = {
    "aimer": ("aime", "aimes", "aime", "aimons", "aimez", "aiment"),
    "acheter": ("achète", "achètes", "achète", "achetons", "achetez", "achètent"),
    "chercher": ("cherche", "cherches", "cherche", "cherchons", "cherchez", "cherchent"),
    "trouver": ("trouve", "trouves", "trouve", "trouvons", "trouvez", "trouvent"),
    "parler": ("parle", "parles", "parle", "parlons", "parlez", "parlent"),
    "savoir": ("sais", "sais", "sait", "savons", "savez", "savent"),
    "mettre": ("mets", "mets", "met", "mettons", "mettez", "mettent"),
    "laisser": ("laisse", "laisses", "laisse", "laissons", "laissez", "laissent"),
    "apporter": ("apporte", "apportes", "apporte", "apportons", "apportez", "apportent"),
    "montrer": ("montre", "montres", "montre", "montrons", "montrez", "montrent"),
}
#: Past participles, auxiliaries, pronouns, words that open a question, common words.
PARTICIPLES = {
    "manger": "mangé", "boire": "bu", "voir": "vu", "aller": "allé", "venir": "venu", "faire": "fait", "avoir": "eu", "prendre": "pris", "donner": "donné", "vouloir": "voulu",
    "aimer": "aimé", "acheter": "acheté", "chercher": "cherché", "trouver": "trouvé", "parler": "parlé", "savoir": "su", "mettre": "mis", "laisser": "laissé", "apporter": "apporté", "montrer": "montré",
}
GOING = ("vais", "vas", "va", "allons", "allez", "vont")
HAVING = ("ai", "as", "a", "avons", "avez", "ont")
BEING = ("suis", "es", "est", "sommes", "êtes", "sont")
PRONOUNS = ("je", "tu", "il", "elle", "nous", "vous", "ils", "elles")
QUESTION_STARTS = ("est-ce que", "est-ce qu", "qu'est-ce que", "qu'est-ce qu", "où ", "qui ", "que ", "d'où ", "d’où ", "quel ", "quelle ", "comment ")
COMMON_FRENCH = (
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "à", "en", "est", "il", "elle", "je", "tu", "nous", "vous", "ils", "elles",
    "que", "qui", "pas", "ne", "sur", "dans", "pour", "avec", "ce", "ça", "mon", "ma", "mes", "ton", "son", "sa", "ses", "au", "aux",
)
MODULE_NAMES = (("module1_base", 1), ("module2_negation", 2), ("module3_past", 3), ("module4_future", 4), ("module5_questions", 5), ("m1", 1), ("m2", 2), ("m3", 3), ("m4", 4), ("m5", 5))
#: Letters of the target language; target words that mark a tail that doesn't belong to a French text.
TARGET_LETTERS, TAIL_WORDS = "ɖɛɔŋɣʋɥʔᴐ", "mi|wo|yi|e\\s+wa|mi\\s+wa|e\\s+kuku|e\\s+drodro|ŋu|ɔ|ɖɛ|axomɛ|wema|eho"
#: Word pairs around a slash (either order), what the canonical and what the alternative text takes; marks of canonical and alternative phrases; pronouns.
#: word, word, and which of the two is canonical.
SLASH_PAIRS = (("sɔsɔ", "xɔxɔ", "xɔxɔ"), ("sɔ", "xɔ", "xɔ"), ("kuku", "xɔxɔ", "xɔxɔ"), ("ku", "xɔ", "xɔ"), ("baci", "eba", "baci"), ("keke", "ehun", "keke"))
CANONICAL_WORDS, ALTERNATIVE_WORDS, TARGET_PRONOUNS = ("xɔ", "xɔxɔ"), ("sɔ", "sɔsɔ", "ku", "kuku"), ("ŋu", "ɔ", "e", "mi", "wo")

_LONG_QUESTION = "^(?:(?:qu['’])?est-ce qu(?:e |['’])\\s*)+"


def _verbs(run: str | None) -> dict[str, str]:
    return {"phrases_simples": FIRST_RUN, "partie2": SECOND_RUN}.get(run or "", FIRST_RUN | SECOND_RUN)


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in entries.items() for x in item])


def clean_sentence(x: Column) -> Column:
    """Without a leading number; glued `que` and pronouns are set apart. Null stays null."""
    x = F.regexp_replace(strip(x), "^\\d+\\.\\s*", "")
    x = F.regexp_replace(x, "(?iu)(est-ce qu[e'])\\s*([a-zéèêà])", "$1 $2")
    return strip(F.regexp_replace(x, "(?iu)(que\\s+)(il|elle|ils|elles)([a-zéèêà])", "$1$2 $3"))


def _bare(w: Column) -> Column:
    """A word without a bracketed agreement, as in allé(e)."""
    return F.regexp_replace(w, "\\([^)]*\\)", "")


def _agreed(w: Column) -> Column:
    return F.regexp_replace(w, "(e|s|es)$", "")


def _couples(words: Column) -> Column:
    """Each word with the next one."""
    nexts = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(F.slice(words, 1, F.size(nexts)), nexts, lambda a, b: F.struct(F.regexp_replace(a, "^j['’]", "").alias("whole"), a.alias("a"), b.alias("b"), _bare(b).alias("bare")))


def detect_module(x: Column) -> Column:
    """M5 question, M2 negation, M4 going to, M3 past, else M1; the first that holds, in this order. Null for null."""
    x = clean_sentence(x)
    low = F.lower(x)
    couples, participles = _couples(tokens(low)), list(PARTICIPLES.values())
    question = reduce(lambda a, b: a | b, [low.startswith(s) for s in QUESTION_STARTS], x.contains("?"))
    negated = (low.contains(" pas") & (low.contains(" ne ") | low.contains(" n'") | low.startswith("n'"))) | low.rlike("(?U)\\bne\\b.*\\bpas\\b")
    future = F.exists(couples, lambda c: c["a"].isin(*GOING) & c["b"].isin(*PARTICIPLES))
    had = F.exists(couples, lambda c: c["whole"].isin(*HAVING) & c["bare"].isin(*participles))
    been = F.exists(couples, lambda c: c["whole"].isin(*BEING) & (c["bare"].isin(*participles) | _agreed(c["bare"]).isin(*participles)))
    return F.when(x.isNotNull(), F.when(question, "M5").when(negated, "M2").when(future, "M4").when(had | been, "M3").otherwise("M1"))


def detect_verb(x: Column, module: Column, run: str | None = None) -> Column:
    """The infinitive of the sentence's verb among those of a generation run (all without one); null if none stands there. The first word that gives one decides."""
    verbs = _verbs(run)
    words = tokens(F.lower(clean_sentence(x)))
    by_form = _map({form: verb for verb, forms in verbs.items() for form in forms})
    by_participle = _map({PARTICIPLES[v]: v for v in verbs})
    couples = _couples(words)
    first = lambda found: F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))
    ends = lambda w: F.regexp_replace(w, "[?.,!]+$", "")
    elided = lambda w: F.regexp_replace(F.regexp_replace(w, "^j['’]", ""), "^n['’]", "")
    future = first(F.transform(couples, lambda c: F.when(c["a"].isin(*GOING) & c["b"].isin(*verbs), c["b"])))
    past = first(F.transform(couples, lambda c: F.when(c["whole"].isin(*HAVING, *BEING), F.coalesce(by_participle[c["bare"]], by_participle[_agreed(c["bare"])]))))
    asked = F.coalesce(
        first(F.transform(words, lambda w: by_participle[_bare(ends(w))])),
        first(F.transform(words, lambda w: by_form[elided(F.regexp_replace(ends(w), "-.*$", ""))])),
    )
    plain = first(F.transform(words, lambda w: F.when(~ends(w).isin("ne", "pas", "n'", *PRONOUNS), by_form[elided(ends(w))])))
    return F.when(module == "M4", future).when(module == "M3", past).when(module == "M5", asked).otherwise(plain)


def _pronoun(low: Column, deeper: int) -> Column:
    low = F.regexp_replace(low, _LONG_QUESTION, "")
    opened = "^(d['’]où |quel |quelle |comment |où |que |qui )"
    rest = F.trim(F.regexp_replace(low, opened, ""))
    parts = F.flatten(F.transform(F.filter(tokens(rest), lambda w: w.contains("-")), lambda w: F.split(F.regexp_replace(w, "[?.,!]+$", ""), "-")))
    anywhere = F.get(F.filter(parts, lambda p: p.isin(*PRONOUNS)), F.lit(0))
    inverted = F.regexp_extract(rest, "(?U)^\\w+-(?:t-)?(\\w+)", 1)
    inner = _pronoun(rest, deeper - 1) if deeper else F.lit(None).cast("string")
    head = F.get(tokens(low), F.lit(0))
    return (
        F.when(low.rlike("^j['’]"), "je")
        .when(low.rlike(opened) & rest.rlike(_LONG_QUESTION), inner)
        .when(low.rlike("^(d['’]où |quel |quelle |comment )"), anywhere)
        .when(low.rlike("^(où |que |qui )"), F.when(inverted.isin(*PRONOUNS), inverted))
        .when(head.isin(*PRONOUNS), head)
    )


def subject_pronoun(x: Column) -> Column:
    """The subject pronoun, behind question openers too and where it follows the verb; null if there is none."""
    return _pronoun(F.lower(clean_sentence(x)), 2)


def module_number(x: Column) -> Column:
    """1 to 5 by the module's name, exact or within a longer one; null for others."""
    name = F.lower(strip(x))
    return F.coalesce(*[F.when(name == k, n) for k, n in MODULE_NAMES], *[F.when(name.contains(k), n) for k, n in MODULE_NAMES])


def looks_french(x: Column) -> Column:
    """A common French word, or two words at most; false without a word."""
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-zà-öø-ÿ']+"), F.lit(0))
    return F.coalesce((F.size(words) > 0) & ((F.size(words) <= 2) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in COMMON_FRENCH]))), F.lit(False))


def has_placeholder(x: Column) -> Column:
    return x.rlike("\\?{2,}|…|\\.{3,}")


def target_letters(x: Column) -> Column:
    """How many letters only the target language has."""
    return F.regexp_count(F.lower(x), F.lit(f"[{TARGET_LETTERS}]")).cast("long")


def suspicious_tail(x: Column) -> Column:
    return x.rlike(f"(?iuU)\\b({TAIL_WORDS})\\b")


def embedded_newline(x: Column) -> Column:
    return x.rlike("[\\r\\n]")


def negate(x: Column, elide: bool = False) -> Column:
    """Subject, ne, verb, pas, rest; j' becomes je n'. With elide, as the second run has it, ne is n' before a vowel or h. A sentence of one word other than an elision stays."""
    words = tokens(x)
    rest = F.array_join(F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))), " ")
    elided_rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    head, verb = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return F.when(head.startswith("j'"), F.concat(F.lit("je n'"), F.substring(head, 3, 1_000_000), F.lit(" pas "), elided_rest)).when(
        verb.isNotNull(), F.trim(F.concat(head, F.when(F.lit(elide) & F.lower(verb).rlike("^[aeiouhéèêàâîôûœ]"), " n'").otherwise(" ne "), verb, F.lit(" pas "), rest))
    ).otherwise(x)


def _side_score(side: Column) -> Column:
    """Canonical words of a phrase less its alternative ones."""
    words = F.transform(tokens(side), lambda w: F.btrim(w, F.lit("?.,;:")))
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    return count(CANONICAL_WORDS) - count(ALTERNATIVE_WORDS)


def slash_alternatives(x: Column) -> Column:
    """struct(canonical, alternative, status) of a target text in which a slash stands between two ways to say it.

    1. A text without a slash is canonical and has no alternative: no_slash.
    2. Word pairs: where `a/b`, with or without spaces around the slash and with a mark after it, is a pair of SLASH_PAIRS, each of the two texts takes its word. If that settles every slash: normalized.
    3. Phrases: with one slash and two different phrases, the second is canonical if its words score above 0 and those of the first below; it then takes over
       a leading pronoun of the first if it begins with a canonical word. Otherwise the first is canonical: normalized.
    4. All else is needs_review.
    """
    text = collapse(x)
    pairs = {f"{a}/{b}": keep for one, two, keep in SLASH_PAIRS for a, b in ((one, two), (two, one))}
    chosen, left_out = _map(pairs), _map({k: next(w for w in k.split("/") if w != keep) for k, keep in pairs.items()})
    units = F.split(F.regexp_replace(text, " ?/ ?", "/"), " ")

    def taken(words: Column) -> Column:
        def one(unit: Column) -> Column:
            bare = F.regexp_replace(unit, "[?.,;:]$", "")
            return F.coalesce(F.concat(F.element_at(words, bare), F.substring(unit, F.length(bare) + 1, F.lit(1))), unit)

        return F.array_join(F.transform(units, one), " ")

    by_words = F.struct(taken(chosen).alias("canonical"), taken(left_out).alias("alternative"), F.lit("normalized").alias("status"))
    sides = F.transform(F.split(text, "/"), collapse)
    first, second = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    opening = F.get(tokens(first), F.lit(0))
    completed = F.when(opening.isin(*TARGET_PRONOUNS) & F.get(tokens(second), F.lit(0)).isin(*CANONICAL_WORDS), F.concat_ws(" ", opening, second)).otherwise(second)
    swapped = (_side_score(second) > 0) & (_side_score(first) < 0)
    by_phrases = F.struct(F.when(swapped, completed).otherwise(first).alias("canonical"), F.when(swapped, first).otherwise(second).alias("alternative"), F.lit("normalized").alias("status"))
    unsettled = lambda status: F.struct(text.alias("canonical"), F.lit("").alias("alternative"), F.lit(status).alias("status"))
    return (
        F.when(~text.contains("/"), unsettled("no_slash"))
        .when(~by_words["canonical"].contains("/"), by_words)
        .when((F.size(sides) == 2) & (first != "") & (second != "") & (first != second), by_phrases)
        .when(text.isNotNull(), unsettled("needs_review"))
    )


def incomplete_ending(x: Column, words: tuple[str, ...]) -> Column:
    """The last word of a sentence if it is one that can't end one, else null."""
    # read from the end, where the match is anchored: from the start every letter of the text would be tried
    last = F.reverse(F.regexp_extract(F.reverse(F.lower(x)), "^[^a-zà-öø-ÿœ']*+([a-zà-öø-ÿœ']++)", 1))
    return F.when(last.isin(*words), last)
