"""SQL for edits, common subsequences, BLEU, chrF and the signed-rank test: the definitions spelled out over tables of cells, n-grams and ranks."""

from __future__ import annotations

from quern.queries.registry import PAIRS, words_sql

#: Cells of the table of edits, row by row: a row's insertions are running minima. s counts substitutions along the path that is preferred.
EDITS = f"""w AS (SELECT ord, {words_sql('tgt')} AS r, {words_sql('src')} AS h FROM pairs),
rw AS (SELECT ord, unnest(generate_series(1, len(r))) AS i, unnest(r) AS x FROM w),
d AS (
  SELECT ord, 0 AS i, j, CASE WHEN j > 0 THEN h[j] END AS y, j AS d, 0 AS s FROM (SELECT *, unnest(generate_series(0, len(h))) AS j FROM w)
  UNION ALL
  SELECT ord, i, j, y, d, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY ord ORDER BY j), 0) AS s FROM (
    SELECT *, CASE WHEN j > 0 AND d = corner + unlike THEN corner_s + unlike WHEN j > 0 AND d = lag(d) OVER (PARTITION BY ord ORDER BY j) + 1 THEN NULL ELSE s_before END AS own FROM (
      SELECT ord, i, j, y, corner, corner_s, unlike, s AS s_before, (j + min(least(d + 1, corner + unlike) - j) OVER (PARTITION BY ord ORDER BY j))::BIGINT AS d FROM (
        SELECT d.ord, d.i + 1 AS i, j, y, d, s, lag(d) OVER (PARTITION BY d.ord ORDER BY j) AS corner, lag(s) OVER (PARTITION BY d.ord ORDER BY j) AS corner_s, (x IS DISTINCT FROM y)::INT AS unlike FROM d JOIN rw ON rw.ord = d.ord AND rw.i = d.i + 1)))
), edits AS (SELECT ord, d, s, len(h) AS hn, len(r) AS rn FROM d JOIN w USING (ord) WHERE i = len(r) AND j = len(h))"""

OPERATIONS = f"WITH RECURSIVE {PAIRS}, {EDITS} SELECT ord, s::BIGINT AS substitutions, ((d - s + hn - rn) // 2)::BIGINT AS insertions, ((d - s - hn + rn) // 2)::BIGINT AS deletions, rn AS ref_words FROM edits"

#: Characters beyond ASCII each as one that the texts don't have, as the built-in distance counts bytes.
_CODED = """beyond AS (SELECT string_agg(ch, '' ORDER BY ch) AS a, substr('#$%&*+/0123456789;<=>@[]^_`{|}~"()' || chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8), 1, count(*)) AS b FROM (SELECT DISTINCT unnest(string_split(src || tgt, '')) AS ch FROM pairs) WHERE ord(ch) > 127)"""
_STRIP = "translate(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), a, b)"
ERROR_RATES = f"""WITH RECURSIVE {PAIRS}, {EDITS}, {_CODED}, c AS (SELECT ord, levenshtein({_STRIP.format('tgt')}, {_STRIP.format('src')}) AS e, length(regexp_replace(tgt, '^\\s+|\\s+$', '', 'g')) AS n FROM pairs, beyond)
SELECT 'all' AS all, sum(e)::BIGINT AS char_edits, round(100.0 * sum(e) / sum(n), 4) AS cer, sum(d)::BIGINT AS word_edits, round(100.0 * sum(d) / sum(rn), 4) AS wer FROM c JOIN edits USING (ord)"""

ROUGE = f"""WITH RECURSIVE {PAIRS}, w AS (SELECT ord, regexp_extract_all(lower(coalesce(tgt, '')), '[a-z0-9]+') AS r, regexp_extract_all(lower(coalesce(src, '')), '[a-z0-9]+') AS h FROM pairs),
rw AS (SELECT ord, unnest(generate_series(1, len(r))) AS i, unnest(r) AS x FROM w),
d AS (
  SELECT ord, 0 AS i, j, CASE WHEN j > 0 THEN h[j] END AS y, 0 AS d FROM (SELECT *, unnest(generate_series(0, len(h))) AS j FROM w)
  UNION ALL
  SELECT ord, i, j, y, max(greatest(d, coalesce(corner, 0) + same)) OVER (PARTITION BY ord ORDER BY j) AS d FROM (
    SELECT d.ord, d.i + 1 AS i, j, y, d, lag(d) OVER (PARTITION BY d.ord ORDER BY j) AS corner, (x IS NOT DISTINCT FROM y)::INT AS same FROM d JOIN rw ON rw.ord = d.ord AND rw.i = d.i + 1)
) SELECT ord, round(CASE WHEN d > 0 THEN 200.0 * d / (len(r) + len(h)) ELSE 0 END, 6) AS rouge_l FROM d JOIN w USING (ord) WHERE i = len(r) AND j = len(h)"""

_ENTITIES = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def _words_13a(c: str) -> str:
    x = f"coalesce({c}, '')"
    for old, new in _ENTITIES:
        x = f"replace({x}, '{old}', '{new}')"
    x = f"' ' || {x} || ' '"
    for pattern, by in ((r"([\{-\~\[-` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def _apart(c: str) -> str:
    mark = "'[!-/:-@\\[-`{-~]'"
    one = f"CASE WHEN length(w) > 1 AND regexp_matches(w, {mark} || '$') THEN [left(w, -1), right(w, 1)] WHEN length(w) > 1 AND regexp_matches(w, '^' || {mark}) THEN [left(w, 1), substr(w, 2)] ELSE [w] END"
    return f"flatten(list_transform({words_sql(c)}, lambda w: {one}))"


def _grams(side: str, of: str, n: str) -> str:
    return f"SELECT ord, k, n, unnest(list_transform(generate_series(1, len({side}) - n + 1), lambda i: {of})) AS g FROM x, generate_series(1, {n}) t(n)"


def score_ctes(refs: str) -> str:
    """Counts of n-grams from refs (ord, grp, k, h, r), a row for each reference k of a candidate: b (ord, n, m, t) for BLEU with lengths bl, c (ord, k, o, t, r, m) for chrF, of whose orders the first six are characters, and the best references f0 and f2."""
    words = lambda c: f"array_to_string({c}[i:i + n - 1], chr(1))"
    char = lambda c: f"substr({c}, i, n)"
    counted = lambda name, grams: f"{name} AS (SELECT ord, k, n, g, count(*) AS c FROM ({grams}) GROUP BY ALL)"
    shared = lambda name, a, b, shift: f"{name} AS (SELECT {a}.ord, {a}.k, {a}.n + {shift} AS o, sum(least({a}.c, {b}.c)) AS m FROM {a} JOIN {b} ON {a}.ord = {b}.ord AND {a}.k = {b}.k AND {a}.n = {b}.n AND {a}.g = {b}.g GROUP BY ALL)"
    best = lambda w: f"f{w} AS (SELECT ord, arg_min(k, struct_pack(a := -f, b := k)) AS k FROM (SELECT ord, k, coalesce(CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) END, 0) AS f FROM (SELECT ord, k, avg(m / t) FILTER (t > 0 AND r > 0) AS p, avg(m / r) FILTER (t > 0 AND r > 0) AS q FROM c WHERE o <= {6 + w} GROUP BY ALL)) GROUP BY ord)"
    return ", ".join([
        f"refs AS ({refs})",
        f"x AS (SELECT ord, grp, k, {_words_13a('h')} AS hw, {_words_13a('r')} AS rw, regexp_replace(coalesce(h, ''), '\\s+', '', 'g') AS hc, regexp_replace(coalesce(r, ''), '\\s+', '', 'g') AS rc, {_apart('h')} AS ha, {_apart('r')} AS ra FROM refs)",
        counted("bh", _grams("hw", words("hw"), "4")), counted("br", _grams("rw", words("rw"), "4")),
        "bm AS (SELECT ord, n, sum(least(bh.c, q.c)) AS m FROM bh JOIN (SELECT ord, n, g, max(c) AS c FROM br GROUP BY ALL) q USING (ord, n, g) WHERE bh.k = 0 GROUP BY ALL)",
        "bl AS (SELECT ord, any_value(grp) AS grp, any_value(len(hw)) AS hl, arg_min(len(rw), struct_pack(a := abs(len(rw) - len(hw)), b := len(rw))) AS rl FROM x GROUP BY ord)",
        "b AS (SELECT bl.ord, grp, t.n, coalesce(m, 0) AS m, greatest(hl - t.n + 1, 0) AS t FROM bl CROSS JOIN generate_series(1, 4) t(n) LEFT JOIN bm ON bm.ord = bl.ord AND bm.n = t.n)",
        counted("ch", _grams("hc", char("hc"), "6")), counted("cr", _grams("rc", char("rc"), "6")), counted("wh", _grams("ha", words("ha"), "2")), counted("wr", _grams("ra", words("ra"), "2")),
        shared("cm", "ch", "cr", 0), shared("wm", "wh", "wr", 6),
        "c AS (SELECT x.ord, grp, x.k, s.o, CASE WHEN s.o <= 6 THEN greatest(len(hc) - s.o + 1, 0) ELSE greatest(len(ha) - s.o + 7, 0) END AS t, CASE WHEN s.o <= 6 THEN greatest(len(rc) - s.o + 1, 0) ELSE greatest(len(ra) - s.o + 7, 0) END AS r, coalesce(m, 0) AS m FROM x CROSS JOIN generate_series(1, 8) s(o) LEFT JOIN (SELECT * FROM cm UNION ALL SELECT * FROM wm) y ON y.ord = x.ord AND y.k = x.k AND y.o = s.o)",
        best(0), best(2),
    ])


def bleu(by: str, effective: bool = False) -> str:
    """(by, bleu) over the sums of each group."""
    whole = "orders > 0" if effective else "orders = 4"
    return f"""SELECT {by}, CASE WHEN {whole} AND m1 > 0 THEN 100 * exp(CASE WHEN hl >= rl THEN 0 ELSE 1 - rl / hl END + logs / orders) ELSE 0 END AS bleu FROM (
      SELECT {by}, sum(CASE WHEN t > 0 THEN ln(CASE WHEN m = 0 THEN 1.0 / (2 ** z * t) ELSE m / t END) ELSE 0 END) AS logs, count(*) FILTER (t > 0) AS orders, max(m) FILTER (n = 1) AS m1 FROM (
        SELECT *, sum((m = 0 AND t > 0)::INT) OVER (PARTITION BY {by} ORDER BY n) AS z FROM (SELECT {by}, n, sum(m) AS m, sum(t) AS t FROM b GROUP BY ALL)) GROUP BY {by}) JOIN (SELECT {by}, sum(hl) AS hl, sum(rl) AS rl FROM bl GROUP BY {by}) USING ({by})"""


def chrf(by: str, words: int, name: str) -> str:
    """(by, name) over the sums of each group's best references."""
    return f"""SELECT {by}, coalesce(CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) END, 0) AS {name} FROM (
      SELECT {by}, avg(m / t) FILTER (t > 0 AND r > 0) AS p, avg(m / r) FILTER (t > 0 AND r > 0) AS q FROM (SELECT {by}, o, sum(t) AS t, sum(r) AS r, sum(m) AS m FROM c JOIN f{words} USING (ord, k) WHERE o <= {6 + words} GROUP BY ALL) GROUP BY {by})"""


_ONE = "SELECT ord, 'all' AS grp, 0 AS k, src AS h, tgt AS r FROM pairs"
_TWO = "SELECT ord, conv_id % 4 AS grp, k, src AS h, CASE WHEN k = 0 THEN tgt ELSE lower(tgt) END AS r FROM pairs, (VALUES (0), (1)) v(k)"
CORPUS_BLEU = f"WITH {PAIRS}, {score_ctes(_ONE)} SELECT (SELECT count(*) FROM pairs) AS n, round(bleu, 4) AS bleu FROM ({bleu('grp')})"
CORPUS_CHRF = f"WITH {PAIRS}, {score_ctes(_ONE)} SELECT (SELECT count(*) FROM pairs) AS n, round(chrf, 4) AS chrf, round(chrfpp, 4) AS chrfpp FROM ({chrf('grp', 0, 'chrf')}) JOIN ({chrf('grp', 2, 'chrfpp')}) USING (grp)"
CORPUS_SCORES = f"WITH {PAIRS}, {score_ctes(_TWO)} SELECT grp AS part, (SELECT count(*) FROM pairs WHERE conv_id % 4 = grp) AS n, round(bleu, 4) AS bleu, round(chrf, 4) AS chrf, round(chrfpp, 4) AS chrfpp FROM ({bleu('grp')}) JOIN ({chrf('grp', 0, 'chrf')}) USING (grp) JOIN ({chrf('grp', 2, 'chrfpp')}) USING (grp)"
_SENTENCES = f"SELECT ord, round(bleu, 6) AS sentence_bleu, round(chrf, 6) AS sentence_chrf, round(chrfpp, 6) AS sentence_chrfpp FROM ({bleu('ord', True)}) JOIN ({chrf('ord', 0, 'chrf')}) USING (ord) JOIN ({chrf('ord', 2, 'chrfpp')}) USING (ord)"
SENTENCE_SCORES = f"WITH {PAIRS}, {score_ctes(_ONE)} {_SENTENCES}"
SPOTLIGHT = f"WITH {PAIRS}, {score_ctes(_ONE)} SELECT ord, sentence_chrf - sentence_bleu AS gap FROM ({_SENTENCES}) ORDER BY gap DESC, ord LIMIT 20"


def wilcoxon(rows: str, key: str) -> str:
    """The normal branch over rows (key, d): mean ranks of the sizes that aren't 0, both tails by the series of the error function, or its continued fraction far out."""
    return f"""WITH v AS ({rows}), a AS (SELECT {key}, d, rank() OVER (PARTITION BY {key} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {key}, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY {key}, abs(d)) AS c FROM v WHERE d <> 0),
s AS (SELECT {key}, count(*) AS n, sum(r) FILTER (d > 0) AS w, sum(c * c - 1) AS ties FROM a GROUP BY {key}),
z AS (SELECT {key}, n, w, abs(least(w, n * (n + 1) / 2 - w) - n * (n + 1) / 4) / sqrt((n * (n + 1.0) * (2 * n + 1) - ties / 2) / 24) / sqrt(2) AS x FROM s)
SELECT {key}, n, w::DOUBLE AS w_plus, round(CASE WHEN x < 3 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 80), lambda i: (-1) ** i * x ** (2 * i + 1) / gamma(i + 1) / (2 * i + 1))) ELSE exp(-x * x) / sqrt(pi()) / list_reduce(list_transform(generate_series(0, 80), lambda i: x + 0 * i), lambda acc, v, i: v + (82 - i) / 2 / acc) END, 8) AS p_value FROM z"""
