"""Quality rules: a threshold table compiled into one projection.

A rule says that one measure of a text must lie between two bounds. The table
of rules becomes one Boolean column; measures are built-in Spark expressions on
the text, so a scan with this projection is the whole job: nothing is shuffled,
and no user function runs.

Defined results: a null text counts as empty and fails for having too few
words; a ratio of an empty text is 0; rows keep their own columns, and measures
come in one struct column whose name the caller chooses, so no name clashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nestfold.llm.base import WORD, free_name, query, table

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as are was this an at by from or "
    "der die das und ist nicht ein eine zu mit den von auf des im für sich dem auch als "
    "le la les de et des un une est que en du dans pour qui au par sur pas plus "
    "el los las y un una es en del por con para se lo como su al"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must be at least ``low`` and at most ``high``; None: no bound."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The thresholds in use. Ratios are shares of words or lines.
RULES = (
    Rule("enough words", "n_words", low=50),
    Rule("mean word length", "mean_word_chars", low=2, high=14),
    Rule("few symbols", "symbols_per_word", high=0.1),
    Rule("some stop words", "stop_words", low=2),
    Rule("few bullet lines", "bullet_lines", high=0.9),
    Rule("few lines cut off", "ellipsis_lines", high=0.3),
    Rule("few repeated lines", "dup_lines", high=0.5),
    Rule("few repeated windows", "repeat_words", high=0.5),
    Rule("few shouted words", "shout_words", high=0.3),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


#: Bits of a position in the first sort key; longer texts take the second step for all windows.
_PLACE_BITS = 20


def _window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _window_codes(words: Column) -> Column:
    """Sorted longs: the high bits of each 3-word window's hash, then its position."""
    mask = F.lit((1 << _PLACE_BITS) - 1).cast("long")
    codes = F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: _window_hash(words, i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
    return F.when((F.size(words) >= 3) & (F.size(words) <= 1 << _PLACE_BITS), codes).otherwise(
        F.array().cast("array<bigint>"))


def _suspects(words: Column, codes: Column) -> Column:
    """(hash, position) of all windows whose high hash bits occur twice, sorted."""
    mask = F.lit((1 << _PLACE_BITS) - 1).cast("long")
    high = lambda x: F.shiftright(x, _PLACE_BITS)
    near = F.filter(codes, lambda x, k: (
        (high(x) == high(F.get(codes, k - 1))) | (high(x) == high(F.get(codes, k + 1)))))
    places = F.when(
        F.size(words) <= 1 << _PLACE_BITS, F.transform(near, lambda x: x.bitwiseAND(mask).cast("int"))
    ).otherwise(F.sequence(F.lit(0), F.size(words) - 3))
    return F.sort_array(F.transform(places, lambda i: F.struct(_window_hash(words, i).alias("h"), i.alias("i"))))


def _covered(windows: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Windows are sorted by hash; equal neighbours are repeats. That takes n log n
    steps for n words, however long the text is. The first sort is over plain
    longs, and only windows that share 44 bits there are compared by all 64.
    """
    again = F.filter(windows, lambda x, k: (
        (x["h"] == F.get(windows, k - 1)["h"]) | (x["h"] == F.get(windows, k + 1)["h"])))
    places = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(places)).cast("long")


def measures(df: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """``df`` with a struct of the measures of each whole text."""
    part = lambda name: f"_{out}_{name}"
    body = F.coalesce(F.col(text), F.lit(""))
    w, lined = F.col(part("words")), F.col(part("lines"))
    stops = F.array(*[F.lit(x) for s in dict.fromkeys(STOP_WORDS) for x in (s, s.capitalize())])
    counted = (
        df.withColumn(part("words"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
        .withColumn(part("lines"), F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)))
        .withColumn(part("codes"), _window_codes(w))
        .withColumn(part("windows"), _suspects(w, F.col(part("codes"))))
        .withColumn(part("base"), F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lined) - F.size(F.array_distinct(lined))).cast("long").alias("n_dup_lines"),
            _covered(F.col(part("windows"))).alias("n_repeat_words"),
            F.size(lined).cast("long").alias("n_lines"),
            F.size(F.array_intersect(w, stops)).cast("long").alias("stop_words"),
            F.size(F.filter(lined, lambda x: F.ltrim(x).rlike("^[-*•‣]"))).alias("n_bullets"),
            F.size(F.filter(lined, lambda x: x.endswith("...") | x.endswith("…"))).alias("n_cut"),
            ((F.length(body) - F.length(F.replace(body, F.lit("!!"), F.lit("")))) / 2).alias("n_shouts"),
        ))
    )
    b = F.col(part("base"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "stop_words")
    per_word, per_line = (lambda x, n=n: _ratio(b[x], b[n]) for n in ("n_words", "n_lines"))
    return counted.withColumn(out, F.struct(
        *[b[f].alias(f) for f in fields],
        per_word("word_chars").alias("mean_word_chars"), per_word("n_symbols").alias("symbols_per_word"),
        per_line("n_bullets").alias("bullet_lines"), per_line("n_cut").alias("ellipsis_lines"),
        per_line("n_dup_lines").alias("dup_lines"), per_word("n_repeat_words").alias("repeat_words"),
        per_word("n_shouts").alias("shout_words"),
    )).drop(*[part(n) for n in ("words", "lines", "codes", "windows", "base")])


def compile_rules(rules: Sequence[Rule], measure: Mapping[str, Column]) -> Column:
    """One Boolean column: every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        value = measure[rule.measure]
        if rule.low is not None:
            verdict = verdict & (value >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (value <= F.lit(rule.high))
    return verdict


def failed_rules(rules: Sequence[Rule], measure: Mapping[str, Column]) -> Column:
    """The names of the rules that a text breaks, for reports."""
    return F.filter(F.array(*[
        F.when(~compile_rules([rule], measure), F.lit(rule.name)) for rule in rules]), lambda x: x.isNotNull())


class _Fields(dict):
    """Field columns of a struct by name."""

    def __init__(self, struct: Column):
        super().__init__()
        self.struct = struct

    def __missing__(self, name: str) -> Column:
        return self.struct[name]


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", out: str = "measures") -> DataFrame:
    """``df`` with the struct ``out``: all measures, ``failed`` (rule names) and ``kept``."""
    measured = measures(df, text, out)
    fields = _Fields(F.col(out))
    return measured.withColumn(out, F.col(out).withField("failed", failed_rules(rules, fields)).withField(
        "kept", compile_rules(rules, fields)))


def keep_good(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows whose text keeps every rule, with their own columns only.

    The verdict passes through a one-element array: a filter on it is then not
    pushed below the projection, where it would repeat the measures many times.
    """
    verdict, kept = free_name(df, "_quality"), free_name(df, "_kept")
    judged = judge(df, rules, text, verdict)
    return judged.select(*df.columns, F.explode(F.array(f"{verdict}.kept")).alias(kept)).filter(F.col(kept)).drop(kept)


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM
    (SELECT doc_id, i, unnest([0, 1, 2]) AS k, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g)
    WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    len(list_distinct(list_intersect(ws, [STOPS]))) AS stops,
    len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•‣]'))) AS bullets,
    len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS cut,
    (length(t) - length(replace(t, '!!', ''))) / 2.0 AS shouts
    FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws('; ',
    CASE WHEN n_words < 50 THEN 'enough words' END,
    CASE WHEN n_words = 0 OR word_chars / n_words NOT BETWEEN 2 AND 14 THEN 'mean word length' END,
    CASE WHEN n_words > 0 AND n_symbols / n_words > 0.1 THEN 'few symbols' END,
    CASE WHEN stops < 2 THEN 'some stop words' END,
    CASE WHEN n_lines > 0 AND bullets / n_lines > 0.9 THEN 'few bullet lines' END,
    CASE WHEN n_lines > 0 AND cut / n_lines > 0.3 THEN 'few lines cut off' END,
    CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'few repeated lines' END,
    CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.5 THEN 'few repeated windows' END,
    CASE WHEN n_words > 0 AND shouts / n_words > 0.3 THEN 'few shouted words' END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND failed = '' AS kept, failed FROM f
"""
#: What the query computes, for an independent engine.
SQL = _SQL.replace("STOPS", ", ".join(f"'{x}'" for s in dict.fromkeys(STOP_WORDS) for x in (s, s.capitalize())))


@query("op4_quality_rules", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, and the names of the rules it breaks."""
    m = judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "measures.*")
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"),
        F.array_join("failed", "; ").alias("failed"))
