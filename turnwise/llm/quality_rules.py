"""Quality rules: a table of thresholds compiled into one projection, without user functions.

A rule names a measure of the text and the range that passes. ``compile_rules`` turns the table into
boolean columns of a single Spark projection; ``measures`` holds the measures. Everything stays in the JVM
and row by row: there is no shuffle, so a skewed source or a very long document costs its own time only.

Defined cases: a null text counts as empty; an empty text has zero words and fails the base rule; columns of
the input beside the id and the text are ignored, whatever their names; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import SEPARATOR_RUN, SEPARATORS

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish; prose has several different ones.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "was", "on", "are", "as", "by", "this", "or",
    "der", "die", "das", "und", "ist", "ein", "nicht", "zu", "den", "von", "mit", "sich", "des", "auf", "für", "dem",
    "le", "la", "les", "de", "et", "un", "une", "des", "que", "dans", "est", "pour", "pas", "du", "en", "qui",
    "el", "los", "las", "y", "no", "por", "para", "se", "su", "del", "al", "con", "es", "lo", "una", "mi",
)


class Rule(NamedTuple):
    """``measure * 100`` must lie in [low * of, high * of]; None leaves a side open, an empty ``of`` stands for 1."""

    name: str
    measure: str
    of: str
    low: int | None
    high: int | None


#: Percentages, so that all comparisons are of integers and hold exactly on any engine.
RULES: tuple[Rule, ...] = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 25),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 50),
    Rule("stop_words", "n_stop_words", "", 200, None),
    Rule("letter_ratio", "n_letters", "word_chars", 60, None),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("capital_ratio", "n_capitals", "n_letters", None, 40),
)
BASE_WORDS, BASE_REPEAT = 50, 50
#: Up to so many repeated windows of a text are looked up one by one; either way gives the same positions.
FEW = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the lambda's variable stands for it wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(items: Column, keep: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, keep)).cast("long")


def _covered(starts: Column) -> Column:
    """Words covered by windows of three that begin at these ascending positions."""
    first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(starts, first, step, lambda acc: acc["n"].cast("long"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the same text.

    Windows are compared by a 64-bit hash. Only texts that repeat one at all pay for the sort that finds
    the positions.
    """
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<bigint>"))

    def placed(hashes: Column) -> Column:
        """By sorting hashes with their places: for texts that repeat many windows."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1))
        return F.sort_array(F.transform(_let(pairs, twice), lambda x: x["i"]))

    def looked_up(hashes: Column, found: Column) -> Column:
        """By comparing each window with the few hashes that occur twice."""
        return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(found, h), i).otherwise(-1)), lambda i: i >= 0)

    def positions(hashes: Column) -> Column:
        again = lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False))))
        return _let(_let(F.sort_array(hashes), again), lambda found: F.when(F.size(found) <= FEW, looked_up(hashes, found)).otherwise(placed(hashes)))

    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(positions(w))))


def measures(text: Column) -> Column:
    """All measures of a text as one struct of longs; a null text counts as empty."""
    return _let(F.coalesce(text, F.lit("")), _measured)  # no plain struct(), which the optimizer would inline into each use


def _measured(text: Column) -> Column:
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    bare = F.btrim(text, F.lit(SEPARATORS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR_RUN))
    lines = F.filter(F.split(text, "\n"), has_word)
    n = lambda c, name: c.cast("long").alias(name)
    of_words = _let(
        words,
        lambda w: F.struct(
            n(F.size(w), "n_words"),
            n(F.length(F.array_join(w, "")), "word_chars"),
            n(repeated_words(w), "n_repeat_words"),
            n(F.size(F.array_intersect(w, F.array(*map(F.lit, dict.fromkeys(STOP_WORDS))))), "n_stop_words"),
        ),
    )
    of_lines = _let(
        lines,
        lambda x: F.struct(
            n(F.size(x), "n_lines"),
            n(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"),
            n(_count(x, lambda y: y.rlike(r"^[\x20\t]*[-*•]")), "n_bullet_lines"),
            n(_count(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\t\r]*\z")), "n_ellipsis_lines"),
        ),
    )
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    of_text = F.struct(
        n(without(f"[{SYMBOLS}]+"), "n_symbols"),
        n(without(r"\p{L}+"), "n_letters"),
        n(without(r"\p{Lu}+"), "n_capitals"),
    )
    return F.struct(of_words.alias("w"), of_lines.alias("l"), of_text.alias("t"))


FIELDS = {
    "n_words": "w", "n_repeat_words": "w", "n_stop_words": "w", "n_letters": "t", "n_capitals": "t",
    "n_lines": "l", "n_dup_lines": "l", "n_bullet_lines": "l", "n_ellipsis_lines": "l", "word_chars": "w", "n_symbols": "t",
}


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[list[Column], Column]:
    """Columns ``rule_<name>`` (true: passes) over the columns of FIELDS, and their conjunction."""
    out, every = [], F.lit(True)
    for r in rules:
        part, whole, ok = 100 * F.col(r.measure), F.col(r.of) if r.of else F.lit(1), F.lit(True)
        if r.low is not None:
            ok = ok & (part >= r.low * whole)
        if r.high is not None:
            ok = ok & (part <= r.high * whole)
        out.append(ok.alias(f"rule_{r.name}"))
        every = every & ok
    return out, every


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, all measures, ``base_failed``, one column for each rule and ``kept``."""
    named, every = compile_rules(rules)
    measured = docs.select("doc_id", measures(F.col("text")).alias("m"))
    flat = measured.select("doc_id", *(F.col(f"m.{part}.{name}").alias(name) for name, part in FIELDS.items()))
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    return flat.select("*", base.alias("base_failed"), *named, (~base & every).alias("kept"))
