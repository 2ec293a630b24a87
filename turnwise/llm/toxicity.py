"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding maps look-alike letters of other scripts, accents, digits and signs within words to one letter each (``1``, ``l``
and ``i`` are one), and all else to single spaces; the lexicon is folded alike. Entries are whole words or beginnings
of words, learned with log-odds weights from labelled rows; where a longer word that an entry begins occurs in
clean rows, that word is an exception; so is a phrase of two or three words around an entry whose rows are clean significantly
more often than the entry's. A match inside an exception doesn't count. A logistic curve over the logarithms of the
summed weights and of the length gives the score.

Learning reads a bounded sample of labelled rows (FIT_ROWS, a parameter); counts of words are added up on the
executors, and only entries, exceptions and phrases that pass their tests reach the driver: each stands in several rows of the
sample, so its size bounds them, and none is cut. Scoring is row by row over whole texts, in time linear in the text: no shuffle, no skew.

Defined cases: a null or empty text matches nothing and gets the curve's value there; without positive labels there
is no entry and every score is the share of positive labels; extra columns pass through; repeated rows score alike, rows of one id
teach once (the least text); null ids and labels teach nothing; an empty table has an empty result, and without labels the curve gives 0.5.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.common import labelled_sample, materialize, tidy

FIT_ROWS = 12_000
STEM = range(4, 9)
PHRASE = (2, 3)
LEAST_ODDS, LEAST_EVIDENCE, PURE_ODDS, PHRASE_EVIDENCE = 3.0, 12.0, 2.0, 6.0
THRESHOLD = 0.3

#: Letters of other scripts that look like Latin ones; both sides in the same order.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁɡһӏοαεινρτυχκωıɑʟ", "abekmhopctyxijsdghloaeivptuxkwial", strict=True))
#: Digits and signs that stand for letters; i, l and 1 are one letter.
SUBSTITUTES = dict(zip("0134578926l", "oieastbgzgi", strict=True))
SIGNS = dict(zip("@$!|+", "asiit", strict=True))
_SIGN = re.compile(r"(?<=\w)[@$!|+](?=\w)")


class _Fold(dict):
    """Code point -> folded string, worked out when first met."""

    def __missing__(self, point: int) -> str:
        char, out = chr(point), ""
        if unicodedata.category(char) not in ("Mn", "Cf"):
            for c in unicodedata.normalize("NFKD", char).casefold():
                c = LOOKALIKES.get(c, c)
                c = SUBSTITUTES.get(c, c)
                out += c if c.isalnum() else "" if unicodedata.category(c) == "Mn" else " "
        self[point] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, one space between, before and after them."""
    text = text or ""
    if any(c in text for c in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_FOLD).split())} "


def entries(text: str) -> set[str]:
    """Candidate entries in a folded text: its words and their beginnings."""
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEM if k < len(w)}


class Lexicon:
    """Weighted entries and exceptions, compiled into one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float, float]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """(end, entry) of the matches that no exception covers."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for e in (*self.weights, *self.exceptions):
                self._automaton.add_word(e, e)
            self._automaton.make_automaton()
        if not len(self._automaton):
            return []
        found = list(self._automaton.iter(folded))
        excused = sorted((end - len(e) + 1, end) for end, e in found if e not in self.weights)
        starts, reach = [a for a, _ in excused], list(itertools.accumulate((b for _, b in excused), max))

        def covered(start: int, end: int) -> bool:
            before = bisect.bisect_right(starts, start)
            return before > 0 and reach[before - 1] >= end

        return [(end, e) for end, e in found if e in self.weights and not covered(end - len(e) + 1, end)]

    def measure(self, text: str | None) -> tuple[float, int]:
        folded = fold(text)
        return sum(self.weights[e] for _, e in self.matches(folded)), folded.count(" ") - 1

    def score(self, text: str | None) -> float:
        weight, words = self.measure(text)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(weight) + c * np.log1p(max(0, words) / 100) * (weight > 0), -35, 35))))


def _curve(weight: np.ndarray, words: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.stack([np.ones(len(y)), np.log1p(weight), np.log1p(np.maximum(0, words) / 100) * (weight > 0)], axis=1)
    w, ridge = np.zeros(3), 0.1 * np.eye(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return tuple(float(v) for v in w)


def around(folded: str, lexicon: Lexicon) -> set[tuple[str, str]]:
    """(entry, phrase) for each entry that counts in a folded text: itself, and the phrases of PHRASE words that hold its word."""
    found = lexicon.matches(folded)
    gaps = [i for i, c in enumerate(folded) if c == " "] if found else []
    out = {(e, e) for _, e in found}
    for end, e in found:
        word = bisect.bisect_left(gaps, end - len(e) + 1)
        for n in PHRASE:
            out.update((e, folded[gaps[k] : gaps[k + n] + 1]) for k in range(max(0, word - n + 1), min(word + 1, len(gaps) - n)))
    return out


def _phrases(sample: DataFrame, lexicon: Lexicon, odds: Column) -> list[str]:
    """Phrases around entries whose rows are clean so much more often than the entry's that chance doesn't explain it."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
                seen.update((*pair, y) for pair in around(fold(text), lexicon))
        found = list(seen.items())
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.string()), pa.array([n if k[2] else 0 for k, n in part], pa.int64()), pa.array([0 if k[2] else n for k, n in part], pa.int64())], ["entry", "phrase", "bad", "good"])

    rows = sample.select("text", (F.col("y") > 0).cast("int").alias("y")).mapInArrow(count, "entry string, phrase string, bad bigint, good bigint")
    counts = materialize(rows.groupBy("entry", "phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    clean = counts.where(F.col("entry") == F.col("phrase")).select("entry", ((F.col("good") + 0.5) / (F.col("bad") + F.col("good") + 1)).alias("clean"))  # a row for each entry of the lexicon
    evidence = F.col("good") * F.log(F.col("good") / (F.col("bad") + F.col("good")) / F.col("clean"))
    harmless = counts.where((F.col("entry") != F.col("phrase")) & (F.col("good") >= 2)).where(odds < PURE_ODDS).join(F.broadcast(clean), "entry").where(evidence >= PHRASE_EVIDENCE)
    return sorted(r["phrase"] for r in harmless.select("phrase").distinct().collect())  # in two rows of the sample each


@tidy
def learn(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, rows: int = FIT_ROWS, label: str = "toxic") -> Lexicon:
    sample = labelled_sample(docs, labels, label, modulus, remainder, rows)

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
                seen.update((e, y) for e in entries(fold(text)))
        found = list(seen.items())
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([e for (e, _), _ in part], pa.string()), pa.array([n if y else 0 for (_, y), n in part], pa.int64()), pa.array([0 if y else n for (_, y), n in part], pa.int64())], ["entry", "bad", "good"])

    total = sample.agg(F.sum((F.col("y") > 0).cast("long")).alias("bad"), F.sum((F.col("y") == 0).cast("long")).alias("good")).first()
    n_bad, n_good = total["bad"] or 0, total["good"] or 0
    counts = sample.select("text", (F.col("y") > 0).cast("int").alias("y")).mapInArrow(count, "entry string, bad bigint, good bigint").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    evidence = F.col("bad") * F.log((F.col("bad") / max(1, n_bad)) / ((F.col("bad") + F.col("good")) / max(1, n_bad + n_good)))
    strong = counts.withColumn("odds", odds).where((F.col("bad") > 0) & (odds >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE))
    weights: dict[str, float] = {}
    for r in sorted(strong.collect(), key=lambda r: (len(r["entry"]), r["entry"])):
        if not any(r["entry"][:k] in weights for k in range(2, len(r["entry"]))):  # the shortest beginning stands for all
            weights[r["entry"]] = float(r["odds"])
    stems = [e for e in weights if not e.endswith(" ")]
    exceptions: list[str] = []
    if stems:
        of_stem = F.lit(False)
        for k in sorted({len(e) for e in stems}):
            of_stem = of_stem | F.substring("entry", 1, k).isin([e for e in stems if len(e) == k])
        benign = counts.where(F.col("entry").endswith(" ") & of_stem & (F.col("good") >= 2)).withColumn("odds", odds).where(F.col("odds") < PURE_ODDS)
        exceptions = sorted(r["entry"] for r in benign.select("entry").collect())
    lexicon = Lexicon(weights, exceptions, (0.0, 0.0, 0.0))
    if weights:
        lexicon = Lexicon(weights, exceptions + _phrases(sample, lexicon, odds), lexicon.curve)

    def measured(batches):
        for b in batches:
            got = [lexicon.measure(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(x[0]) for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64()), b["y"]], ["weight", "words", "y"])

    points = sample.select("text", (F.col("y") > 0).cast("int").alias("y")).mapInArrow(measured, "weight double, words bigint, y int").orderBy("weight", "words", "y").collect()  # at most ``rows``
    if points:
        lexicon.curve = _curve(*(np.array([p[k] for p in points], float) for k in ("weight", "words", "y")))
    return lexicon


def scorer(lexicon: Lexicon):
    """A column function text -> score in [0, 1]."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(t.as_py()) for t in texts], pa.float64())

    return score.asNondeterministic()
