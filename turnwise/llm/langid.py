"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance.

n-grams of one to three characters within words (a boundary counts as a character, other than letters all are
boundaries), lower case, packed exactly into 64 bits. A profile is the PROFILE most frequent n-grams in order;
ties go by the packed value. For each language the distance is the sum of rank differences, and PROFILE for an n-gram
that its profile lacks. The score is how far the best language is from the worst possible distance and its runner-up.

Profiles come from a bounded sample of documents for each language (FIT_ROWS, a parameter), n-gram counts being added
up on the executors; a profile has 300 entries, so the model grows with the number of languages only. Prediction is
row by row over whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null language or text
don't train; equal texts of one language train once, so rows without an id are sampled like others; without any profile every text is ``und``;
ties between languages go to the first by code point; repeated rows get equal results, an empty table an empty one; a very long text is counted whole.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.common import held_out

PROFILE = 300
FIT_ROWS = 500
#: Characters that are counted at a time; bounds the temporary arrays, not the text.
PIECE = 1 << 20
UNKNOWN = "und"
_EDGE = 1
_BOUND = np.array([_EDGE])


@functools.cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else the boundary."""
    out = np.full(sys.maxunicode + 1, _EDGE, np.int64)
    found = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    out[found] = found
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, counts) of a text, counted a piece at a time, so that memory follows the distinct ones."""
    text, tail, keys, counts = text.lower(), _BOUND, np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, max(1, len(text)), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), np.uint32)
        c = np.concatenate([tail, _letters()[points], _BOUND[: int(at + PIECE >= len(text))]])
        inner = c != _EDGE
        c = c[inner | np.concatenate([[True], inner[:-1]])]  # one boundary between words
        inner, old = c != _EDGE, len(tail)
        two = (c[:-1] << 21) | c[1:]
        three = (two[:-1] << 21) | c[2:]
        own, n = np.unique(np.concatenate([c[old:][inner[old:]], two[old - 1 :], three[inner[1:-1]]]), return_counts=True)  # those that end beyond the tail
        keys, counts = _added(keys, counts, own, n) if at else (own, n)
        tail = c[-2:]
    return keys, counts


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.union1d(keys, more)
    sums = np.zeros(len(out), np.int64)
    sums[np.searchsorted(out, keys)] = counts
    sums[np.searchsorted(out, more)] += n
    return out, sums


def top(keys: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent, in order; ties by value."""
    if len(keys) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:k]


class Profiles:
    """Ranks of all n-grams of all profiles, as a table n-gram x language."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, own)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == own[known]
        ranks = self.ranks[np.where(known, at, len(self.keys))]
        return np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        keys, counts = ngrams(text)
        if not len(keys):
            return UNKNOWN, 0.0
        own = top(keys, counts)
        d = self.distances(own) / (PROFILE * len(own))
        best = int(np.argmin(d))
        others = np.delete(d, best)
        near = others.min() if len(others) else 1.0
        return self.langs[best], float(min(1.0, max(0.0, (near - d[best]) / max(near, 1e-9))))


def fit(docs: DataFrame, modulus: int, remainder: int, rows: int = FIT_ROWS, profile: int = PROFILE) -> Profiles:
    """Profiles from about ``rows`` documents of each language that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    per_lang = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not per_lang:
        return Profiles({})
    span = 1 << 30
    bound = F.lit(0)
    for lang, n in sorted(per_lang.items()):
        bound = F.when(F.col("lang") == lang, min(span, rows * span // n)).otherwise(bound)
    chosen = usable.where(F.pmod(F.xxhash64("text"), F.lit(span)) < bound).select("lang", "text").distinct()  # equal texts, and rows without an id, count once

    def count(batches):
        for b in batches:
            for lang in set(b["lang"].to_pylist()):
                found = [ngrams(t) for x, t in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True) if x == lang]
                keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([c for _, c in found]))
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(keys[part]), pa.array(n[part].astype(np.int64))], ["lang", "key", "n"])

    counts = chosen.mapInArrow(count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))
    best = counts.withColumn("r", rank).where(F.col("r") <= profile).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "key"))).alias("p"))
    return Profiles({r["lang"]: [x["key"] for x in r["p"]] for r in best.collect()})


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(profiles: Profiles):
    """A column function text -> (lang_pred, score)."""

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        got = [profiles.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()
