"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits or runs of other marks. Features are single tokens and pairs, hashed
into 2^18 places; a pair of equal tokens is one feature of its own. A text's vector holds the root of each feature's share
of the text, so it has length 1, and the score is one sparse dot product.

Training reads a bounded sample of labelled rows (FIT_ROWS, a parameter), chosen by the hash of the id; features
are extracted on all executors, and one task makes the ordered passes over the bounded sample. The
model is 2^18 floats, whatever the corpus. Scoring is row by row: no shuffle, no skew.

Defined cases: a null or empty text has no features and gets the score of the bias alone; null labels and
ids don't train, rows of one id train once; without any labelled row all scores are 0.5; repeated rows score alike, an empty table gives an
empty result; a very long text is one vector of at most 2^18 places; extra columns pass through untouched, one of the score's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm import hashing
from turnwise.llm.common import labelled_sample, tidy

BITS = 18
FIT_ROWS = 12_000
#: Passes are made until about so many updates are done, PASSES at most.
UPDATES, PASSES = 48_000, 30
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 1e-4
THRESHOLD = 0.3
_SAME = np.uint64(0x5851F42D4C957F2D)


def each_features(texts: pa.Array):
    """Of each text the distinct feature numbers, ascending, and their values, one text after the other."""
    for _, data, offsets in hashing.text_slices(texts):
        words, first = hashing.tokens(data, offsets, hashing.WORDS_AND_MARKS, None)
        pairs = hashing.mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) else words
        pairs[words[:-1] == words[1:]] = _SAME
        shift = np.uint64(64 - BITS)
        words, pairs = (words >> shift).astype(np.int32), (pairs >> shift).astype(np.int32)
        for a, b in zip(first[:-1], first[1:], strict=True):
            found, n = np.unique(np.concatenate([words[a:b], pairs[a : max(a, b - 1)]]), return_counts=True)
            yield found, np.sqrt(n / max(1, n.sum())).astype(np.float32)


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    return list(each_features(texts))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (features, values, label) in the given order; (weights, bias)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    bias = 1 << BITS
    rows = [(np.append(i, bias), np.append(x, 1.0), y) for i, x, y in rows]
    for _ in range(min(PASSES, -(-UPDATES // max(1, len(rows))))):
        for i, x, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    return w[:bias].astype(np.float32), float(w[bias])


@tidy
def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    sample = labelled_sample(docs, labels, label, modulus, remainder, rows)

    def extract(batches):
        for b in batches:
            found = features(b["text"])
            yield pa.RecordBatch.from_arrays([b["key"], b["y"], pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["key", "y", "idx", "val"])

    def learn(batches):
        got = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        w, bias = train([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), y) for _, y, i, x in got])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    # a row for each of the bounded sample
    got = sample.select(F.xxhash64("doc_id").alias("key"), "y", "text").mapInArrow(extract, "key bigint, y int, idx binary, val binary")
    model = got.repartition(1).mapInArrow(learn, "w binary, bias double").first()
    return np.frombuffer(model["w"], np.float32), model["bias"]


def scorer(model: tuple[np.ndarray, float]):
    """A column function text -> score in [0, 1]."""
    packed, bias = model[0].tobytes(), model[1]

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        w = np.frombuffer(packed, np.float32)
        dots = np.array([w[i].astype(np.float64) @ x for i, x in each_features(texts)])
        return pa.array(1 / (1 + np.exp(-np.clip(dots + bias, -35, 35))), pa.float64())

    return score.asNondeterministic()  # so that a filter on the score doesn't compute it twice


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], name: str, text: Column | None = None) -> DataFrame:
    return docs.withColumn(name, scorer(model)(F.col("text") if text is None else text))
