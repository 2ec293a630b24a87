"""Evaluation of predictions: accuracy tables, macro F1, paired comparison, thresholds, calibration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import json_value
from turnwise.functions.vocab import NLI_FACETS
from turnwise.operators.quality import ratio


def macro_f1(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Mean F1 over all labels of either side."""
    each = df.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("e"), (F.col(gold) == F.col(predicted)).alias("hit")).select("e.*", "hit")
    by = each.groupBy("label").agg(F.count_if(F.col("hit") & (F.col("g") == 1)).alias("tp"), F.sum("g").alias("golds"), F.sum("p").alias("preds"))
    return by.agg(F.coalesce(F.avg(2 * F.col("tp") / F.greatest(F.col("golds") + F.col("preds"), F.lit(1))), F.lit(0.0)).alias("macro_f1"))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def field_accuracy(df: DataFrame, fields: dict[str, tuple[Column, Column]], valid: Column) -> DataFrame:
    """For each field the share of all rows that are valid and right, and the share with every field right."""
    right = {name: F.coalesce(valid & g.eqNullSafe(p), F.lit(False)) for name, (g, p) in fields.items()}
    every = F.lit(True)
    for c in right.values():
        every = every & c
    n = F.count("*")
    return df.agg(n.alias("rows"), F.count_if(valid).alias("valid_rows"), *(ratio(F.count_if(c), n).alias(f"{name}_accuracy") for name, c in right.items()), ratio(F.count_if(every), n).alias("full_exact"))


def exactness(df: DataFrame, valid: Column, sets: dict[str, tuple[Column, Column]], quotes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Shares of all rows that are valid and have the same set (order and repeats don't count), and the same quotes to the letter."""
    n, own = F.count("*"), lambda c: ratio(F.count_if(F.coalesce(valid & c, F.lit(False))), F.count("*"))
    every = F.lit(True)
    for g, p in quotes.values():
        every = every & g.eqNullSafe(p)
    return df.agg(n.alias("rows"), *(own(same_set(g, p)).alias(f"{name}_exact") for name, (g, p) in sets.items()), own(every).alias("quotes_exact"))


def normalisation(cards: DataFrame, gold: DataFrame, key: list[str], kind: str = "Symptom") -> DataFrame:
    """Among predicted spans of the kind that are a gold span to the letter and have a concept: how many there are and the share whose concept is right."""
    told = cards.where((F.col("entity_type") == kind) & F.col("canonical_concept").isNotNull() & (F.col("canonical_concept") != ""))
    both = told.join(gold.select(*key, F.col("concept").alias("gold_concept")), key)
    n = F.count("*")
    return both.agg(ratio(F.count_if(F.col("canonical_concept") == F.col("gold_concept")), n).alias("accuracy"), n.alias("evaluable"))


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value as JSON, n) of each field: one pass, a row for each field goes into one aggregation with map-side sums."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), json_value(F.col(f)).alias("value")) for f in fields)))
    return df.select(each.alias("e")).groupBy("e.field", "e.value").agg(F.count("*").alias("n"))


def field_deltas(paired: DataFrame, fields: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(field, mean_delta): mean of second right minus first right, from (target, first, second) of each row."""
    hit = lambda a, b: F.coalesce(a.eqNullSafe(b), F.lit(False)).cast("double")
    one = paired.agg(*(F.coalesce(F.avg(hit(t, second) - hit(t, first)), F.lit(0.0)).alias(name) for name, (t, first, second) in fields.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("mean_delta")) for f in fields))).alias("e")).select("e.*")


def split_deltas(metrics: DataFrame, split: str, names: list[str], first: str = "train", second: str = "dev") -> DataFrame:
    """(metric, delta): the absolute difference of each metric between two splits, from a row for each split."""
    at = lambda c, s: F.max(F.when(F.col(split) == s, F.col(c)))
    one = metrics.agg(*(F.abs(at(c, first) - at(c, second)).alias(c) for c in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("delta")) for c in names))).alias("e")).select("e.*")


def label_accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(predicted)).alias("right")).withColumn("accuracy", ratio(F.col("right"), F.col("n")))


def error_counts(df: DataFrame, errors: str) -> DataFrame:
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def paired_table(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Wins, losses and ties of the second run over the first, over rows that have both."""
    return df.agg(F.count_if(after & ~before).alias("wins"), F.count_if(before & ~after).alias("losses"), F.count_if(before & after).alias("ties_right"), F.count_if(~before & ~after).alias("ties_wrong"))


def paired(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows (key, first, second) of the keys that both runs have, each side as a struct."""
    a = first.select(key, F.struct(*first.columns).alias("first"))
    return a.join(second.select(key, F.struct(*second.columns).alias("second")), key)


def mcnemar(wins: int, losses: int) -> float:
    """Exact two-sided p of as unequal a table."""
    n, least = wins + losses, min(wins, losses)
    if not n:
        return 1.0
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(least + 1))
    return min(1.0, 2 * tail)


def bootstrap(df: DataFrame, group: str, delta: str, order: str, iterations: int = 10_000, seed: int = 20260831) -> DataFrame:
    """95 % interval of the mean difference, drawing whole groups. Groups are summed up on the executors; one task draws.

    Groups count in the order of their first row (``order``).
    """
    sums = df.groupBy(group).agg(F.sum(delta).alias("s"), F.count("*").alias("n"), F.min(order).alias("o")).withColumn("one", F.lit(1))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        s, n = pdf["s"].to_numpy(float), pdf["n"].to_numpy(float)
        rng, means = np.random.default_rng(seed), np.empty(iterations)
        for i in range(iterations):
            at = rng.choice(len(s), len(s), replace=True)
            means[i] = s[at].sum() / n[at].sum()
        low, high = np.percentile(means, (2.5, 97.5))
        return pd.DataFrame({"groups": [len(s)], "mean": [s.sum() / n.sum()], "low": [low], "high": [high]})

    return sums.groupBy("one").applyInPandas(draw, "groups bigint, mean double, low double, high double")


def threshold_table(df: DataFrame, score: str, target: str, low: float = 0.05, high: float = 0.99, steps: int = 189) -> DataFrame:
    """Counts and rates at each threshold of an even grid. Rows are counted once by grid cell, then cells are summed up."""
    step = (high - low) / (steps - 1)
    known = df.where(F.col(target).isNotNull())
    cell = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor((F.col(score) - low) / step + 1e-9) + 1))  # thresholds reached
    cells = known.groupBy(cell.alias("cell")).agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"))
    grid = df.sparkSession.range(1, steps + 1).select(F.col("id").alias("k"))
    at = grid.join(cells, F.col("cell") >= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    total = cells.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"))
    out = at.crossJoin(total).withColumn("fn", F.col("positives") - F.col("tp")).withColumn("threshold", F.lit(low) + (F.col("k") - 1) * step)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))


def choose_threshold(table: DataFrame, floor: float = 0.9) -> DataFrame:
    """The threshold of greatest recall, then f1, then least value among those that reach the precision; 1.0 if none does."""
    usable = table.where((F.col("tp") + F.col("fp") > 0) & (F.col("precision") >= floor))
    best = usable.agg(F.max(F.struct("recall", "f1", (-F.col("threshold")).alias("minus"), "threshold", "precision"))["threshold"].alias("t"))
    return best.select(F.coalesce("t", F.lit(1.0)).alias("threshold"))


def nli_features(entail: dict[str, Column], contradict: dict[str, Column], review_type: Column, reasons: Column, hint: Column) -> Column:
    """The 18 features of a candidate: entailments, margins, triggers and a one-hot facet."""
    positive = entail["positive"] >= entail["negative"]
    chosen = F.when(positive, entail["positive"]).otherwise(entail["negative"])
    other = F.when(positive, entail["negative"]).otherwise(entail["positive"])
    flag = lambda c: c.cast("double")
    return F.array(
        entail["positive"], entail["negative"], entail["historical"], entail["family"], chosen,
        F.when(positive, contradict["positive"]).otherwise(contradict["negative"]),
        chosen - other, chosen - F.greatest(entail["historical"], entail["family"]),
        flag(review_type == "qa_ellipsis"), flag(F.array_contains(reasons, "negation_scope")), flag(F.array_contains(reasons, "revision_or_current_scope")),
        *(flag(hint == f) for f in NLI_FACETS),
    )


def fit_logistic(df: DataFrame, features: str, target: str, c: float = 1.0):
    """Standardised, class-balanced logistic regression with an L2 penalty: a function table -> table with ``probability``, 0.5 if there is nothing to learn from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    one = df.select(features).first()
    if one is None:
        return lambda table: table.withColumn("probability", F.lit(0.5))
    n = len(one[0])
    stats = df.agg(*(F.avg(F.get(features, F.lit(i))).alias(f"m{i}") for i in range(n)), *(F.stddev_pop(F.get(features, F.lit(i))).alias(f"s{i}") for i in range(n)), F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("pos")).first()
    scaled = F.array(*((F.get(features, F.lit(i)) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i in range(n)))
    weight = F.when(F.col(target) == 1, stats["n"] / (2.0 * max(1, stats["pos"]))).otherwise(stats["n"] / (2.0 * max(1, stats["n"] - stats["pos"])))
    prepared = df.select(array_to_vector(scaled).alias("x"), F.col(target).cast("double").alias("y"), weight.alias("w")).persist()  # each step of the optimiser reads it again
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / (c * stats["n"]), standardization=False, maxIter=200, tol=1e-9).fit(prepared)
    prepared.unpersist()

    def apply(table: DataFrame) -> DataFrame:
        out = model.transform(table.withColumn("x", array_to_vector(scaled)))
        return out.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop("x", "rawPrediction", "prediction")

    return apply


def out_of_fold(df: DataFrame, features: str, target: str, group: str, folds: int = 5) -> DataFrame:
    """Each row's probability from a model of the other folds; a group lies in one fold."""
    dealt = df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    parts = [fit_logistic(dealt.where(F.col("fold") != k), features, target)(dealt.where(F.col("fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sft_rows(df: DataFrame, system: Column, prompt: Column, target: Column) -> DataFrame:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return df.withColumn("messages", F.array(message("system", system), message("user", prompt), message("assistant", target)))


def token_audit(df: DataFrame, length: Column, limit: int = 2048) -> DataFrame:
    measured = df.select(length.alias("tokens"))
    return measured.agg(F.count("*").alias("rows"), F.max("tokens").alias("longest"), F.count_if(F.col("tokens") > limit).alias("over_limit"), F.coalesce(F.bool_and(F.col("tokens") <= limit), F.lit(True)).alias("passed"))
