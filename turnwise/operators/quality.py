"""Counts, quantiles, duplicates, set comparisons, precision and recall, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions.text import matching


def counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """Counts by a key; several columns give one key ``a|b``."""
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by))
    return df.groupBy(key.alias("key")).agg(F.count("*").alias(name))


def as_map(counted: DataFrame, name: str = "n") -> DataFrame:
    """Counts as one row with a map."""
    return counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", name)))).alias("counts"))


def steady_mean(value: Column) -> Column:
    """Mean of doubles, the same in whatever order the rows are added: the sum of their decimals, rounded once. A group with a value of 10^12 or more, or one that isn't finite, has the plain mean."""
    fits = F.abs(value) < 1e12
    total = F.sum(F.when(fits, value).cast("decimal(28,15)")).cast("double")
    return F.when(F.count_if(value.isNotNull() & ~fits) > 0, F.avg(value)).otherwise(total / F.nullif(F.count(value), F.lit(0)))


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


#: Sorted apart from each other when places are sought among distinct values.
VALUE_RANGES = 256


def _at_places(df: DataFrame, values: list[str], at: dict[float, float]) -> DataFrame:
    """(measure, q, value) for each q -> share of ``at``: exact, by linear interpolation between the two places around its rank.

    Values are counted first, so that what is dealt out are distinct ones. Approximate cuts part them into ranges, whose sums
    tell in which range each place lies; only those ranges are sorted, each by itself.
    """
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values)))
    counted = df.select(each.alias("e")).where("e.x is not null").groupBy("e.measure", "e.x").agg(F.count("*").alias("c"))
    cuts = counted.groupBy("measure").agg(F.percentile_approx("x", [i / VALUE_RANGES for i in range(1, VALUE_RANGES)]).alias("cuts"))
    ranged = counted.join(F.broadcast(cuts), "measure").select("measure", "x", "c", F.size(F.filter("cuts", lambda y: y <= F.col("x"))).alias("part"))  # a row a measure is broadcast
    sums = ranged.groupBy("measure", "part").agg(F.sum("c").alias("c"))
    of = W.partitionBy("measure")
    sums = sums.select("measure", "part", "c", (F.sum("c").over(of.orderBy("part")) - F.col("c")).alias("earlier"), F.sum("c").over(of).alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), (F.lit(share) * (F.col("n") - 1)).alias("rank")) for q, share in at.items())))
    asked = sums.select("*", asked.alias("a")).select("measure", "part", "c", "earlier", "a.q", "a.rank")
    asked = asked.withColumn("place", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))))
    asked = asked.where((F.col("earlier") <= F.col("place")) & (F.col("place") < F.col("earlier") + F.col("c"))).drop("c")  # two rows for each measure and q at most
    wanted = ranged.join(F.broadcast(asked.select("measure", "part", "earlier").distinct()), ["measure", "part"])
    upto = wanted.withColumn("upto", F.col("earlier") + F.sum("c").over(W.partitionBy("measure", "part").orderBy("x"))).drop("earlier")
    met = upto.join(F.broadcast(asked.drop("earlier")), ["measure", "part"]).where((F.col("upto") - F.col("c") <= F.col("place")) & (F.col("place") < F.col("upto")))
    ends = met.groupBy("measure", "q").agg(F.min_by("x", "place").alias("a"), F.max_by("x", "place").alias("b"), F.max("rank").alias("rank"))
    return ends.select("measure", "q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("value"))


def quantiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0), digits: int = 3) -> DataFrame:
    """Exact quantiles with linear interpolation, rounded half to even: rows (q, value)."""
    return _at_places(df, [value], {q: float(q) for q in at}).select("q", F.bround("value", digits).alias("value"))


def percentiles(df: DataFrame, values: list[str], at: tuple[float, ...] = (0, 50, 95, 99, 100)) -> DataFrame:
    """(measure, q, value): exact percentiles by linear interpolation, several measures in one pass."""
    return _at_places(df, values, {q: q / 100 for q in at})


def top_k(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The k most frequent values; ties go to the one met first in ``order``."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def duplicate_groups(df: DataFrame, digest: Column, member: str, split: str) -> DataFrame:
    """Groups of two members or more with one digest, and whether they cross splits."""
    grouped = df.withColumn("hash", digest).groupBy("hash").agg(F.count("*").alias("members"), F.min(member).alias("first_member"), F.countDistinct(split).alias("splits"))
    return grouped.where(F.col("members") > 1).select("hash", "members", "first_member", (F.col("splits") > 1).alias("cross_split"))


def keep_first(df: DataFrame, digest: Column, order: list[str]) -> DataFrame:
    """The first row of each digest in the given order: a minimum that is taken before rows are dealt out, so many copies cost one row a task."""
    row = F.struct(*(F.col(c) for c in [*order, *(c for c in df.columns if c not in order)]))
    return df.withColumn("_digest", digest).groupBy("_digest").agg(F.min_by(row, F.struct(*order)).alias("_row")).select(*(F.col("_row")[c].alias(c) for c in df.columns))


def decontaminate(train: DataFrame, dev: DataFrame, digest) -> DataFrame:
    """Train rows whose digest no dev row has; ``digest`` makes the column from a table."""
    return train.withColumn("_d", digest(train)).join(dev.select(digest(dev).alias("_d")).distinct(), "_d", "left_anti").drop("_d")


def compare_keyed(left: DataFrame, right: DataFrame, key: str, digest: Column) -> DataFrame:
    """(key, status) of keys that only one side has, or whose content differs."""
    a = left.select(key, digest.alias("x"))
    b = right.select(key, digest.alias("y"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full_outer")
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("x").eqNullSafe(F.col("y")), "mismatch")
    return both.select(key, status.alias("status")).where(F.col("status").isNotNull())


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether both have the same keys, each as often."""
    a, b = left.select(key), right.select(key)
    return a.exceptAll(b).union(b.exceptAll(a)).agg((F.count("*") == 0).alias("same_keys"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def conflicts(df: DataFrame, by: list[str], state: str) -> DataFrame:
    """Groups with more than one distinct state."""
    return df.groupBy(*by).agg(F.countDistinct(state).alias("states")).where(F.col("states") > 1)


def precision_recall(gold: DataFrame, predicted: DataFrame, key: list[str], kind: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of distinct keys, overall and for each kind (a column of the key)."""
    g = gold.select(*key).distinct().withColumn("in_gold", F.lit(True))
    p = predicted.select(*key).distinct().withColumn("in_pred", F.lit(True))
    both = g.join(p, key, "full_outer")
    hit, only_p, only_g = F.col("in_gold") & F.col("in_pred"), F.col("in_gold").isNull(), F.col("in_pred").isNull()
    grouped = both.rollup(kind) if kind else both.groupBy()
    out = grouped.agg(F.count_if(hit).alias("tp"), F.count_if(only_p).alias("fp"), F.count_if(only_g).alias("fn"), *([F.grouping(kind).alias("whole")] if kind else []))
    named = F.when(F.col("whole") == 1, "overall").otherwise(F.col(kind).cast("string")) if kind else F.lit("overall")
    return with_f1(out.withColumn("kind", named)).select("kind", "tp", "fp", "fn", "precision", "recall", "f1")


def with_f1(df: DataFrame) -> DataFrame:
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return df.withColumns({"precision": precision, "recall": recall, "f1": f1})


def gates(**checks: DataFrame) -> DataFrame:
    """One row of booleans, each from a one-row one-column table, and the status PASS or REVIEW."""
    out = None
    for name, df in checks.items():
        one = df.select(F.col(df.columns[0]).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    every = F.lit(True)
    for name in checks:
        every = every & F.coalesce(F.col(name), F.lit(False))
    return out.withColumn("status", F.when(every, "PASS").otherwise("REVIEW"))


def key_set_errors(df: DataFrame, raw: str, expected: tuple[str, ...], key: str) -> DataFrame:
    """(key, error) of JSON objects whose keys aren't exactly the expected ones."""
    have = F.map_keys(F.from_json(raw, "map<string,string>"))
    want = F.array(*map(F.lit, sorted(expected)))
    error = F.when(have.isNull(), "not_an_object").when(F.size(F.array_except(want, have)) > 0, "missing_keys").when(F.size(F.array_except(have, want)) > 0, "unexpected_keys")
    return df.select(key, error.alias("error")).where(F.col("error").isNotNull())


def audit_rows(df: DataFrame, key: str, required: tuple[str, ...] = (), enums: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, error) in one pass: ``required:field`` where it is null, ``enum:field`` where it is none of the closed values."""
    tests = [(f"required:{c}", F.col(c).isNull()) for c in required]
    tests += [(f"enum:{c}", ~F.coalesce(F.col(c).isin(*values), F.lit(False))) for c, values in (enums or {}).items()]
    return df.select(key, F.explode(matching(tests)).alias("error"))
