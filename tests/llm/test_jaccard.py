"""Components and sizes against brute force, with families that take the pivot path."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnwise.llm import jaccard

SCHEMA = "doc_id bigint, text string, digest string, n int, prefix string"


def brute(rows, width, share):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in seen[g]).items():
            if 100 * k >= share * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for g in s:
            seen[g].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def families(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for size, edits in ((90, 4), (40, 2), (30, 6)):
        base = [word() for _ in range(120)]
        texts += [" ".join(base)] * 5
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(12))) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows, width, share, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard.join(docs, width, share, **options).collect()), key=repr)


@pytest.mark.parametrize(("width", "share", "bucket", "levels"), [(3, 90, 4, 3), (3, 90, 4, 1), (5, 80, 8, 2)])
def test_families_against_brute_force(spark, width, share, bucket, levels):
    rows = families(width)
    assert run(spark, rows, width, share, bucket=bucket, levels=levels) == brute(rows, width, share)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "One two\nthree"), (7, "One two\nthree"), (None, "one two three"), (None, None), (8, "é è one"), (9, "x " * 5000)]
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_empty_table(spark):
    assert run(spark, [], 3, 90) == []


def near_copies(rows: int, words: int = 120, seed: int = 9):
    """Copies of one text with one to three words replaced, the text itself not among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, out = [word() for _ in range(words)], []
    for i in range(rows):
        own = list(base)
        for _ in range(1 + i % 3):
            own[rng.randrange(words)] = word()
        out.append((i, " ".join(own)))
    return out


def test_candidates_of_one_large_family_stay_near_linear(spark, monkeypatch):
    """All pairs of 1,500 near copies would be 1,124,250."""
    made, plain = [], jaccard._meet

    def counted(*a):
        out = plain(*a)
        made.append(out.count())  # what it reads is deleted when the join ends
        return out

    monkeypatch.setattr(jaccard, "_meet", counted)
    rows = near_copies(1500)
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert made and sum(made) < 30 * len(rows)


@pytest.mark.parametrize("share", [80, 90])
def test_slack_and_overlap_decide_links(share):
    """Any centre: pairs are linked just if their differences share the overlap that the slacks ask for."""
    rng, like = random.Random(5), jaccard.Likeness(share)
    for _ in range(3000):
        base = list(range(40))
        make = lambda: {x for x in base if rng.random() > 0.12} | {rng.randrange(1000, 1020) for _ in range(rng.randrange(5))}
        centre, x, y = make(), make(), make()
        slack = like.slack(len(x ^ centre), len(x)) + like.slack(len(y ^ centre), len(y))
        overlap = -(-slack // (2 * like.whole))
        assert (len((x ^ centre) & (y ^ centre)) >= overlap) == (100 * len(x & y) >= share * len(x | y))


def test_fold_has_no_more_tasks_than_chunks(spark):
    settings = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        spark.sparkContext.setJobGroup("fold", "fold")
        parts = spark.range(0, 3, 1, 3).mapInArrow(lambda batches: (jaccard._parts(np.arange(64)) for _ in batches), "chunk int, data binary")
        assert jaccard._fold(parts, "<i8", np.add).tolist() == [3 * i for i in range(64)]
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("fold") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) <= jaccard.CHUNKS
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
