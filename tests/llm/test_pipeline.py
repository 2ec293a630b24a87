"""The pipeline's stages on the smallest tables: columns, decisions and the last stage's digests."""

import hashlib

import corpus_pipeline
from turnwise.llm import langid
from turnwise.llm.common import materialize, read_table


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    start, columns = docs, docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        assert docs.join(start, columns, "left_anti").count() == 0, name
        sizes.append(docs.count())
        if name == "n-gram Jaccard join":
            assert docs.select("doc_id").distinct().count() == sizes[-1] == docs.select("text").distinct().count()
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] > 0 and sizes[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == sizes[4]
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] > 0 for r in last)


def test_empty(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_language_keeps_near_ties(spark, sf_dir):
    profiles = langid.fit(read_table(spark, sf_dir, "documents"), modulus=4, remainder=2)
    near = [t for t in (f"{a}{b}." for a in "abcdefghijklmnopqrstuvwxyz" for b in ("", *"aeinrst")) if profiles.predict(t)[1] < 0.02]
    assert near
    rows = [*enumerate(near), (900, None), (901, ""), (902, "12 - 3")]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], read_table(spark, sf_dir, "documents").schema)
    assert {r["text"] for r in corpus_pipeline.language(spark, docs, sf_dir).collect()} == set(near)


def test_near_copies_without_ids_or_with_repeated_ones(spark, sf_dir):
    long = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, long("a")), (None, long("a")), (None, long("a") + " end"), (5, long("b")), (None, long("b")), (5, long("b") + " end")]
    rows += [(7, long("c")), (7, long("d")), (7, long("d")), (3, long("d") + " end"), (9, long("e")), (8, long("e") + " end"), (2, "short one"), (1, "other one"), (1, None), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], read_table(spark, sf_dir, "documents").schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(None, min((long("a"), long("a") + " end"), key=digest)), (5, min((long("b"), long("b") + " end"), key=digest)), (7, long("c")), (3, long("d") + " end"), (8, long("e") + " end")]
    assert sorted(got, key=repr) == sorted([*want, (2, "short one"), (1, "other one"), (1, None), (None, None)], key=repr)
    assert docs.columns == corpus_pipeline.near_copies(spark, docs, sf_dir).columns
