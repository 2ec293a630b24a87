"""Core operators: literal fixtures, properties and brute force."""

import difflib
import hashlib
import itertools
import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions import spans, text, vocab
from turnwise.operators import belief, evaluate, evidence, quality, state, teacher, tracks
from turnwise.plans import catalog, checks, parity, queries  # noqa: F401
from turnwise.sources import files


PARITY = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ in (checks.__name__, parity.__name__))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ops(*names):
    return F.array(*map(F.lit, names))


def test_state_machine_fixtures(spark):
    for name, (operations, want) in state.CONTRACT.items():
        assert one(spark, state.fold(ops(*operations))) == want, name
    assert one(spark, state.fold(ops("ASSERT_EXISTENCE", "RETRACT_EXISTENCE"))) != one(spark, state.fold(ops("RETRACT_EXISTENCE", "ASSERT_EXISTENCE")))
    assert one(spark, state.transition(F.lit("present"), F.lit("UPDATE_FACET"))) == "present"


def _events(spark, signs, facets=None):
    rows = [("e", i, "existence" if facets is None else facets[i], s) for i, s in enumerate(signs)]
    return spark.createDataFrame(rows, "episode_id string, turn_index bigint, facet string, assertion string")


@pytest.mark.parametrize(("signs", "operations", "trajectory"), [
    (["positive", "negative", "positive"], ["ASSERT_EXISTENCE", "RETRACT_EXISTENCE", "RECUR"], "recurred_after_absence"),
    (["negative", "positive"], ["RETRACT_EXISTENCE", "RECUR"], "recurred_after_absence"),
    (["positive", "negative"], ["ASSERT_EXISTENCE", "RETRACT_EXISTENCE"], "present_to_absent"),
    (["positive"], ["ASSERT_EXISTENCE"], "single_present"),
    (["negative", "negative"], ["RETRACT_EXISTENCE"] * 2, "persistent_absent"),
])
def test_derived_operations(spark, signs, operations, trajectory):
    d = state.derive(_events(spark, signs), ["episode_id"], ["turn_index"])
    assert [r["operation"] for r in d.orderBy("turn_index").collect()] == operations
    assert state.episodes(d, ["episode_id"], ["turn_index"]).first()["trajectory"] == trajectory


def test_facets_leave_existence_alone(spark):
    d = state.derive(_events(spark, ["positive", "negative", "positive"], ["existence", "severity", "existence"]), ["episode_id"], ["turn_index"])
    assert [r["operation"] for r in d.orderBy("turn_index").collect()] == ["ASSERT_EXISTENCE", "UPDATE_FACET", "ASSERT_EXISTENCE"]
    only = state.derive(_events(spark, ["positive"], ["severity"]), ["episode_id"], ["turn_index"])
    assert state.episodes(only, ["episode_id"], ["turn_index"]).first()["trajectory"] == "facet_only"


def test_lag_equals_fold(spark):
    rng = random.Random(1)
    rows = [(f"e{i % 9}", i, "existence", rng.choice(["positive", "negative"])) for i in range(300)]
    d = state.derive(spark.createDataFrame(rows, "episode_id string, turn_index bigint, facet string, assertion string"), ["episode_id"], ["turn_index"])
    w = W.partitionBy("episode_id").orderBy("turn_index").rowsBetween(W.unboundedPreceding, 0)
    both = d.withColumn("folded", state.fold(F.collect_list("operation").over(w)))
    assert both.where(F.col("folded") != F.col("new_state")).count() == 0


def test_collapse_keeps_first_and_all_ids(spark):
    rows = [("d", "patient", "c", "existence", "positive", 3, 9, "b"), ("d", "patient", "c", "existence", "positive", 3, 2, "z"), ("d", "patient", "c", "existence", "negative", 3, 1, "n")]
    got = {r["assertion"]: r for r in state.collapse(spark.createDataFrame(rows, "dialogue_id string, subject string, concept string, facet string, assertion string, turn_index int, char_start int, card_id string")).collect()}
    assert got["positive"]["card_id"] == "z" and got["positive"]["supporting_card_ids"] == ["b", "z"] and len(got) == 2


def test_run_length_fixture(spark):
    df = spark.createDataFrame([("t", i, s) for i, s in enumerate("11001")], "k string, turn int, s string")
    assert [r["s"] for r in tracks.run_length(df, ["k"], ["turn"], "s").orderBy("turn").collect()] == ["1", "0", "1"]
    assert sorted((r["from_state"], r["to_state"], r["gap"]) for r in tracks.transitions(df, ["k"], ["turn"], "s").collect()) == [("0", "1", 2), ("1", "0", 2)]
    assert tracks.changing_tracks(df, ["k"], ["turn"], "s").first()["reversal"]


def test_bio_spans(spark):
    rows = [("a", i, x) for i, x in enumerate(["B-Symptom", "I-Symptom", "B-Symptom", "I-Symptom"])] + [("b", 0, "I-Symptom"), ("c", 0, "B-Drug"), ("c", 1, "I-Symptom")]
    df = spark.createDataFrame(rows, "k string, pos int, label string")
    assert sorted((r["k"], r["char_start"], r["char_end"]) for r in spans.bio_spans(df, ["k"]).collect()) == [("a", 0, 2), ("a", 2, 4), ("c", 0, 1)]


def test_spans_round_trip_and_orphans(spark):
    s = spark.createDataFrame([("a", "Drug", 0, 3), ("a", "Symptom", 3, 4), ("a", "Symptom", 6, 9)], "k string, entity_type string, char_start int, char_end int")
    back = spans.bio_spans(spans.labels_of_spans(s, ["k"]), ["k"])
    assert sorted(map(tuple, back.select("k", "entity_type", "char_start", "char_end").collect())) == sorted(map(tuple, s.collect()))
    tokens = spark.createDataFrame([("a", 0, 2, "I-Drug", 0.5), ("a", 2, 3, "I-Drug", 0.9)], "k string, start int, end int, label string, score double")
    assert [r["label"] for r in spans.char_labels(tokens, ["k"]).orderBy("pos").collect()] == ["B-Drug", "I-Drug", "I-Drug"]


def test_stable_ids_equal_python(spark):
    def want(*parts):
        joined = "|".join(json.dumps(p, ensure_ascii=False, sort_keys=True) for p in parts)
        return hashlib.sha256(joined.encode()).hexdigest()[:24]

    for parts in (("a", 1), ('q"\\\n', -3), ("头疼", 0), ("", 7)):
        assert one(spark, text.stable_id(*map(F.lit, parts))) == want(*parts)
    assert one(spark, text.stable_hash(b=F.lit("x"), a=F.lit(None).cast("string"))) == hashlib.sha256(b'{"a":null,"b":"x"}').hexdigest()


def test_text_functions(spark):
    for s in ("Ａbc １２ é!", "头疼 　", "", None):
        got = spark.createDataFrame([(s,)], "s string").select(text.normalize("s").alias("n"), text.strip(F.col("s")).alias("t")).first()
        assert got["n"] == (None if s is None else re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", s).lower()))
        assert got["t"] == (None if s is None else s.strip())
    assert one(spark, text.fullmatch(F.lit("yes\n"), "yes|no")) is False and one(spark, text.fullmatch(F.lit("no"), "yes|no")) is True
    assert abs(sum(one(spark, text.softmax(F.array(F.lit(1.0), F.lit(2.0))))) - 1) < 1e-12 and one(spark, text.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1


def test_scopes(spark):
    base = {"target_binding": "DIRECT_TARGET", "subject": "patient", "temporality": "current", "existence_effect": "MOVE_TO_HISTORY", "facet_effect": "HOLD"}
    scopes = lambda status="X", **k: tuple(one(spark, c) for c in teacher.write_scopes({n: F.lit(v) for n, v in (base | k).items()}, F.lit(status)))
    assert scopes() == ("CURRENT_TO_HISTORY", "NONE")
    assert scopes(existence_effect="SET_PRESENT", temporality="mixed") == ("NONE", "NONE")
    assert scopes(status="HOLD_META_DISAGREEMENT") == ("NONE", "NONE") and scopes(subject="caregiver") == ("NONE", "NONE")
    assert scopes(facet_effect="UPDATE_CURRENT_FACET")[1] == "CURRENT"


def test_votes(spark):
    rows = [(1, "meta_a", "X"), (1, "meta_b", "Y"), (1, "other", "X"), (2, "meta_a", "X"), (2, "meta_b", "Y"), (2, "other", "Z")]
    got = {r["k"]: r for r in teacher.vote(spark.createDataFrame(rows, "k int, source string, signature string"), "k", ("meta_a", "meta_b", "other")).collect()}
    assert (got[1]["signature"], got[1]["picked"], got[1]["status"]) == ("X", "meta_a", "ADAPTIVE_META_MAJORITY")
    assert got[2]["signature"] is None and got[2]["status"] == "HOLD_META_DISAGREEMENT"


def test_signature_and_set_comparison(spark):
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))
    assert one(spark, teacher.signature([], a)) != one(spark, teacher.signature([], b)) and one(spark, evaluate.same_set(a, b))


def test_aliases(spark):
    rows = [("s", c) for c in "AABB"] + [("t", c) for c in "AAB"]
    got = {r["surface"]: r for r in evidence.aliases(spark.createDataFrame(rows, "surface string, concept string")).collect()}
    assert got["s"]["concept"] is None and got["s"]["candidates"] == ["A", "B"] and got["t"]["concept"] == "A"


def test_quantiles_and_decontamination(spark):
    q = {r["q"]: r["value"] for r in quality.quantiles(spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "x int"), "x").collect()}
    assert q[0.25] == 1.75 and q[0.95] == 8.95
    train = spark.createDataFrame([(0, "h1"), (1, "h1"), (2, "h2")], "o int, h string")
    clean = quality.decontaminate(train, train.where("o = 2"), lambda t: t["h"])
    assert [r["o"] for r in quality.keep_first(clean, F.col("h"), ["o"]).collect()] == [0]


def test_self_report_never_enters_snapshots(spark):
    turns = spark.createDataFrame([("d", 0), ("d", 1)], "dialogue_id string, turn_index bigint")
    event = spark.createDataFrame([("d", -1, "e", "present", 1)], "dialogue_id string, turn_index bigint, episode_id string, new_state string, event_id int")
    assert belief.snapshot_grid(turns, event).count() == 0
    assert belief.snapshot_grid(turns, event, include_pre_turn=True).count() == 3
    snaps = belief.snapshots(turns, belief.snapshot_grid(turns, event))
    assert [r["active_count"] for r in snaps.collect()] == [0, 0]


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("d", t) for t in (0, 1, 2, 5)], "k string, t int")
    right = spark.createDataFrame([("d", 1, "a"), ("d", 3, "b")], "k string, t int, v string")
    got = {r["t"]: r["v"] for r in belief.as_of_before(left, right, "k", "t", ["v"]).collect()}
    assert got == {0: None, 1: None, 2: "a", 5: "b"}


def test_action_family_covers_all_acts(spark):
    got = {a: one(spark, belief.action_family(F.lit(a))) for a in vocab.DIALOGUE_ACTS}
    assert got["Request-Symptom"] == "ASK_SYMPTOM" and got["Request-Etiology"] == "ASK_OTHER" and got["Inform-Precautions"] == "RECOMMEND" and got["Other"] == "OTHER" and len(got) == 16


def test_mcnemar_and_bootstrap(spark):
    assert evaluate.mcnemar(0, 0) == 1.0 and abs(evaluate.mcnemar(5, 0) - 0.0625) < 1e-12
    df = spark.createDataFrame([(f"g{i % 5}", float(i % 3 == 0), i) for i in range(60)], "g string, d double, o int")
    a, b = (evaluate.bootstrap(df, "g", "d", "o", 200).first() for _ in range(2))
    assert a == b and a["low"] <= a["mean"] <= a["high"]


def test_threshold_fallback(spark):
    df = spark.createDataFrame([(0.9, 0), (0.8, 0)], "s double, y int")
    assert evaluate.choose_threshold(evaluate.threshold_table(df, "s", "y")).first()["threshold"] == 1.0


def test_calibration_separates(spark):
    df = spark.createDataFrame([(f"g{i % 10}", [float(i % 2), 1.0], i % 2) for i in range(100)], "g string, f array<double>, y int")
    out = evaluate.out_of_fold(df, "f", "y", "g")
    assert out.count() == 100 and out.where((F.col("probability") > 0.5) != (F.col("y") == 1)).count() == 0


def test_propositions(spark):
    p = spark.createDataFrame([("p", 0, "a", "existence", "positive", "current", "patient", "RECUR", "x", "xyz", 0.5), ("p", 1, "a", "existence", "positive", "current", "patient", "RECUR", "x", "xyz", 0.5), ("p", 2, "b", "nope", "positive", "current", "patient", "RECUR", "x", "xyz", 0.5)], "packet_id string, ord int, card_id string, facet string, assertion string, temporality string, subject string, revision_operation string, evidence_quote string, source_text string, confidence double")
    valid, errors = teacher.proposition_errors(p, spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "packet_id string, card_id string"))
    assert [r["ord"] for r in valid.collect()] == [0]
    assert sorted(r["error"] for r in errors.collect()) == ["invalid_or_duplicate_card_id", "invalid_schema:b", "missing_anchor_count:1"]


def test_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"c1": {"a": 1}, "c2": {"a": 2}}))
    assert sorted(map(tuple, files.read_case_map(spark, str(tmp_path / "cases.json"), "struct<a:int>").collect())) == [("c1", 1), ("c2", 2)]
    (tmp_path / "v.csv").write_text("﻿name\n a \nb\na\n")
    assert sorted(r["concept"] for r in files.read_vocabulary(spark, str(tmp_path / "v.csv")).collect()) == ["a", "b"]
    rows = spark.createDataFrame([(1, "é"), (2, None)], "k int, t string")
    out = str(tmp_path / "out")
    assert files.read_jsonl_or_empty(spark, out, rows.schema).count() == 0
    for _ in range(2):  # the second pass has nothing to do
        assert files.resume(rows, out, rows.schema, "k", lambda t: t).count() == 2
    m = files.manifest(spark, str(tmp_path / "v.csv"))
    assert m.first()["sha256"] == hashlib.sha256((tmp_path / "v.csv").read_bytes()).hexdigest()
    assert [r["error"] for r in files.manifest_errors(m, m.select(F.lit("other").alias("file"), "sha256")).orderBy("error").collect()] == ["missing", "unexpected"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert files.with_retries(flaky, wait=lambda s: None)() == 7
    with pytest.raises(PermissionError):
        teacher.blind_guard("test")


@pytest.mark.parametrize("name", ["dialogue_trajectories", "asof_snapshot_grid", "state_fold", "qa_pairs", "gate_rows", "write_scopes", "doctor_units_supervision", "last3_mentions", *PARITY])
def test_queries_equal_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "events", "conversations", "customer", "orders", "nation"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    con.execute(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})")
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, con.fetchall()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_similarity_top3_asks_for_every_name(spark, tmp_path):
    rows = [("b1", "hot bolt", "TIN"), ("b1", "hot bolts", "TIN"), ("b1", "hot bolt", "BRASS"), ("b2", "cold plate", "TIN"), ("b2", "old plate", "TIN"), ("b2", "old plate", "TIN")]
    spark.createDataFrame(rows, "p_brand string, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    pairs, want = {(n, t) for _, n, t in rows}, set()
    for name in {n for _, n, _ in rows}:
        best = sorted(((difflib.SequenceMatcher(None, name, n).ratio(), n, t) for n, t in pairs), reverse=True)[:3]
        want |= {(name, n, t, s, i) for i, (s, n, t) in enumerate(best, 1)}
    got = catalog.QUERIES["similarity_top3"](spark, str(tmp_path)).collect()
    assert {(r["surface"], r["alias"], r["concept"], r["similarity"], r["rank"]) for r in got} == want and len(got) == 12


def test_suggestions_over_blocks(spark, monkeypatch):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(9))) for _ in range(120)]
    table = [(n, f"c{rng.randrange(4)}") for n in names] + [("abc", None)] * 4
    monkeypatch.setattr(evidence, "_BLOCK", 17)
    monkeypatch.setattr(evidence, "_PACK", 7)
    known = spark.createDataFrame(table, "surface string, concept string")
    got = evidence.suggestions(spark.createDataFrame([(n,) for n in names[:40]], "surface string"), known).collect()
    assert len(got) == 3 * len(set(names[:40]))
    for name in set(names[:40]):
        best = sorted(((difflib.SequenceMatcher(None, name, n).ratio(), n, c or "") for n, c in table), reverse=True)[:3]
        assert [(r["similarity"], r["alias"], r["concept"] or "") for r in sorted((r for r in got if r["surface"] == name), key=lambda r: r["rank"])] == best


def test_percentiles_of_many_values(spark):
    rng = random.Random(4)
    for values in ([rng.randrange(10**9) for _ in range(3000)], [rng.choice((1, 2, 7)) for _ in range(999)], [5.5], [1.0, 4.0], [3.0, None, None]):
        df = spark.createDataFrame([(None if v is None else float(v), -1.0) for v in values], "a double, b double")
        got = {(r["measure"], r["q"]): r["value"] for r in quality.percentiles(df, ["a", "b"]).collect()}
        known = [v for v in values if v is not None]
        assert len(got) == 10 and all(abs(got["a", q] - np.percentile(known, q)) < 1e-6 and got["b", q] == -1.0 for q in (0, 50, 95, 99, 100))
    assert quality.percentiles(df.limit(0), ["a"]).count() == 0


def test_frozen_files(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name)
    found = lambda: files.manifest(spark, str(tmp_path), "*.txt")
    kept = str(tmp_path / "kept")
    files.freeze(found(), kept)
    assert files.frozen_errors(spark, found(), kept).count() == 0
    (tmp_path / "a.txt").write_text("other")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "d.txt").write_text("d")
    assert sorted(map(tuple, files.frozen_errors(spark, found(), kept).collect())) == [("a.txt", "changed"), ("b.txt", "missing"), ("d.txt", "unexpected")]


def test_similarity_equals_difflib(spark):
    rows = [("abcd", "bcde"), ("", ""), (None, "a"), ("cold plate", "old plate")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.similarity("a", "b").alias("r"))
    assert all(r["r"] == difflib.SequenceMatcher(None, r["a"] or "", r["b"] or "").ratio() for r in df.collect())


def test_bootstrap_query_makes_ten_thousand_draws(spark, sf_dir):
    j = queries._judged(spark, sf_dir).select("source", "doc_id", "gold", "pred").toPandas()
    j["delta"] = (j["gold"] == j["pred"]).astype(float) - (j["gold"] == 1).astype(float)
    groups = [g["delta"].to_numpy() for _, g in sorted(j.groupby("source"), key=lambda x: x[1]["doc_id"].min())]
    rng = np.random.default_rng(20260831)
    draws = [np.concatenate([groups[k] for k in rng.choice(len(groups), len(groups), replace=True)]).mean() for _ in range(10_000)]
    got = catalog.QUERIES["bootstrap_ci"](spark, sf_dir).first()
    assert np.allclose((got["low"], got["high"]), np.percentile(draws, (2.5, 97.5)), rtol=0, atol=1e-9)


def test_stable_ids_of_control_characters_and_nulls(spark, tmp_path):
    texts = [*(f"a{chr(i)}b{chr(i)}{chr(i)}" for i in range(32)), None, "", "\x7f", "\\u000B", "\\\x0b", "\\\\\x1f\x1e", "\\\\u001F", "\r\n", 'q"\\\x0c/é ', "".join(map(chr, range(32)))]
    rows = [(i, i % 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {(i, k, hashlib.sha256(f"{json.dumps(t, ensure_ascii=False)}|{k}".encode()).hexdigest()[:24]) for i, k, t in rows}
    assert set(map(tuple, catalog.QUERIES["stable_ids"](spark, str(tmp_path)).collect())) == want


def test_spans_need_a_type(spark):
    labels = ["B", "I", "B-Drug", "I-Drug", "I", "I-Drug", "B-Drug", "O", "I-Drug"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "k int, pos int, label string")
    got = sorted(tuple(r) for r in spans.bio_spans(rows, ["k"]).collect())
    assert got == [(1, 2, 4, "Drug"), (1, 6, 7, "Drug")]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "f array<double>, y int")
    some = spark.createDataFrame([([1.0], 1)], "f array<double>, y int")
    assert [r["probability"] for r in evaluate.fit_logistic(df, "f", "y")(some).collect()] == [0.5]


def test_units_of_an_opening_doctor(spark):
    """The first turn's input is the snapshot before the dialogue; contexts name their speakers; no later turn leaks."""
    turns = spark.createDataFrame([(1, 0, "doctor", "hello", "Other"), (1, 1, "patient", "cough", None), (1, 2, "doctor", "long?", "Request-Symptom")], "dialogue_id bigint, turn_index bigint, speaker string, text string, act string")
    events = spark.createDataFrame([(1, "e", 1, 1, "present")], "dialogue_id bigint, episode_id string, turn_index bigint, event_id int, new_state string")
    taken = belief.snapshots(turns, belief.snapshot_grid(turns, events))
    features, labels = belief.prediction_units(turns, taken)
    got = {r["target_turn"]: (r["input_turn"], r["active_count"], r["context_text"]) for r in features.collect()}
    assert got == {0: (-1, 0, ""), 2: (1, 1, "doctor: hello\npatient: cough")}
    assert belief.no_leak(features).first()[0] is True and labels.count() == 2


def test_last_mentions(spark):
    targets = spark.createDataFrame([(1, "c", 5), (1, "c", 0), (2, "c", 9)], "dialogue_id int, concept string, turn_index int")
    mentions = spark.createDataFrame([(1, "c", t) for t in (0, 1, 2, 4, 5, 7)], "dialogue_id int, concept string, turn_index int")
    got = sorted((r["turn_index"], r["mention_turn"], r["nth"]) for r in teacher.last_mentions(targets, mentions).collect())
    assert got == [(5, 1, 3), (5, 2, 2), (5, 4, 1)]


def test_gate_finds_each_fault(spark):
    good = dict(label_status="DIRECT_CROSS_MODEL_AGREEMENT", state_authority=True, agreement_sources=["a", "b"], temporality="current", existence_effect="SET_PRESENT", facet_effect="NO_FACET_UPDATE", target_binding="DIRECT_TARGET", subject="patient", existence_write_scope="CURRENT", facet_write_scope="NONE")
    schema = "label_status string, state_authority boolean, agreement_sources array<string>, temporality string, existence_effect string, facet_effect string, target_binding string, subject string, existence_write_scope string, facet_write_scope string"
    none = F.array().cast("array<string>")
    run = lambda *rows: teacher.gate(spark.createDataFrame([tuple({**good, **r}.values()) for r in rows], schema), none).first()
    assert run({})["gate_pass"]
    assert not run({}, {"label_status": teacher.HOLD, "existence_write_scope": "NONE"})["hold_has_no_authority"]
    assert not run({"existence_write_scope": "HISTORY"})["scopes_valid"]
    assert not run({"agreement_sources": ["a", "a"]})["views_agree"]


#: Letters beyond ASCII beside words, marks upon them, and letters that fold to ASCII.
ODD = ("é no", "énot", "noé, 不not了", "not\u0301 so", "the perhapſ", "and waſ it", "\u212anot", "ſince then", "an or\u00a0not", "no_ne", "Was İt?", None, "", "the énot and noñ for x", "the not\u0301 and")


@pytest.mark.parametrize("name", ["authority_predicate", "cue_reasons", "review_packets", "route_counts", "high_value_facets", "source_hold", "turn_snapshots"])
def test_patterns_equal_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i // 4, i % 4, ("user", "assistant", "system")[i % 3], t) for i, t in enumerate([*ODD, *(t and t.upper() for t in ODD), *(t and t + " a b" * 12 for t in ODD * 2)])]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_cues_beside_any_letter_equal_sql(spark, tmp_path):
    """Each character up to U+2FFF before, after and within cue words."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(c, i, "user", t.replace("~", chr(c))) for c in range(1, 0x3000) for i, t in enumerate(("~no wa~ Perhap~ or~", "a~go ~ight alway~ ?~"))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = catalog.QUERIES["cue_reasons"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL['cue_reasons']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["review_packets", "route_counts", "authority_predicate"])
def test_odd_turns_and_roles_equal_sql(spark, tmp_path, name):
    """Turns before the first, missing ones and ones that a double can't hold; roles that are missing or in no list."""
    duckdb = pytest.importorskip("duckdb")
    turns, roles = (None, -(2**63), -5, -3, -2, -1, 0, 1, 2**53, 2**53 + 1, 2**53 + 2, 2**63 - 2, 2**63 - 1), ("user", "assistant", "system", "tool", "", None)
    texts = (None, "", "never? " * 3, "plain words of some length and without a cue in them")
    rows = [(i % 3 or None, *x) for i, x in enumerate(itertools.product(turns, roles, texts))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_java_pattern():
    edge = text.java(r"\b")
    assert text.java(r"(?i)\b(was|ago)\b") == f"(?i){edge}(wa[sſ]|ago){edge}" and text.java(r"was [s]") == "was [s]"
    assert text.java(r"(?i)[^a-z]\sk") == "(?i)[^a-zſK]\\s[kK]" and text.java("(?i)[r-t]") == "(?i)[r-tſ]"


def test_votes_do_not_depend_on_the_order_of_addition(spark, tmp_path):
    """Means that are whole multiples of 20 in decimals, though a sum of doubles in this order falls short of them."""
    rng, rows, users = random.Random(4), [], 12
    while len(rows) < 60 * users:
        cents = [rng.randrange(1, 8000) for _ in range(19)]
        values = [c / 100 for c in [*cents, 80_000 - sum(cents)]]
        if float(np.cumsum(values)[-1]) < 800:
            k = len(rows) // 20
            rows += [(3 * (20 * (k // 3) + i) + k % 3, k // 3, v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in catalog.QUERIES["vote_2of3"](spark, str(tmp_path)).collect()}
    assert got == {(u, "2", "meta_a", 3, "ADAPTIVE_META_MAJORITY") for u in range(users)}


def test_steady_mean(spark):
    rows = [(1, 0.1), (1, 0.2), (1, None), (2, None), (3, 1e300), (3, 1.0), (4, float("nan")), (5, float("inf")), (6, -1e-5)]
    got = dict(spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(quality.steady_mean(F.col("v"))).collect())
    assert got[1] == 0.15 and got[2] is None and got[3] == 5e299 and np.isnan(got[4]) and got[5] == float("inf") and got[6] == -1e-5
