import pytest
from pyspark.sql import functions as F

from memlattice.operators import baselines, canon, evaluation, memory, models, retrieval, supersession, upsert


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, p int, q string")
    new = spark.createDataFrame([("a", 9), ("c", 7), (None, 1)], "k string, p int")
    got = {tuple(r) for r in upsert.merge_rows(old, new, "k").collect()}
    assert got == {("a", 9, "x"), ("b", 2, "y"), ("c", 7, None)}
    with pytest.raises(upsert.InvalidStatement):
        upsert.merge_rows(old, new.select("k"), "k")
    with pytest.raises(upsert.InvalidStatement):
        upsert.identifier("a b")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "z"), (None, "b")], "s string, d string")
    assert [tuple(r) for r in upsert.merge_edges(edges, old.select(F.col("k").alias("s")), old.select(F.col("k").alias("d")), "s", "d").collect()] == [("a", "b")]
    gone = spark.createDataFrame([("b",)], "k string")
    assert [r.k for r in upsert.delete_keys(old, "k", gone).collect()] == ["a"]
    assert upsert.detach_delete(edges, ["s", "d"], gone).count() == 1
    with pytest.raises(upsert.LimitExceeded):
        upsert.bounded_rows(old, 1)
    assert len(upsert.bounded_rows(old, 2)) == 2


def slot(spark, rows):
    return spark.createDataFrame(rows, "uid string, skey string, ckey string, text string, session_ord int, t_event int, slot_value string")


def test_supersession(spark):
    home = slot(spark, [("u", "s", "c1", "NYC", 2, 0, "NYC"), ("u", "s", "c1b", "NYC", 3, 0, "NYC"), ("u", "s", "c2", "Brooklyn", 5, 0, "Brooklyn"), ("u", "s", "c3", "SF", 9, 0, "SF"), ("u", "t", "c4", "one", 1, 0, "one")])
    got = {(r.older, r.newer, r.at_session) for r in supersession.detect(home).collect()}
    assert got == {("c1", "c2", 5), ("c1b", "c2", 5), ("c2", "c3", 9)}
    bad = lambda p: spark.createDataFrame([("u", "s", 4, 1), ("u", "s", 1, 1), ("u", "s", 1, 99), ("u", "s", 1, 3), ("u", "s", 1, 3)], "uid string, skey string, older int, newer int")
    assert [(r.older, r.newer) for r in supersession.detect(home, bad).collect()] == [("c1", "c2")]


def test_fold_and_labels(spark):
    edges = spark.createDataFrame([("c1", "c3", 30), ("c1", "c2", 7), ("c9", "b", 7), ("c9", "a", 7), ("c4", "c5", 37), ("x", "y", None)], "older string, newer string, at_session int")
    assert {(r.older, r.newer) for r in supersession.fold_edges(edges).collect()} == {("c1", "c2"), ("c9", "a"), ("c4", "c5")}
    assert supersession.fold_edges(edges, 4).count() == 0
    claims = spark.createDataFrame([("c4", 3), ("c5", 37)], "ckey string, session_ord int")
    assert {(r.ckey, r.status) for r in supersession.label_as_of(claims, edges).collect()} == {("c4", "SUPERSEDED"), ("c5", "CURRENT")}
    assert {(r.ckey, r.status) for r in supersession.label_as_of(claims, edges, 4).collect()} == {("c4", "CURRENT")}


def fixture(spark):
    questions = spark.createDataFrame([("q1", "u", "What did the hamster nibble?"), ("q2", "u", "the of"), ("q3", "u", "vet")], "qid string, uid string, question string")
    claims = spark.createDataFrame([("c1", "u", 1, 0, "s"), ("c2", "u", 2, 20230101, None), ("c3", "u", 3, 0, "s")], "ckey string, uid string, session_ord int, t_event int, skey string")
    hits = spark.createDataFrame([("u", "hamster", "c1"), ("u", "nibbl", "c1"), ("u", "hamster", "c2"), ("u", "vet", "c1")], "uid string, stem string, ckey string")
    names = spark.createDataFrame([("u", "hamster", "e1")], "uid string, stem string, ekey string")
    mentions = spark.createDataFrame([("e1", "c1"), ("e1", "c3")], "ekey string, ckey string")
    return questions, claims, hits, names, mentions


def test_convergence_and_verdicts(spark):
    questions, claims, hits, names, mentions = fixture(spark)
    anchors = retrieval.anchors_of(questions)
    df = memory.token_df(hits, names)
    reached = retrieval.converge(questions, retrieval.reach(anchors, hits, names, mentions), claims, df)
    got = {(r.qid, r.ckey): (r.convergence, r.hops, r.anchors) for r in reached.collect()}
    assert got == {("q1", "c1"): (2, 1, ["hamster", "nibbl"]), ("q1", "c2"): (1, 1, ["hamster"]), ("q1", "c3"): (1, 2, ["hamster"]), ("q3", "c1"): (1, 1, ["vet"])}
    one_hop = retrieval.reach(anchors, hits, names, mentions, 1)
    assert "c3" not in {r.ckey for r in one_hop.collect()}
    verdict = {r.qid: (r.verdict, r.reason, r.threshold) for r in retrieval.verdicts(questions, anchors, reached).collect()}
    assert verdict == {"q1": ("ANSWER", None, 2), "q2": ("ABSENT", "A1_no_anchors", 1), "q3": ("ANSWER", None, 1)}
    cands = retrieval.candidates(reached, retrieval.verdicts(questions, anchors, reached))
    assert {(r.qid, r.ckey, r["rank"]) for r in cands.collect()} == {("q1", "c1", 1), ("q3", "c1", 1)}
    mates = retrieval.slot_mates(cands, claims)
    assert {(r.qid, r.ckey) for r in mates.collect()} == {("q1", "c3"), ("q3", "c3")}
    edges = spark.createDataFrame([("c1", "c3", 3)], "older string, newer string, at_session int")
    order = lambda **k: [r.ckey for r in retrieval.evidence(cands, mates, edges, **k).where("qid = 'q1'").orderBy("position").collect()]
    assert order() == ["c3", "c1"] and order(historical=True) == ["c1", "c3"]
    before = retrieval.converge(questions, retrieval.reach(anchors, hits, names, mentions), claims, df, 1)
    assert {r.ckey for r in before.collect()} == {"c1"}


def test_trajectory(spark):
    questions, claims, hits, names, mentions = fixture(spark)
    anchors = retrieval.anchors_of(questions)
    reached = retrieval.converge(questions, retrieval.reach(anchors, hits, names, mentions), claims, memory.token_df(hits, names))
    points = spark.createDataFrame([("q1", 0), ("q1", 1), ("q1", 3), ("q2", 3)], "qid string, k int")
    got = {(r.qid, r.k): r.verdict for r in retrieval.trajectory(reached, points).collect()}
    assert got == {("q1", 0): "A1_no_anchors", ("q1", 1): "ANSWER", ("q1", 3): "ANSWER", ("q2", 3): "A1_no_anchors"}


def test_canon(spark):
    rows = [("u", "hamster", "pet", [], True), ("u", "the hamsters", "thing", ["Moma"], False), ("u", "moma", None, None, False), ("u", "goldfish", "pet", [], False), ("u", "journal", "thing", ["template"], False), ("u", "template", "thing", ["bullet"], False), ("u", "bullet", "topic", [], False), ("u", None, "pet", [], True), ("v", "hamsters", "pet", [], False)]
    df = spark.createDataFrame(rows, "uid string, canon string, etype string, aliases array<string>, existing boolean")
    renames = canon.reconcile(df)
    got = {(r.uid, r.canon): r.new_canon for r in renames.collect()}
    assert got == {("u", "hamster"): "hamster", ("u", "the hamsters"): "hamster", ("u", "moma"): "hamster", ("u", "goldfish"): "goldfish", ("u", "journal"): "bullet", ("u", "template"): "bullet", ("u", "bullet"): "bullet", ("v", "hamsters"): "hamsters"}
    merged = canon.merged_entities(df, renames)
    assert {r.canon: (r.etype, r.aliases) for r in merged.where("uid = 'u'").collect()}["hamster"] == ("pet", ["Moma", "moma", "the hamsters"])
    again = canon.reconcile(merged.withColumn("existing", F.lit(True)))
    assert all(r.canon == r.new_canon for r in again.collect())


def test_bm25_and_budget(spark):
    rows = [("u", "t1", 1, 0, "We should think of a cute name for a hamster"), ("u", "t2", 1, 1, "the weather is fine"), ("u", "t3", 2, 0, "my hamster sleeps"), ("u", "t4", 3, 0, "")]
    turns = spark.createDataFrame(rows, "uid string, turn string, session_ord int, turn_idx int, text string")
    q = spark.createDataFrame([("q", "u", "What is the name of my hamster?"), ("z", "u", "quantum")], "qid string, uid string, question string")
    got = [(r.qid, r.turn, r["rank"]) for r in baselines.bm25(q, turns).orderBy("rank").collect()]
    assert got == [("q", "t1", 1), ("q", "t3", 2)]
    kept = lambda n: {r.session_ord for r in baselines.full_context(turns.withColumn("text", F.lpad("text", 100, "x")), n).where("kept").collect()}
    assert kept(10_000) == {1, 2, 3} and kept(250) == {2, 3} and kept(1) == {3}


def test_slices(spark):
    rows = [(f"q{i:03d}", f"type{i % 6}") for i in range(47)] + [(f"z{i:03d}_abs", f"type{i % 6}") for i in range(3)]
    qs = spark.createDataFrame(rows, "question_id string, question_type string")
    assert evaluation.benchmark_slice(qs, 50).count() == 50 and evaluation.benchmark_slice(qs, 900).count() == 50
    ten = evaluation.benchmark_slice(qs, 10).collect()
    assert len(ten) == 10 and sum(r.question_id.endswith("_abs") for r in ten) == 3
    assert evaluation.benchmark_slice(qs, 2).count() == 2


def test_rates(spark):
    rows = [("a", False, "ANSWER", None, True, False, True, ["s"], 3)] * 2 + [("a", False, "ABSENT", "A1_no_anchors", False, False, False, ["s"], 0), ("a", False, "ANSWER", None, False, False, False, ["s"], 4), ("b", True, "ABSENT", "A2_no_convergence", True, False, False, [], 0), ("b", True, "ANSWER", None, False, False, False, [], 1)]
    df = spark.createDataFrame(rows, "question_type string, is_abstention boolean, verdict string, reason string, judged boolean, not_in_memory boolean, session_hit boolean, answer_sessions array<string>, reader_tokens int")
    gate = {r.question_type: r for r in evaluation.gate_report(df).collect()}
    assert gate["ALL"].session_recall == 0.5 and gate["ALL"].false_abstention == 0.25 and gate["ALL"].abstention_recall == 0.5 and gate["ALL"].abstention_precision == 0.5
    assert gate["b"].session_recall == 0.0 and gate["a"].abstention_recall is None
    assert {r.question_type for r in evaluation.summaries(df).collect()} == {"a", "b", "ALL"}
    assert evaluation.micro_recall(spark.createDataFrame([], "kind string, covered boolean"), "kind").first().recall == 1.0


def test_entities_and_stats(spark):
    e = spark.createDataFrame([("u", "u|e|A", "A", "pet", ["x"], True, 1), ("u", "u|e|A", "A", None, None, False, 2), ("u", "k", None, None, None, False, 2)], "uid string, ekey string, canon string, etype string, aliases array<string>, existing boolean, extra int")
    assert [tuple(r) for r in memory.entities_of(e).collect()] == [("u", "u|e|A", "A", "pet", ["x"], True)]


def test_what_readers_and_judges_say(spark):
    df = spark.createDataFrame([("NOT_IN_MEMORY.", True), (" yes", True), ("yes", False), (None, None)], "a string, premise boolean")
    assert [r[0] for r in df.select(evaluation.not_in_memory(F.col("a"), F.col("premise"))).collect()] == [True, False, True, False]
    prompt = spark.createDataFrame([("abstention",), ("default",)], "t string").select(evaluation.judge_prompt(F.col("t"), F.lit("Q"), F.lit("A"), F.lit("R")).alias("p")).collect()
    assert "Why it can't be answered: A" in prompt[0].p and "Expected answer: A\n\nReply: R" in prompt[1].p
    assert [r[0] for r in spark.createDataFrame([("Yesterday",), ("no",)], "r string").select(evaluation.judge_label(F.col("r"))).collect()] == [True, False]


def test_runs_latency_and_cost(spark):
    runs = spark.createDataFrame([("q", 1, "h"), ("q", 2, "h"), ("p", 1, "h"), ("p", 2, "x")], "qid string, run int, hash string")
    assert {(r.qid, r.runs, r.hashes) for r in retrieval.distinct_hashes(runs).collect()} == {("q", 2, 1), ("p", 2, 2)}
    rows = spark.createDataFrame([("t", False, "ANSWER", None, True, 1.0), ("t", False, "ABSENT", "A1_no_anchors", False, 4.0)], "question_type string, is_abstention boolean, verdict string, reason string, session_hit boolean, latency_ms double")
    assert {r.latency_p50 for r in evaluation.gate_report(rows).collect()} == {2.5}
    cache = spark.createDataFrame([("read", "k", "m", "v", 1_000_000, 2_000_000), ("read", "k", "other", "v", 5, 5)], "kind string, key string, model string, value string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 0.5, 2.0)], "model string, input double, output double")
    assert {(r.model, r.cost) for r in models.usage(cache, prices).collect()} == {("m", 4.5), ("other", 0.0)}


def test_users_nothing_is_remembered_of(spark):
    q = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "b")], "qid string, uid string")
    claims = spark.createDataFrame([("a",), ("a",)], "uid string")
    assert [tuple(r) for r in evaluation.missing_users(q, claims).collect()] == [("b", 2)]
    assert [r.qid for r in evaluation.askable(q, claims).collect()] == ["q1"]
