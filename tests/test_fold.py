import re

import pytest
from pyspark.sql import functions as F

from memlattice import runtime
from memlattice.operators import baselines, fold, memory, retrieval
from memlattice.plans import ask


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowd(spark, n=120):
    """One user, n claims and n questions that all share a word."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(n)]
    claims = spark.createDataFrame([(f"c{i}", "u", f"u|s|k{i % 5}", f"hamster {w} {words[i // 3]}", i % 7, i % 3, None, ["e1"] if i % 4 == 0 else None) for i, w in enumerate(words)], "ckey string, uid string, skey string, text string, session_ord int, t_event int, keywords array<string>, mentions array<string>")
    entities = spark.createDataFrame([("u", "e1", "velvet", None, ["moma"], False)], "uid string, ekey string, canon string, etype string, aliases array<string>, existing boolean")
    edges = spark.createDataFrame([("u", f"c{i}", f"c{i + 5}", 6) for i in range(0, 40, 3)], "uid string, older string, newer string, at_session int")
    questions = spark.createDataFrame([(f"q{i}", "u", f"velvet hamster {w}" if i % 2 else f"{w} {words[i // 2]}") for i, w in enumerate(words)] + [("none", "u", "the"), ("other", "v", "hamster")], "qid string, uid string, question string")
    return claims, memory.entities_of(entities), edges, questions


def rows(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


def test_billionths():
    import numpy as np

    assert fold.billionths(np.array([0.0000000005, 1.0000000015, 2.5, 0.1234567894])).tolist() == [1, 1000000002, 2500000000, 123456789]


@pytest.mark.parametrize("as_of,historical,tasks", [(None, False, 2_000), (4, True, 7)])
def test_lookups_are_what_joins_give(spark, monkeypatch, as_of, historical, tasks):
    """Also if a user's questions are dealt to several tasks."""
    monkeypatch.setattr(fold, "QUESTIONS", tasks)
    claims, entities, edges, questions = crowd(spark)
    hits, names = memory.hits_of(claims, entities), memory.names_of(entities)
    anchors = retrieval.anchors_of(questions)
    reached = retrieval.converge(questions, retrieval.reach(anchors, hits, names, memory.mentions_of(claims)), claims, memory.token_df(hits, names), as_of)
    verdict = retrieval.verdicts(questions, anchors, reached)
    cands = retrieval.candidates(reached, verdict)
    found = retrieval.evidence(cands, retrieval.slot_mates(cands, claims, as_of), edges, as_of, historical)
    got = ask.ask(questions, ask.Memory.of(claims, entities, edges), as_of, historical)
    assert rows(got.verdicts) == rows(verdict)
    assert rows(got.reached.select(*reached.columns)) == rows(reached)
    assert rows(got.candidates.select(*cands.columns)) == rows(cands)
    assert rows(got.evidence.select(*found.columns)) == rows(found)
    assert rows(got.hashes) == rows(retrieval.hashes(questions, found))
    points = questions.select("qid").crossJoin(spark.createDataFrame([(0,), (3,), (9,)], "k int"))
    if as_of is None:
        said = ask.trajectory(questions, ask.Memory.of(claims, entities, edges), questions.select("uid").distinct().crossJoin(points.select("k").distinct()))
        assert rows(said) == rows(retrieval.trajectory(reached, points))


def test_no_table_has_a_row_for_each_pair(spark):
    claims, entities, edges, questions = crowd(spark, 300)
    before = set(runtime._written)
    got = ask.ask(questions, ask.Memory.of(claims, entities, edges))
    got.evidence.count()
    most = max(df.count() for k, (df, _) in runtime._written.items() if k not in before)
    assert most <= questions.count() * (retrieval.TOP_K + retrieval.SLOT_MATES)


def test_bm25_shuffles_no_pairs(spark):
    questions = spark.createDataFrame([("q1", "u", "a red lamp"), ("q2", "u", "lamp lamp")], "qid string, uid string, question string")
    turns = spark.createDataFrame([("u", f"t{i}", i, 0, "the lamp is red " * (1 + i % 2)) for i in range(15)], "uid string, turn string, session_ord int, turn_idx int, text string")
    found = baselines.bm25(questions, turns)
    assert not re.search(r"hashpartitioning\(qid#\d+, turn#", plan_of(found))
    assert {(r.qid, r.turn) for r in found.where("rank = 1").collect()} == {("q1", "t1"), ("q2", "t1")}
    assert found.where(F.col("rank") > 10).count() == 0 and found.count() == 20
