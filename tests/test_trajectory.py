import os

import pytest

import verify
from memlattice import queries
from memlattice.operators import retrieval

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
def test_every_session_is_a_point(spark):
    assert verify.main([ROOT, "trajectory"]) == 0
    asked = {(r.uid, r.k) for r in queries._turns(spark, ROOT, "uid", "session_ord").selectExpr("uid", "session_ord as k").distinct().collect()}
    users = {r.qid: r.uid for r in queries._questions(spark, ROOT).collect()}
    points = {(r.qid, r.k) for r in queries.trajectory(spark, ROOT).collect()}
    assert points == {(q, k) for q, u in users.items() for v, k in asked if u == v}


def test_trajectory_of_few_claims(spark):
    reached = spark.createDataFrame([("q", 2, ["a"], 1), ("q", 5, ["a", "b"], 2), ("q", 5, ["c"], 1)], "qid string, session_ord int, anchors array<string>, convergence int")
    points = spark.createDataFrame([("q", 1), ("q", 2), ("q", 4), ("q", 9), ("none", 3)], "qid string, k int")
    got = sorted(map(tuple, retrieval.trajectory(reached, points).collect()), key=repr)
    assert got == [("none", 3, "A1_no_anchors", None), ("q", 1, "A1_no_anchors", None), ("q", 2, "ANSWER", 1), ("q", 4, "ANSWER", 1), ("q", 9, "ANSWER", 2)]
