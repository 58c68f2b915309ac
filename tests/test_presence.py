import pytest
from pyspark.sql import functions as F

from memlattice.operators.presence import bitmap_words, runs, snapshot_history
from memlattice.operators.slot_history import slot_history, slot_timeline


def brute(seen):
    out, seen = [], sorted(set(seen))
    for x in seen:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seen", [[1], [0], [61, 62], [0, 1, 2, 61, 62, 63, 123, 124], [5, 5, 5], list(range(0, 400)), [1, 3, 5, 200], list(range(60, 190)) + [500]])
def test_runs(spark, seen):
    df = spark.createDataFrame([("k", s) for s in seen], "k string, at int")
    got = bitmap_words(df, ["k"], "at").select(runs(F.col("words")).alias("r")).first().r
    assert [tuple(r) for r in got] == brute(seen)


def test_snapshot_history(spark):
    rows = [("u", "a", 1), ("u", "a", 2), ("u", "a", 2), ("u", "b", 3), ("u", "a", 5), (None, None, 7), ("v", None, 1), ("u", "z", None)]
    df = spark.createDataFrame(rows, "who string, what string, at int").withColumn("word", F.lit("clash")).withColumn("bits", F.lit(None).cast("string"))
    got = {tuple(r) for r in snapshot_history(df, ["who"], ["what"], "at").collect()}
    assert got == {("u", "a", 1, 2, False), ("u", "b", 3, 3, False), ("u", "a", 5, 5, True), (None, None, 7, 7, True), ("v", None, 1, 1, True)}
    assert snapshot_history(df.limit(0), ["who"], ["what"], "at").collect() == []


CLAIM = "ckey string, skey string, session_ord int, ingested_at int, words string"
EDGE = "older string, newer string, at_session int, bits int"
LABEL = "ckey string, superseded_by string, status string, at_session int, as_of int"


def history(spark, claims, edges, labels):
    return slot_history(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(edges, EDGE), spark.createDataFrame(labels, LABEL))


def test_slot_history(spark):
    claims = [("a", "s", 2, 1, "x"), ("a", "s", 2, 2, "x"), ("b", "s", 5, 1, "x"), ("c", "s", 5, 1, None), ("d", "t", 9, 1, "x"), ("n", None, 1, 1, "x"), ("far", "s", 500, 1, "x")]
    edges = [("a", "b", 5, 0), ("a", "b", 5, 0), ("a", "far", 300, 0), ("b", "c", 5, 0), ("b", "a", 9, 0), ("c", "c", 6, 0), ("d", "a", 9, 0), ("c", "gone", 7, 0), ("c", "far", None, 0), (None, "b", 3, 0), ("a", "b", 1, 0)]
    labels = [("c", "far", "SUPERSEDED", 400, 401), ("c", "far", "CURRENT", 100, 401), ("c", None, "SUPERSEDED", 6, 401), ("c", "far", None, 8, 1)]
    got = {(r.ckey, r.valid_from, r.valid_to) for r in history(spark, claims, edges, labels).collect()}
    assert got == {("a", 2, 5), ("b", 5, 5), ("c", 5, 400), ("d", 9, 0), ("far", 500, 0)}


def test_slot_history_of_nothing(spark):
    assert history(spark, [], [], []).collect() == []
    assert [tuple(r) for r in history(spark, [("a", "s", 2, 1, "x")], [], []).collect()] == [("s", "a", 2, 0)]


def test_timeline(spark):
    h = history(spark, [("a", "s", 2, 1, ""), ("b", "s", 5, 1, "")], [("a", "b", 5, 0)], [])
    assert [(r.ckey, r.version, r.is_current) for r in slot_timeline(h).orderBy("version").collect()] == [("a", 1, False), ("b", 2, True)]
