from collections import Counter

import pytest

import memlattice.llm.frequency as frequency
from memlattice.llm.frequency import corrected_df, mark_unusable, term_frequencies

ROWS = [("u", "s1", ["a", "a", "b", None, ""], 1), ("u", "s1", ["a", "a", "b", None, ""], 2), ("u", "s2", ["a"], 1), ("v", "s1", None, 1), ("v", "s2", [], 1), (None, None, ["a", "c"], 1)]


def test_counts(spark):
    df = spark.createDataFrame(ROWS, "uid string, session_key string, hits array<string>, scope int")
    got = {r.term: (r.occurrences, r.records, r.total_records) for r in term_frequencies(df, ["uid", "session_key"], "hits", "scope").collect()}
    assert got == {"a": (4, 3, 5), "b": (1, 1, 5), "c": (1, 1, 5)}
    assert term_frequencies(df.limit(0), ["uid", "session_key"], "hits").collect() == []


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_slices_of_a_term_add_up(spark, monkeypatch, slices):
    rows = [(f"r{i}", [f"t{(i * j) % 23}" for j in range(12)]) for i in range(200)]
    df = spark.createDataFrame(rows, "r string, t array<string>")
    monkeypatch.setattr(frequency, "SLICES", slices)
    occ, rec = Counter(t for _, ts in rows for t in ts), Counter(t for _, ts in rows for t in set(ts))
    assert {r.term: (r.occurrences, r.records) for r in term_frequencies(df, ["r"], "t").collect()} == {t: (occ[t], rec[t]) for t in occ}


def test_records_that_differ_in_a_null_only(spark):
    df = spark.createDataFrame([("u", None, ["a"]), (None, "u", ["a"]), ("u", "", ["a"]), ("u", "u", ["a"])], "x string, y string, t array<string>")
    assert [tuple(r) for r in term_frequencies(df, ["x", "y"], "t").collect()] == [("a", 4, 4, 4)]


def test_marks(spark):
    df = spark.createDataFrame([("x", 2, 100), ("y", 3, 100), ("z", 6, 100), ("w", 2, 3)], "term string, records int, total_records int")
    assert {r.term: r.mark for r in mark_unusable(df).collect()} == {"x": "rare", "y": None, "z": "common", "w": "rare"}


def test_corrected(spark):
    docs = spark.createDataFrame([("u", "s", 0, ["a", "a"]), ("u", "s", 0, ["a", "a"]), ("u", "s", 1, ["a", "b"]), ("u", "s", 2, None)], "uid string, session_key string, turn_idx int, terms array<string>")
    stored = spark.createDataFrame([("u", "a", 2), ("u", "a", None), ("u", "b", 0), ("u", "z", 4)], "uid string, term string, df int")
    assert {(r.term, r.df, r.state) for r in corrected_df(docs, stored).collect()} == {("a", 2, "right"), ("b", 1, "no_count"), ("z", 0, "stale")}
