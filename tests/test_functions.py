from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlattice.functions import dates, keys
from memlattice.functions.text import IRREGULAR, STOPWORDS, claim_tokens, excerpt, locate_span, match_keys, stems


def stems_of(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(stems(F.col("t"))).collect()]


def test_stems(spark):
    got = stems_of(spark, "We were planting tulips and the smallest one died", "Brother's half-price ladder: 12,500 yen", None, "", "virus oasis kiss abs glass", "turtles foxes stories wives geese leaves", "hoping stopped noticed")
    assert got[0] == ["plant", "tulip", "smallest", "one", "died"]
    assert got[1] == ["brother", "half", "pric", "ladder", "12", "500", "yen"]
    assert got[2] == got[3] == []
    assert got[4] == ["virus", "oasis", "kiss", "abs", "glass"]
    assert got[5] == ["turtl", "fox", "story", "wif", "goos", "leaf"]
    assert got[6] == ["hop", "stop", "notic"]
    assert len(STOPWORDS) == 134 and len(IRREGULAR) == 12


def test_stems_agree_and_keep_repeats(spark):
    assert stems_of(spark, "cape capes CAPE's") == [["cap", "cap", "cap"]]


def test_claim_tokens(spark):
    df = spark.createDataFrame([("the boat " + " ".join(f"word{i}x" for i in range(80)), ["dinghy", None, "sailboats"], None)], "t string, k array<string>, n array<string>")
    got = df.select(claim_tokens(F.col("t"), F.col("k"), F.col("n"))).first()[0]
    assert got[:3] == ["dinghy", "sailboat", "boat"] and len(got) == 24


def test_match_keys(spark):
    df = spark.createDataFrame([("the red kettles", ["Kettle red", "", None])], "c string, a array<string>")
    assert df.select(match_keys(F.col("c"), F.col("a"))).first()[0] == ["kettl red"]


def test_locate_span(spark):
    rows = [("y the oven broke", "the oven broke"), ("so\n\t the oven  broke", "the oven broke"), ("try _Linseed_ `oil` now", "Linseed oil now"), ("abc", "teapot"), ("abc", ""), ("abc", "   "), (None, "x"), ("abc", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, q string").select(locate_span(F.col("t"), F.col("q"))).collect()]
    assert [tuple(g) if g else None for g in got] == [(2, 16, "exact"), (5, 20, "normalised"), (5, 23, "markdown"), None, None, None, None, None]


def test_excerpt_is_clamped(spark):
    rows = [("a" * 50 + "SPAN" + "b" * 50, 50, 54), ("short", 3, 900), ("0123456789", 10, 5), ("0123456789", -4, 12)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, s int, e int").select(excerpt(F.col("t"), F.col("s"), F.col("e"), 20)).collect()]
    assert len(got[0].excerpt) == 44 and got[0].highlight_start == 20
    assert tuple(got[1]) == ("short", 3, 5)
    for g in got:
        assert 0 <= g.highlight_start <= g.highlight_end <= len(g.excerpt)


def test_dates(spark):
    df = spark.createDataFrame([("2023-03-15",), ("2023-03",), ("2023",), (None,), ("last Tuesday",)], "t string").select(dates.event_date(F.col("t")).alias("d"))
    assert [tuple(r.d) for r in df.collect()] == [(20230315, "day"), (20230300, "month"), (20230000, "year"), (0, "none"), (0, "none")]
    stamp = spark.createDataFrame([("2023/04/10 (Mon) 17:50",), ("never",)], "t string").select(dates.session_stamp(F.col("t")).alias("d")).collect()
    assert tuple(stamp[0].d) == (1681149000, 20230410) and stamp[1].d is None


def test_keys(spark):
    row = spark.range(1).select(keys.vertex_id(F.lit("abc")).alias("v"), keys.turn_key(F.lit("u"), F.lit("s"), F.lit(3)).alias("t"), keys.evidence_hash(F.array(F.lit("b"), F.lit("a"))).alias("h")).first()
    assert row.v == int("ba7816bf8f01cfea", 16) >> 11 and row.t == "u|turn|s|3"
    import hashlib

    assert row.h == hashlib.sha256(b"a\nb").hexdigest()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abcdeings'’ 1é", max_size=40), min_size=1, max_size=20))
def test_stems_are_long_enough_and_no_text_fails(spark, texts):
    for got in stems_of(spark, *texts):
        assert all(len(s) >= 2 for s in got)
