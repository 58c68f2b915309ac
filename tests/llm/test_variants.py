import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlattice.llm.names import FORMAL
from memlattice.llm import variants
from memlattice.llm.variants import canonical_entities, given_meanings, link_variants, name_forms, radius_join, shortened, slip_distance, slip_distances, variant_pairs

ROWS = [
    ("u", "k1", "Henrietta Dilthailow", "person", ["Dilthailow, Henrietta"]),
    ("u", "k2", "hattie dlithailow", "person", None),
    ("u", "k3", "Dr. H. Dilthailow", "topic", []),
    ("u", "k4", "Quentin Dilthailow", "person", ["the office"]),
    ("u", "k5", "Etta", "person", ["Henrietta Dilthailow"]),
    ("u", "k6", "Kinnend Coffee Roasters", "org", ["work"]),
    ("u", "k7", "Roasters, Kinnend Coffee", "org", None),
    ("u", "k8", "KCR", "org", ["boss"]),
    ("u", "k9", "the Kinnend-coffee roastrs Ltd", "thing", None),
    ("u", "k10", "Kinnend Dental Clinic", "org", None),
    ("u", "k11", "Holttiex the ferret", "pet", ["Holttiex"]),
    ("u", "k12", "Faenboa project 14", "topic", None),
    ("u", "k13", "Faenboa project 15", "topic", None),
    ("u", "k14", None, "person", ["landlord", None, ""]),
    ("u", "k15", "", None, None),
    ("u", "k1", "Henrietta Dilthailow", "person", ["Dilthailow, Henrietta"]),
    ("v", "k16", "Henrietta Dilthailow", "person", None),
    (None, "k17", "Henrietta Dilthailow", "person", None),
]
SCHEMA = "uid string, ekey string, canon string, etype string, aliases array<string>"


def test_links(spark):
    df = spark.createDataFrame([(*r, True, "clash") for r in ROWS], SCHEMA + ", existing boolean, kind string")
    linked = link_variants(df)
    got = {(r.ekey_a, r.ekey_b) for r in variant_pairs(linked).collect()}
    groups = [("k1", "k2", "k3", "k5"), ("k6", "k7", "k8", "k9")]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}
    named = {r.canon for r in canonical_entities(df, linked).collect()}
    assert named == {"Henrietta Dilthailow", "the Kinnend-coffee roastrs Ltd"}
    assert link_variants(df.limit(0)).collect() == []


def test_an_initial_that_may_be_two_people_is_linked_to_none(spark):
    rows = [("u", "a", "Jonathan Tyllund", "person", None), ("u", "b", "Jacqueline Tyllund", "person", None), ("u", "c", "J. Tyllund", "person", None)]
    assert link_variants(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_names_in_no_list(spark):
    """Given names of many origins that no list has: typos, initials, order and accents; apart from others of the same surname."""
    rows = []
    people = [("priya", "Sharma"), ("katarina", "Nowak"), ("mohammed", "Haddad"), ("chloe", "Dubois"), ("hiroshi", "Tanaka"), ("wei", "Cheng"), ("ngozi", "Okonkwo"), ("søren", "Kjeldsen")]
    for n, (g, s) in enumerate(people):
        g = g.capitalize()
        slip = g[0] + g[2] + g[1] + g[3:] if len(g) > 4 else g
        forms = [f"{g} {s}", f"{s}, {g}", f"{g[0]}. {s}", f"{g} {s[:-2]}{s[-1]}{s[-2]}", f"{slip.lower()} {s.lower()}", f"{g.upper()} {s.upper()}", f"{g} K. {s}"]
        rows += [(f"u{n}", f"{n}-{i}", f, "thing" if i == 1 else "person", None) for i, f in enumerate(forms)]
        rows += [(f"u{n}", f"{n}-x", f"Bartholo {s}", "person", None), (f"u{n}", f"{n}-y", "wooden scooter", "thing", None), (f"u{n}", f"{n}-z", "wooden scooters", "thing", None)]
        assert g.lower() not in FORMAL
    got = {(r.ekey_a, r.ekey_b) for r in variant_pairs(link_variants(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {(f"{n}-{i}", f"{n}-{j}") for n in range(len(people)) for i in range(7) for j in range(i + 1, 7)}


def test_organisations_of_one_word(spark):
    rows = [("u", "a", "Quorvane Ltd", "org", None), ("u", "b", "Quorvane Inc.", None, None), ("u", "c", "Quorvana, LLC", "org", None), ("u", "d", "Quorvane", "person", None), ("u", "e", "Brell Ltd", "org", None)]
    got = {(r.ekey_a, r.ekey_b) for r in variant_pairs(link_variants(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}


def test_given_meanings(spark):
    words = spark.createDataFrame([("usrula", 1), ("priya", 30), ("pirya", 2), ("priyan", 25), ("bill", 9), ("zed", 1)], "given string, n bigint")
    got = {}
    for r in given_meanings(words).collect():
        got.setdefault(r.given, set()).add(r.meaning)
    assert got == {"usrula": {"ursula"}, "priya": {"priya"}, "pirya": {"priya"}, "priyan": {"priyan"}, "bill": {"william"}, "zed": {"zed"}}


def test_forms():
    assert name_forms("Prof. Zaemvane, Bob R.") == [("p", "zaemvane", "bob", "", "bob r zaemvane")]
    assert name_forms("Tryalow Y") == [("p", "tryalow", "", "y", "")]
    assert name_forms("Baethwim Comm. Lib.")[0] == name_forms("the Baethwim Community Library")[0]
    assert name_forms("Ana Lopez Garcia") == [("o", "ana lopez garcia", "", "", ""), ("m", "lopez garcia", "ana", "", "")]
    assert name_forms("Jean-Luc Picard")[0][:3] == ("p", "picard", "jeanluc")
    assert name_forms("me") == name_forms("") == name_forms("  ") == name_forms("the office") == []


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_slip_distance(a, b):
    d = slip_distance(a, b)
    assert d == slip_distance(b, a) == slip_distances([a], [b])[0] and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=5), st.text("ab", max_size=5), st.text("ab", max_size=5))
def test_slips_are_a_metric(a, b, c):
    assert slip_distance(a, c) <= slip_distance(a, b) + slip_distance(b, c)
    if slip_distance(a, b) <= 2:
        assert shortened(a, 2) & shortened(b, 2)


def test_many_slips_at_once():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=rng.randrange(0, 60))) for _ in range(300)]
    others = words[1:] + words[:1]
    assert list(slip_distances(words, others)) == [slip_distance(a, b) for a, b in zip(words, others, strict=True)]
    assert slip_distance("ca", "abc") == 2


@pytest.mark.parametrize("crowded", [256, 4])
@pytest.mark.parametrize("size", [40, 700])
def test_radius_join_misses_no_pair(spark, size, crowded, monkeypatch):
    """Against all pairs, with cells split more than once and with crowded cells."""
    monkeypatch.setattr(variants, "CROWDED", crowded)
    rng = random.Random(size)
    names = sorted({"".join(rng.choices("abcde", k=rng.randrange(2, 9))) for _ in range(size)})
    df = spark.createDataFrame([("x", n) for n in names] + [("y", n) for n in names[:30]] + [("x", None), (None, "x")], "b string, n string")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    want = {p: int(d) for p, d in zip(pairs, slip_distances(*map(list, zip(*pairs, strict=True))), strict=True) if d <= 2}
    got = [((r.name_a, r.name_b), r.slips) for r in radius_join(df, ["b"], "n").where("b = 'x'").collect()]
    assert len(got) == len(want) and dict(got) == want


def test_shortened_words_are_not_sent_to_the_driver(spark):
    """Many times the size of the table they are drawn from, which Spark doesn't foresee."""
    words = spark.createDataFrame([(f"{a}{b}lomira", 9) for a in "bdfgk" for b in "aeiou"], "given string, n long")
    plan = given_meanings(words)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_key" in line]
    assert joins and all("merge" in line for line in joins)
