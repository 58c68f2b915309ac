import random

from pyspark.sql import functions as F

from memlattice.llm.truncation import EndingModel, closing_formulas, judge, length_limits, truncation, truncation_rates

NOUNS = "garden kettle lamp bicycle tent sofa piano ladder camera guitar".split()


def sentence(rng):
    return rng.choice([f"I bought a {rng.choice(NOUNS)} at the market last week.", f"The {rng.choice(NOUNS)} stands next to the {rng.choice(NOUNS)} in the hall.", f"Can you repair the {rng.choice(NOUNS)} before the weekend?"])


def corpus(rng, n, limit):
    rows = []
    for i in range(n):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 9)))
        source = rng.choice(["free", "short"])
        cut = source == "short" and len(text) > limit
        if cut:
            text = text[:limit]
        if not cut and rng.random() < 0.1:
            text = text.rstrip(".?")
        rows.append((i, text, source, cut and text[-1] not in ".?"))
    return rows


def test_truncation(spark):
    rng = random.Random(4)
    rows = corpus(rng, 1500, 200)
    for i in range(0, 30):
        text = " ".join(sentence(rng) for _ in range(4))
        rows.append((5000 + i, text[: len(text) - 30], "free", text[: len(text) - 30][-1] not in ".?"))
    extra = [(9000, "It was the garden and the ke�", "free"), (9001, None, "free"), (9002, "", None), (9003, rows[0][1], None), (9003, rows[0][1], None)]
    df = spark.createDataFrame([(*r[:3], "clash") for r in rows] + [(*e, None) for e in extra], "doc_id long, body string, source string, ending string")
    found = truncation(df, "doc_id", "body", "source")
    got = {r.doc_id: r for r in found.collect()}
    truth = {r[0] for r in rows if r[3]} | {9000}
    said = {k for k, r in got.items() if r.is_cut}
    assert 9001 not in got and not got[9002].is_cut
    assert len(said & truth) >= 0.95 * len(truth) and len(said - truth) <= 0.02 * len(rows)
    assert all(got[r[0]].by_limit for r in rows if r[3] and len(r[1]) == 200)
    assert all(r.is_cut == (r.by_limit or r.by_ending) and not (r.by_limit and r.by_ending) for r in got.values())
    assert {k for k, r in got.items() if r.by_ending} >= {5000 + i for i in range(30)} & truth - {k for k, r in got.items() if not r.is_cut}
    rates = {r.source: r.share for r in truncation_rates(found, "source").collect()}
    assert rates["short"] > 0.3 > rates["free"]
    assert truncation(df.limit(0), "doc_id", "body", "source").collect() == []


def test_limits(spark):
    rng = random.Random(7)
    rows = [("a", n, 1 + rng.randrange(2)) for n in range(50, 400, 2)] + [("a", 161, 60), ("b", 100, 3), (None, 5, 1)]
    got = length_limits(spark.createDataFrame(rows, "s string, n int, c long"), "s", "n", "c").collect()
    assert [(r.s, r.n) for r in got] == [("a", 161)]


def test_judge():
    rng = random.Random(2)
    model = EndingModel.fit([" ".join(sentence(rng) for _ in range(5)) + "\nbye for now" * (i % 9 == 0) for i in range(400)])
    model.formulas = {"bye for now"}
    assert judge(model, "Can you repair the lamp?")[0] == "stopped"
    assert judge(model, "I bought a tent at the market last week\nbye for now")[0] == "closed"
    assert judge(model, "I bought a tent at the market last week https://a.example/x")[0] == "closed"
    assert judge(model, "")[0] == "closed"
    for cut in ("The lamp stands next", "The lamp stands next to the gar", "Can you repair the lamp bef...", "I bought a tent at the mark</p>", "Can you repair the\n--\nend of export"):
        assert judge(model, cut)[1] < 0.3, cut
    for whole in ("I bought a tent at the market last week", "The lamp stands next to the sofa in the hall"):
        assert judge(model, whole)[1] > 0.5, whole


def test_whole_texts_are_judged():
    """An opening mark far from the end: the closing one belongs to it, and nothing was put after a break."""
    model = EndingModel.fit(["The lamp stands next to the sofa in the hall. I bought a tent at the market last week."] * 30)
    far = "The lamp stands next to the sofa in the hall. " * 400
    for opening, closing in (("[", "]"), ("{", "}"), ("<p>", "</p>")):
        assert judge(model, f"{opening}{far}The lamp stands next to the sofa{closing}")[0] == "open"
        assert judge(model, f"{far}The lamp stands next to the sofa{closing}")[0] == "marked"
    assert judge(model, far + "x" * 5000)[1] == judge(model, far[-92:] + "x" * 5000)[1]


def test_formulas_are_counted_over_all_texts(spark):
    texts = [f"Text number {i} is here.\nSee you around" for i in range(4)] + ["Copy\nnot shared"] * 9 + [f"The end of {i}.\nThe end of" for i in range(5)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pieces = df.select(F.xxhash64("t").alias("h"), F.substring_index("t", "\n", -1).alias("piece"))
    assert closing_formulas(df, "t", pieces, len(texts)) == {"See you around"}
