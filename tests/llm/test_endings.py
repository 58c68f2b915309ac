import random
from collections import Counter

import numpy as np
import pyarrow as pa

from memlattice.llm import endings
from memlattice.llm.truncation import EndingModel, truncation

LONG = "The lamp stands next to the sofa in the hall. I bought a tent at the market last week. We moved to Weltmouth in January.\n" * 250
ODD = ["", "\n", " a\tb.\r\nc…) d' it's o’clock _x_  1.5, \n\n", "Ende. Wort 東京タワー。次", "x.\"» y?!", "a\x00b \x1c c"]


def test_all_texts_are_counted(spark):
    """One text of more than 20,000 characters has all there is to learn."""
    rng = random.Random(3)
    tails = ["I bought a tent at the market last week", "The lamp stands next to the so", "We moved to Weltmouth in Janury", "We moved to Xarbridge", "We moved to Weltmouth in Janua", "A tent stands", "7", "lam", "The lamp stands next to the Sofa..."]
    texts = [LONG, *tails, *(" ".join(rng.choice(LONG.split()) for _ in range(9)).rstrip(".") for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").selectExpr("k", "t", "CAST(NULL AS string) AS s").repartition(3)
    got = {r.k: (r.ending, r.p_whole) for r in truncation(df, "k", "t", "s").collect()}
    model = EndingModel.fit(texts)
    asked = {k: t for k, t in enumerate(texts) if got[k][0] in ("open", "marked")}
    assert len(asked) > 50
    for k, text in asked.items():
        assert abs(got[k][1] - model.whole(text.removesuffix("..."))) < 1e-9, text
    assert got[1][1] > 0.9 and got[2][1] < 0.1 and got[5][1] < 0.1


def test_a_rare_context_falls_back_on_a_wider_one():
    model = EndingModel.fit([f"We met in {town} in {month} again." for town in "Berlin Paris Rome Oslo".split() * 9 for month in ("January", "March")] + ["We met in Xanten in May again."] * 12)
    assert model.whole("We met in Xanten in Janua") == 0.02


def test_pieces_give_the_same_tokens():
    words = endings.Lexicon()
    for texts in (ODD, ODD[::-1]):
        ids, place, left = words.read(texts)
        rows = [["\n", *endings._TOKEN.findall(t), "\n"] for t in texts]
        assert [list(words.words)[i] for i in ids] == [w for row in rows for w in row]
        assert list(place) == [k for row in rows for k in range(len(row))] and list(place + left) == [len(row) - 1 for row in rows for _ in row]


def test_a_full_lexicon_is_begun_again(monkeypatch):
    """Whatever is told in parts adds up to the same."""
    texts = [f"word{i % 7} and word{i % 3}" for i in range(40)]
    batches = [pa.RecordBatch.from_pydict({"t": texts[k : k + 5]}) for k in range(0, 40, 5)]
    told = []
    for most in (1 << 20, 4):
        monkeypatch.setattr(endings, "MOST_PIECES", most)
        parts = list(endings._counted(iter(batches), frozenset(), lambda w, ids, *_: np.unique(ids, return_counts=True), lambda w, ids, n: [(list(w.words)[i], c) for i, c in zip(ids, n, strict=True)]))
        total = Counter()
        for part in parts:
            total.update({w: int(c) for w, c in part})
        told.append((len(parts), total))
    assert told[0][0] == 1 < told[1][0] and told[0][1] == told[1][1] and told[0][1]["and"] == 40
