"""What p8 saves time by: texts are tokenised once, and read as seldom as the order of its steps allows."""

import random
from collections import Counter

from memlattice.llm import endings, truncation
from memlattice.llm.truncation import EndingModel, begun_with, closing_formulas, ending

SHORT, DOTTED = "See you around", "and so on and on..."
LONG = "The lamp stands next to the sofa in the hall and the tent stands next to the piano "


def test_a_text_is_read_three_times(spark):
    """Once for its end, once for the lines it begins with, once for its words."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, f"The lamp number {i} stands next to the sofa.\n{SHORT}" if i % 2 else f"I bought tent {i} at the mar", "s") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t string, s string").mapInArrow(counted, "k long, t string, s string")
    got = {r.k: r.ending for r in truncation.truncation(df, "k", "t", "s").collect()}
    assert got == {i: "closed" if i % 2 else "open" for i in range(40)}
    assert read.value == 3 * len(rows)


def test_numbered_texts_have_the_same_words(spark):
    """In one group more words than two bytes number, and in another a text without any."""
    many = " ".join(f"w{i}" for i in range(70_000))
    texts = [many, "", "It's a tent.\n\nIt was 2 o'clock…", many[:50]]
    table = endings.numbered(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1))
    rows = table.where("ids IS NOT NULL").select("words", "wide", "ids", "lengths").toArrow().to_batches()
    assert any(b.column(1).to_pylist()[0] for b in rows)
    words = endings.Lexicon()
    found = []
    for read in endings._read(iter(rows)):
        ids, place, left = read(words)
        assert all(p + l >= 1 for p, l in zip(place, left, strict=True))
        found += [list(words.words)[i] for i in ids] if len(ids) < 100 else map(list(words.words).__getitem__, ids)
    expected = [w for t in texts for w in ["\n", *endings._TOKEN.findall(t), "\n"]]
    assert found == expected
    assert {r.word: r.n for r in endings.word_counts(table).collect()} == Counter(expected)


def test_lines_and_sentences_that_begin_with_a_piece():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab^-].!… \n\n\t") for _ in range(rng.randrange(0, 25)))
        pieces = {"".join(rng.choice("ab^-]. ") for _ in range(rng.randrange(1, 5))) for _ in range(4)}
        begin, spans = 0, []
        for m in truncation._BETWEEN.finditer(text):
            spans.append((begin, m.start() + (text[m.start()] != "\n")))
            begin = m.end()
        spans.append((begin, len(text)))
        expected = Counter(p for b, e in spans for p in pieces if len(p) < e - b and text[b:].startswith(p))
        assert Counter(begun_with(pieces)(text)) == expected, (text, pieces)


def test_formulas_hold_after_other_words_and_under_what_follows_a_break(spark):
    texts = [f"Text number {i} is here.\n{SHORT if i % 2 else DOTTED}" for i in range(12)]
    texts += [f"{LONG}{DOTTED}", f"{LONG}b{DOTTED}", f"Here it is.\n{SHORT}\n---\n", f"Here it is.\n{SHORT}</p>", f"Here is {SHORT}", f"Here it is.\n{SHORT}�", "", " \n ", "\n--\nx", DOTTED]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").selectExpr("k", "t", "'s' AS s")
    pieces = df.selectExpr("xxhash64(t) AS h", "substring_index(t, '\\n', -1) AS piece")
    model = EndingModel()
    model.formulas = closing_formulas(df, "t", pieces, len(texts))
    assert model.formulas == {SHORT, DOTTED}
    got = {r.k: r.ending for r in truncation.truncation(df, "k", "t", "s").collect()}
    assert got == {k: ending(model, t)[0] for k, t in enumerate(texts)}
    assert got[12] == got[14] == got[15] == "closed" and got[13] == "marked" and got[16] == "open" and got[17] == "lost"
