import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from memlattice.llm.leakage import align, choose_seeds, item_grams, leaked_items, leaked_pairs, longest_passage, passage_in, plain_words


def shared(item, doc, n=5):
    """The n-grams that both have, as (document word, item word)."""
    at = {}
    for k in range(len(item) - n + 1):
        at.setdefault(tuple(item[k : k + n]), []).append(k)
    return [(j, k) for j in range(len(doc) - n + 1) for k in at.get(tuple(doc[j : j + n]), ())]


WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("st", "nt", "rk", "l", "m")]


def test_plain_words():
    assert plain_words("> Ans-\nwer: **every** Cän­of second-hand, it's 2020-04-12") == plain_words("answer every canof secondhand its 20200412")
    assert plain_words("ﬁne ＡＢ — x…y 🙂") == ["fine", "ab", "x", "y"]
    assert plain_words("") == []


def brute_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -2), h[i - 1][j] - 2, h[i][j - 1] - 2)
            best = max(best, h[i][j])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=25))
def test_alignment_is_optimal(a, b):
    if a and b:
        score, path = align(a, b)
        assert score == brute_score(a, b)
        assert sum(2 if s else -2 for _, _, s in path) == score


def test_longest_passage():
    steps = [(i, i, i not in (3, 11, 15)) for i in range(24)]
    assert longest_passage(steps) == 15  # from the first to before the third alteration, 15 - 0
    assert longest_passage([]) == 0


def test_every_qualifying_passage_has_a_seed():
    rng = random.Random(3)
    items = [(n, " ".join(rng.choices(WORDS, k=70))) for n in range(8)]
    grams = item_grams(items)
    seeds = choose_seeds(grams, {g: rng.randrange(50) for g in grams})
    for n, (_, text) in enumerate(items):
        words = text.split()
        for start in range(len(words) - 6):
            assert any(n in seeds.get(" ".join(words[k : k + 5]), ()) for k in range(start, start + 3))


def altered(words, rng, every=8):
    out = list(words)
    for k in range(rng.randrange(every), len(out), every):
        out[k] = "changed"
    return out


def test_operator(spark):
    rng = random.Random(5)
    items = [(n, " ".join(rng.choices(WORDS, k=60)).capitalize() + ".") for n in range(6)] + [(90, None), (91, "too short")]
    word_lists = [plain_words(t or "") for _, t in items]
    noise = lambda: " ".join(rng.choices(WORDS, k=120))
    docs, want = [], set()
    for d in range(60):
        n = d % 6
        if d < 24:  # an altered passage of 30 words
            start = rng.randrange(30)
            docs.append((d, f"{noise()}\n> {' '.join(altered(word_lists[n][start : start + 30], rng)).upper()} {noise()}"))
            want.add((d, n))
        elif d < 40:  # a short quotation
            docs.append((d, f"{noise()} {' '.join(word_lists[n][5:17])} {noise()}"))
        else:
            docs.append((d, noise()))
    docs += [(100, items[0][1]), (100, items[0][1]), (101, None), (102, ""), (None, items[1][1])]
    want |= {(100, 0), (None, 1)}
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, body string, score string")
    it = spark.createDataFrame(items, "item_id long, body string")
    got = leaked_items(df, "doc_id", "body", it, "item_id", "body")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert leaked_pairs(got, "doc_id", "item_id").count() == len(want)
    assert leaked_items(df.limit(0), "doc_id", "body", it, "item_id", "body").collect() == []
    assert leaked_items(df, "doc_id", "body", it.limit(0), "item_id", "body").collect() == []


def test_blocks_of_items(spark, monkeypatch):
    import memlattice.llm.leakage as leakage

    rng = random.Random(6)
    items = [(n, " ".join(rng.choices(WORDS, k=40))) for n in range(4)]
    docs = spark.createDataFrame(items, "doc_id long, body string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 50)
    assert {tuple(r)[:2] for r in leaked_items(docs, "doc_id", "body", docs.toDF("item_id", "body"), "item_id", "body").collect()} == {(n, n) for n in range(4)}


def test_two_short_halves_are_no_passage():
    rng = random.Random(8)
    item = rng.choices(WORDS, k=40)
    doc = item[:12] + ["x1", "x2", "x3"] + item[12:24]
    assert passage_in(item, doc, shared(item, doc)) == (0, 0)
    assert passage_in(item, item[:18], shared(item, item[:18]))[0] == 18


def test_the_longest_passage_of_a_long_document():
    """Half a million words: only the chains around shared n-grams are aligned, and the longest of several passages counts."""
    rng = random.Random(5)
    item = [f"w{i}" for i in range(2000)]
    doc = [rng.choice(["a", "b", "c", "d"]) for _ in range(500_000)]
    doc[1000:1018] = item[40:58]
    doc[300_000:300_900] = [w if i % 9 else "x" for i, w in enumerate(item[500:1400])]
    doc[499_970:500_000] = item[1970:]
    tracemalloc.start()
    length, _ = passage_in(item, doc, shared(item, doc))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert length == 899 and peak < 100_000_000


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), min_size=1, max_size=12))
def test_a_wide_band_is_the_whole_matrix(a, b):
    assert align(a, b)[0] == align(a, b, -len(a) - 3, len(b) + 3)[0]
