import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlattice.llm.packing import combinations, fill_report, greedy, pack, packing_plan, repeat_counts
from memlattice.llm.tokenizer import Counter, default_vocabulary, encoding


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t  -'.1🧑", max_size=200))
def test_token_counts_are_exact(text):
    assert Counter(default_vocabulary())(text) == len(encoding(default_vocabulary()).encode_ordinary(text))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=300))
def test_greedy(lengths):
    n = np.array(lengths)
    boxes = greedy(n, 100)
    sums = np.bincount(boxes, n)
    assert sums.max() <= 100 and len(boxes) == len(n)
    assert len(sums) <= 2 * np.ceil(n.sum() / 100) + 1


def test_combinations_fill_a_window_and_counts_stay_within_the_stock():
    lengths = np.arange(5, 100, 3)
    combos = combinations(lengths, 256)
    assert combos and all(248 <= sum(n * k for n, k in c.items()) <= 256 for c in combos)
    stock = np.full(len(lengths), 40)
    counts = repeat_counts(combos, lengths, stock)
    used = {int(n): 0 for n in lengths}
    for c, x in zip(combos, counts, strict=True):
        for n, k in c.items():
            used[n] += k * int(x)
    assert all(used[int(n)] <= 40 for n in lengths) and sum(used.values()) > 0.8 * stock.sum()


def test_plan_of_nothing():
    plan, n = packing_plan(pd.DataFrame({"n_tokens": [], "n": []}), 64)
    assert len(plan) == 0 and n == 0


def test_pack(spark):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(["word"] * int(k)), "clash") for i, k in enumerate(rng.integers(1, 60, 700))] + [(1000, " ".join(["word"] * 200), ""), (1001, None, ""), (1002, "", ""), (1003, " ".join(["word"] * 64), ""), (1004, "a", ""), (1004, "a", "")]
    df = spark.createDataFrame(texts, "doc_id long, body string, container string")
    packed = pack(df, "doc_id", "body", 64)
    rows = packed.toPandas()
    assert rows.groupby("container").n_tokens.sum().max() <= 64
    assert len(rows) == 700 + 4 + 1 + 2 and set(rows[rows.doc_id == 1000].n_tokens) == {64, 8}
    assert set(rows[rows.n_pieces > 1].doc_id) == {1000}
    assert fill_report(packed, 64).first().fill > 0.95
    assert pack(df.limit(0), "doc_id", "body", 64).count() == 0


def test_one_length_for_all(spark):
    df = spark.range(3000).select("id", F.lit("word word word").alias("body"))
    rows = pack(df, "id", "body", 10).toPandas()
    assert len(rows) == 3000 and rows.groupby("container").n_tokens.sum().max() <= 10 and rows.container.nunique() == 1000
