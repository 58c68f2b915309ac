import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlattice.llm.splitting import join_pieces, pieces, split_oversized


def check(text, limit, overlap):
    parts = pieces(text, limit, overlap)
    assert join_pieces(parts) == text
    assert all(len(p[2].encode()) <= limit for p in parts)
    for a, b in zip(parts, parts[1:], strict=False):
        assert a[2][-overlap:] == b[2][:overlap] if overlap else True
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é🧑‍🚀\n.,;!", max_size=900), st.integers(120, 400), st.integers(0, 20))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


@pytest.mark.parametrize("text", ["a" * 5000, "é" * 4000, "🧑‍🚀" * 900, "x " * 3000, "a" + "́" * 4000, "\n" * 5000, "word. " * 1000])
def test_awkward_texts(text):
    assert len(check(text, 1000, 50)) > 1


def test_natural_cuts():
    text = "\n\n".join("One sentence follows another here. " * 8 for _ in range(9))
    for _, start, _ in check(text, 1000, 20)[1:]:
        assert text[start - 1] == "\n"


def brute(text, limit, overlap):
    """The fewest pieces of any cut."""
    count, at = 1, 0
    while len(text[max(0, at - overlap) if at else 0 :].encode()) > limit:
        end = at
        while len(text[max(0, at - overlap) if at else 0 : end + 1].encode()) <= limit:
            end += 1
        at, count = end, count + 1
    return count


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n.", min_size=300, max_size=900))
def test_no_needless_pieces(text):
    assert len(pieces(text, 200, 10)) <= brute(text, 200, 10) + 2


def test_no_room():
    with pytest.raises(ValueError):
        pieces("a" * 500, 100, 50)


def test_table(spark):
    rows = [("a", "x. " * 200, 1), ("a", "x. " * 200, 2), ("b", "short", 1), ("c", None, 1), ("d", "", 1), (None, "y " * 400, 1)]
    df = spark.createDataFrame(rows, "k string, body string, piece int")
    got = split_oversized(df, "k", "body", 200, 10, "piece")
    assert {r.k for r in got.collect()} == {"a", None} and got.columns == ["k", "piece_idx", "n_pieces", "start_pos", "new_from", "n_bytes", "piece"]
    a = got.where("k = 'a'").orderBy("piece_idx").collect()
    assert "".join(r.piece[r.new_from :] for r in a) == "x. " * 200 and [r.piece_idx for r in a] == list(range(a[0].n_pieces))
    assert split_oversized(df.limit(0), "k", "body", 200, 10).collect() == []
