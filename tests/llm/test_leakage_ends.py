import random

import pytest

from memlattice.llm.leakage import passage_in


def shared(item, doc):
    return [(j, k) for j in range(len(doc) - 4) for k in range(len(item) - 4) if doc[j : j + 5] == item[k : k + 5]]

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("st", "nt", "rk", "l", "m")]
ITEM = random.Random(9).sample(WORDS, 40)


def found(words):
    doc = ["x"] * 5 + words + ["y"] * 5
    return passage_in(ITEM, doc, shared(ITEM, doc))[0]


@pytest.mark.parametrize("n", [18, 19])
@pytest.mark.parametrize("last", [False, True])
def test_an_altered_word_next_to_the_end(n, last):
    words = ITEM[10 : 10 + n]
    at = n - 2 if last else 1
    assert found(words[:at] + ["changed"] + words[at + 1 :]) == n
    assert found(words[:at] + words[at + 1 :]) == n
    at += last
    assert found(words[:at] + ["changed"] + words[at:]) == n


def test_no_more_than_the_rule_allows():
    words = ITEM[10:29]
    assert found(words[:17]) == 0
    assert found([words[0], "changed", *words[2:7], "changed", *words[8:]]) == 0
    assert found([words[0], "changed", "changed", *words[3:18]]) == 0
