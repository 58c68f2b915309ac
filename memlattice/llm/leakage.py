"""Evaluation texts that leaked into a corpus.

Both sides are reduced to plain words, so that case, markup, quoting, line
breaks and hyphenation make no difference. One scan over the corpus looks for
all n-grams of the test items at once. How many documents hold each n-gram is
then known, and the rarest of every few neighbouring ones become the seeds that
join documents to items. A Smith-Waterman alignment over words scores each
joined pair, and the pair counts if the alignment has a passage that is long and
close enough.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.runtime import materialize

#: Words of an n-gram.
GRAM = 5
#: A passage has at least so many running words of the item, and in any ALTERED_SPAN words at most one is altered.
PASSAGE, ALTERED_SPAN = 18, 8
#: Such a passage has ALTERED_SPAN - 1 unaltered words in a row, hence so many whole n-grams in a row, of which one is a seed ...
WHOLE_RUN = ALTERED_SPAN - 1
GRAMS_IN_RUN = WHOLE_RUN - GRAM + 1
#: ... and no fewer whole n-grams of the item in all (reached by three runs of 3, 7 and 6 words or 4, 7 and 5).
LEAST_GRAMS = 4
#: Whole n-grams of such a passage follow each other within so many words, on diagonals so close; beyond its outermost ones it has no more words than REACH.
REACH, DRIFT = 2 * ALTERED_SPAN, 4
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -2, -2
#: Items are taken in blocks of at most so many words, each with a scan of its own; the n-grams of one block are what is sent to the executors.
BLOCK_WORDS = 500_000

_BROKEN = re.compile(r"(?<=\w)[-\u00ad\u2010\u2011][ \t]*\r?\n[ \t]*(?:[>|][ \t]*)*(?=\w)")


class _PlainTable(dict):
    """Letters without accents in lower case, hyphens and invisible marks gone, everything else a space."""

    def __missing__(self, point: int) -> str | None:
        char = chr(point)
        kept = "".join(c for c in unicodedata.normalize("NFKD", char) if c.isalnum()).lower()
        gone = unicodedata.category(char) in ("Cf", "Mn", "Me") or char in "-‐‑'’"
        self[point] = kept or (None if gone else " ")
        return self[point]


_PLAIN = _PlainTable()
#: The same for texts of one byte a character; those with a character that becomes several go the longer way.
_BYTES = bytes(ord(m) if (m := _PLAIN[c] or " ") and len(m) == 1 and ord(m) < 256 else 32 for c in range(256))
_GONE = bytes(c for c in range(256) if _PLAIN[c] is None)
_SEVERAL = re.compile("[" + "".join(chr(c) for c in range(128, 256) if len(_PLAIN[c] or " ") > 1 or ord(_PLAIN[c] or " ") > 255) + "]")
_MAY_BREAK = ("-\n", "-\r", "- \n", "-\t", "\xad\n", "\xad\r")


def plain_words(text: str) -> list[str]:
    """The words of a text without differences of mere form."""
    try:
        raw = text.encode("latin-1")
        if not text.isascii() and _SEVERAL.search(text):
            raw = None
    except UnicodeEncodeError:
        raw = None
    if raw is None:
        return _BROKEN.sub("", unicodedata.normalize("NFC", text)).translate(_PLAIN).split()
    if any(map(text.__contains__, _MAY_BREAK)):
        raw = _BROKEN.sub("", text).encode("latin-1")
    return raw.translate(_BYTES, _GONE).decode("latin-1").split()


def item_grams(items: list[tuple[object, str]]) -> dict[str, list[tuple[int, int]]]:
    """n-gram -> (index of the item, position in it)."""
    grams: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, text) in enumerate(items):
        words = plain_words(text)
        for k in range(len(words) - GRAM + 1):
            grams[" ".join(words[k : k + GRAM])].append((i, k))
    return dict(grams)


def choose_seeds(grams: dict[str, list[tuple[int, int]]], frequency: dict[str, int]) -> dict[str, list[int]]:
    """The rarest n-gram of every GRAMS_IN_RUN neighbouring ones of each item -> the items it seeds.

    A passage that counts holds a run of WHOLE_RUN unaltered words, hence at
    least one seed, however common its n-grams are.
    """
    order: dict[int, dict[int, str]] = defaultdict(dict)
    for gram, places in grams.items():
        for item, at in places:
            order[item][at] = gram
    seeds: dict[str, set[int]] = defaultdict(set)
    for item, by_place in order.items():
        row = [by_place[k] for k in sorted(by_place)]
        for k in range(max(1, len(row) - GRAMS_IN_RUN + 1)):
            rarest = min(row[k : k + GRAMS_IN_RUN], key=lambda g: (frequency.get(g, 0), g))
            seeds[rarest].add(item)
    return {g: sorted(s) for g, s in seeds.items()}


@lru_cache(maxsize=2)
def _automaton(grams: tuple[str, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for n, gram in enumerate(grams):
        machine.add_word(f" {gram} ", n)
    machine.make_automaton()
    return machine


def align(item: list[str], doc: list[str], low: int | None = None, high: int | None = None) -> tuple[int, list[tuple[int, int, bool]]]:
    """Score and path of the best local alignment on the diagonals (place in doc less place in item) from low to high, all if not given.

    The path's steps are (item word or -1, document word or -1, match). Only the
    band is kept, a row at a time: the gap along the row is a running maximum.
    """
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in item])
    b = np.array([ids.setdefault(w, len(ids)) for w in doc])
    m, n = len(a), len(b)
    low, high = -m if low is None else low, n if high is None else high
    width = high - low + 1
    h = np.zeros((m + 1, width + 1), dtype=np.int32)  # one more diagonal, always 0
    slope = np.arange(width, dtype=np.int32) * -GAP
    for i in range(1, m + 1):
        first = i - 1 + low  # the document word of the band's first diagonal
        begin, end = max(0, -first), min(width, n - first)
        if begin >= end:
            continue
        best = np.zeros(width, dtype=np.int32)
        score = np.where(b[first + begin : first + end] == a[i - 1], MATCH, MISMATCH)
        np.maximum(h[i - 1, begin:end] + score, h[i - 1, begin + 1 : end + 1] + GAP, out=best[begin:end])
        np.maximum(best, 0, out=best)
        row = np.maximum.accumulate(best + slope) - slope
        h[i, begin:end] = row[begin:end]
    i, c = np.unravel_index(int(np.argmax(h)), h.shape)
    score, path = int(h[i, c]), []
    while i > 0 and h[i, c] > 0:
        j = i - 1 + low + c
        same = bool(a[i - 1] == b[j])
        if h[i, c] == h[i - 1, c] + (MATCH if same else MISMATCH):
            path.append((int(i - 1), int(j), same))
            i -= 1
        elif h[i, c] == h[i - 1, c + 1] + GAP:
            path.append((int(i - 1), -1, False))
            i, c = i - 1, c + 1
        else:
            path.append((-1, int(j), False))
            c -= 1
    return score, path[::-1]


def longest_passage(path: list[tuple[int, int, bool]]) -> int:
    """Item words of the longest part of an alignment in which any ALTERED_SPAN steps hold at most one that is no match."""
    best, begin, words, altered = 0, 0, 0, []
    for k, (i, _, same) in enumerate(path):
        if not same:
            if altered and k - altered[-1] < ALTERED_SPAN:
                begin = altered[-1] + 1
                words = sum(p[0] >= 0 for p in path[begin:k])
            altered.append(k)
        words += i >= 0
        best = max(best, words)
    return best


def _onward(item: list[str], doc: list[str], i: int, j: int, since: int, side: int) -> list[tuple[int, int, bool]]:
    """Steps from item word i and document word j to one side, `since` matches after the last altered word; they end on a match."""
    steps = []
    while 0 <= i < len(item) and 0 <= j < len(doc) and item[i] == doc[j]:
        steps.append((i, j, True))
        i, j, since = i + side, j + side, since + 1
    best: list[tuple[int, int, bool]] = []
    if since >= ALTERED_SPAN - 1:
        for a, b in ((1, 1), (0, 1), (1, 0)):  # a word replaced, added, lost
            rest = _onward(item, doc, i + side * a, j + side * b, 0, side)
            if rest and len(rest) + a > sum(p[0] >= 0 for p in best):
                best = [(i if a else -1, j if b else -1, False), *rest]
    return steps + best


def extended(path: list[tuple[int, int, bool]], item: list[str], doc: list[str]) -> list[tuple[int, int, bool]]:
    """An alignment carried on to both sides while any ALTERED_SPAN steps hold at most one that is no match, ending on a match.

    A match beyond an altered word adds nothing to the score, so the best alignment may end before both.
    """
    if not path:
        return path
    lead = next((n for n, p in enumerate(path) if not p[2]), ALTERED_SPAN)
    before = _onward(item, doc, path[0][0] - 1, path[0][1] - 1, lead, -1)
    path = before[::-1] + path
    trail = next((n for n, p in enumerate(reversed(path)) if not p[2]), ALTERED_SPAN)
    return path + _onward(item, doc, path[-1][0] + 1, path[-1][1] + 1, trail, 1)


def chains(places: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Item words from and to, document words from and to, diagonals from and to, of the chains that n-grams at (document word, item word) form.

    An n-gram goes on with a chain that ended no more than REACH words before, on
    a diagonal that differs by no more than DRIFT. Chains with fewer n-grams than
    a passage has are left out.
    """
    open_, done = [], []
    for at, k in sorted(places):
        done += [c for c in open_ if at - c[3] > REACH]
        open_ = [c for c in open_ if at - c[3] <= REACH]
        near = min((c for c in open_ if abs(at - k - c[6]) <= DRIFT), key=lambda c: abs(at - k - c[6]), default=None)
        if near is None:
            open_.append([k, k, at, at, at - k, at - k, at - k, 1])
        else:
            near[0], near[1], near[3] = min(near[0], k), max(near[1], k), at
            near[4], near[5], near[6], near[7] = min(near[4], at - k), max(near[5], at - k), at - k, near[7] + 1
    return [tuple(c[:6]) for c in done + open_ if c[7] >= LEAST_GRAMS]


def passage_in(item: list[str], doc: list[str], places: list[tuple[int, int]]) -> tuple[int, int]:
    """Item words of the longest passage of the item in the document, and the score of its alignment; 0, 0 if it is too short.

    places are the n-grams they share, as (document word, item word). Each chain
    of them is aligned in the band around its diagonals, so what is kept grows
    with its length, not with that of the document.
    """
    found = (0, 0)
    for k0, k1, at0, at1, low, high in chains(places):
        i, j = max(0, k0 - REACH), max(0, at0 - REACH)
        part, window = item[i : k1 + GRAM + REACH], doc[j : at1 + GRAM + REACH]
        while True:
            score, path = align(part, window, low - j + i - DRIFT, high - j + i + DRIFT)
            # the fewest matches and most alterations that a passage can have
            if score < MATCH * (PASSAGE - 3) + 3 * MISMATCH:
                break
            found = max(found, (longest_passage(extended(path, part, window)), score))
            for _, at, _ in path:  # look for another passage beside this one
                if at >= 0:
                    window[at] = "\0"
    return found if found[0] >= PASSAGE else (0, 0)


def _scan(docs: DataFrame, key: str, text: str, grams: tuple[str, ...]) -> DataFrame:
    """key, grams, places, words of the documents that hold any n-gram of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared.value)
        for batch in batches:
            keys, found, where, words = [], [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                line = f" {' '.join(plain_words(value))} "
                hits = list(machine.iter(line))
                if hits:
                    starts = [i for i, c in enumerate(line) if c == " "]
                    keys.append(k)
                    found.append([n for _, n in hits])
                    where.append([bisect_right(starts, end) - GRAM - 1 for end, _ in hits])
                    words.append(line[1:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.list_(pa.int32())), pa.array(where, pa.list_(pa.int32())), pa.array(words, pa.string())], names=["key", "grams", "places", "words"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"key {kind}, grams array<int>, places array<int>, words string")


def _block(docs: DataFrame, key: str, text: str, items: list[tuple[object, str]], item_type: str, item_key: str) -> DataFrame:
    by_gram = item_grams(items)
    grams = tuple(by_gram)
    hits = materialize(_scan(docs, key, text, grams), "leak-hits")
    frequency = hits.select(F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()  # one row per n-gram of the block
    seeds = choose_seeds(by_gram, {grams[r["g"]]: r["n"] for r in frequency})
    shared = docs.sparkSession.sparkContext.broadcast(([i for i, _ in items], [plain_words(t) for _, t in items], [(by_gram[g], seeds.get(g, ())) for g in grams]))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, info = shared.value
        for batch in batches:
            out = []
            for row, (found, where, line) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                places, seeded = defaultdict(list), set()
                for g, at in zip(found, where, strict=True):
                    of_items, of_seeds = info[g]
                    seeded.update(of_seeds)
                    for item, k in of_items:
                        places[item].append((at, k))
                joined = [i for i in seeded if len(places[i]) >= LEAST_GRAMS]
                if joined:
                    words = line.split(" ")
                    for i in joined:
                        length, score = passage_in(texts[i], words, places[i])
                        if length:
                            out.append((row, names[i], length, score))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], to_arrow), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int32())],
                names=[key, item_key, "passage_words", "score"],
            )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    to_arrow = to_arrow_type(_parse_datatype_string(item_type))
    kind = docs.schema[key].dataType.simpleString()
    return hits.mapInArrow(pairs, f"{key} {kind}, {item_key} {item_type}, passage_words int, score int")


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """key, item_key, passage_words, score: the documents that hold a passage of a test item, and which.

    A passage has at least PASSAGE running words of the item with at most one
    altered (replaced, added or lost) in any ALTERED_SPAN. Every document and
    every item is compared in full, however common its words are. Null and
    empty texts and items shorter than a passage leak nothing; repeated keys
    are compared row by row; further columns are ignored. Items are the stated
    query set: they are read to the driver block by block, BLOCK_WORDS words
    each, with one scan of the corpus for each block.
    """
    item_type = items.schema[item_key].dataType.simpleString()
    named = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("k"), F.col(item_text).alias("t"))
    result, block, size = None, [], 0

    def add(block: list[tuple[object, str]]) -> None:
        nonlocal result
        part = _block(docs, key, text, block, item_type, item_key)
        result = part if result is None else result.unionByName(part)

    for row in named.toLocalIterator():
        words = len(plain_words(row["t"]))
        if words < PASSAGE:
            continue
        if block and size + words > BLOCK_WORDS:
            add(block)
            block, size = [], 0
        block.append((row["k"], row["t"]))
        size += words
    if block:
        add(block)
    if result is None:
        kind = docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{key} {kind}, {item_key} {item_type}, passage_words int, score int")
    return result


def leaked_pairs(found: DataFrame, key: str, item_key: str) -> DataFrame:
    """Each pair of document and item once, with its longest passage."""
    return found.groupBy(key, item_key).agg(F.max("passage_words").alias("passage_words"), F.max("score").alias("score"))
