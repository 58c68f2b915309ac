"""How likely the last words of a text are a whole ending, by how sentences end in all texts of a table.

Only counts that the endings in question ask for are kept: of words, of the
words that follow a context, of word n-grams with their ends, and of the
letters that words end in. Each is counted over all texts, whole. The texts are
tokenised once and written as numbers of words; each count is a scan of these,
whose sums are combined in the tasks. A sieve of bounded size keeps back what
no ending asks for, and joins on the keys drop the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.runtime import materialize, release

#: Words met at least so often, and as so large a share of all tokens (so there are at most 1 / KNOWN_SHARE), stand for themselves, others for their shape.
KNOWN, KNOWN_SHARE = 12, 4e-6
#: Longest word n-gram of the model.
ORDER = 6
#: How much rarer a cut inside the last word is than a whole sentence without a full stop that ends in the same letters.
INSIDE = 0.05
#: Characters whose tokens are counted at once (a longer text by itself), different pieces of text or words after which a task starts its numbering afresh, and bits of a sieve.
GROUP_CHARS, MOST_PIECES, SIEVE_BITS = 2_000_000, 1 << 20, 1 << 26

_TOKEN = re.compile(r"\n|[^\W_]+(?:['’][^\W_]+)*|[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|[^\w\s]|_")
_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*$")
ELLIPSIS = re.compile(r"\s*(?:\.{3,}|…)$")
#: What an ELLIPSIS ends with: what to look for before a pattern runs over a whole text.
DOTS = ("...", "…")
#: The key of an n-gram is the sum of the hashes of its words, each times the power of its distance from the last.
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(ORDER)]


def known_from(tokens: int) -> int:
    """How often a word is met that is known, among so many tokens."""
    return max(KNOWN, math.ceil(KNOWN_SHARE * tokens))


def shape(word: str, known) -> str:
    """A word, or what stands for it: its kind where it is rare."""
    if word.isdigit():
        return "#"
    if word in known or not word[0].isalnum():
        return word
    if any(c.isdigit() for c in word):
        return "a#"
    return "Aa" if word[0].isupper() else "aa"


def last_tokens(text: str) -> list[str]:
    """The last ORDER tokens or more of a text, with the beginning of the text as a line break: as many characters are read as that takes."""
    reach = 128
    while reach < len(text):
        found = _TOKEN.findall(text, len(text) - reach)
        if len(found) > ORDER + 1:
            return found[1:]
        reach *= 4
    return ["\n", *_TOKEN.findall(text)]


class EndingModel:
    """How sentences end: counts of word n-grams with their ends, of word endings, and of common last lines.

    fit() and whole() hold everything in memory and say what whole_endings() finds for a table.
    """

    def __init__(self) -> None:
        self.known: set[str] = set()
        self.grams: list[dict[tuple, list[int]]] = [{} for _ in range(ORDER)]
        self.next_words: dict[tuple, dict[str, int]] = {}
        self.suffixes: dict[str, list[int]] = {}
        self.formulas: set[str] = set()

    @classmethod
    def fit(cls, texts: list[str]) -> EndingModel:
        self = cls()
        tokens = [["\n", *_TOKEN.findall(t), "\n"] for t in texts]
        vocabulary = Counter(w for line in tokens for w in line)
        least = known_from(sum(vocabulary.values()))
        self.known = {w for w, n in vocabulary.items() if n >= least}
        grams: list[dict[tuple, list[int]]] = [defaultdict(lambda: [0, 0]) for _ in range(ORDER)]
        following: dict[tuple, Counter] = defaultdict(Counter)
        for line in tokens:
            row = [shape(w, self.known) for w in line]
            # the end of the text itself is what is in question: its last word teaches nothing
            for k in range(1, len(row) - 2):
                word = row[k]
                if word == "\n" or _END.match(word):
                    continue
                ends = row[k + 1] == "\n" or bool(_END.match(row[k + 1]))
                for n in range(ORDER):
                    if k - n >= 0:
                        count = grams[n][tuple(row[k - n : k + 1])]
                        count[0] += ends
                        count[1] += 1
                        if n and row[k] == word and word[0].isupper():  # a known name is also any name
                            count = grams[n][(*row[k - n : k], "Aa")]
                            count[0] += ends
                            count[1] += 1
                following[(row[k - 1],)][word] += 1
                if k > 1:
                    following[(row[k - 2], row[k - 1])][word] += 1
        self.grams = [{g: c for g, c in table.items() if c[1] >= 3 or not n} for n, table in enumerate(grams)]
        self.next_words = {c: {w: n for w, n in words.items() if n >= 2} for c, words in following.items() if sum(words.values()) >= 3}
        suffixes: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for word in vocabulary:
            if word.isalpha() and len(word) > 3:
                low = word.lower()
                for k in range(2, len(low) + 1):
                    for width in (3, 4, 5):
                        if k >= width:
                            count = suffixes[low[k - width : k]]
                            count[0] += k == len(low)
                            count[1] += 1
        self.suffixes = {s: c for s, c in suffixes.items() if c[1] >= 3}
        return self

    @staticmethod
    def _last_piece(text: str) -> str:
        line = text.rstrip().rpartition("\n")[2]
        body = ELLIPSIS.sub("", line) if line.endswith(DOTS) else line
        cut = max((m.end() for m in re.finditer(r"[.!?…]\s+", body)), default=0)
        return line[cut:]

    def formulaic(self, text: str) -> bool:
        """Whether the text ends with a last line or a trailing phrase that many texts share."""
        piece = self._last_piece(text)
        if piece in self.formulas:
            return True
        return piece.endswith(DOTS) and any(piece.endswith(" " + f) for f in self.formulas if ELLIPSIS.search(f))

    def _ends(self, row: list[str]) -> float:
        for n in range(ORDER - 1, -1, -1):
            count = self.grams[n].get(tuple(row[-n - 1 :])) if len(row) > n else None
            if n and row[-1][0].isupper() and (not count or count[1] < 3):
                count = self.grams[n].get((*row[-n - 1 : -1], "Aa")) if len(row) > n else None
            if count and count[1] >= (3 if n else 1):
                return (count[0] + 0.02) / (count[1] + 0.5)
        return 0.05

    def whole(self, text: str) -> float:
        """Probability that a text ends with a whole sentence, whatever stands after its last word aside."""
        line = last_tokens(text)
        word = line[-1]
        row = [shape(w, self.known) for w in line[-ORDER:]]
        if not word[0].isalnum():
            return self._ends(row)
        if word.isdigit():
            return self._ends(row)
        contexts = [c for c in (self.next_words.get(tuple(row[-3:-1])), self.next_words.get((row[-2],))) if c]
        for choices in contexts:
            longer = sum(n for w, n in choices.items() if w.startswith(word) and len(w) > len(word))
            if longer >= max(3, 3 * choices.get(word, 0)):
                return 0.02
            if longer >= 3 or word in choices:  # else the context is too rare to tell
                break
        if word in self.known:
            return self._ends(row)
        choices = contexts[0] if contexts else {}
        meant = [w for w, n in choices.items() if n >= 3 and abs(len(w) - len(word)) <= 1 and one_slip(word, w)]
        if meant:
            return self._ends([*row[:-1], min(meant, key=lambda w: (-choices[w], w))])
        ratio = 0.02 if len(word) < 4 else 0.1
        for width in (5, 4, 3):
            count = self.suffixes.get(word.lower()[-width:]) if len(word) > width else None
            if count and count[1] >= 8:
                ratio = (count[0] + 0.01) / (count[1] + 0.1)
                break
        return self._ends(row) * ratio / (ratio + INSIDE * (1.0 - ratio))


def one_slip(a: str, b: str) -> bool:
    """Whether two words differ by one letter changed, added, lost or swapped with its neighbour."""
    if a == b:
        return True
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


class _Numbers(dict):
    """Numbers strings from 0 as they are met; new has those not yet seen to."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Lexicon:
    """Numbers the tokens of texts. No token reaches over a space or a line break, so a piece between two is tokenised once, whatever the texts it stands in."""

    def __init__(self, known: frozenset[str] = frozenset()) -> None:
        self.known = known
        self.pieces, self.words, self.shapes, self.contexts = _Numbers(), _Numbers(), _Numbers(), _Numbers()
        self._tokens, self._first, self._many = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Of each word: the number of its shape, whether it ends a sentence, whether its shape is like a name's. Of each shape: its hash.
        self.shape_of, self.ends, self.name = np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, bool)
        self.hashes = np.zeros(0, np.uint64)

    def full(self) -> bool:
        return max(len(self.pieces), len(self.words)) > MOST_PIECES

    def read(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts in a row, each text between two line breaks; how many words of its text stand before each, and how many after it."""
        ids, lengths = self.numbers(texts)
        self._learn()
        return ids, *_places(lengths)

    def numbers(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts in a row, each text between two line breaks, and how many there are of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        found = split.flatten().dictionary_encode()
        line_break = self.pieces["\n"]
        numbers = np.fromiter(map(self.pieces.__getitem__, found.dictionary.to_pylist()), np.int32, len(found.dictionary))
        self._tokenise()
        sizes = np.diff(split.offsets.to_numpy()) + 2
        first = np.cumsum(sizes) - sizes
        inner = np.ones(sizes.sum(), bool)
        inner[first] = inner[first + sizes - 1] = False
        row = np.full(len(inner), line_break, np.int32)
        row[inner] = numbers[found.indices.to_numpy()]
        many = self._many[row]
        ids = self._tokens[np.repeat(self._first[row] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return ids, np.add.reduceat(many, first)

    def reread(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What read() makes of the texts that numbered() has these words, numbers and lengths of."""
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        self._learn()
        return numbers[ids], *_places(lengths)

    def _tokenise(self) -> None:
        found = [_TOKEN.findall(p) for p in self.pieces.new]
        self.pieces.new = []
        many = np.array([len(f) for f in found], np.int64)
        self._first = np.concatenate([self._first, len(self._tokens) + np.cumsum(many) - many])
        self._many = np.concatenate([self._many, many])
        self._tokens = np.concatenate([self._tokens, np.array([self.words[w] for f in found for w in f], np.int32)])

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        stands = [shape(w, self.known) for w in new]
        self.shape_of = np.concatenate([self.shape_of, np.array([self.shapes[s] for s in stands], np.int32)])
        self.ends = np.concatenate([self.ends, np.array([w == "\n" or bool(_END.match(w)) for w in new], bool)])
        self.name = np.concatenate([self.name, np.array([s[0].isupper() for s in stands], bool)])
        self.hashes, self.shapes.new = np.concatenate([self.hashes, _hashes(self.shapes.new)]), []


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of texts with so many words, how many of its text stand before it, and how many after it."""
    lengths = lengths.astype(np.int32)
    place = np.arange(lengths.sum(), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    return place, np.repeat(lengths, lengths) - 1 - place


def _groups(batch: pa.RecordBatch) -> Iterator[pa.Array]:
    texts = batch.column(0)
    begin = chars = 0
    for k, n in enumerate(pc.utf8_length(texts).to_pylist()):
        if k > begin and chars + n > GROUP_CHARS:
            yield texts.slice(begin, k - begin)
            begin, chars = k, 0
        chars += n
    if begin < len(texts):
        yield texts.slice(begin)


def numbered(docs: DataFrame) -> DataFrame:
    """words, n, wide, ids, lengths: the words of groups of texts with spaces between, and in ids the number of each word in a row (of two bytes, or of four if wide) with the words of each text in lengths.

    docs has the texts in its one column; every text counts as between two line
    breaks. Rows without ids have all words of a task, or of as much as a
    lexicon holds, and how often each was met.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met = Lexicon(), np.zeros(0, np.int64)
        for batch in batches:
            for texts in _groups(batch):
                ids, lengths = words.numbers(texts)
                n = np.bincount(ids, minlength=len(words.words))
                here = np.flatnonzero(n)
                place = np.zeros(len(n), np.int32)
                place[here] = np.arange(len(here))
                wide = len(here) > 1 << 16
                yield row(words, here, None, wide, place.astype(np.uint32 if wide else np.uint16)[ids], lengths.astype(np.int32))
                n[: len(met)] += met
                met = n
                if words.full():
                    yield row(words, np.arange(len(met)), met, None, None, None)
                    words, met = Lexicon(), np.zeros(0, np.int64)
        if len(met):
            yield row(words, np.arange(len(met)), met, None, None, None)

    def row(words: Lexicon, which: np.ndarray, n: np.ndarray | None, wide: bool | None, ids: np.ndarray | None, lengths: np.ndarray | None) -> pa.RecordBatch:
        counts = pa.array([n], pa.list_(pa.int64()))
        ids, lengths = (pa.array([None if x is None else x.tobytes()], pa.binary()) for x in (ids, lengths))
        return pa.RecordBatch.from_arrays([pa.array([" ".join(_strings(words.words, which).to_pylist())], pa.string()), counts, pa.array([wide], pa.bool_()), ids, lengths], names=["words", "n", "wide", "ids", "lengths"])

    return docs.mapInArrow(number, "words string, n array<bigint>, wide boolean, ids binary, lengths binary")


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n for numbered texts."""
    return texts.where("ids IS NULL").select(F.inline(F.arrays_zip(F.split("words", " ").alias("word"), "n"))).groupBy("word").agg(F.sum("n").alias("n"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Callable[[Lexicon], tuple[np.ndarray, ...]]]:
    """For each group of texts, plain or numbered, what reads it with a lexicon."""
    for batch in batches:
        if batch.num_columns == 1:
            for texts in _groups(batch):
                yield lambda words, texts=texts: words.read(texts)
            continue
        for words_, wide, ids, lengths in zip(*batch.columns, strict=True):
            numbers = np.frombuffer(ids.as_buffer(), np.uint32 if wide.as_py() else np.uint16)
            yield lambda words, of=words_.as_py().split(" "), ids=numbers, lengths=np.frombuffer(lengths.as_buffer(), np.int32): words.reread(of, ids, lengths)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row for each key of (keys, counts...), the counts added up."""
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(where, np.concatenate(c), len(keys)).astype(np.int64) for c in list(zip(*parts, strict=True))[1:])


def _counted(batches: Iterator[pa.RecordBatch], known: frozenset[str], count: Callable, told: Callable) -> Iterator[pa.RecordBatch]:
    """What told makes of the sums of what count finds in each group of texts: of a whole task, or of as much as a lexicon holds."""
    words, parts = Lexicon(known), []
    for read in _read(batches):
        parts.append(count(words, *read(words)))
        if sum(len(p[0]) for p in parts[1:]) > max(MOST_PIECES, len(parts[0][0])):
            parts = [_summed(parts)]
        if words.full():
            yield told(words, *_summed(parts))
            words, parts = Lexicon(known), []
    if parts:
        yield told(words, *_summed(parts))


def _strings(words: _Numbers, ids: np.ndarray) -> pa.Array:
    return pa.array(list(words), pa.string()).take(pa.array(ids))


class Sieve:
    """A bit for each of up to SIEVE_BITS classes of keys: which classes a table has keys of."""

    def __init__(self, keys: DataFrame, key: str) -> None:
        self.mask = min(SIEVE_BITS, 1 << max(10, (32 * keys.count()).bit_length())) - 1
        place = F.col(key).bitwiseAND(F.lit(self.mask))
        found = keys.select(F.shiftright(place, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast({key} & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.bits = np.zeros((self.mask + 1) // 64, np.uint64)
        self.bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    def lets(self, keys: np.ndarray) -> np.ndarray:
        return (self.bits[((keys & np.uint64(self.mask)) >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)


def _groups_of(texts: DataFrame) -> DataFrame:
    return texts.where("ids IS NOT NULL").select("words", "wide", "ids", "lengths")


def _asked_about(words: Lexicon, ids: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Where words stand that have something to teach; the end of a text is itself in question."""
    return np.flatnonzero((place > 0) & (left > 1) & ~words.ends[ids])


def following_counts(texts: DataFrame, known, sieve) -> DataFrame:
    """ctx, word, n: how often a word, or its shape, follows a context of one or two shapes that the sieve lets through."""

    def count(words: Lexicon, ids: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        at = _asked_about(words, ids, place, left)
        shapes = words.shape_of[ids]
        asked = sieve.value.lets(words.hashes)
        ones = np.zeros(len(words.hashes), np.int64)
        ones[asked] = [words.contexts[h] for h in words.hashes[asked].tolist()]
        one = at[asked[shapes[at - 1]]]
        two = at[place[at] > 1]
        pairs = words.hashes[shapes[two - 1]] + np.uint64(_POWERS[1]) * words.hashes[shapes[two - 2]]
        let = sieve.value.lets(pairs)
        two = two[let]
        different, where = np.unique(pairs[let], return_inverse=True)
        twos = np.array([words.contexts[h] for h in different.tolist()], np.int64)[where]
        words.contexts.new.clear()
        keys, n = np.unique(np.concatenate([ones[shapes[one - 1]] << 32 | shapes[one], twos << 32 | shapes[two]]), return_counts=True)
        return keys, n

    def told(words: Lexicon, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        contexts = np.array(list(words.contexts), np.uint64)[keys >> 32].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(contexts), _strings(words.shapes, keys & 0xFFFFFFFF), pa.array(n)], names=["ctx", "word", "n"])

    return _groups_of(texts).mapInArrow(lambda b: _counted(b, known.value, count, told), "ctx bigint, word string, n bigint").groupBy("ctx", "word").agg(F.sum("n").alias("n"))


def ending_counts(texts: DataFrame, known, sieve) -> DataFrame:
    """key, ends, n: how often an n-gram of shapes that the sieve lets through stands in the texts, and at the end of a sentence. What is like a name counts as any name besides."""

    def count(words: Lexicon, ids: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        at = _asked_about(words, ids, place, left)
        hashes = words.hashes[words.shape_of[ids]]
        last = words.ends[ids[at + 1]]
        any_name = np.uint64(_hashes(["Aa"])[0])
        # one word: by its number
        n, ends = np.bincount(ids[at], minlength=len(words.words)), np.bincount(ids[at[last]], minlength=len(words.words))
        own = words.hashes[words.shape_of]
        seen = np.flatnonzero((n > 0) & sieve.value.lets(own))
        longer, ending = [], []
        # more words: what the sieve lets through is asked for with all words but the first, too
        asked = np.flatnonzero(sieve.value.lets(own)[ids[at]])
        named = np.flatnonzero(words.name[ids[at]])
        for rows, keys in ((asked, hashes[at[asked]]), (named, np.full(len(named), any_name))):
            for k in range(1, ORDER):
                keep = place[at[rows]] >= k
                rows, keys = rows[keep], keys[keep]
                keys = keys + np.uint64(_POWERS[k]) * hashes[at[rows] - k]
                let = sieve.value.lets(keys)
                rows, keys = rows[let], keys[let]
                longer.append(keys)
                ending.append(keys[last[rows]])
        keys, many = np.unique(np.concatenate(longer), return_counts=True)
        closed, of_those = np.unique(np.concatenate(ending), return_counts=True)
        whole = np.zeros(len(keys), np.int64)
        whole[np.searchsorted(keys, closed)] = of_those
        return _summed([(own[seen], ends[seen], n[seen]), (keys, whole, many)])

    def told(words: Lexicon, keys: np.ndarray, ends: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ends), pa.array(n)], names=["key", "ends", "n"])

    return _groups_of(texts).mapInArrow(lambda b: _counted(b, known.value, count, told), "key bigint, ends bigint, n bigint").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))


def _suffix_counts(words: DataFrame) -> DataFrame:
    """suffix, whole, n: how many places in different words have these three to five letters, and how many of them are the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, n = Counter(), Counter()
            for word in batch.column(0).to_pylist():
                if word.isalpha() and len(word) > 3:
                    low = word.lower()
                    for width in (3, 4, 5):
                        n.update(low[k - width : k] for k in range(width, len(low) + 1))
                        if len(low) >= width:
                            ends[low[-width:]] += 1
            yield pa.RecordBatch.from_pydict({"suffix": list(n), "whole": [ends[s] for s in n], "n": list(n.values())}, schema=pa.schema([("suffix", pa.string()), ("whole", pa.int64()), ("n", pa.int64())]))

    return words.select("word").mapInArrow(count, "suffix string, whole bigint, n bigint").groupBy("suffix").agg(F.sum("whole").alias("whole"), F.sum("n").alias("n"))


def _keys(rows: list[list[str]]) -> list[int]:
    """Of each row of shapes, the key."""
    numbers = _Numbers()
    ids = [[numbers[w] for w in row] for row in rows]
    hashes = _hashes(list(numbers)).tolist()
    keys = [sum(hashes[i] * _POWERS[k] for k, i in enumerate(reversed(row))) & (1 << 64) - 1 for row in ids]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _slips(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """ctx, asked, word, n: of the words of others (ctx, word, n), those that differ from an asked one (ctx, asked) of the same context by one slip at most.

    Two such words are the same after one letter at most is left out of each.
    """

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [{w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for w in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(forms)), [len(f) for f in forms]))
            yield pa.RecordBatch.from_arrays([*batch.take(rows).columns, pa.array([x for f in forms for x in f], pa.string())], names=[*batch.schema.names, "form"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([abs(len(a) - len(w)) <= 1 and one_slip(a, w) for a, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))

    here = pairs.mapInArrow(shorter, "ctx bigint, asked string, form string")
    there = others.join(pairs.select("ctx").distinct(), "ctx", "left_semi").select("ctx", "word", "n").mapInArrow(shorter, "ctx bigint, word string, n bigint, form string")
    return here.join(there, ["ctx", "form"]).select("ctx", "asked", "word", "n").distinct().mapInArrow(close, "ctx bigint, asked string, word string, n bigint")


def whole_endings(docs: DataFrame, tails: DataFrame) -> DataFrame:
    """tail, p: for the different last words of texts (tail: up to ORDER tokens with spaces between), the probability that they are a whole ending.

    docs has the texts in its one column. p is what EndingModel.fit() on all of
    them would say. The driver gets the known words (at most 1 / KNOWN_SHARE)
    and a sieve.
    """
    spark = docs.sparkSession
    texts = materialize(numbered(docs), "numbered")
    words = materialize(word_counts(texts), "words")
    least = known_from(words.agg(F.sum("n")).first()[0] or 0)
    known = spark.sparkContext.broadcast(frozenset(r["word"] for r in words.where(F.col("n") >= least).select("word").collect()))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [t.split(" ") for t in batch.column(0).to_pylist()]
            rows = [[shape(w, known.value) for w in line] for line in lines]
            open_ = [line[-1][0].isalnum() and not line[-1].isdigit() for line in lines]
            keys = (iter(_keys([c for row, o in zip(rows, open_, strict=True) if o for c in (row[-3:-1], row[-2:-1])])))
            found = [(line[-1], line[-1] in known.value, next(keys), next(keys)) if o else (None,) * 4 for line, o in zip(lines, open_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(zip(*found, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True))], names=["tail", "asked", "known", "two", "one"])

    asked = materialize(tails.mapInArrow(contexts, "tail string, asked string, known boolean, two bigint, one bigint"), "asked")
    wanted = asked.select(F.explode(F.array("two", "one")).alias("ctx")).where("ctx IS NOT NULL").distinct()
    followed = materialize(following_counts(texts, known, spark.sparkContext.broadcast(Sieve(wanted, "ctx"))), "following")
    there = followed.groupBy("ctx").agg(F.sum("n").alias("all"), F.max("n").alias("most")).where("all >= 3 AND most >= 2").select("ctx")
    chosen = asked.join(there.select(F.col("ctx").alias("two"), F.col("ctx").alias("_two")), "two", "left").join(there.select(F.col("ctx").alias("one"), F.col("ctx").alias("_one")), "one", "left")
    chosen = materialize(chosen.select("tail", "asked", "known", F.coalesce("_two", "_one").alias("ctx"), F.expr("IF(_two IS NULL, NULL, _one)").alias("wider")), "chosen")
    pairs = chosen.select(F.explode(F.array("ctx", "wider")).alias("ctx"), "asked").where("ctx IS NOT NULL").distinct()
    often = followed.where("n >= 2").join(pairs.select("ctx").distinct(), "ctx", "left_semi")
    # of each word only beginnings that are as long as an asked one of the same context and first letter
    first = F.substring("asked", 1, 1).alias("first")
    reach = pairs.select("ctx", first, F.length("asked").alias("long")).groupBy("ctx", "first").agg(F.collect_set("long").alias("long"))
    begins = often.where(F.length("word") > 1).withColumn("first", F.substring("word", 1, 1)).join(reach, ["ctx", "first"])
    begun = begins.select("ctx", F.explode(F.expr("transform(filter(long, k -> k < length(word)), k -> substring(word, 1, k))")).alias("asked"), "n").groupBy("ctx", "asked").agg(F.sum("n").alias("longer"))
    meant = _slips(chosen.where("NOT known AND ctx IS NOT NULL").select("ctx", "asked").distinct(), often.where("n >= 3")).groupBy("ctx", "asked").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("meant"))
    own = often.select("ctx", F.col("word").alias("asked"), F.col("n").alias("own"))
    choices = materialize(pairs.join(begun, ["ctx", "asked"], "left").join(own, ["ctx", "asked"], "left").join(meant, ["ctx", "asked"], "left").select("ctx", "asked", F.coalesce("longer", F.lit(0)).alias("longer"), F.coalesce("own", F.lit(0)).alias("own"), "meant"), "choices")

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed, rows, counts, suffixes, ratios = [], [], [], [], []
            for tail, word, is_known, begins, meant in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = [shape(w, known.value) for w in tail.split(" ")]
                fixed.append(0.02 if begins else None)
                if word and not is_known and meant:
                    row[-1] = meant
                before = len(rows)
                for n in range(min(len(row), ORDER) - 1, -1, -1):
                    rows.append(row[-n - 1 :])
                    if n and row[-1][0].isupper():
                        rows.append([*row[-n - 1 : -1], "Aa"])
                counts.append(len(rows) - before)
                lettered = bool(word) and not is_known and not meant
                suffixes.append([word.lower()[-width:] for width in (5, 4, 3) if len(word) > width] if lettered else [])
                ratios.append((0.02 if len(word) < 4 else 0.1) if lettered else None)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(_keys(rows), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fixed, pa.float64()), keys, pa.array(suffixes, pa.list_(pa.string())), pa.array(ratios, pa.float64())], names=["tail", "fixed", "keys", "suffixes", "ratio"])

    begins = F.expr("longer >= greatest(3, 3 * own) OR longer < 3 AND own = 0 AND longer_wider >= greatest(3, 3 * own_wider)")
    wider = choices.select(F.col("ctx").alias("wider"), "asked", F.col("longer").alias("longer_wider"), F.col("own").alias("own_wider"))
    plan = chosen.join(choices, ["ctx", "asked"], "left").join(wider, ["wider", "asked"], "left").select("tail", "asked", "known", F.coalesce(begins, F.lit(False)).alias("begins"), "meant")
    plan = materialize(plan.mapInArrow(questions, "tail string, fixed double, keys array<bigint>, suffixes array<string>, ratio double"), "questions")
    keys = plan.where("fixed IS NULL").select("tail", F.posexplode("keys").alias("place", "key"), (F.size("keys") - 1).alias("last"))
    counts = materialize(ending_counts(texts, known, spark.sparkContext.broadcast(Sieve(keys.select("key").distinct(), "key"))), "grams")
    # the longest n-gram that was met three times, or else the last word however often it was met
    told = keys.join(counts, "key").where("n >= IF(place = last, 1, 3)").groupBy("tail").agg(F.min_by(F.struct("ends", "n"), "place").alias("met"))
    letters = plan.where("fixed IS NULL").select("tail", F.posexplode("suffixes").alias("place", "suffix")).join(_suffix_counts(words).where("n >= 8"), "suffix")
    letters = letters.groupBy("tail").agg(F.min_by((F.col("whole") + 0.01) / (F.col("n") + 0.1), "place").alias("by_letters"))
    ends = F.coalesce((F.col("met.ends") + 0.02) / (F.col("met.n") + 0.5), F.lit(0.05))
    ratio = F.coalesce("by_letters", "ratio")
    found = plan.join(told, "tail", "left").join(letters, "tail", "left")
    found = materialize(found.select("tail", F.coalesce("fixed", F.when(F.col("ratio").isNull(), ends).otherwise(ends * ratio / (ratio + INSIDE * (1.0 - ratio)))).alias("p")), "p_whole")
    for done in (texts, words, asked, followed, chosen, choices, plan, counts):
        release(done)
    return found
