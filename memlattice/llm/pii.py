"""Personal data in free text: found behind disguises, replaced by typed placeholders.

A text passes transducers that undo disguises (look-alike and accented letters,
invisible marks, digits spelled as words, "at" and "dot" in words or brackets),
each keeping for every character the place it came from. Detectors run on the
plain form, and what they find is mapped back to the source.

Names are found by their shape: a title or an initial before a surname, a known
short or full given name before one, or two or three capitalised words none of
which a public vocabulary has as an everyday word.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm.names import EVERYDAY, FORMAL, NOT_SURNAMES, TITLES
from memlattice.llm.tokenizer import default_vocabulary

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХасеіјорѕухԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικ",
        "ABESIJKMHOPCTYXaceijopsyxdhlABEZHIKMNOPTYXovik",
        strict=True,
    )
)
# Digits as words, in English, German, Spanish and French.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "funf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}

TYPES = ("email", "id_number", "phone", "address", "name")


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for point in (*range(0x80, 0x3000), *range(0xFF00, 0xFFF0)):
        char = chr(point)
        if char in LOOK_ALIKES or char == "ß":
            continue
        base = unicodedata.normalize("NFKD", char)
        kept = "".join(c for c in base if not unicodedata.combining(c))
        if len(kept) == 1 and kept != char and (kept.isascii() or kept.isspace()):
            table[point] = kept
        elif unicodedata.category(char) == "Pd":
            table[point] = "-"
        elif unicodedata.category(char) == "Zs":
            table[point] = " "
        elif char.isdigit() and len(kept) == 1:
            table[point] = str(unicodedata.digit(char))
    table[ord("’")] = table[ord("‘")] = "'"
    return table


_FOLD = _fold_table()
_INVISIBLE = re.compile("[­̀-ͯ͏؜​-‏‪-‮⁠-⁤︀-️﻿]+")
_SPELLED_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:(?:double |triple )?(?:{_SPELLED_WORD})\b[\s,.\-]*){{6,}}(?<=[a-z])", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?:(double|triple) )?({_SPELLED_WORD})|([\s,.\-]+)", re.IGNORECASE)
_DOT = r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)| dot|\.) ?"
_DOMAIN = rf"[A-Za-z0-9-]+(?:(?:{_DOT})[A-Za-z0-9-]+)*(?:(?:{_DOT})(?:[A-Za-z]{{2,24}}))(?![\w-])"
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|<at>|@) ?| at (?=[\w-]+(?: dot | ?[\[(]dot))", re.IGNORECASE)
_LOCAL = re.compile(r"[A-Za-z0-9][\w.+%-]*$")
_NO_LOCAL = re.compile(r"[^\w.+%-]")
_HOST = re.compile(_DOMAIN, re.IGNORECASE)
_DOT_MARK = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>) ?| dot | ?\. ?", re.IGNORECASE)

EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-])")
URL = re.compile(r"https?://\S+")
PHONE = re.compile(
    r"""(?<![\w@\#/.,-])(?:
      \+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\(?\d{1,5}\)?){2,6}
    | \(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}
    | \d{3}[.-]\d{3}[.-]\d{4}
    | [2-9]\d{2}\ \d{3}\ \d{4}
    | 0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}
    | 0\d{4}\ \d{6}
    | 0\d-\d{4}-\d{4}
    | 0[1-9]\d{8,9}
    | 0[1-9](?:[ .]\d{2}){4}
    )(?![\w/]|[.-]\d)""",
    re.VERBOSE,
)
SPELLED_PHONE = re.compile(r"\d{3}-?\d{4}|\d{7,15}|[\d-]{8,20}")
ID_NUMBER = re.compile(
    r"""(?<![\w/.@\#-])(?:
      \d{3}-\d{2}-\d{4} | \d{3}\ \d{2}\ \d{4}
    | [A-Z]{2}\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D]
    | [XYZ]-?\d{7}-?[A-Z] | \d{8}-?[A-HJ-NP-TV-Z] | [A-Z]\d{7,8}
    | \d{2}/\d{3}/\d{5}
    | \d{2}\ \d{3}\ \d{3}\ \d{3}
    )(?![\w/]|[.-]\d)""",
    re.VERBOSE | re.IGNORECASE,
)
LABELLED_ID = re.compile(r"\b(?:passport|licen[cs]e|permit|ssn|tax id|insurance)(?: (?:no\.?|number|card))?(?: is| says)?[: ]+(?=[A-Z0-9-]*\d{4})([A-Z0-9][A-Z0-9-]{5,14})\b", re.IGNORECASE)
_STREET = r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|crescent|cres|row|court|ct|place|pl|boulevard|blvd|way|terrace|square|sq|gardens|grove|hill|mews|parade|highway|hwy"


def _set(words: str) -> frozenset[bytes]:
    return frozenset(w.encode("latin-1") for w in words.split())


_STREET_START = r"(?<![\w.,:/$€£#-])\d{1,5}[A-Za-z]?"
#: What a text must have (one of some words, or a string) for a pattern of addresses to be tried, and the pattern; its group is the name of the street where that has to be checked.
ADDRESS = (
    (_set(_STREET.replace("|", " ")), re.compile(rf"{_STREET_START},? ((?:[^\W\d_][\w'-]* ){{1,3}}?)(?:{_STREET})\b", re.IGNORECASE)),
    (_set("rue avenue boulevard place chemin allee impasse quai cours route"), re.compile(rf"{_STREET_START}(?: ?(?:bis|ter))?,? ()(?:rue|avenue|boulevard|place|chemin|allee|impasse|quai|cours|route) (?:(?:de la|de l'|du|des|de|d') ?)?[^\W\d_][\w'-]+", re.IGNORECASE)),
    *((s, re.compile(rf"\b()[^\W\d_][\w-]*{re.escape(s)} \d{{1,4}}[a-z]?\b", re.IGNORECASE)) for s in ("straße", "strasse", "str.", "platz", "allee", "gasse", "weg", "ufer", "damm")),
    (_set("calle avenida avda paseo plaza carrer via viale"), re.compile(r"\b()(?:calle|avenida|avda\.?|paseo|plaza|carrer|via|viale) (?:de la |de los |de las |de |del )?[^\W\d_][\w'-]*,? (?:n[ro]?\.? ?)?\d{1,4}\b", re.IGNORECASE)),
)
#: Six digits or more, with the marks that stand between them: only there can a phone or identity number be.
_MANY_DIGITS = re.compile(r"\d(?:[ .()/-]{0,3}\d){5,}")
_AT_WORDS, _ID_LABELS = _set("at dot"), _set("passport licence license permit ssn tax insurance")
_DIGIT_WORD_SET = _set(" ".join(DIGIT_WORDS))
#: One-byte characters that are no letters, as spaces.
_LETTERS = bytes(c if chr(c).isalpha() else 32 for c in range(256))
_DOTTED = re.compile(r"\. ")
_AFTER = re.compile(r"((?: [A-Za-z]\.)*) ([^\W\d_][\w'-]*[^\W\d_])")
_NO_WORD = re.compile(r"[^\w'-]")
_SURNAME = re.compile(r"[^\W\d_][\w'-]*[^\W\d_]")
_INITIAL = re.compile(r"(?<![\w.@'-])([A-Za-z])\. (?:[A-Za-z]\. )*([^\W\d_][\w'-]+[^\W\d_])")
_TITLES = {t.translate(_FOLD).encode(): re.compile(rf"(?<![\w@'-]){t.translate(_FOLD)}\.? (?:[A-Za-z]\. )*([^\W\d_][\w'-]*[^\W\d_])", re.IGNORECASE) for t in TITLES}
_SHORT_TITLES = _set("dr mr mrs ms prof")
#: What stands before "will" where it is a name in lower case and not the verb.
_BEFORE_WILL = re.compile(r"(?:^|[:.!?\n(]\s*|\b(?:to|with|by|for|from|and|ask|thank|an|dear|think)\s)$", re.IGNORECASE)
_MIDDLE = re.compile(r"(?: [A-Za-z]\.)*")
_FIRST_WORD = re.compile(r"\S+ ")
_UPPER = "A-Z" + "".join(chr(c) for c in range(0xC0, 0x250) if chr(c).isupper())
_NAME_WORD = rf"[{_UPPER}][^\W\d_]*[^\W\d_{_UPPER}]+(?:[-'][^\W\d_]+)*"
#: Capitalised words in a row, with the initials between them.
_CAPITALS = re.compile(rf"(?<![\w@.'#/&-]){_NAME_WORD}(?:(?: [A-Z]\.)* {_NAME_WORD})+(?![\w@&/-])")
_CAPITAL_WORD = re.compile(_NAME_WORD)
#: A surname, a comma and what may be a given name, with nothing but an initial or the end of a clause after it; lists of more are no names.
_TURNED = re.compile(rf"(?<![\w@.'#/&-])(?<!, )(?<![{_UPPER}]\w )({_NAME_WORD}), ({_NAME_WORD})(?: [A-Z]\.)*(?! ?[,/&@-]| und | and | [{_UPPER}])(?!\w)")
_PLACED = re.compile(r"\b(?:in|near|at|nach|bei|aus|en|à|of|around)\s+$", re.IGNORECASE)
_AFTER_NUMBER = re.compile(r"\d[.,]? ?$")
#: Words beside which capitalised words name a street or place, in whatever spelling.
_STREET_WORDS = frozenset(f"{_STREET}|station|bridge|park|river|lake".split("|"))
_GIVEN = {n.encode(): re.compile(rf"(?<![\w@.'-]){n}(?![\w@-])", re.IGNORECASE) for n in FORMAL}


class Plain:
    """A text without disguises, and where each of its characters comes from."""

    def __init__(self, text: str) -> None:
        self.text = text if text.isascii() else text.translate(_FOLD)
        self.origin: list[int] | None = None
        self.spelled: list[tuple[int, int]] = []
        if not text.isascii() and _INVISIBLE.search(text):
            self._rewrite((m.start(), m.end(), "") for m in _INVISIBLE.finditer(self.text))

    def source(self, at: int) -> int:
        return at if self.origin is None else self.origin[at]

    def _rewrite(self, changes: Iterator[tuple[int, int, str]]) -> None:
        origin = self.origin or list(range(len(self.text) + 1))
        out, where, last = [], [], 0
        for start, end, new in changes:
            out += [self.text[last:start], new]
            where += origin[last:start] + [origin[start]] * len(new)
            last = end
        out.append(self.text[last:])
        where += origin[last:]
        self.text, self.origin = "".join(out), where

    def digits(self) -> None:
        found = [m for m in _SPELLED.finditer(self.text) if len(_SPELLED_PART.findall(m.group())) >= 7]
        if not found:
            return
        shift, spots, changes = 0, [], []
        for m in found:
            new = ""
            for times, word, gap in _SPELLED_PART.findall(m.group()):
                if word:
                    new += DIGIT_WORDS[word.lower()] * {"double": 2, "triple": 3}.get(times.lower(), 1)
                elif gap.strip():
                    new += "-"
            new = new.strip("-")
            changes.append((m.start(), m.end(), new))
            spots.append((m.start() + shift, m.start() + shift + len(new)))
            shift += len(new) - (m.end() - m.start())
        self._rewrite(iter(changes))
        self.spelled = spots

    def _local(self, low: int, at: int) -> bool:
        """Whether the local part of an address ends here, however long it is."""
        begin = at
        while begin > low and not _NO_LOCAL.match(self.text, begin - 1):
            begin -= 1
        return begin < at and bool(_LOCAL.search(self.text, begin, at))

    def addresses(self) -> None:
        """at and dot disguises of e-mail addresses."""
        changes, last = [], 0
        for m in _AT.finditer(self.text):
            host = _HOST.match(self.text, m.end())
            if not host or m.start() < last or not self._local(last, m.start()):
                continue
            if m.group() != "@":
                changes.append((m.start(), m.end(), "@"))
            changes += [(host.start() + d.start(), host.start() + d.end(), ".") for d in _DOT_MARK.finditer(host.group()) if d.group() != "."]
            last = host.end()
        if changes:
            self._rewrite(iter(changes))


@lru_cache(maxsize=1)
def _everyday(path: str) -> frozenset[str]:
    """Words that are a token of their own in the public vocabulary."""
    import base64

    with open(path, "rb") as lines:
        tokens = (base64.b64decode(line.split()[0]) for line in lines)
        return frozenset(t[1:].decode().lower() for t in tokens if t[:1] == b" " and t[1:].isalpha() and t.isascii())


@lru_cache(maxsize=1)
def _lower_words(path: str) -> frozenset[str]:
    """Words that are a token of their own, in lower case, in the public vocabulary or in that for many languages beside it, accents aside."""
    import base64

    found = set()
    for file in (path, os.path.join(os.path.dirname(path), "byte_bpe_multi_50k.tiktoken")):
        if os.path.exists(file):
            with open(file, "rb") as lines:
                for line in lines:
                    token = base64.b64decode(line.split()[0]).decode(errors="replace")
                    if token[:1] == " " and token[1:].isalpha() and token.islower():
                        found |= {token[1:], token[1:].translate(_FOLD)}
    return frozenset(found)


def _one_slip(a: str, b: str) -> bool:
    """Whether two words differ by at most one letter changed, added, lost or swapped with the next."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


class Finder:
    """Finds the items of a text."""

    def __init__(self, vocabulary: str | None = None) -> None:
        path = vocabulary or default_vocabulary()
        self._words, self._lower = _everyday(path), _lower_words(path)

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(type, start, end) of each item, in order, by the characters of the text."""
        plain = Plain(text)
        low = plain.text.lower()
        words = set(low.encode("latin-1", "replace").translate(_LETTERS).split())
        # Each detector runs only where a word or mark that it needs occurs at all.
        if "@" in low or not words.isdisjoint(_AT_WORDS):
            plain.addresses()
        if len(words & _DIGIT_WORD_SET) > 1:
            plain.digits()
        found: list[tuple[str, int, int]] = []
        work = plain.text

        def take(kind: str, start: int, end: int) -> None:
            nonlocal work
            found.append((kind, start, end))
            work = f"{work[:start]}{chr(0) * (end - start)}{work[end:]}"

        if "@" in work:
            for m in EMAIL.finditer(work):
                take("email", *m.span())
        if "://" in work:
            for m in URL.finditer(work):
                work = f"{work[: m.start()]}{chr(0) * len(m.group())}{work[m.end() :]}"
        for start, end in plain.spelled:
            if SPELLED_PHONE.fullmatch(work, start, end):
                take("phone", start, end)
        for near in [m.span() for m in _MANY_DIGITS.finditer(work)]:
            low_end, high_end = max(0, near[0] - 6), near[1] + 6
            for kind, pattern in (("id_number", ID_NUMBER), ("phone", PHONE)):
                for m in pattern.finditer(work, low_end, high_end):
                    if kind == "id_number" or 8 <= sum(map(str.isdigit, m.group())) <= 15:
                        take(kind, *m.span())
        for needed, pattern in ADDRESS:
            if needed in low if isinstance(needed, str) else not words.isdisjoint(needed):
                for m in pattern.finditer(work):
                    if "\0" not in m.group() and self._street_name(m.group(1)):
                        take("address", *m.span())
        if not words.isdisjoint(_ID_LABELS):
            for m in LABELLED_ID.finditer(work):
                take("id_number", *m.span(1))
        for start, end in self._names(work, words):
            take("name", start, end)
        return sorted(((k, plain.source(a), plain.source(b)) for k, a, b in found), key=lambda x: (x[1], x[2], x[0]))

    def _street_name(self, words: str) -> bool:
        """Names of streets are capitalised or no everyday words."""
        return all(w[0].isupper() or w not in self._words for w in words.split())

    def _surname(self, word: str, capital: bool) -> bool:
        low = word.lower().removesuffix("'s")
        if len(low) < 3 or low in NOT_SURNAMES:
            return False
        return word[0].isupper() if capital else low not in self._words

    def _common(self, word: str) -> bool:
        """Whether a capitalised word is one of everyday, a title, a month or the like."""
        low = word.lower().removesuffix("'s")
        return low in self._lower or low in NOT_SURNAMES or low.encode() in _TITLES

    @staticmethod
    def _of_place(word: str) -> bool:
        return any(_one_slip(word.lower(), s) for s in _STREET_WORDS if len(s) > 3)

    def _names(self, text: str, words: set[bytes]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []

        def add(start: int, end: int) -> None:
            if not any(start < b and a < end for a, b in out):
                out.append((start, end))

        rest = []
        for start, end in sorted(m.span() for w in words & _GIVEN.keys() for m in _GIVEN[w].finditer(text)):
            capital = text[start].isupper()
            m = _AFTER.match(text, end)
            if m and self._surname(m.group(2), capital):
                if capital or text[start:end] != "will" or _BEFORE_WILL.search(text, max(0, start - 16), start):
                    add(start, m.end())
            elif capital or text[start:end] not in EVERYDAY:
                rest.append((start, end, capital))
        for start, end, capital in rest:
            begin = start - 2
            while begin > 0 and not _NO_WORD.match(text, begin - 1):
                begin -= 1
            m = _SURNAME.fullmatch(text, begin, start - 2) if start > 3 and text[start - 2 : start] == ", " and (begin == 0 or text[begin - 1] not in "@.") else None
            if m and self._surname(m.group(), capital):
                add(m.start(), _MIDDLE.match(text, end).end())
        for m in _CAPITALS.finditer(text):
            parts = list(_CAPITAL_WORD.finditer(text, m.start(), m.end()))
            while parts and self._common(parts[0].group()):
                parts.pop(0)
            if len(parts) in (2, 3) and not any(self._common(p.group()) or self._of_place(p.group()) for p in parts) and self._surname(parts[-1].group(), True):
                if not (parts[0].start() == m.start() and _AFTER_NUMBER.search(text, max(0, m.start() - 3), m.start())):
                    add(parts[0].start(), m.end())
        if ", " in text:
            for m in _TURNED.finditer(text):
                if not any(self._common(w) or self._of_place(w) for w in m.groups()) and self._surname(m.group(1), True) and not _PLACED.search(text, max(0, m.start() - 12), m.start()):
                    add(m.start(), m.end())
        for title in words & _TITLES.keys():
            for m in _TITLES[title].finditer(text):
                surname = m.group(1)
                if m.group()[0].islower() and title not in _SHORT_TITLES:
                    continue  # "my coach said"
                if surname.lower() not in FORMAL and self._surname(surname, m.group()[0].isupper()):
                    add(m.start() + _FIRST_WORD.match(m.group()).end(), m.end())
        for dot in _DOTTED.finditer(text):
            m = _INITIAL.match(text, dot.start() - 1) if dot.start() else None
            if m and self._surname(m.group(2), m.group(1).isupper()):
                add(m.start(), m.end())
        return out


def redact(text: str, items: list[tuple[str, int, int]]) -> str:
    """The text with a typed placeholder for each item; everything else stays as it was."""
    out, last = [], 0
    for kind, start, end in items:
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
            last = end
    out.append(text[last:])
    return "".join(out)


def find_pii(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """key, pii_type, start_pos, end_pos of each item in the texts of a table, each once.

    Positions count code points of the text from 0. Every row is read in full,
    in one pass without a shuffle; only the items found are made distinct, so a
    record delivered twice counts once. Null and empty texts hold no items;
    null keys are kept; further columns are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(vocabulary)
        for batch in batches:
            rows, kinds, starts, ends = [], [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                for kind, a, b in finder.find(value):
                    rows.append(k)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "pii_type", "start_pos", "end_pos"])

    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(find, f"{key} string, pii_type string, start_pos int, end_pos int").distinct()


def redacted(df: DataFrame, text: str, vocabulary: str | None = None) -> DataFrame:
    """The table with the column `text` redacted; rows, order and all other columns stay. Null texts stay null."""

    @F.pandas_udf("string")
    def clean(values):
        finder = Finder(vocabulary)
        return values.map(lambda t: redact(t, finder.find(t)) if t else t)

    return df.withColumn(text, clean(F.col(text)))
