"""Tokens of free text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words, among them the two roles.
STOPWORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can did do does doing done down during each few for from further "
    "get got had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own re s said same she should so some such than that the their theirs them themselves then there these they this those through to too under until up us very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves user assistant"
).split()

# Plurals that suffixes don't give.
IRREGULAR = {"children": "child", "people": "person", "men": "man", "women": "woman", "teeth": "tooth", "feet": "foot", "mice": "mouse", "geese": "goose", "wives": "wife", "knives": "knife", "lives": "life", "leaves": "leaf"}

# Consonants doubled before a suffix; letters and digits of a word; tokens of a claim.
DOUBLED = "bdfglmnprt"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}]+)?"
POSSESSIVE = r"['’]s$"
CLAIM_TOKENS = 24


def _drop(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def undouble(base: Column) -> Column:
    """Without its last letter where that repeats the one before and is one that English doubles."""
    last = F.substring(base, -1, 1)
    return F.when((F.length(base) > 1) & (last == F.substring(base, -2, 1)) & last.isin(*DOUBLED), _drop(base, 1)).otherwise(base)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of up to three letters are their own."""
    base = F.when(word.isin(*IRREGULAR), F.element_at(F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair]), word))
    base = base.when(word.endswith("ies") & (F.length(word) > 4), F.concat(_drop(word, 3), F.lit("y")))
    base = base.when(word.endswith("sses") | word.endswith("shes") | word.endswith("ches"), _drop(word, 2))
    base = base.when(word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us") & ~word.endswith("is"), _drop(word, 1))
    base = base.when(word.endswith("ing") & (F.length(word) > 5), undouble(_drop(word, 3)))
    base = base.when(word.endswith("ed") & (F.length(word) > 4), undouble(_drop(word, 2))).otherwise(word)
    return F.when(F.length(word) <= 3, word).otherwise(F.regexp_replace(base, "^(.{3,})e$", "$1"))


def content_words(text: Column) -> Column:
    """Words of a text that are stemmed, in order and with repeats. No stem of such a word is shorter than two letters."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, POSSESSIVE, ""))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))


def stems(text: Column) -> Column:
    """Stems of a text's content words, in order and with repeats; an empty array for null.

    For short texts and where order counts. For long ones explode content_words
    and stem the column: that runs in generated code, an array's lambda doesn't.
    """
    return F.coalesce(F.transform(content_words(text), stem), F.array().cast("array<string>"))


def claim_tokens(text: Column, keywords: Column, names: Column) -> Column:
    """Distinct stems of keywords, then names, then text, in order, at most CLAIM_TOKENS."""
    every = F.concat(*[F.flatten(F.transform(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull()), stems)) for x in (keywords, names)], stems(text))
    return F.slice(F.array_distinct(every), 1, CLAIM_TOKENS)


def match_keys(canon: Column, aliases: Column) -> Column:
    """Sorted stems of each of an entity's names, joined; distinct and not empty."""
    names = F.filter(F.concat(F.array(canon), F.coalesce(aliases, F.array().cast("array<string>"))), lambda n: n.isNotNull())
    keys = F.transform(names, lambda n: F.array_join(F.array_sort(stems(n)), " "))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def excerpt(text: Column, cs: Column, ce: Column, context: int = 300) -> Column:
    """struct(excerpt, highlight_start, highlight_end): a span with context on both sides, clamped to the text. Offsets count code points from 0."""
    n = F.length(text)
    low = F.greatest(F.lit(0), F.least(cs, n))
    high = F.greatest(low, F.least(ce, n))
    start = F.greatest(F.lit(0), low - context)
    end = F.least(n, high + context)
    cut = F.substring(text, start + 1, end - start)
    return F.struct(cut.alias("excerpt"), (low - start).alias("highlight_start"), F.least(F.length(cut), high - start).alias("highlight_end"))


def _normalised(text: Column, strip_markup: bool) -> Column:
    """array<struct<c,i>>: characters with white space collapsed (and markup dropped), each with its place."""
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(F.when(c.rlike(r"(?U)^\s$"), F.lit(" ")).otherwise(c).alias("c"), i.alias("i")))
    kept = F.filter(chars, lambda x: x["c"] != "")
    if strip_markup:
        kept = F.filter(kept, lambda x: ~x["c"].isin("*", "_", "`", "#", "~"))
    return F.filter(F.transform(kept, lambda x, k: F.struct(x["c"].alias("c"), x["i"].alias("i"), ((x["c"] == " ") & ((k == 0) | (F.get(kept, k - 1)["c"] == " "))).alias("drop"))), lambda x: ~x["drop"])


def locate_span(text: Column, quote: Column) -> Column:
    """struct(cs, ce, located) of a quote in a text, null if it isn't there or says nothing.

    Exact first; then with white space collapsed; then without markup as well,
    offsets mapped back to the text. The later ways are tried only where the
    earlier fail.
    """

    def found(cs: Column, ce: Column, how: str) -> Column:
        return F.struct(cs.cast("int").alias("cs"), ce.cast("int").alias("ce"), F.lit(how).alias("located"))

    exact = F.instr(text, quote)
    result = F.when(exact > 0, found(exact - 1, exact - 1 + F.length(quote), "exact"))
    for strip, how in ((False, "normalised"), (True, "markdown")):
        hay, needle = _normalised(text, strip), _normalised(quote, strip)
        flat = F.array_join(F.transform(needle, lambda x: x["c"]), "")
        at = F.instr(F.array_join(F.transform(hay, lambda x: x["c"]), ""), flat)
        result = result.when((flat != "") & (at > 0), found(F.get(hay, at - 1)["i"], F.get(hay, at - 2 + F.length(flat))["i"] + 1, how))
    return F.when(F.trim(F.regexp_replace(quote, r"(?U)\s", " ")) != "", result)
