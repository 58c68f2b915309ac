"""Histories of changing attributes from presence bitmaps.

Each version of an attribute has a bitmap with one bit per snapshot, kept as
words of WORD bits; words without a bit are not kept, and a stretch of words of
ones is one entry. Words are OR-ed map-side, so a version seen in a thousand
snapshots shuffles seventeen words and no key ever gathers its rows in one
task. Runs of consecutive ones are the periods of validity; a gap ends one run
and the next begins another. Everything stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a word: 62 of the 64, so that no shift or subtraction reaches the sign.
WORD = 62
FULL = (1 << WORD) - 1
#: The word at which bitmaps of open versions end: beyond all snapshots that an int can number.
HORIZON = (1 << 31) // WORD + 1


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _shl(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by.cast("int"))


def _shr(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by.cast("int"))


def _not(x: Column) -> Column:
    return x.bitwiseXOR(_long(FULL))


def word_of(at: Column) -> Column:
    return F.floor(at / WORD).cast("bigint")


def _from_bit(at: Column) -> Column:
    """The bits of a word from a snapshot's own upwards."""
    return _not(_shl(_long(1), F.pmod(at, F.lit(WORD))) - _long(1))


def _entry(word: Column, span: Column, bits: Column) -> Column:
    return F.struct(word.cast("bigint").alias("word"), span.cast("bigint").alias("span"), bits.alias("bits"))


def bitmap_words(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, words: the bitmap of each key as an ordered array of (word, span, bits), span 1.

    Rows with a null snapshot carry no presence and are left out; a null key is
    a key like any other. Repeated rows set the same bit again. The array holds
    at most one entry for 62 snapshots, however many rows a key has, and none
    for words without a bit.
    """
    seen = df.where(F.col(at).isNotNull()).select(*keys, word_of(F.col(at)).alias("word"), _shl(_long(1), F.pmod(F.col(at), F.lit(WORD))).alias("bits"))
    ored = seen.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))
    return ored.groupBy(*keys).agg(F.array_sort(F.collect_list(_entry(F.col("word"), F.lit(1), F.col("bits")))).alias("words"))


def _neighbour(words: Column, i: Column, step: int) -> Column:
    """Bits of the word before an entry or after it; 0 where there is no such word."""
    x, y = F.get(words, i), F.get(words, i + F.lit(step))
    left, right = (y, x) if step < 0 else (x, y)
    return F.when((i + F.lit(step) >= 0) & (left["word"] + left["span"] == right["word"]), y["bits"]).otherwise(_long(0))


def _bit_numbers(words: Column, mask, at_end: bool) -> Column:
    """Snapshot numbers of the bits that `mask` (a function of the entry's index) leaves; entries it leaves empty cost one test."""
    masked = F.transform(words, lambda x, i: F.struct((x["word"] + x["span"] - 1 if at_end else x["word"]).alias("word"), mask(i).alias("bits")))
    return F.flatten(
        F.transform(
            F.filter(masked, lambda x: x["bits"] != 0),
            lambda x: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: _shr(x["bits"], b).bitwiseAND(_long(1)) == 1),
                lambda b: x["word"] * F.lit(WORD) + b,
            ),
        )
    )


def runs(words: Column) -> Column:
    """array<struct<first,last>>: the runs of consecutive ones of an ordered bitmap, across words; empty for an empty bitmap.

    An entry of several words is one of ones only, so a run can begin at its
    first bit and end at its last, and its length costs nothing.
    """

    def starts(i: Column) -> Column:
        bits = F.get(words, i)["bits"]
        return bits.bitwiseAND(_not(_shl(bits, F.lit(1)).bitwiseAND(_long(FULL)).bitwiseOR(_shr(_neighbour(words, i, -1), F.lit(WORD - 1)))))

    def ends(i: Column) -> Column:
        bits = F.get(words, i)["bits"]
        return bits.bitwiseAND(_not(_shr(bits, F.lit(1)).bitwiseOR(_shl(_neighbour(words, i, 1).bitwiseAND(_long(1)), F.lit(WORD - 1)))))

    zipped = F.arrays_zip(_bit_numbers(words, starts, False).alias("first"), _bit_numbers(words, ends, True).alias("last"))
    return F.transform(zipped, lambda z: F.struct(z["first"].alias("first"), z["last"].alias("last")))


def entity_hash(*parts: Column) -> Column:
    """128 bits that stand for an entity and its attribute: two of 10**11 such pairs share them with a chance of 1 in 10**16."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b"))


def snapshot_history(df: DataFrame, entity: list[str], attributes: list[str], snapshot: str) -> DataFrame:
    """Full history of entity attributes seen in numbered periodic snapshots.

    entity, attributes, first_seen, last_seen, is_current. A version that
    disappears and returns has several rows; one in the entity's latest
    snapshot is current. Null attribute values are versions of their own, rows
    without a snapshot number are left out, repeated rows count once, an empty
    table has no history. Columns that are not named are ignored, whatever
    they are called. Bitmaps are kept by the hash of entity and attribute; the
    values go along, so a shared hash mixes nothing.
    """
    keys = [*entity, *attributes]
    names, ents = [f"_k{i}" for i in range(len(keys))], [f"_k{i}" for i in range(len(entity))]
    named = df.select(F.xxhash64(*keys).alias("_h"), *[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(snapshot).cast("bigint").alias("_at"))
    history = bitmap_words(named, ["_h", *names], "_at").select(*names, F.explode(runs(F.col("words"))).alias("_run"))
    latest = named.groupBy(*[F.col(c).alias(f"_e{c}") for c in ents]).agg(F.max("_at").alias("_latest"))
    on = [history[c].eqNullSafe(latest[f"_e{c}"]) for c in ents]
    return history.join(latest, on).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)], F.col("_run.first").alias("first_seen"), F.col("_run.last").alias("last_seen"), (F.col("_run.last") == F.col("_latest")).alias("is_current"))


def presence_from(start: Column, closed: Column) -> Column:
    """Presence bitmap of a version that starts at a snapshot and carries the bitmap `closed` of its closing events.

    Its bits are 1 from the start up to the lowest closing bit, which `x & -x`
    isolates, or up to HORIZON where nothing closes it. Whole words of ones
    between the first and the last are one entry, so a version has at most
    three, however many snapshots it lasts.
    """
    first, begin = F.get(closed, F.lit(0)), word_of(start)
    until = F.coalesce(first["word"], _long(HORIZON))
    lowest = F.coalesce(first["bits"].bitwiseAND(_long(0) - first["bits"]), _long(1))
    below = lowest - _long(1)
    head = F.when(begin < until, _from_bit(start)).when(begin == until, _from_bit(start).bitwiseAND(below)).otherwise(_long(0))
    middle = F.when(begin + 1 < until, _long(FULL)).otherwise(_long(0))
    tail = F.when(begin < until, below).otherwise(_long(0))
    entries = F.array(_entry(begin, F.lit(1), head), _entry(begin + 1, until - begin - 1, middle), _entry(until, F.lit(1), tail))
    return F.filter(entries, lambda x: x["bits"] != 0)


def version_validity(versions: DataFrame, closings: DataFrame, keys: list[str], start: str, at: str) -> DataFrame:
    """The columns of `versions` and valid_to: the period of each version that closing events end.

    versions has one row per key; closings any number per key, none before the
    version's start. Closings set bits in a bitmap kept by the hash of the key
    columns (entity, attribute and version), so no key is shuffled with them.
    The first run of the version's presence bitmap is its period; a run that
    reaches HORIZON is open, valid_to 0. A closing in the very snapshot of the
    start leaves no run: valid_to is the start. Null keys match nothing and stay
    open; a null start gives a null valid_to; an empty table gives an empty one.
    """
    mark = entity_hash(*[F.col(k) for k in keys])
    there = closings.dropna(subset=keys).select(mark.alias("_h"), at)
    closed = bitmap_words(there, ["_h"], at).withColumnRenamed("words", "_closed")
    known = F.when(~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), mark)
    joined = versions.withColumn("_h", known).join(closed, "_h", "left").withColumn("_runs", runs(presence_from(F.col(start).cast("bigint"), F.col("_closed"))))
    run = F.get(F.col("_runs"), F.lit(0))
    ended = F.when(run.isNull(), F.col(start)).when(run["last"] >= F.lit(HORIZON * WORD - 1), F.lit(0)).otherwise(run["last"] + 1)
    return joined.select(*versions.columns, F.when(F.col(start).isNotNull(), ended).cast("int").alias("valid_to"))
