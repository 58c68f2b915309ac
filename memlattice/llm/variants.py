"""Variant spellings of names: which rows mean the same person or organisation.

Every spelling is reduced to a form: people to a surname with the given name it
may stand for, organisations to their written-out name. Whether a name is a
person's is told by its shape and by how its words are marked in the whole
table, not by a list; a list only says which short forms go with which given
names. The distinct names of a block (a user's people, a user's organisations)
are partitioned in the metric space of the edit distance: each goes to the cell
of its nearest pivot and is copied into the cells whose border it is near to, by
the triangle inequality, cell by cell until the cells are small; an exact radius
join inside the cells then misses no pair. Forms that are close in spelling and
agree in the rest are linked, and connected rows are one bearer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from memlattice.llm.names import FORMAL, NOT_SURNAMES, TITLES
from memlattice.operators.components import components
from memlattice.runtime import materialize

#: Radius of the join, in slips: letters changed, added or lost, or two neighbours swapped.
RADIUS = 2
#: Names that a cell should hold, and pivots that a cell is split by at once.
CELL, FAN = 16, 8
#: A cell of so many names that pivots don't make smaller is joined by the letters its names share.
CROWDED = 256
#: Pairs of words up to this length are compared at once, longer ones one by one.
ROW_LETTERS = 48

# Short forms of words in organisations' names, and what follows a name without belonging to it.
ABBREVIATIONS = {
    "acad": "academy", "assoc": "association", "bros": "brothers", "bur": "bureau", "co": "company", "coll": "college", "comm": "community", "ctr": "center", "dept": "department",
    "dist": "district", "fdn": "foundation", "fed": "federation", "grp": "group", "hosp": "hospital", "hq": "headquarters", "ins": "insurance", "inst": "institute", "intl": "international",
    "lab": "laboratory", "lib": "library", "mfg": "manufacturing", "mgmt": "management", "mkt": "market", "mus": "museum", "natl": "national", "sch": "school", "soc": "society", "svc": "service",
    "svcs": "services", "sys": "systems", "tech": "technology", "univ": "university", "wks": "works", "&": "and", "+": "and",
}
LEGAL_FORMS = frozenset("ltd llc inc gmbh corp plc ag limited incorporated corporation sa bv kg".split())
#: Names of at most so many letters are compared letter by letter only with themselves.
SHORT = 4
#: A given name is another one misspelt if that is so many times as frequent; a known short or full form counts as if it had been met PRIOR times more.
MISSPELT, PRIOR = 5, 20

_PIECES = re.compile(r"[^\W_]+|&|\+")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011](?=[^\W\d_])")
_DETERMINERS = frozenset("the my our your his her their a an der die das el la le".split())
_SMALL = frozenset("the and of for in de la".split())


def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def slip_distance(a: str, b: str) -> int:
    """Damerau's distance: letters changed, added or lost, and neighbours swapped even if others come between them afterwards. A metric."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            above, left = seen.get(y, 0), last
            if x == y:
                last = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[above][left] + (i - above - 1) + 1 + (j - left - 1))
        seen[x] = i
    return d[len(a) + 1][len(b) + 1]


def _letters(words: list[str], fill: int) -> np.ndarray:
    out = np.full((len(words), max((len(w) for w in words), default=0)), fill, dtype=np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype="<i4")
    return out


def slip_distances(a: list[str], b: list[str]) -> np.ndarray:
    """slip_distance of each pair of two lists, many at once."""
    out = np.zeros(len(a), dtype=np.int32)
    brief = np.array([len(x) <= ROW_LETTERS and len(y) <= ROW_LETTERS for x, y in zip(a, b, strict=True)], dtype=bool)
    for k in np.nonzero(~brief)[0]:
        out[k] = slip_distance(a[k], b[k])
    for part in np.array_split(np.nonzero(brief)[0], max(1, -(-int(brief.sum()) // 4096))):
        if not len(part):
            continue
        x, y = _letters([a[k] for k in part], -1), _letters([b[k] for k in part], -2)
        n, m, rows = x.shape[1], y.shape[1], np.arange(len(part))
        d = np.full((len(part), n + 2, m + 2), n + m, dtype=np.int32)
        d[:, 1:, 1] = np.arange(n + 1)
        d[:, 1, 1:] = np.arange(m + 1)
        above = np.zeros((len(part), m), dtype=np.int32)  # the last row before with this column's letter
        for i in range(1, n + 1):
            same, left = x[:, i - 1 : i] == y, np.zeros(len(part), dtype=np.int32)
            for j in range(1, m + 1):
                up = above[:, j - 1]
                swap = d[rows, up, left] + (i - up) + (j - left) - 1
                d[:, i + 1, j + 1] = np.minimum(np.minimum(d[:, i, j] + ~same[:, j - 1], swap), np.minimum(d[:, i + 1, j], d[:, i, j + 1]) + 1)
                left = np.where(same[:, j - 1], j, left)
            above = np.where(same, i, above)
        out[part] = d[rows, np.array([len(a[k]) for k in part]) + 1, np.array([len(b[k]) for k in part]) + 1]
    return out


def name_forms(name: str) -> list[tuple[str, str, str, str, str]]:
    """(kind, key, given, initial, alt) of the readings of a typed name.

    kind 'p': key is the surname, given the word before it, initial the first
    letter where only that is written; alt is the name as an organisation's,
    should the table show that it is no person's. kind 'm': as 'p', of more
    than two words, which only those marked as people have. kind 'o': key is the name
    written out, alt 'sure' if a legal form followed it. kind 'a': key are the
    letters that an abbreviation stands for.
    """
    bare = name.strip()
    if re.fullmatch(r"[A-Z](?:\.?[A-Z]){1,5}\.?", bare):
        return [("a", bare.replace(".", "").lower(), "", "", "")]
    text = folded(bare)
    head, comma, tail = text.partition(",")
    if comma and tail.strip().strip(".") not in LEGAL_FORMS:
        text = f"{tail},{head}"

    def pieces(text: str) -> list[str]:
        words: list[str] = []
        for part in text.split(","):
            found = _PIECES.findall(part.replace("'", ""))
            while found and found[0] in _TITLES:
                found = found[1:]
            words += found
        return words

    words = pieces(text)
    if "the" in words[1:] or not words:
        return []
    whole = [ABBREVIATIONS.get(w, w) for w in words]
    if len(whole) > 1 and whole[0] == "the":
        whole = whole[1:]
    legal = len(whole)
    while len(whole) > 1 and whole[-1] in LEGAL_FORMS:
        whole = whole[:-1]
    legal -= len(whole)
    org = " ".join(whole)
    joined = pieces(_HYPHEN.sub("", text))
    for found in (words, joined):
        people = [w for w in found if len(w) > 1]
        letters = [w for w in found if len(w) == 1]
        if legal or not all(w.isalpha() for w in people) or not NOT_SURNAMES.isdisjoint(people[1:]) or people[0] in _DETERMINERS:
            continue
        if len(people) == 2:
            return [("p", people[1], people[0], "", org if len(whole) > 1 else "")]
        if len(people) == 1 and letters:
            return [("p", people[0], "", letters[0], "")]
    if len(whole) < 2:
        return [("o", org, "", "", "sure")] if legal else []
    out = [("o", org, "", "", "sure" if legal else "")]
    people = [w for w in joined if len(w) > 1]
    if len(people) > 2 and not legal and all(w.isalpha() for w in people) and "and" not in people:
        out.append(("m", " ".join(people[1:]), people[0], "", ""))
    return out


_TITLES = frozenset(folded(t) for t in TITLES)


def _readings(entities: DataFrame) -> DataFrame:
    """uid, ekey, etype, kind, key, given, initial, alt: the readings of each row's canon and of those of its aliases that say a name."""
    columns = ("uid", "ekey", "etype", "kind", "key", "given", "initial", "alt")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for uid, ekey, etype, canon, aliases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                readings = {f for name in (canon, *(aliases or ())) if name for f in name_forms(name)}
                for form in sorted(readings):
                    for c, v in zip(out, (uid, ekey, etype, *form), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.string()) for c in columns]))

    return entities.mapInArrow(read, ", ".join(f"{c} string" for c in columns)).distinct()


@F.pandas_udf(IntegerType())
def _slips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(slip_distances(a.tolist(), b.tolist()))


@F.pandas_udf(ArrayType(IntegerType()))
def _pivot_distances(name: pd.Series, pivots: pd.Series) -> pd.Series:
    sizes = [len(p) for p in pivots]
    flat = slip_distances([n for n, k in zip(name, sizes, strict=True) for _ in range(k)], [q for p in pivots for q in p])
    return pd.Series(np.split(flat, np.cumsum(sizes)[:-1]) if sizes else [])


@F.pandas_udf(ArrayType(StringType()))
def _shortened(word: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([sorted(shortened(w, k)) for w, k in zip(word, most, strict=True)])


def shortened(word: str, most: int) -> set[str]:
    """The word without up to `most` of its letters. Words within `most` slips share one of them."""
    return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(most + 1) for gone in map(set, combinations(range(len(word)), min(k, len(word))))}


def _split_cells(placed: DataFrame, block: list[str], name: str, radius: int, salt: int) -> DataFrame:
    """Every cell (block, _cell) split by pivots of its own, and (_split false) as it is: name, _home, _parent, _cell, _d, _was (names of the cell before)."""
    cell = [*block, "_cell"]
    # the names that are least by each of FAN hashes: a pivot sample of bounded size, drawn map-side
    least = [F.min(F.struct(F.xxhash64(name, F.lit(FAN * salt + k)).alias("h"), F.col(name).alias("p")))["p"] for k in range(FAN)]
    sized = placed.groupBy(*cell).agg(F.count("*").alias("_was"), F.array(*least).alias("_drawn"))
    pivots = sized.select(*cell, "_was", F.slice(F.array_distinct("_drawn"), F.lit(1), F.least(F.lit(FAN), F.ceil(F.col("_was") / CELL)).cast("int")).alias("_pivots"))
    far = placed.select(*cell, name, "_home").join(pivots, cell).withColumn("_far", _pivot_distances(F.col(name), F.col("_pivots")))
    near = far.withColumn("_near", F.array_min(F.transform("_far", lambda d, i: F.struct(d.alias("d"), i.alias("i")))))
    into = F.filter(F.transform("_far", lambda d, i: F.struct(d.alias("d"), i.alias("i"), F.lit(True).alias("split"))), lambda x: x["d"] <= F.col("_near.d") + F.lit(2 * radius))
    whole = F.array(F.struct(F.get("_far", F.lit(0)).alias("d"), F.lit(0).alias("i"), F.lit(False).alias("split")))
    spread = near.withColumn("_to", F.explode(F.concat(into, whole)))
    split = F.col("_to.split")
    home = F.col("_home") & (~split | (F.col("_to.i") == F.col("_near.i")))
    into_cell = F.when(split, F.xxhash64("_cell", F.element_at("_pivots", F.col("_to.i") + 1))).otherwise(F.col("_cell"))
    return spread.select(*block, name, home.alias("_home"), F.col("_cell").alias("_parent"), into_cell.alias("_cell"), F.col("_to.d").alias("_d"), split.alias("_split"), "_was")


def radius_join(names: DataFrame, block: list[str], name: str, radius: int = RADIUS) -> DataFrame:
    """block, name_a, name_b, slips: all pairs (the lesser first) of distinct names of a block within `radius` slips of each other.

    names has each name of a block once. A block is split into the cells of up
    to about FAN pivots, drawn by a hash. A name's home is the cell of its
    nearest pivot; it is copied into the cells of all pivots that are at most
    twice the radius farther, so every pair meets in the home cell of its first
    name. Cells of more than CELL names are split again by pivots of their own,
    as long as that makes them smaller; a cell whose parts would hold more than
    twice its names, as they lie about as far from each other as from any pivot,
    stays as it is. Inside a cell only names whose distance to the pivot differs
    by no more than the radius are compared; in crowded cells those that share a
    word left by taking away up to `radius` letters, which all pairs within the
    radius do. A null block or name pairs with nothing.
    """
    whole = names.select(*block, name).where(" and ".join(f"{c} is not null" for c in [*block, name])).withColumn("_cell", F.lit(0).cast("bigint")).withColumn("_home", F.lit(True))
    leaves, salt = None, 0
    while True:
        cells = materialize(_split_cells(whole, block, name, radius, salt), "cells")
        apart = cells.groupBy(*block, "_parent").agg((F.count_if("_split") <= 2 * F.max("_was")).alias("_apart"))
        sizes = cells.groupBy(*block, "_parent", "_cell", "_split").agg(F.count("*").alias("_n"), F.max("_home").alias("_homes"))
        # where no name is at home, nothing is looked for
        kept = sizes.join(apart, [*block, "_parent"]).where("_homes and _split = _apart").drop("_homes", "_apart")
        sized = cells.join(kept, [*block, "_parent", "_cell", "_split"])
        again = F.col("_split") & (F.col("_n") > CELL) & (F.col("_n") < 0.7 * F.col("_was"))
        done = sized.where(~again).select(*block, "_cell", name, "_home", "_d", "_n")
        leaves = done if leaves is None else leaves.unionByName(done)
        if sized.where(again).limit(1).count() == 0:
            break
        whole, salt = sized.where(again).select(*block, "_cell", name, "_home"), salt + 1
    leaves = materialize(leaves.where("_n > 1"), "leaves")
    on = [*block, "_cell"]

    def pairs(cells: DataFrame, keys: list[str]) -> DataFrame:
        a = cells.where("_home").select(*keys, F.col("_d").alias("_da"), F.col(name).alias("name_a"))
        b = cells.select(*keys, F.col("_d").alias("_db"), F.col(name).alias("name_b"))
        # swapped neighbours are two changes of Levenshtein's
        close = (F.col("name_a") < F.col("name_b")) & (F.abs(F.col("_da") - F.col("_db")) <= radius) & (F.abs(F.length("name_a") - F.length("name_b")) <= radius) & (F.levenshtein("name_a", "name_b", 2 * radius) >= 0)
        # what explode makes of a small table isn't in its estimated size: without the hint the driver may be sent all of it
        return a.join(b.hint("merge"), keys).where(close).select(*block, "name_a", "name_b")

    found = pairs(leaves.where(F.col("_n") <= CROWDED), on)
    crowded = leaves.where(F.col("_n") > CROWDED)
    if crowded.limit(1).count():
        found = found.unionByName(pairs(crowded.withColumn("_key", F.explode(_shortened(F.col(name), F.lit(radius)))), [*on, "_key"]).distinct())
    return found.withColumn("slips", _slips(F.col("name_a"), F.col("name_b"))).where(F.col("slips") <= radius)


def given_meanings(words: DataFrame) -> DataFrame:
    """given, meaning: the given names that each typed word may stand for.

    words has given and n, how often each was met. A known short form stands
    for its full forms. Another word is taken for a misspelling of the words
    nearest to it, within one slip (two from seven letters on), that are
    MISSPELT times as frequent, known ones with a head start; else it stands for
    itself. Short words must begin with the same letter.
    """
    known = words.sparkSession.createDataFrame([(w, m) for w, ms in FORMAL.items() for m in ms], "v string, meaning string")
    listed = known.select(F.col("v").alias("given"), F.lit(0).cast("bigint").alias("n"), F.lit(PRIOR).alias("prior"))
    counted = materialize(words.select("given", "n", F.lit(0).alias("prior")).unionByName(listed).groupBy("given").agg(F.sum("n").alias("n"), F.max("prior").alias("prior")), "given")
    allowed = F.when(F.length("given") < 7, 1).otherwise(2)
    open_words = counted.where((F.col("prior") == 0) & (F.length("given") > 1)).select("given", "n", F.explode(_shortened(F.col("given"), allowed)).alias("_key"))
    weight = F.col("n") + F.col("prior")
    targets = counted.where(weight >= MISSPELT).select(F.col("given").alias("v"), weight.alias("m"), F.explode(_shortened(F.col("given"), F.lit(RADIUS))).alias("_key"))
    likely = (F.col("m") >= MISSPELT * F.col("n")) & (F.col("given") != F.col("v")) & ((F.least(F.length("v"), F.length("given")) > 3) | (F.substring("v", 1, 1) == F.substring("given", 1, 1)))
    # many times the table that they are drawn from, which the estimate of their size doesn't know: not to be sent to the driver
    pairs = open_words.join(targets.hint("merge"), "_key").where(likely & (F.abs(F.length("given") - F.length("v")) <= allowed) & (F.levenshtein("given", "v", 4) >= 0)).select("given", "v").distinct()
    near = pairs.withColumn("d", _slips(F.col("given"), F.col("v"))).where(F.col("d") <= allowed)
    best = near.groupBy("given").agg(F.min("d").alias("d"))
    meant = near.join(best, ["given", "d"]).select("given", "v").unionByName(counted.where("prior > 0").select("given", F.col("given").alias("v")))
    corrected = meant.join(known, "v", "left").select("given", F.coalesce("meaning", "v").alias("meaning")).distinct()
    return counted.where("n > 0").select("given").join(corrected, "given", "left").select("given", F.coalesce("meaning", "given").alias("meaning"))


def _person_share(marked: DataFrame, column: str) -> DataFrame:
    """column, and how many rows with a mark have it, and how many of those are marked as people."""
    return marked.groupBy(column).agg(F.count("etype").alias(f"_{column}_n"), F.count_if(F.col("etype") == "person").alias(f"_{column}_p"))


def _forms(read: DataFrame) -> DataFrame:
    """uid, ekey, kind, key, given, initial: the readings that the table bears out.

    A name of two words is a person's if its given name and its surname,
    wherever they stand, are mostly marked so; else it may be an organisation's.
    A name is an organisation's if a legal form follows it or one of its words
    after the first mostly stands in names that are marked so.
    """
    columns = ["uid", "ekey", "kind", "key", "given", "initial"]
    named = read.where("kind in ('p', 'm')")
    meanings = materialize(given_meanings(named.where("given <> ''").groupBy("given").agg(F.count("*").alias("n"))), "meanings")
    people = materialize(named.withColumn("_typed", F.col("given")).join(meanings, "given", "left").withColumn("given", F.coalesce("meaning", "given")).drop("meaning"), "people")
    judged = people.join(_person_share(people.where("given <> '' and kind = 'p'"), "given"), "given", "left").join(_person_share(people.where("kind = 'p'"), "key"), "key", "left")
    marks, of = [F.coalesce(F.col(f"_given_{x}"), F.lit(0)) + F.coalesce(F.col(f"_key_{x}"), F.lit(0)) for x in "np"]
    sure = judged.withColumn("_person", F.when(F.col("kind") == "m", F.col("etype") == "person").otherwise((marks == 0) | (of >= 0.5 * marks)))
    sure = materialize(sure.select(*columns, "etype", "alt", "_person"), "sure")
    other = sure.where("kind = 'p' and not _person and alt <> ''").select("uid", "ekey", "etype", F.lit("o").alias("kind"), F.col("alt").alias("key"), F.lit("").alias("given"), F.lit("").alias("initial"), F.lit("").alias("alt"))
    orgs = read.where("kind = 'o'").unionByName(other.select(*read.columns)).distinct()
    words = F.split("key", " ")
    spelt = orgs.withColumn("_word", F.explode(F.when(F.size(words) > 1, F.slice(words, F.lit(2), F.size(words) - 1)).otherwise(words)))
    shares = spelt.groupBy("_word").agg(F.coalesce(F.avg((F.col("etype") == "org").cast("int")), F.lit(0.0)).alias("_share"))
    kept = spelt.join(shares, "_word").where("_share >= 0.5 or alt = 'sure'").select(*columns).distinct()
    # a name of several words that the table shows to be an organisation's is no person's
    long = sure.where("kind = 'm' and _person").select("uid", "ekey", F.lit("p").alias("kind"), "key", "given", "initial").join(kept.select("uid", "ekey").distinct(), ["uid", "ekey"], "left_anti")
    short = sure.where("kind = 'p' and _person").select(*columns)
    letters = read.where("kind = 'a'").select(*columns)
    return short.unionByName(long.select(*columns)).unionByName(kept).unionByName(letters).distinct()


def _class_links(forms: DataFrame) -> DataFrame:
    """Pairs of ekeys that stand for linked classes of forms.

    A class is a distinct form of a block, represented by its least ekey; rows
    that share it are linked to the representative, not to each other.
    """
    block = ["uid", "kind"]
    # a short form that may mean several names means the one that most of the user's rows bear out
    sized = forms.groupBy(*block, "key", "given", "initial").agg(F.count("*").alias("_n"))
    most = F.max("_n").over(Window.partitionBy("uid", "ekey", "kind", "key", "initial"))
    forms = materialize(forms.join(sized, [*block, "key", "given", "initial"]).withColumn("_most", most).where("_n = _most").drop("_n", "_most"), "resolved")
    classes = materialize(forms.groupBy(*block, "key", "given", "initial").agg(F.min("ekey").alias("rep")), "classes")
    rows = forms.join(classes, [*block, "key", "given", "initial"]).select(F.col("ekey").alias("a"), F.col("rep").alias("b"))
    names = materialize(classes.where("kind in ('p', 'o') and length(key) > 1").select(*block, "key").distinct(), "names")
    close = radius_join(names, block, "key")
    longest = F.greatest(F.length("name_a"), F.length("name_b"))
    slipped = close.where((longest > SHORT) & ((F.col("slips") <= 1) | (longest >= 9))).withColumnRenamed("slips", "_slips")
    turned = slipped.select(*block, F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "_slips")
    same = names.select(*block, F.col("key").alias("name_a"), F.col("key").alias("name_b"), F.lit(0).alias("_slips"))
    near = materialize(slipped.select(*block, "name_a", "name_b", "_slips").unionByName(turned).unionByName(same), "near")
    left = classes.select(*block, F.col("key").alias("name_a"), "given", F.col("initial").alias("initial_a"), F.col("rep").alias("a"))
    right = classes.select(*block, F.col("key").alias("name_b"), "given", F.col("initial").alias("initial_b"), F.col("rep").alias("b"))
    # whole names agree in the given name; initials with themselves
    whole = near.join(left.where("initial_a = ''"), [*block, "name_a"]).join(right.where("initial_b = ''"), [*block, "name_b", "given"]).select("a", "b")
    by_initial = near.where("name_a < name_b or _slips = 0").join(left.where("initial_a <> ''"), [*block, "name_a"]).join(right.where("initial_b <> ''").drop("given"), [*block, "name_b"]).where("initial_a = initial_b").select("a", "b")
    # an initial stands for the one given name that fits, of those whose surname is spelt closest
    fits = near.join(left.where("initial_a <> ''").drop("given"), [*block, "name_a"]).join(right.where("initial_b = '' and given <> ''"), [*block, "name_b"]).where(F.substring("given", 1, 1) == F.col("initial_a"))
    chosen = fits.groupBy(*block, "name_a", "initial_a", "a").agg(F.min(F.struct("_slips", "given", "b")).alias("m"), F.min("given").alias("lo"), F.max("given").alias("hi"), F.min(F.when(F.col("_slips") == 0, F.col("given"))).alias("lo0"), F.max(F.when(F.col("_slips") == 0, F.col("given"))).alias("hi0"))
    initials = chosen.where("lo = hi or (lo0 is not null and lo0 = hi0)").select("a", F.col("m.b").alias("b"))
    # letters stand for the one organisation of the user that they abbreviate
    short = F.array_join(F.transform(F.filter(F.split("key", " "), lambda w: ~w.isin(*_SMALL)), lambda w: F.substring(w, 1, 1)), "")
    orgs = classes.where("kind = 'o'").select("uid", short.alias("key"), F.col("key").alias("_name"), F.col("rep").alias("b"))
    # (spellings of its name within the radius of each other count as one)
    first = orgs.groupBy("uid", "key").agg(F.min(F.struct("_name", "b")).alias("_m"))
    apart = orgs.join(first, ["uid", "key"]).groupBy("uid", "key").agg(F.min("_m").alias("_m"), F.max(F.levenshtein("_name", F.col("_m._name"))).alias("_d"))
    letters = classes.where("kind = 'a'").select("uid", "key", F.col("rep").alias("a")).join(apart.where(F.col("_d") <= RADIUS), ["uid", "key"]).select("a", F.col("_m.b").alias("b"))
    return rows.unionByName(whole).unionByName(by_initial).unionByName(initials).unionByName(letters).where("a <> b")


def link_variants(entities: DataFrame) -> DataFrame:
    """uid, ekey, bearer: the rows that mean the same person or organisation as another share a bearer (their least ekey).

    Rows are linked within a user only. Repeated rows count once; a null uid is
    no user's and links to nothing; null canons, null or empty aliases and
    aliases that say no full name add nothing; empty tables give no rows;
    further columns are ignored. etype is not trusted row by row: a row counts
    as what the rows with the same words are mostly marked as.
    """
    read = materialize(_readings(entities.where("uid is not null and ekey is not null").select("uid", "ekey", "etype", "canon", "aliases")), "readings")
    forms = materialize(_forms(read), "bearers")
    found = components(_class_links(forms), "variants")
    return forms.select("uid", "ekey").distinct().join(found.withColumnRenamed("node", "ekey"), "ekey").select("uid", "ekey", F.col("component").alias("bearer"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """ekey_a, ekey_b: all pairs of a bearer's rows, the lesser first."""
    a = linked.select("uid", "bearer", F.col("ekey").alias("ekey_a"))
    b = linked.select("uid", "bearer", F.col("ekey").alias("ekey_b"))
    return a.join(b, ["uid", "bearer"]).where("ekey_a < ekey_b").select("ekey_a", "ekey_b")


def canonical_entities(entities: DataFrame, linked: DataFrame) -> DataFrame:
    """uid, bearer, canon, spellings: each bearer with its longest spelling and all of them, sorted."""
    there = entities.where("canon is not null").select("uid", "ekey", "canon", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    named = linked.join(there, ["uid", "ekey"])
    spelt = named.select("uid", "bearer", "canon", F.explode(F.array_union(F.array("canon"), "aliases")).alias("s"))
    return spelt.groupBy("uid", "bearer").agg(F.max(F.struct(F.length("canon"), "canon"))["canon"].alias("canon"), F.sort_array(F.collect_set("s")).alias("spellings"))
