"""Texts cut off by a field limit or in transfer.

Fixed limits: for each source, the hazard of a text to end at exactly n
characters, among those that reach n, is held against the hazards around n;
lengths whose excess survives false-discovery control are limits, and there an
unfinished ending is a cut, whatever its words. Elsewhere no limit explains the
end of a text, and only its words can tell: a model of sentence endings (endings)
says how likely the last words end a sentence and how likely the last word is
whole. What it counts, and the closing lines that many texts share, are counted
over all texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.endings import DOTS, ELLIPSIS, ORDER, EndingModel, last_tokens, whole_endings
from memlattice.runtime import materialize

#: Lengths on either side that a length is held against, and the false discovery rate.
NEIGHBOURS, FDR = 40, 0.01
#: A limit stops at least so many texts, and several times what the lengths around would.
LEAST_TEXTS, LEAST_RATIO = 4, 4.0
#: At a limit at least this share of the texts ends with nothing that closes them; a length that many whole texts happen to have is none.
LEAST_OPEN = 0.4
#: A last line of at most so many characters is a closing formula if that share of all different texts (and three at least) ends with it, so there are at most 1 / FORMULA_SHARE.
FORMULA_CHARS, FORMULA_SHARE = 40, 0.0004
#: Below this probability of being a whole ending, a text that doesn't end at a limit counts as cut; one that is marked as broken off, below the other.
WHOLE, WHOLE_MARKED = 0.3, 0.6

_STOPS, _AFTER_STOPS = tuple(".!?。！？"), "\"'”’»)]*_"
_WRAPPED = re.compile(r"(?:</?[A-Za-z][\w-]*>|\"?\s*[}\]]+|\"\s*[,;]?)\s*$")
_TRAILER = re.compile(r"\n\s*(?:-{2,}|={2,}|\*{3,}|_{3,})\s*\n?[^\n.!?]{0,60}$")
_CUT_NOTE = re.compile(r"\s*[\[(<](?:\.{3}|…|\w+ )*(?:truncated|cut|snip|more|continued|gekürzt|suite|sigue)[^\])>]{0,30}[\])>]$", re.IGNORECASE)
_LINK = re.compile(r"https?://\S+$")
_ENDS = ".!?…"
_BETWEEN = re.compile(r"[.!?…](?:\n|\s+)|\n")
_NUMBERED = re.compile(r"^\s*\d+[.)]\s+\S+$")


def judge(model: EndingModel, text: str) -> tuple[str, float]:
    """How a text ends, and the probability that the ending is whole."""
    kind, asked = ending(model, text)
    return kind, model.whole(asked) if asked else float(kind != "lost")


def ending(model: EndingModel, whole_text: str) -> tuple[str, str | None]:
    """How a text ends: 'lost' (bytes of the last character are gone), 'stopped' (by a full stop or the like), 'closed' (by something that
    ends texts on purpose), 'marked' (broken off and marked so), 'open' (by neither); and the text whose last words say whether the ending
    is whole, where that is in question. Of the model only the closing formulas count."""
    text, marked = _bared(whole_text)
    kind, asked = _told(text, marked)
    return ("closed", None) if kind != "lost" and text and model.formulaic(text) else (kind, asked)


def _bared(whole_text: str) -> tuple[str, bool]:
    """A text without what was put after a break, and whether there was such."""
    text = whole_text.rstrip()
    marked = False
    for _ in range(4):
        was = text
        for pattern, closing in ((_TRAILER, ""), (_CUT_NOTE, "])>"), (_WRAPPED, ">}]\",;")):
            if text[-1:] not in closing if closing else not any(map(text.__contains__, ("--", "==", "***", "___"))):
                continue
            m = pattern.search(text)
            if m and m.start() > 0 and not (pattern is _WRAPPED and _balanced(text, m.group())):
                text, marked = text[: m.start()].rstrip(), True
        if text == was:
            break
    return text, marked


def _told(text: str, marked: bool) -> tuple[str, str | None]:
    """What ending() says of a bared text, closing formulas aside."""
    if text.endswith("�"):
        return "lost", None
    if not text:
        return "closed", None
    if text.endswith(DOTS):
        attached = ELLIPSIS.sub("", text)
        return "marked", attached or None
    if text.rstrip(_AFTER_STOPS).endswith(_STOPS):
        return "stopped", None
    last = text.rpartition("\n")[2]
    if _LINK.search(text.rsplit(None, 1)[-1]) or last.strip() == "```" or unicodedata.category(text[-1]) in ("So", "Sk") or _NUMBERED.match(last):
        return "closed", None
    return ("marked" if marked else "open"), text


def _balanced(text: str, closing: str) -> bool:
    """Whether a closing mark at the end belongs to an opening one in the text."""
    name = re.match(r"</([A-Za-z][\w-]*)>", closing)
    if name:
        return f"<{name.group(1)}" in text[: -len(closing)]
    mark = closing.strip()[-1:]
    pair = {"}": "{", "]": "["}.get(mark)
    return text.count(pair) >= text.count(mark) if pair else text.count('"') % 2 == 0


def length_limits(counts: DataFrame, source: str, length: str, texts: str) -> DataFrame:
    """source, length, texts, at_risk, hazard, expected: the lengths at which a source stops far more texts than around them.

    counts has one row for each source and length, and so have the tables the
    windows run over. Benjamini-Hochberg within each source; a null source is one of its own.
    """
    counts = counts.select(source, length, F.col(texts).alias("texts"))
    down = Window.partitionBy(source).orderBy(F.col(length).desc()).rowsBetween(Window.unboundedPreceding, 0)
    around = Window.partitionBy(source).orderBy(F.col(length)).rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    risk = counts.withColumn("at_risk", F.sum("texts").over(down))
    near = risk.withColumn("_texts", F.sum("texts").over(around) - F.col("texts")).withColumn("_hazard", (F.col("_texts") + 0.5) / F.lit(2 * NEIGHBOURS) / F.col("at_risk"))
    expected = near.withColumn("hazard", F.col("texts") / F.col("at_risk")).withColumn("expected", F.col("_hazard") * F.col("at_risk")).drop("_texts", "_hazard")

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p=[_poisson_tail(int(n), x) if n >= LEAST_TEXTS and n >= LEAST_RATIO * x else 1.0 for n, x in zip(f.texts, f.expected, strict=True)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in expected.schema) + ", p double"
    tested = expected.mapInPandas(tails, schema)
    size = Window.partitionBy(source)
    ranked = tested.withColumn("_m", F.count("*").over(size)).withColumn("_k", F.row_number().over(size.orderBy("p", length)))
    passed = ranked.withColumn("_cut", F.max(F.when(F.col("p") <= F.col("_k") * F.lit(FDR) / F.col("_m"), F.col("_k"))).over(size))
    return passed.where("p < 1 and _k <= _cut").drop("_m", "_k", "_cut", "p")


def _poisson_tail(n: int, mean: float) -> float:
    """P(X >= n), summed from its largest term as n is above the mean."""
    term = math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))
    total, k = 0.0, n
    while term > total * 1e-12 and k < n + 1000:
        total, k = total + term, k + 1
        term *= mean / k
    return total


def begun_with(pieces: set[str]) -> Callable[[str], Iterator[str]]:
    """Finds of a text each of the pieces that a longer line or sentence of it begins with, as often as one does.

    A line or sentence begins where the text does and after every _BETWEEN. The
    pattern finds those before the first two characters of a piece, and inside
    white space after the end of a sentence some that are none.
    """
    sizes: dict[str, set[int]] = defaultdict(set)
    second: dict[str, set[str]] = defaultdict(set)
    for p in pieces:
        sizes[p[:3]].add(len(p))
        second[p[0]].add(p[1:2])
    heads, sizes = sorted({len(h) for h in sizes}), dict(sizes)
    first = "|".join(re.escape(c) + ("" if "" in after else f"[{''.join(map(re.escape, sorted(after)))}]") for c, after in sorted(second.items()))
    start = re.compile(rf"[{_ENDS}\n](?>(?<=\n)|\n|\s+)(?={first})")

    def inside(text: str, begin: int) -> bool:
        """Whether the line break before is part of the white space after the end of a sentence, which goes on."""
        k = begin - 1
        while k > 0 and text[k].isspace():
            k -= 1
        return text[begin - 1] == "\n" and text[k] in _ENDS and text[k + 1] != "\n" and text[begin].isspace()

    def found(text: str) -> Iterator[str]:
        for begin in (0, *(m.end() for m in start.finditer(text))):
            for head in heads:
                for n in sizes.get(text[begin : begin + head], ()):
                    if text[begin : begin + n] in pieces and not (begin and inside(text, begin)):
                        m = _BETWEEN.search(text, begin)
                        if n < (m.start() + (text[m.start()] != "\n") if m else len(text)) - begin:
                            yield text[begin : begin + n]

    return found


def closing_formulas(docs: DataFrame, text: str, pieces: DataFrame, rows: int) -> set[str]:
    """Last lines that many texts end with on purpose: shared ones that other lines or sentences don't begin with.

    pieces has piece (null beyond FORMULA_CHARS) and the hash h of each text;
    copies of a text count once. What comes to the driver is at most
    1 / FORMULA_SHARE lines.
    """
    least = max(3, int(math.ceil(FORMULA_SHARE * rows)))
    shared = pieces.where("piece <> ''").select("piece", "h").distinct().groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = {r["piece"]: r["n"] for r in shared.collect()}
    if not counts:
        return set()
    wanted = set(counts)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        find = begun_with(wanted)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(find(value))
        yield pa.RecordBatch.from_pydict({"piece": list(seen), "n": list(seen.values())}, schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    longer = {r["piece"]: r["n"] for r in docs.select(text).mapInArrow(begun, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    return {p for p, n in counts.items() if longer.get(p, 0) < n}


def truncation(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source, n_chars, at_limit, ending, p_whole, by_limit, by_ending, is_cut for every text that is not null.

    by_limit: the text has a length that is a limit of its source and an ending
    that nothing closes. by_ending: no limit explains its length, and its last
    bytes are broken or its ending is unlikely to be whole. is_cut: either.
    Texts are judged whole, however long. An empty text is not cut; a null
    source is a source of its own, to which every limit found applies. Keys
    repeat in the result as they do in the table; a table without texts gives
    no rows; further columns are ignored.
    """
    there = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.length(text).alias("_n"), F.col(text).alias("_text"))

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for whole_text in batch.column(4).to_pylist():
                text, marked = _bared(whole_text)
                kind, asked = _told(text, marked)
                own = last = EndingModel._last_piece(whole_text)
                if marked:
                    last = EndingModel._last_piece(text)
                if kind == "lost" or not text:
                    last = None
                elif len(last) > FORMULA_CHARS:  # of a formula behind other words there is a blank before
                    last = last[-FORMULA_CHARS - 1 :] if last.endswith(DOTS) else None
                found.append((own if len(own) <= FORMULA_CHARS else None, kind, " ".join(last_tokens(asked)[-ORDER:]) if asked else None, last))
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, pa.string()) for c in columns)], names=["_key", "_source", "_n", "h", "piece", "ending", "tail", "last"])

    kind = there.schema["_key"].dataType.simpleString()
    hashed = there.select("_key", "_source", "_n", F.xxhash64("_text").alias("h"), "_text")
    ends = materialize(hashed.mapInArrow(endings, f"_key {kind}, _source string, _n int, h bigint, piece string, ending string, tail string, last string"), "endings")
    lengths = materialize(ends.groupBy("_source", "_n").agg(F.count("*").alias("_rows")), "lengths")
    rows = lengths.agg(F.sum("_rows")).first()[0] or 0
    limits = materialize(length_limits(lengths, "_source", "_n", "_rows"), "limits")
    formulas = closing_formulas(there, "_text", ends.select("piece", "h"), rows)
    trailing = [F.lit(" " + f) for f in sorted(formulas) if ELLIPSIS.search(f)]
    formulaic = F.col("last").isin(*sorted(formulas))
    if trailing:
        dotted = reduce(lambda a, b: a | b, (F.col("last").endswith(d) for d in DOTS))
        formulaic = formulaic | dotted & F.exists(F.array(*trailing), lambda f: F.endswith(F.col("last"), f))
    formulaic = F.coalesce(formulaic, F.lit(False))
    ends = ends.select("_key", "_source", "_n", F.when(formulaic, "closed").otherwise(F.col("ending")).alias("ending"), F.when(~formulaic, F.col("tail")).alias("tail"))
    p_whole = whole_endings(there.select("_text"), ends.where("tail IS NOT NULL").select("tail").distinct())
    ends = ends.join(p_whole, "tail", "left").withColumn("p_whole", F.coalesce("p", (F.col("ending") != "lost").cast("double"))).drop("tail", "p")
    unclosed = F.col("ending").isin("open", "marked", "lost")
    open_share = ends.groupBy(F.col("_source").alias("_s"), F.col("_n").alias("_l")).agg(F.avg(unclosed.cast("int")).alias("_open"))
    limits = limits.join(open_share, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_n") == F.col("_l"))).where(F.col("_open") >= LEAST_OPEN).drop("_s", "_l")
    own = limits.where(F.col("_source").isNotNull()).select(F.col("_source").alias("_s"), F.col("_n").alias("_l"), F.lit(False).alias("_any"))
    anyone = limits.select("_n").distinct().select(F.lit(None).cast("string").alias("_s"), F.col("_n").alias("_l"), F.lit(True).alias("_any"))
    at = own.unionByName(anyone)
    joined = ends.join(at, (ends["_n"] == at["_l"]) & ends["_source"].eqNullSafe(at["_s"]), "left").withColumn("at_limit", F.col("_l").isNotNull())
    by_limit = F.col("at_limit") & unclosed
    likely_cut = F.col("p_whole") < F.when(F.col("ending") == "marked", WHOLE_MARKED).otherwise(WHOLE)
    by_ending = ~F.col("at_limit") & ((F.col("ending") == "lost") | (F.col("ending").isin("open", "marked") & likely_cut))
    told = joined.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_n").alias("n_chars"), "at_limit", "ending", "p_whole", by_limit.alias("by_limit"), by_ending.alias("by_ending"))
    return told.withColumn("is_cut", F.col("by_limit") | F.col("by_ending"))


def truncation_rates(found: DataFrame, source: str) -> DataFrame:
    """source, texts, cut, by_limit, by_ending, share: how often each source truncates."""
    return found.groupBy(source).agg(F.count("*").alias("texts"), F.count_if("is_cut").alias("cut"), F.count_if("by_limit").alias("by_limit"), F.count_if("by_ending").alias("by_ending")).withColumn("share", F.col("cut") / F.col("texts"))
