"""Splitting of oversized texts at natural boundaries by dynamic programming.

Candidate cuts are the natural boundaries of the text, each with a penalty by
its kind. The programme picks the cuts whose penalties and size imbalances add
up to the least, under a limit in UTF-8 bytes that includes the overlap
repeated from the piece before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of boundary, from the best: the pattern whose match ends at the cut, and the penalty of a cut there.
BOUNDARIES = (
    (re.compile(r"\n[^\S\n]*\n\s*"), 0.0),
    (re.compile(r"\n\s*"), 0.4),
    (re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+"), 0.8),
    (re.compile(r"[,;:–—][\"'”’»)\]]*\s+"), 2.0),
    (re.compile(r"\s+"), 3.0),
)
#: Penalty of a cut inside a word, between two grapheme clusters.
ANYWHERE = 12.0
#: Weight of a piece's squared deviation from equal size, and the price of one more piece.
IMBALANCE, PIECE = 4.0, 3.0
#: Finer boundaries are offered only where coarser ones leave a gap beyond this share of the limit.
GAP_SHARE = 1 / 8
#: Boundaries of one kind within such a gap are offered at no less than this share of the limit from each other.
STEP_SHARE = 1 / 400

_CLINGS = re.compile("[̀-ͯ҃-҉֑-ֽً-़ٟ-्ัิ-ฺ᪰-᫿᷀-᷿‍⃐-⃿︀-️︠-︯\U0001f3fb-\U0001f3ff]")


def _byte_offsets(text: str) -> np.ndarray:
    """Bytes of UTF-8 before each character, and in all."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def _candidates(text: str, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    n, gap, step = len(text), max(1, int(limit * GAP_SHARE)), max(1, int(limit * STEP_SHARE))
    penalty: dict[int, float] = {0: 0.0, n: 0.0}
    for pattern, cost in (*BOUNDARIES, (None, ANYWHERE)):
        at = np.array(sorted(penalty))
        wide = np.nonzero(np.diff(offsets[at]) > gap)[0]
        if not len(wide):
            break
        for k in wide:
            low, high = int(at[k]), int(at[k + 1])
            if pattern is None:
                cuts = _grapheme_starts(text, low, high)
            else:
                cuts = (m.end() for m in pattern.finditer(text, low, high))
            last = offsets[low]
            for cut in cuts:
                if low < cut < high and offsets[cut] - last >= step:
                    penalty[cut], last = cost, offsets[cut]
    at = np.array(sorted(penalty))
    return at, np.array([penalty[int(p)] for p in at])


def _grapheme_starts(text: str, low: int, high: int) -> Iterator[int]:
    for i in range(low + 1, high):
        if not _CLINGS.match(text, i) and text[i - 1] != "‍":
            yield i


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Where the pieces after the first begin their own new text; empty if the text fits."""
    offsets = _byte_offsets(text)
    if offsets[-1] <= limit:
        return []
    room = limit - 4 * overlap
    if room < 8:
        raise ValueError("the limit leaves no room beside the overlap")
    at, penalty = _candidates(text, offsets, room)
    return _least_cost(at, penalty, offsets, limit, overlap) or _fallback(text, offsets, limit, overlap)


def _least_cost(at: np.ndarray, penalty: np.ndarray, offsets: np.ndarray, limit: int, overlap: int) -> list[int]:
    total, ends = offsets[-1], offsets[at]
    begins = offsets[np.maximum(0, at - overlap)]  # a piece that starts at this cut repeats the characters before it
    count = int(np.ceil((total - limit) / max(1, limit - overlap)) + 1)
    target = total / count
    cost, back = np.full(len(at), np.inf), np.full(len(at), -1)
    cost[0], low = 0.0, 0
    for j in range(1, len(at)):
        while ends[j] - begins[low] > limit:
            low += 1
        if low >= j:
            continue
        piece = cost[low:j] + IMBALANCE * ((ends[j] - ends[low:j]) / target - 1.0) ** 2
        k = int(np.argmin(piece))
        if np.isfinite(piece[k]):
            cost[j], back[j] = piece[k] + penalty[j] + PIECE, low + k
    cuts, j = [], len(at) - 1
    if back[j] < 0:
        return []
    while back[j] > 0:
        j = int(back[j])
        cuts.append(int(at[j]))
    return cuts[::-1]


def _fallback(text: str, offsets: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Cuts between any two characters: for texts whose clusters alone exceed the limit."""
    at = np.arange(len(text) + 1)
    return _least_cost(at, np.full(len(at), ANYWHERE), offsets, limit, overlap)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """start, new_start, text of each piece: it begins at start, and what it adds to the pieces before begins at new_start."""
    cuts = [0, *cut_points(text, limit, overlap), len(text)]
    return [(max(0, a - overlap) if a else 0, a, text[max(0, a - overlap) if a else 0 : b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def join_pieces(parts: list[tuple[int, int, str]]) -> str:
    """The text again."""
    return "".join(text[new - start :] for start, new, text in parts)


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 30_000, overlap: int = 200, arrived: str | None = None) -> DataFrame:
    """key, piece_idx, n_pieces, start_pos, new_from, n_bytes, piece of every text beyond the limit.

    Pieces are numbered from 0 and have at most `limit` UTF-8 bytes; each after
    the first begins with the last `overlap` characters of the one before, and
    the parts from new_from on, joined in order, are the text. Texts within the
    limit, empty and null ones have no rows. A key delivered several times is
    cut once (the last delivery that exceeds the limit); a null key is a key.
    Only oversized texts leave the JVM or are shuffled. Further columns are
    ignored.
    """
    order = [F.col("_at").desc_nulls_last()] if arrived else []
    big = df.where(F.octet_length(text) > limit).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), (F.col(arrived) if arrived else F.lit(None)).alias("_at"))
    once = big.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order, "_text"))).where("_n = 1").select("_key", "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = pieces(value, limit, overlap)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": [one] * len(parts),
                        "piece_idx": list(range(len(parts))),
                        "n_pieces": [len(parts)] * len(parts),
                        "start_pos": [p[0] for p in parts],
                        "new_from": [p[1] - p[0] for p in parts],
                        "n_bytes": [len(p[2].encode("utf-8", "surrogatepass")) for p in parts],
                        "piece": [p[2] for p in parts],
                    },
                    schema=pa.schema([("key", pa.string()), ("piece_idx", pa.int32()), ("n_pieces", pa.int32()), ("start_pos", pa.int32()), ("new_from", pa.int32()), ("n_bytes", pa.int32()), ("piece", pa.string())]),
                )

    out = once.mapInArrow(cut, "key string, piece_idx int, n_pieces int, start_pos int, new_from int, n_bytes int, piece string")
    return out.withColumnRenamed("key", key)
