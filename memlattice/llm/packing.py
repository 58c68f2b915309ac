"""Filling containers of fixed capacity with texts of varying token length.

Lengths go into a histogram of at most `capacity` entries. Shallow combinations
of lengths that fill a container up to a small window are enumerated, and
non-negative least squares says how often to repeat each so that together they
use up the histogram. The counts are rounded down, every item finds its place in
the plan by its rank among the items of its length, and what is left over is
packed greedily, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.tokenizer import Counter, default_vocabulary
from memlattice.runtime import materialize

#: Tokens of a container that a combination may leave unused.
WINDOW = 8
#: Companions tried for each leading length.
COMPANIONS = 24
#: Steps of the least-squares solver.
STEPS = 400
#: Items of one length that are ranked together, and left-over items packed together.
BLOCK = 20_000


def token_items(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """key, piece_idx, n_pieces, token_from, n_tokens: every text as one item, an oversized one as capacity-sized pieces and a rest.

    Null and empty texts hold no tokens and are no items.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Counter(path)
        for batch in batches:
            n = np.array([tokens(t) for t in batch.column(1).to_pylist()], dtype=np.int64)
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(parts[row].astype(np.int32)), pa.array(start), pa.array(np.minimum(capacity, n[row] - start).astype(np.int32))],
                names=["key", "piece_idx", "n_pieces", "token_from", "n_tokens"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"key {kind}, piece_idx int, n_pieces int, token_from bigint, n_tokens int").withColumnRenamed("key", key)


def combinations(lengths: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Shallow combinations: some copies of a leading length, a companion, and whichever length fills the rest best.

    At most COMPANIONS + 1 for each length, none leaves more than WINDOW.
    """
    found: dict[tuple, dict[int, int]] = {}
    spread = lengths[np.unique(np.linspace(0, len(lengths) - 1, COMPANIONS).astype(int))]

    def fitting(room: int) -> int:
        k = int(np.searchsorted(lengths, room, "right")) - 1
        return int(lengths[k]) if k >= 0 else 0

    for lead in lengths:
        lead = int(lead)
        for companion in [0, *map(int, spread)]:
            for copies in {1, max(1, (capacity - companion) // lead)}:
                room = capacity - companion - copies * lead
                combo = {lead: copies}
                if companion:
                    combo[companion] = combo.get(companion, 0) + 1
                for _ in range(3):
                    more = fitting(room)
                    if room <= 0 or not more:
                        break
                    times = room // more if more * 2 <= room else 1
                    combo[more] = combo.get(more, 0) + times
                    room -= more * times
                if 0 <= room <= WINDOW:
                    found[tuple(sorted(combo.items()))] = combo
    return list(found.values())


def repeat_counts(combos: list[dict[int, int]], lengths: np.ndarray, stock: np.ndarray) -> np.ndarray:
    """How often to use each combination: min ||A x - stock||, x >= 0, by accelerated projected gradients, then rounded down within the stock."""
    if not combos:
        return np.zeros(0, dtype=np.int64)
    where = {int(n): i for i, n in enumerate(lengths)}
    row = np.array([where[n] for c in combos for n in c])
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    val = np.array([k for c in combos for k in c.values()], dtype=float)
    weight = lengths.astype(float) / lengths.max()  # a long item left over costs more room than a short one
    aval = val * weight[row]
    target = stock * weight
    # Row sums times column sums bound the curvature along each coordinate.
    rows = np.bincount(row, aval, len(lengths))
    step = 1.0 / np.maximum(np.bincount(col, aval * rows[row], len(combos)), 1e-12)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(STEPS):
        short = np.bincount(row, aval * y[col], len(lengths)) - target
        new = np.maximum(0.0, y - step * np.bincount(col, aval * short[row], len(combos)))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (was - 1) / t * (new - x), new
    left = stock.astype(np.int64).copy()
    counts = np.zeros(len(combos), dtype=np.int64)
    for k in np.argsort(-x, kind="stable"):
        at = [where[n] for n in combos[k]]
        each = np.array(list(combos[k].values()))
        most = int(np.min(left[at] // each))
        counts[k] = min(int(np.ceil(x[k] - 1e-9)), most)
        left[at] -= each * counts[k]
    return counts


def packing_plan(histogram: pd.DataFrame, capacity: int) -> tuple[pd.DataFrame, int]:
    """The plan's rows (n_tokens, rank_from, rank_to, container, copies) and the number of planned containers.

    The histogram has a row per length, so everything here is bounded by the capacity.
    """
    h = histogram[histogram.n_tokens < capacity].sort_values("n_tokens")
    lengths, stock = h.n_tokens.to_numpy(np.int64), h.n.to_numpy(np.int64)
    combos = combinations(lengths, capacity) if len(lengths) else []
    counts = repeat_counts(combos, lengths, stock)
    rows, used, container = [], dict.fromkeys(map(int, lengths), 0), 0
    for combo, times in zip(combos, map(int, counts), strict=True):
        if times:
            for n, copies in combo.items():
                rows.append((n, used[n], used[n] + copies * times, container, copies))
                used[n] += copies * times
            container += times
    return pd.DataFrame(rows, columns=["n_tokens", "rank_from", "rank_to", "container", "copies"]), container


def greedy(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, best fit over lengths in falling order; open containers are kept by their room."""
    order, place = np.argsort(-lengths, kind="stable"), np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some container has room r
    opened = 0
    for i in order:
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + ((fitting & -fitting).bit_length() - 1)
            box = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, box, opened = capacity, opened, opened + 1
        place[i] = box
        if room - n:
            by_room[room - n].append(box)
            rooms |= 1 << (room - n)
    return place


def _ranked(items: DataFrame, key: str, largest: int) -> DataFrame:
    """items with their rank (from 0) within their length.

    A length that a third of all items share is ranked in slices of about BLOCK
    items, each knowing how many come before it.
    """
    slices = max(1, -(-largest // BLOCK))
    sliced = items.withColumn("_slice", F.pmod(F.xxhash64(key, "piece_idx"), F.lit(slices)))
    before = sliced.groupBy("n_tokens", "_slice").agg(F.count("*").alias("_n"))
    offsets = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).select("n_tokens", "_slice", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "_slice").orderBy(key, "piece_idx")) - 1
    return sliced.withColumn("_in", within).join(offsets, ["n_tokens", "_slice"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_slice", "_in", "_before")


def pack(df: DataFrame, key: str, text: str, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """key, piece_idx, n_pieces, token_from, n_tokens, container: every text with tokens in exactly one container, in one piece unless it alone exceeds the capacity.

    No container holds more than `capacity` tokens. Keys are taken to be unique;
    a key in two rows gives two items. Null and empty texts are no items, an
    empty table has no containers; further columns are ignored. The driver sees
    only the histogram of lengths (at most `capacity` rows) and the plan made
    from it.
    """
    items = materialize(token_items(df, key, text, capacity, vocabulary), "items")
    histogram = items.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()
    plan, planned = packing_plan(histogram, capacity)
    by_length = {int(n): (g.rank_from.to_numpy(), g.rank_to.to_numpy(), g.container.to_numpy(), g.copies.to_numpy()) for n, g in plan.groupby("n_tokens")}
    used = plan.groupby("n_tokens").rank_to.max() if len(plan) else pd.Series(dtype="int64")
    full = int(histogram.loc[histogram.n_tokens >= capacity, "n"].sum())
    left_over = int(histogram.n.sum() - full - used.sum())
    blocks = max(1, -(-left_over // BLOCK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("n_tokens").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            box = np.full(len(length), -1, dtype=np.int64)
            box[length >= capacity] = planned + rank[length >= capacity]
            for n in np.unique(length):
                if int(n) in by_length:
                    low, high, first, copies = by_length[int(n)]
                    mine = np.nonzero(length == n)[0]
                    k = np.searchsorted(low, rank[mine], "right") - 1
                    inside = rank[mine] < high[k]
                    mine, k = mine[inside], k[inside]
                    box[mine] = first[k] + (rank[mine] - low[k]) // copies[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(box)], names=[*batch.schema.names[:-1], "container"])

    kind = items.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece_idx int, n_pieces int, token_from bigint, n_tokens int, container bigint"
    ranked = _ranked(items, key, int(histogram.n.max()) if len(histogram) else 0).select(key, "piece_idx", "n_pieces", "token_from", "n_tokens", "_rank")
    placed = materialize(ranked.mapInArrow(place, schema), "placed")
    base = planned + full

    def rest(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "piece_idx"])
        rows["container"] = base + greedy(rows.n_tokens.to_numpy(), capacity) * blocks + int(block[0])
        return rows.drop(columns="_block")

    packed = placed.where("container < 0").withColumn("_block", F.pmod(F.xxhash64(key, "piece_idx"), F.lit(blocks)).cast("int")).groupBy("_block").applyInPandas(rest, schema)
    return placed.where("container >= 0").unionByName(packed)


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """containers, items, tokens, fill: how full the containers are."""
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("i"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * F.lit(capacity))).alias("fill"))
