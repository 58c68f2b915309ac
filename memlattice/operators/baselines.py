"""Baselines: BM25 over turns, and as much of the transcript as fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.text import content_words, stem
from memlattice.operators import fold

# Fixed values.
K1, B, TOP = 1.5, 0.75, 10


def bm25(questions: DataFrame, turns: DataFrame, k: int = TOP) -> DataFrame:
    """qid, turn, session_ord, turn_idx, score, rank: the k best turns of each question among its user's; only scores above 0.

    Questions' distinct stems meet postings of their user (fold.ranked_turns);
    scores are summed in the stems' order, and ties go to the earlier turn.
    """
    words = lambda c: F.explode_outer(content_words(F.col(c))).alias("_w")
    said = turns.select("uid", "turn", "session_ord", "turn_idx", words("text"))
    docs = said.groupBy("turn", "uid", "session_ord", "turn_idx").agg(F.collect_list(stem(F.col("_w"))).alias("terms"))
    asked = questions.select("qid", "uid", words("question")).groupBy("qid", "uid").agg(F.collect_set(stem(F.col("_w"))).alias("terms"))
    docs = docs.select("uid", F.col("turn").alias("id"), "terms", F.lit(1).alias("hop"), F.col("session_ord").alias("ord"), F.col("turn_idx").alias("event"))
    found = fold.ranked_turns(fold.gathered(asked.select("uid", F.col("qid").alias("id"), "terms"), docs=docs), K1, B, k)
    kinds = dict(turns.dtypes)
    return found.select("qid", "turn", *[F.col(c).cast(kinds[c]).alias(c) for c in ("session_ord", "turn_idx")], "score", "rank")


def as_spans(found: DataFrame) -> DataFrame:
    """qid, position, turn, id, status, highlight_start, highlight_end: BM25's turns in the shape of evidence and in the order they were said; a term index knows no supersession, so all are current."""
    order = Window.partitionBy("qid").orderBy("session_ord", "turn_idx", "turn")
    return found.select("qid", F.row_number().over(order).alias("position"), "turn", F.concat_ws("-", "session_ord", "turn_idx").alias("id"), F.lit("CURRENT").alias("status"), F.lit(0).alias("highlight_start"), F.lit(0).alias("highlight_end"))


def full_context(turns: DataFrame, most: int) -> DataFrame:
    """uid, session_ord, chars, kept: sessions from the newest back until the budget of characters is passed; the newest is always kept."""
    sizes = turns.groupBy("uid", "session_ord").agg(F.sum(F.length("text")).alias("chars"))
    newest = Window.partitionBy("uid").orderBy(F.col("session_ord").desc())
    running = F.sum("chars").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("kept", (F.row_number().over(newest) == 1) | (running <= most))
