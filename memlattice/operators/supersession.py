"""Supersession: which claims of a slot were replaced, by which, and as seen from which session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.memory import contested_slots, slot_positions

#: A policy reads ordered slot lists and answers with uid, skey, older and newer as positions from 1.
Policy = Callable[[DataFrame], DataFrame]


def value_changed(positions: DataFrame) -> DataFrame:
    """The policy for data without a model: a claim is replaced by the next of its slot that has another value."""
    order = Window.partitionBy("skey").orderBy("position")
    # where a run of one value ends, the next claim starts another; every claim of the run is replaced by it
    run = positions.withColumn("_new", F.coalesce(~F.col("slot_value").eqNullSafe(F.lag("slot_value").over(order)), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = run.groupBy("skey", "_run").agg(F.min("position").alias("_first"))
    following = first.select("skey", (F.col("_run") - 1).alias("_run"), F.col("_first").alias("newer"))
    return run.join(following, ["skey", "_run"]).select("uid", "skey", F.col("position").alias("older"), "newer")


def detect(claims: DataFrame, policy: Policy = value_changed) -> DataFrame:
    """uid, skey, older, newer (ckeys), at_session: the valid replacements of the contested slots, each once.

    Positions out of range, self-replacements and those that point back to an
    earlier session are dropped.
    """
    positions = slot_positions(claims).join(contested_slots(claims).select("skey"), "skey", "left_semi")
    listed = positions.select("skey", "position", "ckey", "session_ord")
    older = listed.select("skey", F.col("position").alias("older"), F.col("ckey").alias("_old"), F.col("session_ord").alias("_old_ord"))
    newer = listed.select("skey", F.col("position").alias("newer"), F.col("ckey").alias("_new"), F.col("session_ord").alias("_new_ord"))
    pairs = policy(positions).join(older, ["skey", "older"]).join(newer, ["skey", "newer"])
    valid = pairs.where((F.col("_old") != F.col("_new")) & (F.col("_new_ord") >= F.col("_old_ord")))
    return valid.select("uid", "skey", F.col("_old").alias("older"), F.col("_new").alias("newer"), F.col("_new_ord").alias("at_session")).distinct()


def slot_prompts(claims: DataFrame) -> DataFrame:
    """skey, prompt: what a model is shown of each contested slot: its claims by number, oldest first, with their session and date."""
    listed = slot_positions(claims).join(contested_slots(claims).select("skey"), "skey", "left_semi")
    dated = F.when(F.col("t_event") > 0, F.concat(F.lit(", event "), F.col("t_event"))).otherwise("")
    line = F.concat(F.col("position"), F.lit(". (session "), F.col("session_ord"), dated, F.lit(") "), F.col("text"))
    lines = listed.groupBy("skey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
    return lines.select("skey", F.concat(F.lit("SLOT: "), F.regexp_replace("skey", r"^[^|]*\|s\|", ""), F.lit("\n\nCLAIMS, oldest first:\n"), F.col("_lines")).alias("prompt"))


def fold_edges(edges: DataFrame, as_of: int | None = None) -> DataFrame:
    """older, newer, at_session: of each claim's edges seen by session as_of the earliest, ties by the newer's key; edges without a session are not seen."""
    seen = edges.where("at_session is not null and older is not null and newer is not null")
    if as_of is not None:
        seen = seen.where(F.col("at_session") <= as_of)
    return seen.groupBy("older").agg(F.min(F.struct("at_session", "newer")).alias("m")).select("older", F.col("m.newer").alias("newer"), F.col("m.at_session").alias("at_session"))


def label_as_of(claims: DataFrame, edges: DataFrame, as_of: int | None = None) -> DataFrame:
    """claims up to session as_of with status CURRENT or SUPERSEDED, superseded_by and at_session."""
    seen = claims if as_of is None else claims.where(F.col("session_ord") <= as_of)
    folded = fold_edges(edges, as_of).select(F.col("older").alias("ckey"), F.col("newer").alias("superseded_by"), "at_session")
    joined = seen.join(folded, "ckey", "left")
    return joined.withColumn("status", F.when(F.col("superseded_by").isNull(), "CURRENT").otherwise("SUPERSEDED"))


def chains(claims: DataFrame, edges: DataFrame, as_of: int | None = None) -> DataFrame:
    """skey, position, ckey, text, session_ord, t_event, status, superseded_by, at_session of every slot as seen from session as_of."""
    seen = claims if as_of is None else claims.where(F.col("session_ord") <= as_of)
    labelled = label_as_of(slot_positions(seen), edges, as_of)
    return labelled.select("skey", "position", "ckey", "text", "session_ord", "t_event", "status", "superseded_by", "at_session")
