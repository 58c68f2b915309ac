"""Every version of each slot and the sessions from and to which it held."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.presence import version_validity

#: Fixed value: the label that carries an edge.
SUPERSEDED = "SUPERSEDED"


def latest_delivery(df: DataFrame, key: list[str], arrived: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: that of the last delivery; rows that arrived together are settled by their content.

    With `columns` only those (and the key) are read, kept and settled by; all
    of a row goes through the shuffle otherwise. Keys with a null part are keys
    as well. A key's deliveries are reduced map-side, never gathered.
    """
    if columns:
        return latest_delivery(df.select(*dict.fromkeys([*key, *columns, arrived])), key, arrived).select(*dict.fromkeys([*key, *columns]))
    rest = [c for c in df.columns if c not in key and c != arrived]
    best = df.groupBy(*key).agg(F.max(F.struct(F.col(arrived), *[F.col(c) for c in rest])).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in [*rest, arrived]]).select(*df.columns)


def slot_claims(claims: DataFrame) -> DataFrame:
    """ckey, skey, session_ord of the claims that fill a slot, each once."""
    return latest_delivery(claims.where(F.col("skey").isNotNull() & F.col("ckey").isNotNull()).select("ckey", "skey", "session_ord", "ingested_at"), ["ckey"], "ingested_at").drop("ingested_at")


def candidate_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """older, newer, at_session as edges and SUPERSEDED labels state them, without null parts, each once.

    A label is read again in every later session; taking each edge once before
    any join is what keeps a popular claim from becoming a hot key.
    """
    from_labels = labels.where(F.col("status") == SUPERSEDED).select(F.col("ckey").alias("older"), F.col("superseded_by").alias("newer"), "at_session")
    both = edges.select("older", "newer", "at_session").unionByName(from_labels)
    return both.where(F.col("older").isNotNull() & F.col("newer").isNotNull() & F.col("at_session").isNotNull() & (F.col("older") != F.col("newer"))).groupBy("older", "newer", "at_session").agg(F.lit(1).alias("_")).drop("_")


def valid_edges(slots: DataFrame, edges: DataFrame) -> DataFrame:
    """skey, ckey (the older), newer, at_session of the edges between different claims of one slot that point forward and don't precede the older claim."""
    older = slots.select(F.col("ckey").alias("older"), F.col("skey").alias("_skey"), F.col("session_ord").alias("_ord"))
    newer = slots.select(F.col("ckey").alias("newer"), F.col("skey").alias("_skey"), F.col("session_ord").alias("_new_ord"))
    known = edges.join(older, "older").where(F.col("at_session") >= F.col("_ord"))
    return known.join(newer, ["newer", "_skey"]).where(F.col("_new_ord") >= F.col("_ord")).select(F.col("_skey").alias("skey"), F.col("older").alias("ckey"), "newer", "at_session")


def slot_history(claims: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """skey, ckey, valid_from, valid_to: one row per slot claim.

    valid_to is the end of the first run of the claim's presence bitmap, 0
    while it holds. Redelivered claims, edges and labels count once; edges that
    are null in part, impossible or dangling close nothing; labels other than
    SUPERSEDED are no edges. Claims outside slots have no history. Empty tables
    give no rows, columns beyond those read are ignored.
    """
    slots = slot_claims(claims)
    closings = valid_edges(slots, candidate_edges(edges, labels))
    return version_validity(slots, closings, ["skey", "ckey"], "session_ord", "at_session").select("skey", "ckey", F.col("session_ord").alias("valid_from"), "valid_to")


def slot_timeline(history: DataFrame) -> DataFrame:
    """The history with the number of each version within its slot and whether it is the slot's current one."""
    order = Window.partitionBy("skey").orderBy("valid_from", "ckey")
    return history.withColumn("version", F.row_number().over(order)).withColumn("is_current", F.col("valid_to") == 0)
