"""Reconciliation of entities that share a name under stemming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions.text import match_keys
from memlattice.operators.components import components

# Kinds of entities, the more telling first.
ETYPES = ("self", "person", "pet", "place", "org", "event", "thing", "topic")


def name_links(entities: DataFrame) -> DataFrame:
    """uid, a, b: canons linked to the least canon that has a match key with them; a star for each key, so a common key makes no pairs."""
    keyed = entities.select("uid", "canon", F.explode(match_keys(F.col("canon"), F.col("aliases"))).alias("key"))
    first = keyed.groupBy("uid", "key").agg(F.min("canon").alias("b"))
    return keyed.join(first, ["uid", "key"]).select("uid", F.col("canon").alias("a"), "b").distinct()


def reconcile(entities: DataFrame) -> DataFrame:
    """uid, canon (as written), new_canon, of each entity.

    The transitive closure of name_links. Of a component the least canon that
    exists already wins, else the least. Rows without a user or a canon are
    dropped, repeated rows count once.
    """
    there = entities.where("uid is not null and canon is not null and canon <> ''")
    members = there.groupBy("uid", "canon").agg(F.max(F.coalesce("existing", F.lit(False))).alias("existing"))
    links = name_links(there).where("a <> b").select(F.struct("uid", F.col("a").alias("canon")).alias("a"), F.struct("uid", F.col("b").alias("canon")).alias("b"))
    found = components(links, "canon").select("node.uid", "node.canon", F.col("component.canon").alias("label"))
    labels = members.join(found, ["uid", "canon"], "left").withColumn("label", F.coalesce("label", "canon"))
    chosen = labels.groupBy("uid", "label").agg(F.min(F.struct(~F.col("existing"), F.col("canon"))).alias("m")).select("uid", "label", F.col("m.canon").alias("new_canon"))
    return labels.join(chosen, ["uid", "label"]).select("uid", "canon", "new_canon")


def canon_drift(entities: DataFrame) -> DataFrame:
    """uid, canon, cold, warm: names that are chosen otherwise when some entities exist already than when all are new."""
    cold = reconcile(entities.withColumn("existing", F.lit(False))).withColumnRenamed("new_canon", "cold")
    return cold.join(reconcile(entities).withColumnRenamed("new_canon", "warm"), ["uid", "canon"]).where("cold <> warm").select("uid", "canon", "cold", "warm")


def merged_entities(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """uid, canon, etype, aliases: one row per component, its aliases and renamed canons together, its kind the most telling."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in ETYPES]), F.col("etype")), F.lit(0))
    there = entities.where("canon is not null and canon <> ''").join(renames, ["uid", "canon"])
    named = there.select("uid", "canon", "new_canon", F.when(rank == 0, len(ETYPES)).otherwise(rank).alias("_rank"), F.explode(F.concat(F.array("canon"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"))
    grouped = named.groupBy("uid", "new_canon").agg(F.min("_rank").alias("_rank"), F.sort_array(F.collect_set("_name")).alias("_names"))
    return grouped.select("uid", F.col("new_canon").alias("canon"), F.element_at(F.array(*[F.lit(t) for t in ETYPES]), F.col("_rank").cast("int")).alias("etype"), F.filter("_names", lambda n: n != F.col("new_canon")).alias("aliases"))


def rename_mentions(mentions: DataFrame, renames: DataFrame) -> DataFrame:
    """uid, canon, ckey: mentions under the canons that were chosen; canons without a rename stay."""
    return mentions.join(renames, ["uid", "canon"], "left").select("uid", F.coalesce("new_canon", "canon").alias("canon"), "ckey").distinct()
