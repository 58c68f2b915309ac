"""Tables of the memory, from the deliveries they arrive in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.text import claim_tokens, stems
from memlattice.operators.slot_history import latest_delivery


def role_of(role: Column) -> Column:
    """Whoever isn't the assistant is the user."""
    return F.when(role == "assistant", F.lit("assistant")).otherwise(F.lit("user"))


def turns_of(deliveries: DataFrame, *columns: str) -> DataFrame:
    """Each turn once, its last delivery; texts that are null are ''. With `columns` only turn and those are read."""
    once = latest_delivery(deliveries, ["turn"], "ingested_at", columns)
    clean = {"role": role_of(F.col("role")), "text": F.coalesce("text", F.lit("")), "has_answer": F.coalesce("has_answer", F.lit(False))}
    return once.withColumns({c: v for c, v in clean.items() if c in once.columns})


def claims_of(deliveries: DataFrame, *columns: str) -> DataFrame:
    """Each claim once, its last delivery. With `columns` only ckey and those are read."""
    return latest_delivery(deliveries, ["ckey"], "ingested_at", columns)


def entities_of(rows: DataFrame) -> DataFrame:
    """uid, ekey, canon, etype, aliases, existing: each entity once, aliases of its rows together; rows without a canon are dropped."""
    named = rows.where(F.col("canon").isNotNull() & (F.col("canon") != ""))
    listed = named.withColumn("_alias", F.explode_outer("aliases"))
    return listed.groupBy("uid", "ekey", "canon").agg(F.min("etype").alias("etype"), F.sort_array(F.collect_set("_alias")).alias("aliases"), F.max("existing").alias("existing"))


def sessions_of(turns: DataFrame) -> DataFrame:
    """uid, sid, session_key, session_ord, date_int, ts, n_turns of each session, from its turns."""
    return turns.groupBy("uid", "session_key").agg(F.min("sid").alias("sid"), F.min("session_ord").alias("session_ord"), F.min("date_int").alias("date_int"), F.min("ts").alias("ts"), F.count("*").alias("n_turns")).select("uid", "sid", "session_key", "session_ord", "date_int", "ts", "n_turns")


def order_sessions(sessions: DataFrame, by: list[str]) -> DataFrame:
    """sessions with clock_ord: the number of each within its user by the clock, ties as `by` has them."""
    return sessions.withColumn("clock_ord", F.row_number().over(Window.partitionBy("uid").orderBy(*by)))


def repeat_keys(sessions: DataFrame, order: str) -> DataFrame:
    """sessions with repeat_key: the sid, from its second use by a user on with its number."""
    n = F.row_number().over(Window.partitionBy("uid", "sid").orderBy(order, "session_key"))
    return sessions.withColumn("repeat_key", F.when(n == 1, F.col("sid")).otherwise(F.concat_ws("#", "sid", n)))


def named_in(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """ckey, names: canon and aliases of the entities that each claim mentions, in the order of its mentions; claims without any are left out."""
    there = claims.select("ckey", F.posexplode("mentions").alias("_at", "ekey")).where("ekey is not null")
    named = there.join(entities.select("ekey", "canon", "aliases"), "ekey").select("ckey", F.struct("_at", "canon", F.concat(F.array("canon"), "aliases").alias("names")).alias("_e"))
    return named.groupBy("ckey").agg(F.flatten(F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["names"])).alias("names"))


def tokens_of(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """uid, ckey, tokens: each claim's tokens, from its keywords, the names of the entities it mentions, and its text."""
    return claims.select("uid", "ckey", "text", "keywords").join(named_in(claims, entities), "ckey", "left").select("uid", "ckey", claim_tokens(F.col("text"), F.col("keywords"), F.col("names")).alias("tokens"))


def hits_of(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """uid, stem, ckey: which tokens lead to which claims."""
    return tokens_of(claims, entities).select("uid", F.explode("tokens").alias("stem"), "ckey")


def names_of(entities: DataFrame) -> DataFrame:
    """uid, stem, ekey: which tokens lead to which entities, by any of their names."""
    names = F.concat(F.array("canon"), "aliases")
    return entities.select("uid", "ekey", F.explode(F.array_distinct(F.flatten(F.transform(names, stems)))).alias("stem")).select("uid", "stem", "ekey")


def mentions_of(claims: DataFrame) -> DataFrame:
    """ekey, ckey: which entities are mentioned where, each pair once."""
    return claims.select("ckey", F.explode(F.array_distinct("mentions")).alias("ekey")).where("ekey is not null").select("ekey", "ckey")


def docs_of(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """uid, id, terms, hop, ord, event, skey: which terms lead to which claims, in one hop by a claim's tokens, in two by the names of an entity it mentions (uid is the entity's)."""
    ranked = [F.col("ckey").alias("id"), F.col("session_ord").alias("ord"), F.col("t_event").alias("event"), "skey"]
    own = tokens_of(claims, entities).join(claims.select("ckey", "session_ord", "t_event", "skey"), "ckey").select("uid", "tokens", F.lit(1).alias("hop"), *ranked)
    named = entities.select("uid", "ekey", F.array_distinct(F.flatten(F.transform(F.concat(F.array("canon"), "aliases"), stems))).alias("tokens"))
    there = claims.select("ckey", "session_ord", "t_event", "skey", F.explode(F.array_distinct("mentions")).alias("ekey")).where("ekey is not null and ckey is not null")
    by_name = there.join(named, "ekey").select("uid", "tokens", F.lit(2).alias("hop"), *ranked)
    return own.unionByName(by_name).withColumnRenamed("tokens", "terms")


def token_df(hits: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """uid, stem, df: claims that each token leads to; tokens that only name entities have 0."""
    counted = hits.groupBy("uid", "stem").agg(F.count_distinct("ckey").alias("df"))
    if names is None:
        return counted
    return names.select("uid", "stem").distinct().join(counted, ["uid", "stem"], "full_outer").select("uid", "stem", F.coalesce("df", F.lit(0)).alias("df"))


def slots_of(claims: DataFrame) -> DataFrame:
    """uid, skey, n_claims of each slot."""
    return claims.where("skey is not null and skey <> ''").groupBy("uid", "skey").agg(F.count("*").alias("n_claims"))


def contested_slots(claims: DataFrame) -> DataFrame:
    """The slots with two claims or more."""
    return slots_of(claims).where("n_claims >= 2")


def largest_slots(claims: DataFrame) -> DataFrame:
    """uid, skey, n_claims: the contested slot of each user with the most claims, the first by key among equals."""
    return contested_slots(claims).groupBy("uid").agg(F.min(F.struct((-F.col("n_claims")).alias("n"), "skey")).alias("m")).select("uid", "m.skey", (-F.col("m.n")).alias("n_claims"))


def top_tokens(df: DataFrame, most: int = 10) -> DataFrame:
    """The tokens that lead to the most claims, ties by user and token."""
    return df.orderBy(F.col("df").desc(), "uid", "stem").limit(most)


def slot_positions(claims: DataFrame) -> DataFrame:
    """uid, skey, ckey, text, session_ord, t_event, slot_value, position: the claims of each slot in order, from 1."""
    order = Window.partitionBy("skey").orderBy("session_ord", "t_event", "ckey")
    return claims.where("skey is not null and skey <> ''").select("uid", "skey", "ckey", "text", "session_ord", "t_event", "slot_value").withColumn("position", F.row_number().over(order))


def supersessions_of(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, older, newer: the edges between two claims that are there, out of those that fill a contested slot, each once; uid is the older claim's."""
    filling = claims.select("uid", "skey", F.col("ckey").alias("older")).join(contested_slots(claims).select("skey"), "skey", "left_semi").select("uid", "older")
    known = edges.where("older is not null and newer is not null").select("older", "newer").distinct()
    return known.join(filling, "older").join(claims.select(F.col("ckey").alias("newer")), "newer", "left_semi").select("uid", "older", "newer")


def user_stats(claims: DataFrame, entities: DataFrame, turns: DataFrame, edges: DataFrame) -> DataFrame:
    """uid and eight counts of what is remembered of each user; a user without rows of a kind has 0 of it."""
    hits, names = hits_of(claims, entities), names_of(entities)
    slots = slots_of(claims)
    parts = [
        claims.groupBy("uid").agg(F.count("*").alias("claims")),
        entities.groupBy("uid").agg(F.count("*").alias("entities")),
        slots.groupBy("uid").agg(F.count("*").alias("slots"), F.count_if(F.col("n_claims") >= 2).alias("contested_slots")),
        token_df(hits, names).groupBy("uid").agg(F.count("*").alias("tokens")),
        turns.groupBy("uid").agg(F.count("*").alias("turns"), F.count_distinct("session_key").alias("sessions")),
        supersessions_of(claims, edges).groupBy("uid").agg(F.count("*").alias("supersessions")),
    ]
    counts = ["claims", "entities", "slots", "tokens", "sessions", "turns", "supersessions", "contested_slots"]
    # one shuffle: the parts, a row for each user, are stacked and summed
    stacked = None
    for part in parts:
        row = part.select("uid", *[(F.col(c) if c in part.columns else F.lit(0)).cast("bigint").alias(c) for c in counts])
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.groupBy("uid").agg(*[F.sum(c).alias(c) for c in counts])
