"""Sessions as they are posted: the same functions as in bulk, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import keys
from memlattice.functions.dates import session_stamp
from memlattice.operators import canon, memory, models, supersession
from memlattice.runtime import materialize, release
from memlattice.sources.store import Store
from memlattice.sources.transcripts import turns_from

POSTED = "uid string, date string, turns array<struct<role:string,content:string>>"
PLACED = "uid string, sid string, session_key string, session_ord int, date_int int, ts bigint, turns array<struct<role:string,content:string>>"
SESSIONS = "uid string, sid string, session_key string, session_ord int, date_int int, ts bigint, n_turns int"
TURNS = "turn string, uid string, sid string, session_key string, session_ord int, date_int int, ts bigint, turn_idx int, role string, text string, has_answer boolean"
CLAIMS = (
    "ckey string, uid string, skey string, text string, speaker string, ctype string, session_ord int, t_event int, t_prec string, sid string, turn_idx int, cs int, ce int, session_date int, located string, "
    "mentions array<string>, keywords array<string>, slot_value string"
)
ENTITIES = "uid string, ekey string, canon string, etype string, aliases array<string>, existing boolean"
EDGES = "uid string, skey string, older string, newer string, at_session int"
WRITES = "uid string, session_key string, session_ord int, n_claims int, token_hits array<string>"
TABLES = {"sessions": SESSIONS, "turns": TURNS, "claims": CLAIMS, "entities": ENTITIES, "edges": EDGES, "session_writes": WRITES}


def _placed(store: Store, posted: DataFrame) -> DataFrame:
    """The new sessions of a batch, each after all that its user has."""
    known = store.read("sessions", SESSIONS)
    sid = keys.live_session_id(F.col("date"), F.transform("turns", lambda t: F.coalesce(t["content"], F.lit(""))))
    dated = posted.where("size(turns) > 0").select("uid", sid.alias("sid"), session_stamp(F.col("date")).alias("_d"), "turns").where("_d is not null")
    fresh = dated.dropDuplicates(["uid", "sid"]).join(known.select("uid", "sid"), ["uid", "sid"], "left_anti")
    last = known.groupBy("uid").agg(F.max("session_ord").alias("_last"))
    place = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("uid").orderBy("_d.ts", "sid"))
    return fresh.join(last, "uid", "left").select("uid", "sid", F.col("sid").alias("session_key"), place.cast("int").alias("session_ord"), "_d.date_int", "_d.ts", "turns")


def reconciled(claims: DataFrame, named: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims with their mentions and slots under the canons chosen, and the entities (layout of ENTITIES) that they mention.

    named has ckey, uid, canon, etype and aliases of what the claims mention,
    known what is remembered already. A canon that is known wins over a new one;
    what was written before keeps its keys.
    """
    users = claims.select("uid").distinct()
    old = known.join(users, "uid", "left_semi").select("uid", "canon", "aliases", F.lit(True).alias("existing"))
    new = named.select("uid", "canon", "aliases", F.lit(False).alias("existing"))
    renames = materialize(canon.reconcile(old.unionByName(new)), "renames")
    renamed = materialize(named.join(renames, ["uid", "canon"]), "renamed")
    spelt = renamed.withColumn("_name", F.explode(F.concat(F.array("canon"), F.coalesce("aliases", F.array().cast("array<string>")))))
    grouped = spelt.groupBy("uid", F.col("new_canon").alias("canon")).agg(F.min("etype").alias("etype"), F.sort_array(F.collect_set("_name")).alias("_names"))
    there = old.select("uid", "canon", F.lit(True).alias("existing")).distinct()
    entities = grouped.join(there, ["uid", "canon"], "left").select("uid", keys.entity_key(F.col("uid"), F.col("canon")).alias("ekey"), "canon", "etype", F.filter("_names", lambda n: n != F.col("canon")).alias("aliases"), F.coalesce("existing", F.lit(False)).alias("existing"))
    mentions = renamed.groupBy("ckey").agg(F.sort_array(F.collect_set(keys.entity_key(F.col("uid"), F.col("new_canon")))).alias("_mentions"))
    part = F.split("skey", "\\|")
    slot = F.when(F.size(part) == 4, F.concat_ws("|", F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.coalesce("new_canon", F.get(part, F.lit(2))), F.get(part, F.lit(3)))).otherwise(F.col("skey"))
    joined = claims.withColumn("canon", F.get(part, F.lit(2))).join(renames, ["uid", "canon"], "left").join(mentions, "ckey", "left")
    return joined.withColumn("skey", slot).withColumn("mentions", F.coalesce("_mentions", "mentions")).select(*claims.columns), entities


def session_writes(sessions: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """uid, session_key, session_ord, n_claims, token_hits (one entry per claim and token) of each session."""
    tokens = memory.tokens_of(claims, entities).join(claims.select("ckey", "session_ord"), "ckey")
    counted = tokens.groupBy("uid", "session_ord").agg(F.count("*").cast("int").alias("n_claims"), F.sort_array(F.flatten(F.collect_list("tokens"))).alias("token_hits"))
    return sessions.select("uid", "session_key", "session_ord").join(counted, ["uid", "session_ord"], "left").select("uid", "session_key", "session_ord", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("token_hits", F.array().cast("array<string>")).alias("token_hits"))


def ingest_batch(store: Store, posted: DataFrame, batch: int, extractor: models.Extractor = models.sentence_claims, policy: supersession.Policy = supersession.value_changed, namer: models.Namer = models.capitalised_names) -> dict[str, int]:
    """Add the sessions of a batch to the store; how many rows of each table it wrote.

    A session posted before, in this batch or another, is no new one. New ones
    are placed after all that their user has, in the order of their dates, and
    only the slots they touch are looked at again; backdated sessions still
    come last. Sessions without turns or with an unreadable date are dropped.
    A batch number that was committed is left as it is; one that failed on the
    way, wherever that was, is done again from the start and then seen whole.
    """
    if not store.begin(batch):
        return {name: store.of_batch(name, schema, batch).count() for name, schema in TABLES.items()}
    # each table is written before the next is made from it, so no step computes another again
    store.append("posted", _placed(store, posted), batch)
    new = store.of_batch("posted", PLACED, batch)
    store.append("sessions", new.select("uid", "sid", "session_key", "session_ord", "date_int", "ts", F.size("turns").alias("n_turns")), batch)
    store.append("turns", turns_from(new.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), F.lit(False).alias("has_answer"))))), batch)
    drawn = materialize(extractor(store.of_batch("turns", TURNS, batch)), "drawn")
    known = memory.entities_of(store.read("entities", ENTITIES))
    claims, entities = reconciled(drawn, namer(drawn), known)
    store.append("claims", claims, batch)
    store.append("entities", entities, batch)
    release(drawn)
    mine = store.of_batch("claims", CLAIMS, batch)
    every = store.read("claims", CLAIMS).unionByName(mine)
    store.append("edges", supersession.detect(every.join(mine.where("skey is not null").select("skey").distinct(), "skey", "left_semi"), policy), batch)
    met = memory.entities_of(store.read("entities", ENTITIES).unionByName(store.of_batch("entities", ENTITIES, batch)))
    store.append("session_writes", session_writes(store.of_batch("sessions", SESSIONS, batch), mine, met), batch)
    store.commit(batch)
    return {name: store.of_batch(name, schema, batch).count() for name, schema in TABLES.items()}


def stream(spark: SparkSession, inbox: str, store: Store, checkpoint: str, extractor: models.Extractor = models.sentence_claims):
    """A streaming query over a folder of JSON lines, one posted session each; stops when all there is has been read."""
    source = spark.readStream.schema(POSTED).json(inbox)
    return source.writeStream.foreachBatch(lambda rows, n: ingest_batch(store, rows, n, extractor) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
