"""From questions to evidence: one lookup over any number of questions, its shared stages written as they are made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions.keys import citation_id
from memlattice.functions.text import excerpt
from memlattice.operators import fold, memory, retrieval, supersession
from memlattice.runtime import materialize


@dataclass
class Memory:
    """The tables that lookups read: claims, edges, and docs (uid, id, terms, hop and what a claim is ranked by): which terms lead to which claims of whom."""

    claims: DataFrame
    edges: DataFrame
    docs: DataFrame

    @classmethod
    def of(cls, claims: DataFrame, entities: DataFrame, edges: DataFrame) -> Memory:
        """From claims, entities and edges that are clean already."""
        return cls(claims, edges, memory.docs_of(claims, entities))


@dataclass
class Answers:
    """What a batch of questions was told, stage by stage. reached has a row for each pair of question and claim and is worked out when it is read; best has each question's top_k of it."""

    reached: DataFrame
    best: DataFrame
    verdicts: DataFrame
    candidates: DataFrame
    evidence: DataFrame
    hashes: DataFrame


def asked_of(questions: DataFrame, anchors: DataFrame) -> DataFrame:
    """uid, id, terms: each question with its anchors."""
    terms = anchors.groupBy("qid").agg(F.collect_set("stem").alias("terms"))
    return questions.select("uid", "qid").join(terms, "qid", "left").select("uid", F.col("qid").alias("id"), "terms")


def ask(questions: DataFrame, of: Memory, as_of: int | None = None, historical: bool = False, top_k: int = retrieval.TOP_K, max_hops: int = 2, expansions: DataFrame | None = None) -> Answers:
    """Answers for questions (qid, uid, question). With as_of, the memory is what it was after that session, verdict and ranks included.

    Questions without content words, and those of users without claims, are
    told A1_no_anchors. No table has a row for each claim that a question reaches.
    """
    anchors = materialize(retrieval.anchors_of(questions, expansions), "anchors")
    asked, docs = asked_of(questions, anchors), of.docs.where(F.col("hop") <= max_hops)
    labels = supersession.fold_edges(of.edges, as_of).select(F.col("older").alias("id"), F.col("newer").alias("superseded_by"), "at_session")
    slots = retrieval.newest_of_slots(of.claims, as_of, retrieval.SLOT_MATES + top_k).select("skey", F.col("ckey").alias("id"), F.col("session_ord").alias("ord"), F.col("t_event").alias("event"))
    users = docs.where("skey is not null and skey <> ''").select("uid", "skey").distinct()
    rows = fold.gathered(asked, docs=docs.join(labels, "id", "left"), slots=slots.join(users, "skey").join(labels, "id", "left"))
    kinds = dict(of.claims.dtypes) | {"at_session": dict(of.edges.dtypes)["at_session"]}
    told = materialize(fold.typed(fold.lookups(rows, as_of, historical, top_k, retrieval.SLOT_MATES, retrieval.THRESHOLD), kinds), "told")
    best = told.where("rank is not null").drop("position", "superseded_by", "at_session", "found", "hash")
    verdict = retrieval.verdicts(questions, anchors, told.where("rank = 1").select("qid", "convergence", F.col("found").alias("anchors")))
    evidence = told.where("position is not null").withColumn("status", F.when(F.col("superseded_by").isNull(), "CURRENT").otherwise("SUPERSEDED"))
    hashes = questions.select("qid").join(told.where("rank = 1").select("qid", "hash"), "qid", "left").select("qid", F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("hash"))
    reached = fold.typed(fold.reached_all(fold.gathered(asked, docs=docs), as_of), kinds)
    # the candidates are those of the best that are evidence
    return Answers(reached, best, verdict, told.where("rank is not null and position is not null").select(*best.columns), evidence.drop("rank", "found", "hash"), hashes)


def trajectory(questions: DataFrame, of: Memory, sessions: DataFrame) -> DataFrame:
    """qid, k, verdict, top_convergence: what each question would have been told at each session k of its user (uid, k)."""
    rows = fold.gathered(asked_of(questions, retrieval.anchors_of(questions)), docs=of.docs, points=sessions.select("uid", F.col("k").alias("ord")))
    seen = fold.over_sessions(rows)
    return seen.select("qid", F.col("k").cast(dict(sessions.dtypes)["k"]).alias("k"), retrieval.told_at(F.col("resolved"), F.col("top_convergence")).alias("verdict"), "top_convergence")


def hydrate(evidence: DataFrame, claims: DataFrame, deliveries: DataFrame) -> DataFrame:
    """qid, position, ckey, id, status, excerpt, highlight_start, highlight_end: evidence with the words it was drawn from; rows whose turn is missing are dropped.

    deliveries are turns as they came (or as they are). Only those that some
    evidence was drawn from are shuffled with their texts.
    """
    where = ["uid", "sid", "turn_idx"]
    spans = evidence.select("qid", "position", "ckey", "status").join(claims.select("ckey", *where, "cs", "ce"), "ckey")
    needed = spans.select(*where).distinct()
    came = deliveries if "ingested_at" in deliveries.columns else deliveries.withColumn("ingested_at", F.lit(0))
    texts = memory.turns_of(came.select("turn", *where, "text", "ingested_at").join(needed, where, "left_semi"), *where, "text").groupBy(*where).agg(F.min("text").alias("text"))
    joined = spans.join(texts, where)
    return joined.select("qid", "position", "ckey", citation_id(F.col("ckey")).alias("id"), "status", excerpt(F.col("text"), F.col("cs"), F.col("ce")).alias("_e")).select("qid", "position", "ckey", "id", "status", "_e.*")


def reader_prompt(questions: DataFrame, spans: DataFrame) -> DataFrame:
    """qid, prompt: what a reader is given for each question: its date, itself, and its excerpts in order."""
    head = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("status"), F.lit("\n"), F.col("excerpt"))
    body = spans.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", head.alias("line")))), lambda x: x["line"]), "\n\n").alias("body"), F.count("*").alias("n"))
    return questions.join(body, "qid", "left").select("qid", F.concat(F.lit("QUESTION: "), "question", F.lit("\n\nEXCERPTS ("), F.coalesce("n", F.lit(0)), F.lit("):\n\n"), F.coalesce("body", F.lit(""))).alias("prompt"))
