"""Answers by convergence, for batches of questions at once.

Every step carries the question's id, so any number of questions share one
plan: anchors meet claims directly and through entities, a claim's score is
folded from its distinct anchors, and ranks are taken per question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.keys import evidence_hash
from memlattice.functions.text import content_words, stem, stems
from memlattice.operators.supersession import label_as_of

# Fixed values.
TOP_K, SLOT_MATES, THRESHOLD = 25, 40, 2
CLAIM = ["ckey", "session_ord", "t_event", "skey"]


def anchors_of(questions: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """qid, uid, stem: the distinct stems of each question and of its expansion terms (qid, term)."""
    own = questions.select("qid", "uid", F.explode(F.array_distinct(content_words(F.col("question")))).alias("_w")).select("qid", "uid", stem(F.col("_w")).alias("stem")).distinct()
    if expansions is None:
        return own
    more = expansions.join(questions.select("qid", "uid"), "qid").select("qid", "uid", F.explode(stems(F.col("term"))).alias("stem"))
    return own.unionByName(more).distinct()


def idf(df: Column, total: Column) -> Column:
    return F.log(F.lit(1.0) + total / F.greatest(F.lit(1), df))


def reach(anchors: DataFrame, hits: DataFrame, names: DataFrame, mentions: DataFrame, max_hops: int = 2) -> DataFrame:
    """qid, stem, ckey, hops: what the anchors lead to, over one hop or by way of an entity."""
    direct = anchors.join(hits, ["uid", "stem"]).select("qid", "stem", "ckey", F.lit(1).alias("hops"))
    if max_hops < 2:
        return direct
    by_name = anchors.join(names, ["uid", "stem"]).select("qid", "stem", "ekey").distinct()
    return direct.unionByName(by_name.join(mentions, "ekey").select("qid", "stem", "ckey", F.lit(2).alias("hops")))


def converge(questions: DataFrame, reached: DataFrame, claims: DataFrame, df: DataFrame, as_of: int | None = None) -> DataFrame:
    """qid, claim columns, convergence, hops, score, anchors: each claim reached, with the distinct anchors that reach it.

    The score is summed over the anchors in order, so it is the same on every
    run; claims after session as_of are not seen.
    """
    seen = claims if as_of is None else claims.where(F.col("session_ord") <= as_of)
    total = claims.groupBy("uid").agg(F.count("*").alias("total"))
    per_anchor = reached.groupBy("qid", "ckey", "stem").agg(F.min("hops").alias("hops"))
    weighted = per_anchor.join(questions.select("qid", "uid"), "qid").join(df, ["uid", "stem"], "left").join(total, "uid", "left")
    weight = F.struct("stem", idf(F.coalesce("df", F.lit(0)), F.coalesce("total", F.lit(0))).alias("w"))
    folded = weighted.groupBy("qid", "ckey").agg(F.count("*").cast("int").alias("convergence"), F.min("hops").alias("hops"), F.sort_array(F.collect_list(weight)).alias("_w"))
    scored = folded.select("qid", "ckey", "convergence", "hops", F.round(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["w"]), 9).alias("score"), F.transform("_w", lambda x: x["stem"]).alias("anchors"))
    return scored.join(seen.select(*CLAIM), "ckey")


def rank_order() -> list[Column]:
    return [F.col("convergence").desc(), F.col("score").desc(), F.col("t_event").desc(), F.col("session_ord").desc(), F.col("ckey")]


def verdicts(questions: DataFrame, anchors: DataFrame, reached: DataFrame) -> DataFrame:
    """qid, resolved, threshold, top_convergence, verdict, reason, unresolved (sorted stems that reach nothing)."""
    asked = anchors.groupBy("qid").agg(F.collect_set("stem").alias("_asked"))
    found = reached.groupBy("qid").agg(F.max("convergence").alias("top_convergence"), F.array_distinct(F.flatten(F.collect_set("anchors"))).alias("_found"))
    q = questions.select("qid").join(asked, "qid", "left").join(found, "qid", "left")
    none = F.array().cast("array<string>")
    q = q.select("qid", F.coalesce("top_convergence", F.lit(0)).alias("top_convergence"), F.coalesce("_asked", none).alias("_asked"), F.coalesce("_found", none).alias("_found"))
    q = q.withColumn("resolved", F.size("_found")).withColumn("threshold", F.least(F.lit(THRESHOLD), F.greatest(F.lit(1), "resolved")))
    reason = F.when(F.col("resolved") == 0, "A1_no_anchors").when(F.col("top_convergence") < F.col("threshold"), "A2_no_convergence")
    return q.select("qid", "resolved", "threshold", "top_convergence", F.when(reason.isNull(), "ANSWER").otherwise("ABSENT").alias("verdict"), reason.alias("reason"), F.sort_array(F.array_except("_asked", "_found")).alias("unresolved"))


def candidates(reached: DataFrame, verdict: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The converged claims of the questions that get an answer, with their rank from 1, the top_k best of each."""
    answered = verdict.where("verdict = 'ANSWER'").select("qid", "threshold")
    converged = reached.join(answered, "qid").where("convergence >= threshold").drop("threshold")
    return converged.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*rank_order()))).where(F.col("rank") <= top_k)


def receipts(questions: DataFrame, reached: DataFrame, historical: bool = False, top_k: int = TOP_K) -> DataFrame:
    """qid, rank, ckey, convergence, score (4 places), anchors, historical: the top_k claims of each question among all it reaches, converged or not."""
    ranked = reached.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*rank_order()))).where(F.col("rank") <= top_k)
    listed = ranked.join(questions.select("qid"), "qid", "left_semi")
    return listed.select("qid", "rank", "ckey", "convergence", F.round("score", 4).alias("score"), "anchors", F.lit(historical).alias("historical"))


def distinct_hashes(runs: DataFrame) -> DataFrame:
    """qid, runs, hashes: how many different fingerprints a question got over several runs (qid, run, hash); 1 says it was told the same each time."""
    return runs.groupBy("qid").agg(F.count_distinct("run").alias("runs"), F.count_distinct("hash").alias("hashes"))


def slot_mates(cands: DataFrame, claims: DataFrame, as_of: int | None = None, most: int = SLOT_MATES) -> DataFrame:
    """The newest other claims of the candidates' slots, at most `most` for a question; they converge on nothing."""
    seen = claims if as_of is None else claims.where(F.col("session_ord") <= as_of)
    slots = cands.where("skey is not null and skey <> ''").select("qid", "skey").distinct()
    mates = slots.join(seen.select(*CLAIM), "skey").join(cands.select("qid", "ckey"), ["qid", "ckey"], "left_anti")
    newest = Window.partitionBy("qid").orderBy(F.col("session_ord").desc(), "ckey")
    kept = mates.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    return kept.select("qid", *CLAIM, F.lit(0).alias("convergence"), F.lit(0).alias("hops"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("anchors"))


def newest_of_slots(claims: DataFrame, as_of: int | None, most: int) -> DataFrame:
    """The claims seen of each slot, its `most` newest: slot mates of a question are among those if `most` is the mates and candidates that it can have."""
    seen = claims if as_of is None else claims.where(F.col("session_ord") <= as_of)
    newest = Window.partitionBy("skey").orderBy(F.col("session_ord").desc(), "ckey")
    return seen.where("skey is not null and skey <> ''").select(*CLAIM).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def told_at(resolved: Column, top: Column) -> Column:
    """ANSWER, or why there is none, by the anchors resolved and the highest convergence."""
    threshold = F.least(F.lit(THRESHOLD), F.greatest(F.lit(1), resolved))
    return F.when(resolved == 0, "A1_no_anchors").when(top < threshold, "A2_no_convergence").otherwise("ANSWER")


def evidence(cands: DataFrame, mates: DataFrame, edges: DataFrame, as_of: int | None = None, historical: bool = False) -> DataFrame:
    """The evidence of each question in reading order (position from 1): current before superseded unless the question is historical, then by date, the undated last."""
    both = cands.drop("rank").unionByName(mates)
    labelled = label_as_of(both, edges, as_of)
    stale = F.lit(0) if historical else (F.col("status") == "SUPERSEDED").cast("int")
    order = Window.partitionBy("qid").orderBy(stale, F.when(F.col("t_event") == 0, F.lit(2**31 - 1)).otherwise(F.col("t_event")), "session_ord", "ckey")
    return labelled.withColumn("position", F.row_number().over(order))


def hashes(questions: DataFrame, found: DataFrame) -> DataFrame:
    """qid, hash: fingerprint of each question's evidence, that of nothing where there is none."""
    keys = found.groupBy("qid").agg(F.collect_set("ckey").alias("_k"))
    return questions.select("qid").join(keys, "qid", "left").select("qid", evidence_hash(F.coalesce("_k", F.array().cast("array<string>"))).alias("hash"))


def trajectory(reached: DataFrame, points: DataFrame) -> DataFrame:
    """qid, k, verdict, top_convergence: what each question would have been told at each session k of the points (qid, k).

    The claims a question reaches are folded once: an anchor counts from the
    first session it reaches a claim of, and one row for each session says how
    many anchors came and how far claims converged. A running sum and maximum
    over those rows answer for every k, instead of asking again for each.
    """
    first = reached.select("qid", "session_ord", F.explode("anchors").alias("_a")).groupBy("qid", "_a").agg(F.min("session_ord").alias("k"))
    came = first.select("qid", "k", F.lit(1).alias("_new"), F.lit(None).cast("int").alias("_top"), F.lit(False).alias("_point"))
    tops = reached.select("qid", F.col("session_ord").alias("k"), F.lit(0).alias("_new"), F.col("convergence").alias("_top"), F.lit(False).alias("_point"))
    asked = points.select("qid", "k", F.lit(0).alias("_new"), F.lit(None).cast("int").alias("_top"), F.lit(True).alias("_point"))
    rows = came.unionByName(tops).unionByName(asked).groupBy("qid", "k").agg(F.sum("_new").alias("_new"), F.max("_top").alias("_top"), F.max("_point").alias("_point"))
    upto = Window.partitionBy("qid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_resolved", F.sum("_new").over(upto)).withColumn("top_convergence", F.max("_top").over(upto))
    return seen.where("_point").select("qid", "k", told_at(F.col("_resolved"), F.col("top_convergence")).alias("verdict"), "top_convergence")


def belief_changes(labels: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """The rows at which a label differs from the one before; each first row counts as a change."""
    before = F.lag(label).over(Window.partitionBy(*by).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    return labels.withColumn("_change", first | ~F.col(label).eqNullSafe(before)).where("_change").drop("_change")
