"""Queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm import frequency, leakage, packing, pii, splitting, truncation, variants
from memlattice.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed values of the data's problems.
PIECE_BYTES, PIECE_OVERLAP, CONTAINER_TOKENS = 30_000, 200, 4_096


def _bearers(spark: SparkSession, root: str) -> DataFrame:
    return variants.link_variants(table(spark, root, "entities"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return variants.variant_pairs(_bearers(spark, root))


def p1_bearers(spark: SparkSession, root: str) -> DataFrame:
    return variants.canonical_entities(table(spark, root, "entities"), _bearers(spark, root))


def p2_spans(spark: SparkSession, root: str) -> DataFrame:
    turns = pii.find_pii(table(spark, root, "turns"), "turn", "text").select(F.lit("turns").alias("rec_table"), F.col("turn").alias("rec_key"), "pii_type", "start_pos", "end_pos")
    claims = pii.find_pii(table(spark, root, "claims"), "ckey", "text").select(F.lit("claims").alias("rec_table"), F.col("ckey").alias("rec_key"), "pii_type", "start_pos", "end_pos")
    return turns.unionByName(claims)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_spans(spark, root).select("rec_table", "rec_key", "pii_type", "start_pos").distinct()


def p2_redacted(spark: SparkSession, root: str) -> DataFrame:
    turns = pii.redacted(table(spark, root, "turns").select(F.lit("turns").alias("rec_table"), F.col("turn").alias("rec_key"), "text"), "text")
    claims = pii.redacted(table(spark, root, "claims").select(F.lit("claims").alias("rec_table"), F.col("ckey").alias("rec_key"), "text"), "text")
    return turns.unionByName(claims)


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(table(spark, root, "turns"), "turn", "text", PIECE_BYTES, PIECE_OVERLAP, "ingested_at")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root).where("piece_idx = 1").select("turn")


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root)


def _token_hits(spark: SparkSession, root: str) -> DataFrame:
    return frequency.mark_unusable(frequency.term_frequencies(table(spark, root, "session_writes"), ["uid", "session_key"], "token_hits", "written_at"))


def _terms(spark: SparkSession, root: str) -> DataFrame:
    return frequency.mark_unusable(frequency.term_frequencies(table(spark, root, "bm25_docs"), ["uid", "session_key", "turn_idx"], "terms"))


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    both = _token_hits(spark, root).withColumn("field", F.lit("token_hits")).unionByName(_terms(spark, root).withColumn("field", F.lit("terms")))
    return both.select("field", "term", "occurrences", "records", F.coalesce("mark", F.lit("useful")).alias("mark"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_counts(spark, root).where("mark <> 'useful'").select("field", "term", "mark")


def p4_corrected_df(spark: SparkSession, root: str) -> DataFrame:
    return frequency.corrected_df(table(spark, root, "bm25_docs"), table(spark, root, "bm25_df"))


def _packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), "doc_id", "text", CONTAINER_TOKENS)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root).where("piece_idx = 1").select("doc_id").distinct()


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root)


def p7_pairs(spark: SparkSession, root: str) -> DataFrame:
    found = leakage.leaked_items(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text")
    return leakage.leaked_pairs(found, "doc_id", "item_id")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_pairs(spark, root).select("doc_id", "item_id")


def _truncated(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncation(table(spark, root, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _truncated(spark, root).where("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncation_rates(_truncated(spark, root), "source")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_bearers": p1_bearers,
    "p2_found": p2_found,
    "p2_spans": p2_spans,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p4_corrected_df": p4_corrected_df,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}

_COUNTS = """
WITH recs AS (
  SELECT 'token_hits' AS field, uid || chr(31) || session_key AS rec, arg_max(token_hits, written_at) AS terms FROM session_writes GROUP BY uid, session_key
  UNION ALL
  SELECT 'terms', uid || chr(31) || session_key || chr(31) || turn_idx, max(terms) FROM bm25_docs GROUP BY uid, session_key, turn_idx),
totals AS (SELECT field, count(*) AS n FROM recs GROUP BY field),
toks AS (SELECT field, rec, unnest(terms) AS term FROM recs),
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM toks WHERE term IS NOT NULL AND term <> '' GROUP BY field, term)
SELECT field, term, occurrences, records,
  CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05 * n THEN 'common' ELSE 'useful' END AS mark
FROM counts JOIN totals USING (field)
"""

ORACLES: dict[str, str] = {
    "p3_found": "SELECT DISTINCT turn FROM turns WHERE strlen(text) > 30000",
    "p4_counts": _COUNTS,
    "p4_found": f"SELECT field, term, mark FROM ({_COUNTS}) WHERE mark <> 'useful'",
    "p4_corrected_df": """
WITH docs AS (SELECT uid, session_key, turn_idx, max(terms) AS terms FROM bm25_docs GROUP BY ALL),
counted AS (SELECT uid, term, count(DISTINCT (session_key, turn_idx)) AS df FROM (SELECT uid, session_key, turn_idx, unnest(terms) AS term FROM docs) WHERE term IS NOT NULL AND term <> '' GROUP BY uid, term),
kept AS (SELECT uid, term, max(df) AS stored_df FROM bm25_df GROUP BY uid, term)
SELECT coalesce(c.uid, k.uid) AS uid, coalesce(c.term, k.term) AS term, coalesce(c.df, 0) AS df, k.stored_df,
  CASE WHEN k.uid IS NULL THEN 'missing' WHEN c.uid IS NULL THEN 'stale' WHEN coalesce(k.stored_df, 0) <= 0 THEN 'no_count' WHEN k.stored_df = c.df THEN 'right' ELSE 'wrong' END AS state
FROM counted c FULL OUTER JOIN kept k ON c.uid = k.uid AND c.term = k.term
""",
}
