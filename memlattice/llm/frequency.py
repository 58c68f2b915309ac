"""Occurrences and record frequency of every distinct term (last-seen counters).

Tokens are hash-partitioned by term and every partition is read in the order of
records. A term's counter holds three values: occurrences, records, and the
record last seen; the record count rises only when the record changes, so no set
of records per term exists anywhere, and what a task holds is one counter. A
term that occurs everywhere is split by a hash of the record into slices whose
counters add up, since no record is in two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.operators.presence import entity_hash

#: Slices that the records of each term are split into.
SLICES = 64


def _whole_records(df: DataFrame, record: list[str], terms: str, arrived: str | None, scope: Column) -> DataFrame:
    """scope, rec, terms of one row per record: the last delivery, or the greatest array where deliveries carry no time."""
    newest = F.struct(*([F.col(arrived).alias("_t")] if arrived else []), F.col(terms).alias("_v"))
    names = [f"_r{i}" for i in range(len(record))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(record, names, strict=True)], scope.alias("_scope"), newest.alias("_n"))
    once = rows.groupBy(*names).agg(F.first("_scope").alias("scope"), F.max("_n").getField("_v").alias("terms"))
    # which parts are null is part of the hash, as null and nothing hash alike
    return once.select("scope", entity_hash(*[c for n in names for c in (F.col(n), F.col(n).isNull())]).alias("rec"), "terms")


def _last_seen(tokens: DataFrame) -> DataFrame:
    """scope, term, occurrences, records from tokens (scope, term, rec)."""
    by_record = Window.partitionBy("scope", "term", "_slice").orderBy("rec")
    sliced = tokens.withColumn("_slice", F.pmod(F.col("rec.a"), F.lit(SLICES)).cast("int"))
    counted = sliced.withColumn("_changed", ~F.lag("rec").over(by_record).eqNullSafe(F.col("rec")))
    return counted.groupBy("scope", "term").agg(F.count("*").alias("occurrences"), F.count_if("_changed").alias("records"))


def term_frequencies(df: DataFrame, record: list[str], terms: str, arrived: str | None = None, scope: str | None = None) -> DataFrame:
    """[scope,] term, occurrences, records, total_records.

    A record is one distinct combination of the `record` columns (nulls count
    as values); of repeated deliveries the last one holds. total_records counts
    all of them, those with null or empty arrays included. Null and '' elements
    are no terms; a term is taken as stored. With `scope`, one of the record
    columns, counts are kept apart by it. An empty table gives no rows. Further
    columns are ignored.
    """
    whole = _whole_records(df, record, terms, arrived, F.col(scope) if scope else F.lit(None).cast("string"))
    sums = _last_seen(whole.select("scope", "rec", F.explode("terms").alias("term")).where("term <> ''"))
    size = df.select(*record).groupBy(*record).agg(F.lit(1).alias("_one"))
    if scope:
        totals = size.groupBy(F.col(scope).alias("_s")).agg(F.count("*").alias("total_records"))
        joined = sums.join(totals, F.col("scope").eqNullSafe(F.col("_s")), "left").drop("_s")
        return joined.select(F.col("scope").alias(scope), "term", "occurrences", "records", "total_records")
    return sums.select("term", "occurrences", "records", size.agg(F.count("*")).scalar().alias("total_records"))


def mark_unusable(counts: DataFrame, rare: int = 2, common_share: float = 0.05) -> DataFrame:
    """counts with `mark`: 'rare' for terms in at most `rare` records, else 'common' for those in more than the share of all records, else null."""
    mark = F.when(F.col("records") <= rare, F.lit("rare")).when(F.col("records") > F.col("total_records") * F.lit(common_share), F.lit("common"))
    return counts.withColumn("mark", mark)


def corrected_df(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """uid, term, df, stored_df, state: the document frequency per user counted anew, against the stored one.

    state is 'right', 'wrong', 'no_count' (null or not above 0), 'missing' (no stored row) or
    'stale' (a stored term that no document holds, df 0). Repeated stored rows
    count once, the greatest count first.
    """
    counted = term_frequencies(docs, ["uid", "session_key", "turn_idx"], "terms", scope="uid").select("uid", "term", F.col("records").alias("df"))
    kept = stored.groupBy("uid", "term").agg(F.max("df").alias("stored_df")).withColumn("_there", F.lit(True))
    a, b = counted.alias("a"), kept.alias("b")
    joined = a.join(b, F.col("a.uid").eqNullSafe(F.col("b.uid")) & F.col("a.term").eqNullSafe(F.col("b.term")), "full_outer")
    df = F.coalesce(F.col("a.df"), F.lit(0))
    state = (
        F.when(F.col("b._there").isNull(), "missing")
        .when(F.col("a.df").isNull(), "stale")
        .when(F.coalesce(F.col("b.stored_df"), F.lit(0)) <= 0, "no_count")
        .when(F.col("b.stored_df") == F.col("a.df"), "right")
        .otherwise("wrong")
    )
    return joined.select(F.when(F.col("a.df").isNull(), F.col("b.uid")).otherwise(F.col("a.uid")).alias("uid"), F.when(F.col("a.df").isNull(), F.col("b.term")).otherwise(F.col("a.term")).alias("term"), df.alias("df"), "stored_df", state.alias("state"))
