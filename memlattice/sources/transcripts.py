"""Transcripts from JSON files and pasted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import dates, keys
from memlattice.operators.memory import role_of
from memlattice.operators.upsert import MemoryError_

QUESTION_FILE = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)


class DatasetUnavailable(MemoryError_):
    """A dataset, or a question in it, isn't there."""


def read_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The records of a question file: one JSON array, or with `lines` one record a line, which can be read in parallel."""
    try:
        return spark.read.schema(QUESTION_FILE).option("multiLine", str(not lines).lower()).json(path)
    except Exception as e:
        raise DatasetUnavailable(f"{path}: {e}") from e


def find_question(questions: DataFrame, question_id: str) -> DataFrame:
    """The one record of a question; an error if there is none."""
    found = questions.where(F.col("question_id") == question_id)
    if found.isEmpty():
        raise DatasetUnavailable(f"no question {question_id}")
    return found


def sessions_from(questions: DataFrame, strict: bool = True) -> DataFrame:
    """uid, sid, session_key, session_ord, date_int, ts, turns of the sessions of each question, in the order of their clocks.

    Sessions of one clock time keep the file's order; a sid met again gets the
    number of its use as suffix, in session order; a session without an id is
    called by its place. A date that can't be read is an error, or without
    `strict` drops the session.
    """
    parts = F.arrays_zip(F.col("haystack_dates").alias("date"), F.col("haystack_session_ids").alias("sid"), F.col("haystack_sessions").alias("turns"))
    rows = questions.select(F.col("question_id").alias("uid"), F.posexplode(parts).alias("_i", "_s"))
    dated = rows.select("uid", "_i", F.coalesce(F.col("_s.sid"), F.concat(F.lit("session_"), F.col("_i"))).alias("sid"), dates.session_stamp(F.col("_s.date"), strict).alias("_d"), F.col("_s.turns").alias("turns"))
    ordered = dated.where(F.col("_d").isNotNull()).withColumn("session_ord", F.row_number().over(Window.partitionBy("uid").orderBy("_d.ts", "_i")))
    n = F.row_number().over(Window.partitionBy("uid", "sid").orderBy("session_ord"))
    named = ordered.withColumn("session_key", F.when(n == 1, F.col("sid")).otherwise(F.concat_ws("#", "sid", n)))
    return named.select("uid", "sid", "session_key", "session_ord", "_d.date_int", "_d.ts", "turns")


def turns_from(sessions: DataFrame) -> DataFrame:
    """One row for each turn of the sessions, in the layout of the turns table."""
    rows = sessions.select("uid", "sid", "session_key", "session_ord", "date_int", "ts", F.posexplode("turns").alias("turn_idx", "_t"))
    cleaned = rows.select("*", role_of(F.col("_t.role")).alias("role"), F.coalesce("_t.content", F.lit("")).alias("text"), F.coalesce("_t.has_answer", F.lit(False)).alias("has_answer")).drop("_t")
    return cleaned.select(keys.turn_key(F.col("uid"), F.col("session_key"), F.col("turn_idx")).alias("turn"), "*")


def pasted_turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, turn_idx, role, content of pasted transcripts.

    A line that begins with "user:" or "assistant:" (in any case) begins a
    turn; other lines go on with the turn before, those before the first turn
    are the user's. Turns without content are dropped.
    """
    prefix = r"(?i)^\s*(user|assistant)\s*:\s*"
    lines = df.select(F.col(key).alias("_key"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("_n", "_line"))
    begins = F.col("_line").rlike(prefix)
    order = Window.partitionBy("_key").orderBy("_n")
    marked = lines.withColumn("_role", F.when(begins, F.lower(F.regexp_extract("_line", prefix, 1)))).withColumn("_turn", F.sum(begins.cast("int")).over(order)).withColumn("_line", F.regexp_replace("_line", prefix, ""))
    grouped = marked.groupBy("_key", "_turn").agg(F.max("_role").alias("role"), F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n"), r"^\s+|\s+$", "").alias("content"))
    kept = grouped.where("content <> ''").withColumn("turn_idx", F.row_number().over(Window.partitionBy("_key").orderBy("_turn")) - 1)
    return kept.select(F.col("_key").alias(key), "turn_idx", F.coalesce("role", F.lit("user")).alias("role"), "content")


def live_ids(sessions: DataFrame, date: str, turns: str) -> Column:
    """The id of a posted session: the same post always has the same."""
    return keys.live_session_id(F.col(date), F.transform(F.col(turns), lambda t: t["content"]))
