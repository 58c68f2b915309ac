"""Metrics and slices of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_abstention(question_id: Column) -> Column:
    return question_id.endswith("_abs")


def stratified(questions: DataFrame, size: int) -> DataFrame:
    """The first `size` questions when types take turns, each in the order of its ids; with its round."""
    nth = Window.partitionBy("question_type").orderBy("question_id")
    return questions.withColumn("round", F.row_number().over(nth)).orderBy("round", "question_type", "question_id").limit(size)


def benchmark_slice(questions: DataFrame, size: int) -> DataFrame:
    """question_id, question_type: all if there are no more than size; a stratified choice if size is within the abstentions; else all abstentions and stratified others."""
    counts = questions.agg(F.count("*").alias("n"), F.count_if(is_abstention(F.col("question_id"))).alias("a")).first()
    columns = ["question_id", "question_type"]
    if size >= counts["n"]:
        return questions.select(*columns)
    if size <= counts["a"]:
        return stratified(questions, size).select(*columns)
    absent = is_abstention(F.col("question_id"))
    return stratified(questions.where(~absent), size - counts["a"]).select(*columns).unionByName(questions.where(absent).select(*columns))


def turn_coverage(turns: DataFrame, claims: DataFrame) -> DataFrame:
    """uid, sid, turn_idx, covered: the turns with an answer and whether a claim was drawn from them."""
    drawn = claims.select("uid", "sid", "turn_idx").distinct().withColumn("_there", F.lit(True))
    return turns.where("has_answer").select("uid", "sid", "turn_idx").join(drawn, ["uid", "sid", "turn_idx"], "left").select("uid", "sid", "turn_idx", F.col("_there").isNotNull().alias("covered"))


def extraction_recall(coverage: DataFrame) -> DataFrame:
    """uid, answer_turns, covered_turns, recall."""
    sums = coverage.groupBy("uid").agg(F.count("*").alias("answer_turns"), F.count_if("covered").alias("covered_turns"))
    return sums.withColumn("recall", F.try_divide("covered_turns", "answer_turns"))


def micro_recall(coverage: DataFrame, by: str) -> DataFrame:
    """by, answer_turns, covered_turns, recall: over turns, not questions; 1 where there are none; with a row ALL."""
    counts = [F.count("*").alias("answer_turns"), F.count_if("covered").alias("covered_turns")]
    each = coverage.groupBy(by).agg(*counts)
    every = each.agg(F.coalesce(F.sum("answer_turns"), F.lit(0)).alias("answer_turns"), F.coalesce(F.sum("covered_turns"), F.lit(0)).alias("covered_turns")).select(F.lit("ALL").alias(by), "answer_turns", "covered_turns")
    return each.unionByName(every).withColumn("recall", F.coalesce(F.try_divide("covered_turns", "answer_turns"), F.lit(1.0)))


def _share(of: Column, among: Column) -> Column:
    return F.try_divide(F.count_if(among & of), F.count_if(among))


def summaries(rows: DataFrame) -> DataFrame:
    """question_type and the rates of an evaluation's rows, for each type and for ALL; null where nothing is counted against. Without rows there is no report."""
    answerable = ~F.col("is_abstention")
    refused = (F.col("verdict") == "ABSENT") | F.coalesce("not_in_memory", F.lit(False))
    rolled = rows.rollup("question_type").agg(
        F.count("*").alias("n"),
        _share(F.col("judged"), ~answerable).alias("abstention_accuracy"),
        _share(F.col("judged"), answerable).alias("accuracy"),
        _share(refused, answerable).alias("false_abstention"),
        _share(F.col("session_hit"), answerable & (F.size("answer_sessions") > 0)).alias("session_recall"),
        F.coalesce(F.median("reader_tokens"), F.lit(0.0)).alias("tokens_p50"),
        F.count_if(F.col("reason") == "A1_no_anchors").alias("a1"),
        F.count_if(F.col("reason") == "A2_no_convergence").alias("a2"),
        *([F.coalesce(F.median("latency_ms"), F.lit(0.0)).alias("latency_p50")] if "latency_ms" in rows.columns else []),
        F.grouping("question_type").alias("_all"),
    )
    return rolled.withColumn("question_type", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("question_type"))).drop("_all")


def gate_report(rows: DataFrame) -> DataFrame:
    """question_type and the retrieval gate's rates, for each type and for ALL; with no answerable question its two rates are 0."""
    answerable, absent = ~F.col("is_abstention"), F.col("verdict") == "ABSENT"
    rolled = rows.rollup("question_type").agg(
        F.count_if(answerable).alias("answerable"),
        F.coalesce(_share(F.col("session_hit"), answerable), F.lit(0.0)).alias("session_recall"),
        F.coalesce(_share(absent, answerable), F.lit(0.0)).alias("false_abstention"),
        F.count_if(~answerable).alias("abstention_questions"),
        _share(absent, ~answerable).alias("abstention_recall"),
        _share(~answerable, absent).alias("abstention_precision"),
        F.count_if(F.col("reason") == "A1_no_anchors").alias("a1"),
        F.count_if(F.col("reason") == "A2_no_convergence").alias("a2"),
        *([F.coalesce(F.median("latency_ms"), F.lit(0.0)).alias("latency_p50")] if "latency_ms" in rows.columns else []),
        F.grouping("question_type").alias("_all"),
    )
    return rolled.withColumn("question_type", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("question_type"))).drop("_all")


def session_hits(questions: DataFrame, evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, evidence_sessions, answer_sessions (sorted), session_hit; evidence has qid and sid, answers uid and sid."""
    found = evidence.groupBy("qid").agg(F.sort_array(F.collect_set("sid")).alias("evidence_sessions"))
    right = answers.groupBy("uid").agg(F.sort_array(F.collect_set("sid")).alias("answer_sessions"))
    none = F.array().cast("array<string>")
    joined = questions.join(found, "qid", "left").join(right, "uid", "left").withColumn("evidence_sessions", F.coalesce("evidence_sessions", none)).withColumn("answer_sessions", F.coalesce("answer_sessions", none))
    return joined.withColumn("session_hit", F.arrays_overlap("evidence_sessions", "answer_sessions"))


def judge_template(question_type: Column, abstention: Column) -> Column:
    """Which rubric judges a question; an unknown type is an error."""
    # The kinds of questions that are judged.
    plain = question_type.isin("single-session-user", "single-session-assistant", "multi-session")
    own = question_type.isin("temporal-reasoning", "knowledge-update", "single-session-preference")
    return F.when(abstention, "abstention").when(own, question_type).when(plain, "default").otherwise(F.raise_error(F.concat(F.lit("no rubric for question type "), question_type)))


#: What each rubric asks of a reply, and what it calls the text to hold the reply against.
RUBRICS = {
    "default": ("Say yes if the reply gives the expected answer, in any words or with all steps that lead to it. A reply with only a part of it is a no.", "Expected answer"),
    "temporal-reasoning": ("Say yes if the reply gives the expected answer, in any words or with all steps that lead to it. A count of days, weeks or months that is off by one is still right. A reply with only a part of it is a no.", "Expected answer"),
    "knowledge-update": ("Say yes if the reply gives the updated answer, even if it also tells what held before.", "Expected answer"),
    "single-session-preference": ("Say yes if the reply makes right use of what is known of the person. It needn't meet every point of the rubric.", "Rubric"),
    "abstention": ("The question can't be answered. Say yes if the reply recognises that, for instance by saying that something asked for is not known.", "Why it can't be answered"),
}


def judge_prompt(template: Column, question: Column, expected: Column, reply: Column) -> Column:
    """What a judge is asked, by the rubric of judge_template; answered by yes or no."""
    prompt = None
    for name, (rubric, label) in RUBRICS.items():
        text = F.concat(F.lit(f"{rubric}\n\nQuestion: "), question, F.lit(f"\n\n{label}: "), expected, F.lit("\n\nReply: "), reply, F.lit("\n\nAnswer yes or no only."))
        prompt = F.when(template == name, text) if prompt is None else prompt.when(template == name, text)
    return prompt


def not_in_memory(answer: Column, premise_supported: Column | None = None) -> Column:
    """Whether a reader declined: by its answer, or because what the question takes for granted isn't borne out."""
    said = F.trim(F.coalesce(answer, F.lit(""))).startswith("NOT_IN_MEMORY")
    return said if premise_supported is None else said | ~F.coalesce(premise_supported, F.lit(True))


def missing_users(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """uid, questions: users that are asked about and of whom nothing is remembered."""
    return questions.join(claims.select("uid").distinct(), "uid", "left_anti").groupBy("uid").agg(F.count("*").alias("questions"))


def askable(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """The questions of users of whom something is remembered; missing_users says how many that leaves out."""
    return questions.join(claims.select("uid").distinct(), "uid", "left_semi")


def judge_label(reply: Column) -> Column:
    """Whether a judge's reply says yes anywhere."""
    return F.lower(reply).contains("yes")


def drop_reason(turn_text: Column, quote: Column, cs: Column) -> Column:
    """Why an extracted claim is dropped, the first reason that holds; null if it is kept."""
    return F.when(turn_text.isNull(), "bad_turn_idx").when(F.trim(quote) == "", "empty_quote").when(cs.isNull(), "span_not_found")
