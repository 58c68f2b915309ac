"""The five places where a model may be asked, each with a rule that needs none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions import keys
from memlattice.sources.store import cache_misses

#: turns -> claims; claims -> the entities they mention (ckey, uid, canon, etype, aliases); questions -> (qid, term); (question, spans) -> reply; (question, answer, reply) -> yes or no.
Extractor = Callable[[DataFrame], DataFrame]
Namer = Callable[[DataFrame], DataFrame]
Expander = Callable[[DataFrame], DataFrame]


def sentence_claims(turns: DataFrame) -> DataFrame:
    """The extractor for data without a model: every sentence of a turn is a claim, with its exact span."""
    parts = F.regexp_extract_all("text", F.lit(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$"), F.lit(0))
    spans = F.aggregate(parts, F.array().cast("array<struct<s:string,cs:int>>"), lambda a, p: F.concat(a, F.array(F.struct(p.alias("s"), F.when(F.size(a) == 0, F.lit(0)).otherwise(F.element_at(a, -1)["cs"] + F.length(F.element_at(a, -1)["s"])).cast("int").alias("cs")))))
    rows = turns.select("uid", "sid", "session_key", "session_ord", "date_int", "turn_idx", F.col("role").alias("speaker"), F.explode(spans).alias("_p"))
    trimmed = rows.withColumn("text", F.trim(F.regexp_replace("_p.s", r"\s+$", ""))).where("length(text) > 1")
    cs = F.col("_p.cs") + F.instr(F.col("_p.s"), F.col("text")) - 1
    placed = trimmed.withColumn("cs", cs).withColumn("ce", F.col("cs") + F.length("text"))
    digest = keys.claim_digest(F.col("text"), F.col("session_key"), F.col("turn_idx"), F.col("cs"), F.col("ce"))
    return placed.select(
        keys.claim_key(F.col("uid"), digest).alias("ckey"), "uid", F.lit(None).cast("string").alias("skey"), "text", "speaker", F.lit("fact").alias("ctype"), "session_ord", F.lit(0).alias("t_event"), F.lit("none").alias("t_prec"),
        "sid", "turn_idx", "cs", "ce", F.col("date_int").alias("session_date"), F.lit("exact").alias("located"), F.array().cast("array<string>").alias("mentions"), F.array().cast("array<string>").alias("keywords"), F.lit(None).cast("string").alias("slot_value"),
    ).dropDuplicates(["ckey"])


def capitalised_names(claims: DataFrame) -> DataFrame:
    """The namer for data without a model: runs of capitalised words, other than those that begin the claim, as things without aliases."""
    names = F.regexp_extract_all("text", F.lit(r"(?<=[^\s.!?:]\s)(\p{Lu}[\p{L}\p{N}'’-]+(?: \p{Lu}[\p{L}\p{N}'’-]+)*)"), F.lit(1))
    return claims.select("ckey", "uid", F.explode(F.array_distinct(names)).alias("canon"), F.lit("thing").alias("etype"), F.array().cast("array<string>").alias("aliases"))


def synonyms(table: dict[str, str]) -> Expander:
    """The expander for data without a model: the words of a literal table, written apart by blanks, for each stem they follow from."""
    from memlattice.functions.text import stems

    def expand(questions: DataFrame) -> DataFrame:
        pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]) if table else F.create_map()
        words = questions.select("qid", F.explode(stems(F.col("question"))).alias("stem"))
        return words.withColumn("_m", F.try_element_at(pairs, F.col("stem"))).where("_m is not null").select("qid", F.explode(F.split("_m", " ")).alias("term")).distinct()

    return expand


def extractive_reader(questions: DataFrame, spans: DataFrame) -> DataFrame:
    """qid, answer, not_in_memory: the reader for data without a model: the words of the first current span."""
    first = spans.where("status = 'CURRENT'").groupBy("qid").agg(F.min(F.struct("position", F.expr("substring(excerpt, highlight_start + 1, highlight_end - highlight_start)").alias("a"))).alias("m"))
    return questions.join(first, "qid", "left").select("qid", F.coalesce("m.a", F.lit("NOT_IN_MEMORY")).alias("answer"), F.col("m.a").isNull().alias("not_in_memory"))


def containment_judge(rows: DataFrame) -> DataFrame:
    """rows (with expected and answer) and judged: whether the answer has the expected words, case and blanks aside."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return rows.withColumn("judged", (F.trim(plain(F.col("expected"))) != "") & plain(F.col("answer")).contains(F.trim(plain(F.col("expected")))))


def call_model(calls: DataFrame, cache: DataFrame, model: str, reply: Callable[[str], str]) -> DataFrame:
    """New rows for the cache: the replies to the calls (kind, key, prompt) that it lacks, each distinct key asked once.

    A call that fails gives a null value, which counts as a miss the next time.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = []
            for prompt in f.prompt:
                try:
                    values.append(reply(prompt))
                except Exception:
                    values.append(None)
            yield pd.DataFrame({"kind": f.kind, "key": f.key, "model": model, "value": values, "input_tokens": f.prompt.str.len() // 4, "output_tokens": [len(v or "") // 4 for v in values]})

    return cache_misses(calls, cache).select("kind", "key", "prompt").mapInPandas(ask, "kind string, key string, model string, value string, input_tokens bigint, output_tokens bigint")


def usage(cache: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """model, calls and tokens used; with prices (model, input, output for a million tokens) also cost, 0 for models without a price."""
    used = cache.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    if prices is None:
        return used
    cost = (F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")) / 1_000_000
    return used.join(prices.select("model", "input", "output"), "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("input", "output")
