import json

import pytest
from pyspark.sql import functions as F

from memlattice.engine import MemoryEngine, UnknownUser
from memlattice.operators import models
from memlattice.sources import store, transcripts
from memlattice.streaming import ingest

DAY = "2023/04/10 (Mon) 17:50"


def test_question_file(spark, tmp_path):
    turn = {"role": "user", "content": "hi", "has_answer": True}
    record = {"question_id": "q1", "question_type": "multi-session", "question": "?", "question_date": DAY, "haystack_dates": [DAY, "2023/04/10 (Mon) 14:47", DAY], "haystack_session_ids": ["a", "b", "a"], "haystack_sessions": [[turn], [{"role": "system", "content": "x"}], [turn, turn]]}
    path = str(tmp_path / "q.json")
    (tmp_path / "q.json").write_text(json.dumps([record]))
    questions = transcripts.read_questions(spark, path)
    sessions = transcripts.sessions_from(transcripts.find_question(questions, "q1"))
    assert [(r.sid, r.session_key, r.session_ord) for r in sessions.orderBy("session_ord").collect()] == [("b", "b", 1), ("a", "a", 2), ("a", "a#2", 3)]
    turns = transcripts.turns_from(sessions)
    assert {(r.turn, r.role, r.has_answer) for r in turns.collect()} == {("q1|turn|b|0", "user", False), ("q1|turn|a|0", "user", True), ("q1|turn|a#2|0", "user", True), ("q1|turn|a#2|1", "user", True)}
    with pytest.raises(transcripts.DatasetUnavailable):
        transcripts.find_question(questions, "none")
    with pytest.raises(transcripts.DatasetUnavailable):
        transcripts.read_questions(spark, str(tmp_path / "missing.json"))


def test_pasted(spark):
    df = spark.createDataFrame([("k", "before\nUser: hello\nthere\n\nassistant:\nAssistant: yes"), ("n", None)], "id string, body string")
    got = [(r.turn_idx, r.role, r.content) for r in transcripts.pasted_turns(df, "id", "body").orderBy("turn_idx").collect()]
    assert got == [(0, "user", "before"), (1, "user", "hello\nthere"), (2, "assistant", "yes")]


def posted(spark, rows):
    return spark.createDataFrame([(u, d, [("user", t) for t in ts]) for u, d, ts in rows], ingest.POSTED)


STORY = [("u", "2023/01/05 (Thu) 10:00", ["My hamster is named Nibbles. The hamster sleeps."]), ("u", "2023/02/05 (Sun) 10:00", ["I renamed the hamster to Pretzel."])]


def rows_of(engine):
    return {name: sorted(map(repr, engine._read(name).collect())) for name in ("sessions", "turns", "claims")}


def test_story_is_the_same_in_bulk_and_step_by_step(spark, tmp_path):
    bulk, steps = MemoryEngine(spark, str(tmp_path / "bulk")), MemoryEngine(spark, str(tmp_path / "steps"))
    bulk.add_sessions(posted(spark, STORY), 0)
    for n, row in enumerate(STORY):
        steps.add_sessions(posted(spark, [row]), n)
    assert rows_of(bulk) == rows_of(steps)
    before = rows_of(steps)
    steps.add_sessions(posted(spark, STORY[:1]), 2)  # posted again: nothing new
    steps.add_sessions(posted(spark, [STORY[1]]), 1)  # the batch again, as after a crash before the stream's own commit
    assert rows_of(steps) == before
    q = spark.createDataFrame([("q", "u", "What is my hamster named?")], "qid string, uid string, question string")
    answers = bulk.ask(q)
    assert answers.verdicts.first().verdict == "ANSWER"
    assert answers.evidence.count() >= 1
    assert bulk.ask(q).hashes.first().hash == answers.hashes.first().hash
    assert {r.session_ord for r in bulk.ask(q, as_of=1).reached.collect()} == {1}
    assert bulk.sessions("u").count() == 2 and bulk.stats().first().claims == 3
    with pytest.raises(UnknownUser):
        bulk.ask(q.withColumn("uid", F.lit("nobody")))


class Crash(Exception):
    pass


def test_a_batch_that_failed_is_done_again(spark, tmp_path, monkeypatch):
    clean, torn = MemoryEngine(spark, str(tmp_path / "clean")), MemoryEngine(spark, str(tmp_path / "torn"))
    counts = clean.add_sessions(posted(spark, STORY), 0)
    write = torn.store.append

    def crash(*_):
        raise Crash

    for at in ("turns", "edges", None):
        with monkeypatch.context() as m:
            m.setattr(torn.store, "append" if at else "commit", (lambda name, rows, batch: crash() if name == at else write(name, rows, batch)) if at else crash)
            with pytest.raises(Crash):
                torn.add_sessions(posted(spark, STORY), 0)
        assert torn._read("sessions").count() == 0 and torn.store.last_commit() is None  # what failed isn't seen
    for _ in range(2):
        assert torn.add_sessions(posted(spark, STORY), 0) == counts
        assert rows_of(torn) == rows_of(clean)
    assert torn.store.last_commit() == 0


def test_entities_reads_and_removal(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path))
    two = [*STORY, ("v", "2023/01/05 (Thu) 10:00", ["We met Anna Bell in Graz. Yes."])]
    counts = engine.add_sessions(posted(spark, two), 0)
    assert counts["sessions"] == 3 and counts["entities"] == engine._entities().count() == 4
    engine.add_sessions(posted(spark, [("v", "2023/03/05 (Sun) 10:00", ["I saw Anna Bells again."])]), 1)
    assert {r.canon for r in engine._entities().where("uid = 'v'").collect()} == {"Anna Bell", "Graz"}  # the same under stemming
    key = engine._read("claims").where("text like 'I saw%'").first()
    assert key.mentions == ["v|e|Anna Bell"]
    q = spark.createDataFrame([("q", "v", "Who is Anna?")], "qid string, uid string, question string")
    assert {r.hops for r in engine.ask(q).reached.collect()} == {1}
    assert engine.get("claims", key.ckey, ["text"]).text == "I saw Anna Bells again." and engine.get("claims", "none", ["text"]) is None
    sid = engine.sessions("v").first().session_key
    assert engine.turn("v", sid, 0).text.startswith("We met") and engine.turn("v", sid, 9) is None
    assert engine.query("SELECT count(*) AS n FROM {turns} WHERE uid = :who", who="v").first().n == 2
    assert engine._read("session_writes").where("uid = 'v'").agg(F.sum("n_claims").alias("n")).first().n == 3
    engine.remove_user("v")
    assert {r.uid for name in ingest.TABLES for r in engine._read(name).select("uid").distinct().collect()} == {"u"}
    assert engine.sessions("u").count() == 2
    with pytest.raises(UnknownUser):
        engine.remove_user("v")


def test_a_name_known_before_wins_in_slots(spark):
    claims = spark.createDataFrame([("c", "u", "u|s|Bells|age", ["x"])], "ckey string, uid string, skey string, mentions array<string>")
    named = spark.createDataFrame([("c", "u", "Bells", "pet", None)], "ckey string, uid string, canon string, etype string, aliases array<string>")
    known = spark.createDataFrame([("u", "u|e|Zed", "Zed", "pet", ["bell"], True)], ingest.ENTITIES)
    got, entities = ingest.reconciled(claims, named, known)
    assert tuple(got.first()) == ("c", "u", "u|s|Zed|age", ["u|e|Zed"])
    assert tuple(entities.first()) == ("u", "u|e|Zed", "Zed", "pet", ["Bells"], True)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (u, d, ts) in enumerate(STORY + STORY[:1]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"uid": u, "date": d, "turns": [{"role": "user", "content": t} for t in ts]}))
    s = store.Store(spark, str(tmp_path / "store"))
    ingest.stream(spark, str(tmp_path / "in"), s, str(tmp_path / "check")).awaitTermination()
    assert s.read("sessions", ingest.SESSIONS).count() == 2
    ingest.stream(spark, str(tmp_path / "in"), s, str(tmp_path / "check")).awaitTermination()
    assert s.read("claims", ingest.CLAIMS).count() == 3


def test_sentence_claims_have_exact_spans(spark):
    text = "  One two. Three?\n\nFour five"
    t = spark.createDataFrame([("u", "s", "s", 1, 20230101, 0, "user", text)], "uid string, sid string, session_key string, session_ord int, date_int int, turn_idx int, role string, text string")
    got = models.sentence_claims(t).collect()
    assert sorted(r.text for r in got) == ["Four five", "One two.", "Three?"]
    assert all(text[r.cs : r.ce] == r.text for r in got)


def test_models(spark):
    q = spark.createDataFrame([("q", "my cars")], "qid string, question string")
    assert {r.term for r in models.synonyms({"car": "vehicle auto"})(q).collect()} == {"vehicle", "auto"}
    cache = spark.createDataFrame([("read", "k1", "m", "v", 1, 1), ("read", "k2", "m", None, 1, 1)], store.CACHE)
    calls = spark.createDataFrame([("read", "k1", "a"), ("read", "k2", "b"), ("read", "k3", "c"), ("read", "k3", "c")], "kind string, key string, prompt string")
    new = models.call_model(calls, cache, "m", str.upper)
    assert {(r.key, r.value) for r in new.collect()} == {("k2", "B"), ("k3", "C")}
    assert models.usage(cache).first().calls == 2
    rows = spark.createDataFrame([("a  cat", "One A CAT."), ("dog", None), (None, "x")], "expected string, answer string")
    assert [r.judged for r in models.containment_judge(rows).collect()] == [True, False, False]
    assert "n/a" in store.markdown(spark.createDataFrame([("t", None, 0.5)], "type string, a double, b double"))
