"""Registry of the core queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice import checks
from memlattice.functions import dates, keys
from memlattice.functions.text import locate_span, stems
from memlattice.operators import baselines, canon, evaluation, fold, memory, retrieval, supersession, upsert
from memlattice.operators.presence import snapshot_history
from memlattice.operators.slot_history import slot_history
from memlattice.plans import ask
from memlattice.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: The session that as-of queries look from, the user that deletes remove, and the sizes of budgets and slices.
AS_OF, GONE, BUDGET, SLICE = 10, "team_7e3c", 20_000, 60
#: What prefix scans look for. Questions are sorted into kinds by session.
PREFIX = "a"
# The kinds of questions.
KINDS = ("knowledge-update", "multi-session", "single-session-assistant", "single-session-preference", "single-session-user", "temporal-reasoning")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _turns(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return memory.turns_of(table(spark, root, "turns"), *columns)


def _claims(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return memory.claims_of(table(spark, root, "claims"), *columns)


def _worded(spark: SparkSession, root: str) -> DataFrame:
    """What tokens are drawn from."""
    return _claims(spark, root, "uid", "text", "keywords", "mentions")


def _entities(spark: SparkSession, root: str) -> DataFrame:
    return memory.entities_of(table(spark, root, "entities"))


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supersession_edges").select("uid", "older", "newer", "at_session")


def _slotted(spark: SparkSession, root: str) -> DataFrame:
    """What slots and chains are drawn from."""
    return _claims(spark, root, "uid", "skey", "text", "session_ord", "t_event", "slot_value")


def _questions(spark: SparkSession, root: str) -> DataFrame:
    """Every twentieth turn, as a question of its user."""
    asked = memory.turns_of(table(spark, root, "turns").where("turn_idx % 20 = 0"), "uid", "sid", "session_ord", "text").where("text <> ''")
    return asked.select(F.col("turn").alias("qid"), "uid", "sid", F.col("text").alias("question"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod("session_ord", F.lit(len(KINDS))) + 1).cast("int")).alias("question_type"), evaluation.is_abstention(F.col("uid")).alias("is_abstention"))


def _memory(spark: SparkSession, root: str) -> ask.Memory:
    return ask.Memory.of(_claims(spark, root, "uid", "skey", "text", "session_ord", "t_event", "keywords", "mentions"), _entities(spark, root), _edges(spark, root))


def _ask(spark: SparkSession, root: str, as_of: int | None = None) -> tuple[DataFrame, ask.Answers]:
    questions = _questions(spark, root)
    return questions, ask.ask(questions, _memory(spark, root), as_of)


def _reached(spark: SparkSession, root: str, max_hops: int = 2) -> DataFrame:
    """A row for each pair of question and claim that it reaches, as it is written."""
    questions = _questions(spark, root)
    asked = ask.asked_of(questions, retrieval.anchors_of(questions))
    return fold.reached_all(fold.gathered(asked, docs=_memory(spark, root).docs.where(F.col("hop") <= max_hops)))


# Histories


@query(
    """
WITH s AS (SELECT ckey, arg_max(skey, ingested_at) AS skey, arg_max(session_ord, ingested_at) AS session_ord FROM claims WHERE skey IS NOT NULL AND ckey IS NOT NULL GROUP BY ckey),
e AS (SELECT older, newer, at_session FROM supersession_edges UNION SELECT ckey, superseded_by, at_session FROM as_of_labels WHERE status = 'SUPERSEDED'),
v AS (SELECT e.older, min(e.at_session) AS valid_to FROM e JOIN s o ON o.ckey = e.older JOIN s n ON n.ckey = e.newer
  WHERE e.at_session IS NOT NULL AND e.older <> e.newer AND o.skey = n.skey AND n.session_ord >= o.session_ord AND e.at_session >= o.session_ord GROUP BY e.older)
SELECT s.skey, s.ckey, s.session_ord AS valid_from, coalesce(v.valid_to, 0) AS valid_to FROM s LEFT JOIN v ON v.older = s.ckey
"""
)
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return slot_history(table(spark, root, "claims"), table(spark, root, "supersession_edges"), table(spark, root, "as_of_labels"))


@query(
    """
WITH s AS (SELECT DISTINCT uid, ckey, status, as_of FROM as_of_labels WHERE as_of IS NOT NULL),
g AS (SELECT *, as_of - row_number() OVER (PARTITION BY uid, ckey, status ORDER BY as_of) AS island FROM s),
m AS (SELECT uid, ckey, max(as_of) AS latest FROM s GROUP BY uid, ckey)
SELECT g.uid, g.ckey, g.status, min(as_of) AS first_seen, max(as_of) AS last_seen, max(as_of) = max(m.latest) AS is_current
FROM g JOIN m ON m.uid IS NOT DISTINCT FROM g.uid AND m.ckey IS NOT DISTINCT FROM g.ckey GROUP BY g.uid, g.ckey, g.status, island
"""
)
def p5_label_history(spark: SparkSession, root: str) -> DataFrame:
    """The status of every claim over the sessions it was read at, gaps kept."""
    return snapshot_history(table(spark, root, "as_of_labels"), ["uid", "ckey"], ["status"], "as_of")


# Tables


@query(f"WITH {checks.TURNS} SELECT turn, uid, session_key, role, length(text) AS n_chars, has_answer FROM t")
def latest_turns(spark: SparkSession, root: str) -> DataFrame:
    return _turns(spark, root, "uid", "session_key", "role", "text", "has_answer").select("turn", "uid", "session_key", "role", F.length("text").alias("n_chars"), "has_answer")


@query(
    f"""WITH {checks.TURNS}, s AS (SELECT uid, session_key, min(sid) AS sid, min(session_ord) AS session_ord, min(date_int) AS date_int, min(ts) AS ts, count(*) AS n_turns FROM t GROUP BY uid, session_key)
SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts, session_key) AS clock_ord,
  CASE WHEN row_number() OVER (PARTITION BY uid, sid ORDER BY session_ord, session_key) = 1 THEN sid ELSE sid || '#' || row_number() OVER (PARTITION BY uid, sid ORDER BY session_ord, session_key) END AS repeat_key FROM s"""
)
def session_order(spark: SparkSession, root: str) -> DataFrame:
    sessions = memory.sessions_of(_turns(spark, root, "uid", "sid", "session_key", "session_ord", "date_int", "ts"))
    return memory.repeat_keys(memory.order_sessions(sessions, ["ts", "session_key"]), "session_ord")


@query(f"WITH {checks.TURNS} SELECT turn, array_to_string({checks.sql_stems('text')}, ' ') AS stems FROM t")
def stems_per_turn(spark: SparkSession, root: str) -> DataFrame:
    return _turns(spark, root, "text").select("turn", F.array_join(stems(F.col("text")), " ").alias("stems"))


@query(f"WITH {checks.CLAIMS}, {checks.ENTITIES}, {checks.HITS} SELECT ckey, array_to_string(tokens, ' ') AS tokens FROM claim_tok")
def claim_tokens_capped(spark: SparkSession, root: str) -> DataFrame:
    return memory.tokens_of(_worded(spark, root), _entities(spark, root)).select("ckey", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {checks.CLAIMS}, {checks.ENTITIES}, {checks.HITS}, {checks.NAMES}, {checks.DF} SELECT uid, stem, df FROM dfs")
def token_df(spark: SparkSession, root: str) -> DataFrame:
    entities = _entities(spark, root)
    return memory.token_df(memory.hits_of(_worded(spark, root), entities), memory.names_of(entities))


@query(
    f"""WITH {checks.CLAIMS} SELECT ckey, sha1(text || ' | ' || concat_ws('|', sid, turn_idx, cs, ce)) AS digest,
  CAST(('0x' || left(sha256(ckey), 14))::BIGINT // 8 AS BIGINT) AS vertex, 's|' || uid AS probe FROM c"""
)
def claim_ids(spark: SparkSession, root: str) -> DataFrame:
    digest = keys.claim_digest(F.col("text"), F.col("sid"), F.col("turn_idx"), F.col("cs"), F.col("ce"))
    return _claims(spark, root, "uid", "text", "sid", "turn_idx", "cs", "ce").select("ckey", digest.alias("digest"), keys.vertex_id(F.col("ckey")).alias("vertex"), keys.key("s", F.col("uid")).alias("probe"))


@query(f"WITH {checks.CLAIMS} SELECT uid, skey, count(*) AS n_claims FROM c WHERE skey IS NOT NULL AND skey <> '' GROUP BY uid, skey HAVING count(*) >= 2")
def contested_slots(spark: SparkSession, root: str) -> DataFrame:
    return memory.contested_slots(_claims(spark, root, "uid", "skey"))


@query(f"WITH {checks.CLAIMS} SELECT skey, ckey, row_number() OVER (PARTITION BY skey ORDER BY session_ord, t_event, ckey) AS position FROM c WHERE skey IS NOT NULL AND skey <> ''")
def slot_positions(spark: SparkSession, root: str) -> DataFrame:
    return memory.slot_positions(_slotted(spark, root)).select("skey", "ckey", "position")


@query(
    f"""WITH {checks.CLAIMS}, {checks.ENTITIES}, {checks.TURNS}, {checks.HITS}, {checks.NAMES}, {checks.DF},
sl AS (SELECT uid, skey, count(*) AS n FROM c WHERE skey IS NOT NULL AND skey <> '' GROUP BY uid, skey),
u AS (SELECT uid FROM c UNION SELECT uid FROM e UNION SELECT uid FROM t)
SELECT u.uid, (SELECT count(*) FROM c WHERE c.uid = u.uid) AS claims, (SELECT count(*) FROM e WHERE e.uid = u.uid) AS entities, (SELECT count(*) FROM sl WHERE sl.uid = u.uid) AS slots,
  (SELECT count(*) FROM dfs WHERE dfs.uid = u.uid) AS tokens, (SELECT count(DISTINCT session_key) FROM t WHERE t.uid = u.uid) AS sessions, (SELECT count(*) FROM t WHERE t.uid = u.uid) AS turns,
  (SELECT count(*) FROM (SELECT DISTINCT o.uid, s.older, s.newer FROM supersession_edges s JOIN c o ON o.ckey = s.older JOIN c n ON n.ckey = s.newer JOIN sl ON sl.skey = o.skey AND sl.n >= 2) s WHERE s.uid = u.uid) AS supersessions, (SELECT count(*) FROM sl WHERE sl.uid = u.uid AND n >= 2) AS contested_slots FROM u"""
)
def user_stats(spark: SparkSession, root: str) -> DataFrame:
    return memory.user_stats(_claims(spark, root, "uid", "skey", "text", "keywords", "mentions"), _entities(spark, root), _turns(spark, root, "uid", "session_key"), _edges(spark, root))


@query(f"WITH {checks.CLAIMS} SELECT ckey FROM c WHERE starts_with(skey, '{PREFIX}')")
def prefix_scan(spark: SparkSession, root: str) -> DataFrame:
    return _claims(spark, root, "skey").where(F.col("skey").startswith(PREFIX)).select("ckey")


@query(
    f"""WITH {checks.CLAIMS}, left_c AS (SELECT ckey, uid FROM c WHERE uid <> '{GONE}'),
gone AS (SELECT ckey FROM c WHERE uid = '{GONE}')
SELECT 'claims' AS kind, uid, count(*) AS n FROM left_c GROUP BY uid
UNION ALL SELECT 'edges', uid, count(*) FROM (SELECT DISTINCT uid, older, newer FROM supersession_edges WHERE coalesce(older, '') NOT IN (SELECT ckey FROM gone) AND coalesce(newer, '') NOT IN (SELECT ckey FROM gone)) GROUP BY uid"""
)
def delete_detach(spark: SparkSession, root: str) -> DataFrame:
    claims = _claims(spark, root, "uid")
    gone = claims.where(F.col("uid") == GONE).select("ckey")
    kept = upsert.delete_keys(claims, "ckey", gone).groupBy("uid").agg(F.count("*").alias("n")).select(F.lit("claims").alias("kind"), "uid", "n")
    edges = upsert.detach_delete(_edges(spark, root).select("uid", "older", "newer").distinct(), ["older", "newer"], gone)
    return kept.unionByName(edges.groupBy("uid").agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "uid", "n"))


@query(
    f"""WITH {checks.CLAIMS}, b AS (SELECT DISTINCT older, newer FROM supersession_edges)
SELECT older, newer FROM b WHERE older IN (SELECT ckey FROM c) AND newer IN (SELECT ckey FROM c)"""
)
def edge_upsert(spark: SparkSession, root: str) -> DataFrame:
    there = table(spark, root, "claims").select("ckey").where("ckey is not null").distinct()
    return upsert.merge_edges(_edges(spark, root).select("older", "newer"), there.withColumnRenamed("ckey", "older"), there.withColumnRenamed("ckey", "newer"), "older", "newer")


@query(
    f"""WITH {checks.CLAIMS}, n AS (SELECT ckey, max(status) AS status, max(at_session) AS at_session FROM (SELECT ckey, status, at_session FROM as_of_labels WHERE ckey IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ckey ORDER BY status DESC NULLS LAST, at_session DESC NULLS LAST) = 1) GROUP BY ckey)
SELECT coalesce(c.ckey, n.ckey) AS ckey, c.text, n.status, n.at_session FROM c FULL JOIN n ON c.ckey = n.ckey"""
)
def upsert_latest(spark: SparkSession, root: str) -> DataFrame:
    old = _claims(spark, root, "text")
    return upsert.merge_rows(old, table(spark, root, "as_of_labels").select("ckey", "status", "at_session"), "ckey").select("ckey", "text", "status", "at_session")


@query(
    f"""WITH {checks.CLAIMS} SELECT CASE WHEN located IS NULL THEN 'none' ELSE located END AS located, count(*) AS n, count(*) FILTER (speaker = 'assistant') AS by_assistant, count(*) FILTER (t_event > 0) AS dated FROM c GROUP BY 1"""
)
def span_quality(spark: SparkSession, root: str) -> DataFrame:
    return _claims(spark, root, "located", "speaker", "t_event").groupBy(F.coalesce("located", F.lit("none")).alias("located")).agg(F.count("*").alias("n"), F.count_if(F.col("speaker") == "assistant").alias("by_assistant"), F.count_if(F.col("t_event") > 0).alias("dated"))


@query(f"WITH {checks.CLAIMS}, s AS (SELECT uid, skey, count(*) AS n_claims FROM c WHERE skey IS NOT NULL AND skey <> '' GROUP BY uid, skey HAVING count(*) >= 2) SELECT uid, skey, n_claims FROM s QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n_claims DESC, skey) = 1")
def largest_slots(spark: SparkSession, root: str) -> DataFrame:
    return memory.largest_slots(_claims(spark, root, "uid", "skey"))


@query(f"WITH {checks.CLAIMS}, {checks.ENTITIES}, {checks.HITS}, {checks.NAMES}, {checks.DF} SELECT uid, stem, df FROM dfs ORDER BY df DESC, uid, stem LIMIT 10")
def top_tokens(spark: SparkSession, root: str) -> DataFrame:
    return memory.top_tokens(token_df(spark, root))


# Reconciliation

_KEYS = checks.sql_stems("n")


_CANON = f"""{checks.ENTITIES},
n AS MATERIALIZED (SELECT uid, canon, unnest(list_distinct(list_filter(list_transform([canon] || list_filter(aliases, lambda a: a IS NOT NULL), lambda n: array_to_string(list_sort({_KEYS}), ' ')), lambda k: k <> ''))) AS key FROM e),
l AS MATERIALIZED (SELECT DISTINCT a.uid, a.canon AS a, b.canon AS b FROM n a JOIN n b USING (uid, key)),
r AS (SELECT DISTINCT uid, canon AS a, canon AS b FROM e UNION SELECT r.uid, r.a, l.b FROM r JOIN l ON l.uid = r.uid AND l.a = r.b),
xs AS (SELECT uid, canon, bool_or(coalesce(existing, false)) AS existing FROM e GROUP BY uid, canon),
ren AS (SELECT r.uid, r.a AS canon, coalesce(min(r.b) FILTER (xs.existing), min(r.b)) AS new_canon FROM r JOIN xs ON xs.uid = r.uid AND xs.canon = r.b GROUP BY r.uid, r.a)"""


@query(f"WITH RECURSIVE {_CANON} SELECT uid, canon, new_canon FROM ren")
def canon_components(spark: SparkSession, root: str) -> DataFrame:
    return canon.reconcile(_entities(spark, root))


@query(
    f"""WITH RECURSIVE {_CANON}, {checks.CLAIMS}, {checks.MENTIONS}, m AS (SELECT e.uid, e.canon, mentions.ckey FROM mentions JOIN (SELECT DISTINCT uid, ekey, canon FROM e) e USING (ekey))
SELECT DISTINCT m.uid, coalesce(ren.new_canon, m.canon) AS canon, m.ckey FROM m LEFT JOIN ren ON ren.uid = m.uid AND ren.canon = m.canon"""
)
def renamed_mentions(spark: SparkSession, root: str) -> DataFrame:
    entities = _entities(spark, root)
    named = memory.mentions_of(_claims(spark, root, "mentions")).join(entities.select("uid", "ekey", "canon").distinct(), "ekey").select("uid", "canon", "ckey")
    return canon.rename_mentions(named, canon.reconcile(entities))


@query(f"WITH RECURSIVE {_CANON}, cold AS (SELECT uid, a AS canon, min(b) AS cold FROM r GROUP BY uid, a) SELECT uid, canon, cold, new_canon AS warm FROM cold JOIN ren USING (uid, canon) WHERE cold <> new_canon")
def canon_drift(spark: SparkSession, root: str) -> DataFrame:
    return canon.canon_drift(_entities(spark, root))


@query(f"WITH {checks.ENTITIES} SELECT uid, canon, array_to_string(aliases, ';') AS aliases FROM e")
def entity_aliases(spark: SparkSession, root: str) -> DataFrame:
    return _entities(spark, root).select("uid", "canon", F.array_join("aliases", ";").alias("aliases"))


# Supersession

_LABELS = """f AS (SELECT older, min(newer) AS newer, min(at_session) AS at_session FROM (SELECT *, min(at_session) OVER (PARTITION BY older) AS m FROM supersession_edges WHERE at_session <= {k} AND older IS NOT NULL AND newer IS NOT NULL) WHERE at_session = m GROUP BY older),
l AS (SELECT c.*, f.newer AS superseded_by, f.at_session, CASE WHEN f.older IS NULL THEN 'CURRENT' ELSE 'SUPERSEDED' END AS status FROM c LEFT JOIN f ON f.older = c.ckey WHERE session_ord <= {k})"""


@query(
    f"""WITH {checks.CLAIMS}, p AS (SELECT uid, skey, ckey, slot_value, session_ord, row_number() OVER (PARTITION BY skey ORDER BY session_ord, t_event, ckey) AS pos FROM c WHERE skey IS NOT NULL AND skey <> '')
SELECT a.uid, a.skey, a.ckey AS older, b.ckey AS newer, b.session_ord AS at_session FROM p a JOIN p b ON a.skey = b.skey AND b.pos = (SELECT min(x.pos) FROM p x WHERE x.skey = a.skey AND x.pos > a.pos AND x.slot_value IS DISTINCT FROM a.slot_value)"""
)
def supersession_detected(spark: SparkSession, root: str) -> DataFrame:
    return supersession.detect(_slotted(spark, root))


@query(
    f"""WITH {checks.CLAIMS}, p AS (SELECT skey, text, session_ord, t_event, row_number() OVER (PARTITION BY skey ORDER BY session_ord, t_event, ckey) AS pos, count(*) OVER (PARTITION BY skey) AS n FROM c WHERE skey IS NOT NULL AND skey <> '')
SELECT skey, 'SLOT: ' || substr(skey, strpos(skey, '|s|') + 3) || chr(10) || chr(10) || 'CLAIMS, oldest first:' || chr(10) || string_agg(pos || '. (session ' || session_ord || CASE WHEN t_event > 0 THEN ', event ' || t_event ELSE '' END || ') ' || text, chr(10) ORDER BY pos) AS prompt
FROM p WHERE n >= 2 GROUP BY skey"""
)
def slot_prompts(spark: SparkSession, root: str) -> DataFrame:
    return supersession.slot_prompts(_slotted(spark, root))


@query(f"WITH {checks.CLAIMS}, {_LABELS.format(k=AS_OF)} SELECT older, newer, at_session FROM f")
def fold_edges_asof(spark: SparkSession, root: str) -> DataFrame:
    return supersession.fold_edges(_edges(spark, root), AS_OF)


@query(
    f"""WITH {checks.CLAIMS}, {_LABELS.format(k=AS_OF)} SELECT skey, row_number() OVER (PARTITION BY skey ORDER BY session_ord, t_event, ckey) AS position, ckey, status, superseded_by, at_session FROM l WHERE skey IS NOT NULL AND skey <> ''"""
)
def slot_chain_asof(spark: SparkSession, root: str) -> DataFrame:
    return supersession.chains(_slotted(spark, root), _edges(spark, root), AS_OF).select("skey", "position", "ckey", "status", "superseded_by", "at_session")


@query(
    """WITH b AS (SELECT DISTINCT uid, ckey, as_of, status FROM as_of_labels WHERE as_of IS NOT NULL AND ckey IS NOT NULL),
o AS (SELECT uid, ckey, as_of, max(status) AS status FROM b GROUP BY uid, ckey, as_of)
SELECT uid, ckey, as_of, status FROM o QUALIFY row_number() OVER (PARTITION BY uid, ckey ORDER BY as_of) = 1 OR status IS DISTINCT FROM lag(status) OVER (PARTITION BY uid, ckey ORDER BY as_of)"""
)
def belief_changes(spark: SparkSession, root: str) -> DataFrame:
    read = table(spark, root, "as_of_labels").where("as_of is not null and ckey is not null").groupBy("uid", "ckey", "as_of").agg(F.max("status").alias("status"))
    return retrieval.belief_changes(read, ["uid", "ckey"], "as_of", "status")


@query(
    f"""WITH {checks.CLAIMS}, early AS (SELECT DISTINCT skey FROM c WHERE skey IS NOT NULL AND session_ord <= {AS_OF}), late AS (SELECT DISTINCT skey FROM c WHERE skey IS NOT NULL AND session_ord > {AS_OF})
(SELECT 'early' AS side, skey FROM (SELECT * FROM early EXCEPT SELECT * FROM late)) UNION ALL (SELECT 'late', skey FROM (SELECT * FROM late EXCEPT SELECT * FROM early))"""
)
def slot_drift(spark: SparkSession, root: str) -> DataFrame:
    """Slots that only the sessions up to AS_OF fill, and those that only later ones do."""
    slots = _claims(spark, root, "skey", "session_ord").where("skey is not null").groupBy("skey").agg(F.min("session_ord").alias("lo"), F.max("session_ord").alias("hi"))
    side = F.when(F.col("hi") <= AS_OF, "early").when(F.col("lo") > AS_OF, "late")
    return slots.select(side.alias("side"), "skey").where("side is not null")


# Lookups


@query(f"WITH {checks.reached()} SELECT qid, ckey, convergence, hops, round(score, 6) AS score, array_to_string(anchors, ' ') AS anchors FROM r")
def convergence(spark: SparkSession, root: str) -> DataFrame:
    return _reached(spark, root).select("qid", "ckey", "convergence", "hops", F.round("score", 6).alias("score"), F.array_join("anchors", " ").alias("anchors"))


@query(f"WITH {checks.reached()} SELECT qid, ckey, count(*) AS convergence FROM one WHERE hops = 1 GROUP BY qid, ckey")
def one_hop_convergence(spark: SparkSession, root: str) -> DataFrame:
    return _reached(spark, root, max_hops=1).select("qid", "ckey", F.col("convergence").cast("bigint").alias("convergence"))


@query(f"WITH {checks.reached(AS_OF)} SELECT qid, resolved, threshold, top_convergence, CASE WHEN reason IS NULL THEN 'ANSWER' ELSE 'ABSENT' END AS verdict, reason, array_to_string(unresolved, ' ') AS unresolved FROM v")
def verdicts(spark: SparkSession, root: str) -> DataFrame:
    return _ask(spark, root, AS_OF)[1].verdicts.withColumn("unresolved", F.array_join("unresolved", " "))


@query(f"WITH {checks.reached()} SELECT qid, ckey, rank FROM cand")
def topk_claims(spark: SparkSession, root: str) -> DataFrame:
    return _ask(spark, root)[1].candidates.select("qid", "ckey", "rank")


@query(f"WITH {checks.reached()} SELECT qid, rank, ckey, convergence, round(score, 4) AS score, array_to_string(anchors, ' ') AS anchors, false AS historical FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY convergence DESC, score DESC, t_event DESC, session_ord DESC, ckey) AS rank FROM r) WHERE rank <= 25")
def receipts(spark: SparkSession, root: str) -> DataFrame:
    questions, answers = _ask(spark, root)
    return retrieval.receipts(questions, answers.best.drop("rank")).withColumn("anchors", F.array_join("anchors", " "))


@query(f"WITH {checks.TURNS}, {checks.CLAIMS}, {checks.QUESTIONS} SELECT uid, count(*) AS questions FROM q WHERE uid NOT IN (SELECT uid FROM c WHERE uid IS NOT NULL) GROUP BY uid")
def missing_users(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.missing_users(_questions(spark, root), table(spark, root, "claims"))


@query(f"WITH {checks.evidence(AS_OF)} SELECT qid, ckey, position, status, convergence FROM ev")
def evidence_asof(spark: SparkSession, root: str) -> DataFrame:
    return _ask(spark, root, AS_OF)[1].evidence.select("qid", "ckey", "position", "status", "convergence")


@query(f"WITH {checks.evidence()}, g AS (SELECT qid, list(DISTINCT ckey) AS keys FROM ev GROUP BY qid) SELECT q.qid, sha256(array_to_string(list_sort(coalesce(g.keys, [])), chr(10))) AS hash FROM q LEFT JOIN g USING (qid)")
def determinism_hash(spark: SparkSession, root: str) -> DataFrame:
    return _ask(spark, root)[1].hashes


def _spans(spark: SparkSession, root: str) -> DataFrame:
    return _claims(spark, root, "uid", "sid", "turn_idx", "cs", "ce", "session_ord", "session_date", "t_event", "speaker")


_EXCERPTS = f"""{checks.evidence()}, tx AS (SELECT uid, sid, turn_idx, min(text) AS text FROM t GROUP BY ALL),
s AS (SELECT ev.qid, ev.position, ev.ckey, ev.status, tx.text, length(tx.text) AS n, greatest(0, least(c.cs, length(tx.text))) AS low, c.ce FROM ev JOIN c USING (ckey) JOIN tx ON tx.uid = c.uid AND tx.sid = c.sid AND tx.turn_idx = c.turn_idx),
x AS (SELECT *, greatest(low, least(ce, n)) AS high, greatest(0, low - 300) AS b FROM s),
ex AS (SELECT qid, position, ckey, right(ckey, 8) AS id, status, substr(text, b + 1, least(n, high + 300) - b) AS excerpt, low - b AS highlight_start, least(least(n, high + 300) - b, high - b) AS highlight_end FROM x)"""


@query(f"WITH {_EXCERPTS} SELECT * FROM ex")
def excerpts(spark: SparkSession, root: str) -> DataFrame:
    return ask.hydrate(_ask(spark, root)[1].evidence, _spans(spark, root), table(spark, root, "turns"))


@query(
    f"""WITH {checks.reached()}, p AS (SELECT q.qid, x.session_ord AS k FROM q JOIN (SELECT DISTINCT uid, session_ord FROM t) x USING (uid)),
b AS (SELECT p.qid, p.k, max(r.convergence) AS top, len(list_distinct(flatten(list(r.anchors)))) AS resolved FROM p LEFT JOIN r ON r.qid = p.qid AND r.session_ord <= p.k GROUP BY p.qid, p.k)
SELECT qid, k, CASE WHEN coalesce(resolved, 0) = 0 THEN 'A1_no_anchors' WHEN top < least(2, greatest(1, resolved)) THEN 'A2_no_convergence' ELSE 'ANSWER' END AS verdict, top AS top_convergence FROM b"""
)
def trajectory(spark: SparkSession, root: str) -> DataFrame:
    """What each question would have been told as of every session of its user."""
    sessions = _turns(spark, root, "uid", "session_ord").select("uid", F.col("session_ord").alias("k")).distinct()
    return ask.trajectory(_questions(spark, root), _memory(spark, root), sessions)


@query(
    f"""WITH {_EXCERPTS}, b AS (SELECT qid, count(*) AS n, string_agg('[' || id || '] ' || status || chr(10) || excerpt, chr(10) || chr(10) ORDER BY position) AS body FROM ex GROUP BY qid)
SELECT q.qid, 'QUESTION: ' || q.question || chr(10) || chr(10) || 'EXCERPTS (' || coalesce(b.n, 0) || '):' || chr(10) || chr(10) || coalesce(b.body, '') AS prompt FROM q LEFT JOIN b USING (qid)"""
)
def reader_prompts(spark: SparkSession, root: str) -> DataFrame:
    questions, answers = _ask(spark, root)
    return ask.reader_prompt(questions, ask.hydrate(answers.evidence, _spans(spark, root), table(spark, root, "turns")))


# Baselines

_BM25 = f"""{checks.TURNS}, {checks.QUESTIONS},
d AS MATERIALIZED (SELECT uid, turn, session_ord, turn_idx, {checks.sql_stems("text")} AS s FROM t),
st AS (SELECT uid, count(*) AS n, CASE WHEN avg(len(s)) > 0 THEN avg(len(s)) ELSE 1 END AS avg_len FROM d GROUP BY uid),
p AS MATERIALIZED (SELECT uid, turn, any_value(session_ord) AS session_ord, any_value(turn_idx) AS turn_idx, any_value(l) AS l, stem, count(*) AS tf FROM (SELECT uid, turn, session_ord, turn_idx, len(s) AS l, unnest(s) AS stem FROM d) GROUP BY uid, turn, stem),
f AS (SELECT uid, stem, count(*) AS df FROM p GROUP BY uid, stem),
a AS (SELECT DISTINCT qid, uid, unnest({checks.sql_stems("question")}) AS stem FROM q),
sc AS (SELECT a.qid, p.turn, any_value(p.session_ord) AS session_ord, any_value(p.turn_idx) AS turn_idx,
  round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avg_len)) ORDER BY a.stem), 9) AS score
  FROM a JOIN p ON p.uid = a.uid AND p.stem = a.stem JOIN f ON f.uid = p.uid AND f.stem = p.stem JOIN st ON st.uid = p.uid GROUP BY a.qid, p.turn)"""


@query(f"WITH {_BM25} SELECT qid, turn, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, session_ord, turn_idx, turn) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10")
def bm25_top10(spark: SparkSession, root: str) -> DataFrame:
    return baselines.bm25(_questions(spark, root), _turns(spark, root, "uid", "session_ord", "turn_idx", "text")).select("qid", "turn", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {_BM25}, k AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, session_ord, turn_idx, turn) <= 10)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY session_ord, turn_idx, turn) AS position, turn, session_ord || '-' || turn_idx AS id, 'CURRENT' AS status, 0 AS highlight_start, 0 AS highlight_end FROM k"""
)
def bm25_spans(spark: SparkSession, root: str) -> DataFrame:
    return baselines.as_spans(baselines.bm25(_questions(spark, root), _turns(spark, root, "uid", "session_ord", "turn_idx", "text")))


@query(
    f"""WITH {checks.TURNS}, z AS (SELECT uid, session_ord, sum(length(text)) AS chars FROM t GROUP BY uid, session_ord)
SELECT uid, session_ord, chars, row_number() OVER w = 1 OR sum(chars) OVER (PARTITION BY uid ORDER BY session_ord DESC ROWS UNBOUNDED PRECEDING) <= {BUDGET} AS kept FROM z WINDOW w AS (PARTITION BY uid ORDER BY session_ord DESC)"""
)
def full_context_budget(spark: SparkSession, root: str) -> DataFrame:
    return baselines.full_context(_turns(spark, root, "uid", "session_ord", "text"), BUDGET)


# Evaluation

_ROUNDS = "row_number() OVER (PARTITION BY question_type ORDER BY question_id)"


@query(f"SELECT question_id, question_type FROM (SELECT *, {_ROUNDS} AS round FROM eval_items) ORDER BY round, question_type, question_id LIMIT {SLICE}")
def stratified_slice(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.stratified(table(spark, root, "eval_items"), SLICE).select("question_id", "question_type")


@query(
    f"""WITH i AS (SELECT question_id, question_type, question_id LIKE '%\\_abs' ESCAPE '\\' AS ab FROM eval_items)
SELECT question_id, question_type FROM i WHERE ab AND {SLICE} > (SELECT count(*) FROM i WHERE ab)
UNION ALL (SELECT question_id, question_type FROM (SELECT *, {_ROUNDS} AS round FROM i WHERE NOT ab OR {SLICE} <= (SELECT count(*) FROM i WHERE ab)) ORDER BY round, question_type, question_id
  LIMIT (SELECT CASE WHEN {SLICE} <= count(*) FILTER (ab) THEN {SLICE} ELSE {SLICE} - count(*) FILTER (ab) END FROM i))"""
)
def benchmark_slice(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.benchmark_slice(table(spark, root, "eval_items"), SLICE)


_RUBRIC = " ".join(f"WHEN '{n}' THEN '{r.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || '{l.replace(chr(39), chr(39) * 2)}: ' || question_id || chr(10) || chr(10) || 'Reply: ' || left(text, 80) || chr(10) || chr(10) || 'Answer yes or no only.'" for n, (r, l) in evaluation.RUBRICS.items())


@query(
    f"""WITH j AS (SELECT *, CASE WHEN question_id LIKE '%\\_abs' ESCAPE '\\' THEN 'abstention' WHEN question_type IN ('temporal-reasoning', 'knowledge-update') THEN question_type WHEN question_type = 'preference' THEN 'single-session-preference' ELSE 'default' END AS template FROM eval_items)
SELECT item_id, template, CASE template {_RUBRIC} END AS prompt FROM j"""
)
def judge_prompts(spark: SparkSession, root: str) -> DataFrame:
    """The prompt of each test item's rubric; its id stands for the expected answer, the beginning of its text for the reply."""
    asked = F.col("question_type")
    kind = F.when(asked == "preference", "single-session-preference").when(asked.isin(*KINDS), asked).otherwise("multi-session")
    items = table(spark, root, "eval_items").withColumn("template", evaluation.judge_template(kind, evaluation.is_abstention(F.col("question_id"))))
    return items.select("item_id", "template", evaluation.judge_prompt(F.col("template"), F.col("text"), F.col("question_id"), F.substring("text", 1, 80)).alias("prompt"))


_COVER = f"{checks.TURNS}, {checks.CLAIMS}, cov AS (SELECT uid, sid, turn_idx, EXISTS (SELECT 1 FROM c WHERE c.uid = t.uid AND c.sid = t.sid AND c.turn_idx = t.turn_idx) AS covered FROM t WHERE has_answer)"


def _coverage(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.turn_coverage(_turns(spark, root, "uid", "sid", "turn_idx", "has_answer"), _claims(spark, root, "uid", "sid", "turn_idx"))


@query(f"WITH {_COVER} SELECT uid, count(*) AS answer_turns, count(*) FILTER (covered) AS covered_turns, count(*) FILTER (covered) / count(*) AS recall FROM cov GROUP BY uid")
def extraction_recall(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.extraction_recall(_coverage(spark, root))


@query(
    f"""WITH {_COVER}, k AS (SELECT CASE WHEN uid LIKE '%\\_abs' ESCAPE '\\' THEN 'abstention' ELSE 'answerable' END AS kind, covered FROM cov)
SELECT coalesce(kind, 'ALL') AS kind, count(*) AS answer_turns, count(*) FILTER (covered) AS covered_turns, CASE WHEN count(*) = 0 THEN 1 ELSE count(*) FILTER (covered) / count(*) END AS recall FROM k GROUP BY ROLLUP (kind)"""
)
def recall_by_type(spark: SparkSession, root: str) -> DataFrame:
    coverage = _coverage(spark, root)
    return evaluation.micro_recall(coverage.withColumn("kind", F.when(evaluation.is_abstention(F.col("uid")), "abstention").otherwise("answerable")), "kind")


def _rows(spark: SparkSession, root: str) -> DataFrame:
    questions, answers = _ask(spark, root)
    sids = answers.evidence.join(_claims(spark, root, "sid").select("ckey", F.col("sid").alias("esid")), "ckey").select("qid", F.col("esid").alias("sid"))
    right = _turns(spark, root, "uid", "sid", "has_answer").where("has_answer").select("uid", "sid").distinct()
    hits = evaluation.session_hits(questions.select("qid", "uid", "question_type", "is_abstention"), sids, right)
    counts = answers.evidence.groupBy("qid").agg(F.count("*").alias("reader_tokens"))
    both = hits.join(answers.verdicts.select("qid", "verdict", "reason"), "qid").join(counts, "qid", "left").withColumn("reader_tokens", F.coalesce("reader_tokens", F.lit(0)))
    return both.withColumn("not_in_memory", F.col("reader_tokens") == 0).withColumn("judged", F.col("session_hit") != F.col("is_abstention"))


_ROWS = f"""{checks.evidence()}, ans AS (SELECT uid, list(DISTINCT sid) AS sids FROM t WHERE has_answer GROUP BY uid),
es AS (SELECT qid, list(DISTINCT c.sid) AS sids, count(*) AS n FROM ev JOIN c USING (ckey) GROUP BY qid),
rows AS MATERIALIZED (SELECT q.qid, q.question_type, q.is_abstention, v.reason, v.reason IS NOT NULL AS absent, coalesce(es.sids, []) AS es, coalesce(ans.sids, []) AS ans, list_has_any(coalesce(es.sids, []), coalesce(ans.sids, [])) AS hit, coalesce(es.n, 0) AS n
  FROM q JOIN v USING (qid) LEFT JOIN es USING (qid) LEFT JOIN ans ON ans.uid = q.uid)"""


@query(f"WITH {_ROWS} SELECT qid, array_to_string(list_sort(es), ' ') AS evidence_sessions, array_to_string(list_sort(ans), ' ') AS answer_sessions, hit AS session_hit FROM rows")
def session_hits(spark: SparkSession, root: str) -> DataFrame:
    return _rows(spark, root).select("qid", F.array_join("evidence_sessions", " ").alias("evidence_sessions"), F.array_join("answer_sessions", " ").alias("answer_sessions"), "session_hit")


@query(
    f"""WITH {_ROWS}, j AS (SELECT *, hit <> is_abstention AS judged, absent OR n = 0 AS refused FROM rows)
SELECT coalesce(question_type, 'ALL') AS question_type, count(*) AS n, count(*) FILTER (is_abstention AND judged) / nullif(count(*) FILTER (is_abstention), 0) AS abstention_accuracy,
  count(*) FILTER (NOT is_abstention AND judged) / nullif(count(*) FILTER (NOT is_abstention), 0) AS accuracy, count(*) FILTER (NOT is_abstention AND refused) / nullif(count(*) FILTER (NOT is_abstention), 0) AS false_abstention,
  count(*) FILTER (NOT is_abstention AND len(ans) > 0 AND hit) / nullif(count(*) FILTER (NOT is_abstention AND len(ans) > 0), 0) AS session_recall, coalesce(median(n), 0) AS tokens_p50,
  count(*) FILTER (reason = 'A1_no_anchors') AS a1, count(*) FILTER (reason = 'A2_no_convergence') AS a2 FROM j GROUP BY ROLLUP (question_type)"""
)
def eval_summary_rollup(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.summaries(_rows(spark, root))


@query(
    f"""WITH {_ROWS} SELECT coalesce(question_type, 'ALL') AS question_type, count(*) FILTER (NOT is_abstention) AS answerable,
  coalesce(count(*) FILTER (NOT is_abstention AND hit) / nullif(count(*) FILTER (NOT is_abstention), 0), 0) AS session_recall, coalesce(count(*) FILTER (NOT is_abstention AND absent) / nullif(count(*) FILTER (NOT is_abstention), 0), 0) AS false_abstention,
  count(*) FILTER (is_abstention) AS abstention_questions, count(*) FILTER (is_abstention AND absent) / nullif(count(*) FILTER (is_abstention), 0) AS abstention_recall,
  count(*) FILTER (is_abstention AND absent) / nullif(count(*) FILTER (absent), 0) AS abstention_precision, count(*) FILTER (reason = 'A1_no_anchors') AS a1, count(*) FILTER (reason = 'A2_no_convergence') AS a2
FROM rows GROUP BY ROLLUP (question_type)"""
)
def gate_report(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.gate_report(_rows(spark, root))


# Scalars


@query(
    f"""WITH {checks.CLAIMS}, d AS (SELECT ckey, CASE t_prec WHEN 'day' THEN strftime(make_date(t_event // 10000, t_event // 100 % 100, t_event % 100), '%Y-%m-%d') WHEN 'month' THEN (t_event // 10000) || '-' || lpad((t_event // 100 % 100)::VARCHAR, 2, '0') WHEN 'year' THEN (t_event // 10000)::VARCHAR ELSE 'last week' END AS said, t_event, t_prec FROM c)
SELECT ckey, said, t_event, t_prec FROM d"""
)
def event_date_parse(spark: SparkSession, root: str) -> DataFrame:
    c = _claims(spark, root, "t_event", "t_prec")
    year, month, day = F.floor(F.col("t_event") / 10000), F.pmod(F.floor(F.col("t_event") / 100), F.lit(100)), F.pmod("t_event", F.lit(100))
    said = F.when(F.col("t_prec") == "day", F.format_string("%d-%02d-%02d", year, month, day)).when(F.col("t_prec") == "month", F.format_string("%d-%02d", year, month)).when(F.col("t_prec") == "year", F.format_string("%d", year)).otherwise("last week")
    return c.select("ckey", said.alias("said")).select("ckey", "said", dates.event_date(F.col("said")).alias("d")).select("ckey", "said", "d.t_event", "d.t_prec")


@query(f"WITH {checks.TURNS} SELECT turn, ts // 60 * 60 AS ts, CAST(strftime(make_timestamp(ts * 1000000), '%Y%m%d') AS INT) AS date_int FROM t")
def session_stamp_parse(spark: SparkSession, root: str) -> DataFrame:
    stamp = F.date_format(F.timestamp_seconds("ts"), "yyyy/MM/dd '('EEE')' HH:mm")
    return _turns(spark, root, "ts").select("turn", dates.session_stamp(stamp).alias("d")).select("turn", "d.ts", "d.date_int")


_SPANS = f"{checks.TURNS}, {checks.CLAIMS}, tx AS (SELECT uid, sid, turn_idx, min(text) AS text FROM t GROUP BY ALL), z AS (SELECT c.ckey, tx.text, substr(tx.text, c.cs + 1, c.ce - c.cs) AS quote FROM c LEFT JOIN tx USING (uid, sid, turn_idx))"


def _quotes(spark: SparkSession, root: str) -> DataFrame:
    texts = _turns(spark, root, "uid", "sid", "turn_idx", "text").groupBy("uid", "sid", "turn_idx").agg(F.min("text").alias("text"))
    return _claims(spark, root, "uid", "sid", "turn_idx", "cs", "ce").join(texts, ["uid", "sid", "turn_idx"], "left").select("ckey", "cs", "ce", texts["text"].alias("turn_text")).withColumn("quote", F.substring("turn_text", F.col("cs") + 1, F.col("ce") - F.col("cs")))


@query(
    f"""WITH {_SPANS} SELECT ckey, CASE WHEN text IS NOT NULL AND trim(regexp_replace(quote, '\\s', ' ', 'g')) <> '' THEN strpos(text, quote) - 1 END AS cs,
  CASE WHEN text IS NULL THEN 'bad_turn_idx' WHEN trim(quote) = '' THEN 'empty_quote' WHEN trim(regexp_replace(quote, '\\s', ' ', 'g')) = '' THEN 'span_not_found' END AS drop_reason FROM z"""
)
def span_locate(spark: SparkSession, root: str) -> DataFrame:
    found = _quotes(spark, root).withColumn("at", locate_span(F.col("turn_text"), F.col("quote")))
    return found.select("ckey", "at.cs", evaluation.drop_reason(F.col("turn_text"), F.col("quote"), F.col("at.cs")).alias("drop_reason"))


@query(f"WITH {_SPANS} SELECT CASE WHEN text IS NULL THEN 'bad_turn_idx' WHEN trim(quote) = '' THEN 'empty_quote' WHEN trim(regexp_replace(quote, '\\s', ' ', 'g')) = '' THEN 'span_not_found' ELSE 'kept' END AS reason, count(*) AS n FROM z GROUP BY 1")
def drop_histogram(spark: SparkSession, root: str) -> DataFrame:
    return span_locate(spark, root).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
