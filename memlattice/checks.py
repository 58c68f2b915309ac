"""SQL building blocks of the checks, written apart from the operators they check."""

from __future__ import annotations

from memlattice.functions.text import IRREGULAR, STOPWORDS


def sql_stem(w: str) -> str:
    def undoubled(b: str) -> str:
        return f"CASE WHEN length({b}) > 1 AND right({b}, 1) = substr({b}, length({b}) - 1, 1) AND contains('bdfglmnprt', right({b}, 1)) THEN left({b}, length({b}) - 1) ELSE {b} END"

    irregular = " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    base = (
        f"CASE {irregular} WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN {w} LIKE '%sses' OR {w} LIKE '%shes' OR {w} LIKE '%ches' THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' AND {w} NOT LIKE '%is' THEN left({w}, length({w}) - 1) "
        f"WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN {undoubled(f'left({w}, length({w}) - 3)')} "
        f"WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN {undoubled(f'left({w}, length({w}) - 2)')} ELSE {w} END"
    )
    return f"CASE WHEN length({w}) <= 3 THEN {w} ELSE regexp_replace({base}, '^(.{{3,}})e$', '\\1', 's') END"


def sql_stems(text: str) -> str:
    stops = ", ".join(f"'{s}'" for s in STOPWORDS)
    words = f"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}]+)?'), lambda w: regexp_replace(w, '[''’]s$', ''))"
    content = f"list_filter({words}, lambda w: length(w) >= 2 AND NOT list_contains([{stops}], w))"
    return f"list_filter(list_transform({content}, lambda w: {sql_stem('w')}), lambda w: length(w) >= 2)"


def in_order(items: str) -> str:
    """Distinct elements in order of first occurrence."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


TURNS = "t AS MATERIALIZED (SELECT turn, uid, sid, session_key, session_ord, date_int, ts, turn_idx, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '') AS text, coalesce(has_answer, false) AS has_answer FROM turns QUALIFY row_number() OVER (PARTITION BY turn ORDER BY ingested_at DESC) = 1)"
CLAIMS = "c AS MATERIALIZED (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY ckey ORDER BY ingested_at DESC) = 1)"
ENTITIES = """e AS MATERIALIZED (SELECT uid, ekey, canon, min(etype) AS etype, coalesce(list_sort(list_distinct(flatten(list(coalesce(aliases, []))))), []) AS aliases, max(existing) AS existing
  FROM entities WHERE canon IS NOT NULL AND canon <> '' GROUP BY uid, ekey, canon)"""
HITS = f"""nm AS (SELECT ckey, flatten(list([canon] || aliases ORDER BY pos, canon)) AS names FROM (SELECT ckey, unnest(mentions) AS ekey, generate_subscripts(mentions, 1) AS pos FROM c) JOIN e USING (ekey) GROUP BY ckey),
tok AS MATERIALIZED (SELECT uid, ckey, flatten(list_transform(list_filter(coalesce(keywords, []), lambda v: v IS NOT NULL), lambda v: {sql_stems('v')})) ||
  flatten(list_transform(list_filter(coalesce(names, []), lambda v: v IS NOT NULL), lambda v: {sql_stems('v')})) || {sql_stems('text')} AS raw FROM (SELECT c.*, nm.names FROM c LEFT JOIN nm USING (ckey))),
claim_tok AS MATERIALIZED (SELECT uid, ckey, ({in_order('raw')})[1:24] AS tokens FROM tok),
hits AS MATERIALIZED (SELECT uid, unnest(tokens) AS stem, ckey FROM claim_tok)"""
NAMES = f"names AS MATERIALIZED (SELECT DISTINCT uid, unnest(flatten(list_transform([canon] || aliases, lambda v: {sql_stems('v')}))) AS stem, ekey FROM e)"
MENTIONS = "mentions AS MATERIALIZED (SELECT DISTINCT ckey, ekey FROM (SELECT ckey, unnest(mentions) AS ekey FROM c) WHERE ekey IS NOT NULL)"
DF = "dfs AS MATERIALIZED (SELECT coalesce(h.uid, n.uid) AS uid, coalesce(h.stem, n.stem) AS stem, coalesce(h.df, 0) AS df FROM (SELECT uid, stem, count(DISTINCT ckey) AS df FROM hits GROUP BY ALL) h FULL JOIN (SELECT DISTINCT uid, stem FROM names) n ON h.uid = n.uid AND h.stem = n.stem)"
QUESTIONS = "q AS MATERIALIZED (SELECT turn AS qid, uid, sid, text AS question, (['knowledge-update', 'multi-session', 'single-session-assistant', 'single-session-preference', 'single-session-user', 'temporal-reasoning'])[session_ord % 6 + 1] AS question_type, uid LIKE '%\\_abs' ESCAPE '\\' AS is_abstention FROM t WHERE turn_idx % 20 = 0 AND text <> '')"


def reached(as_of: int | None = None) -> str:
    """The common part of all lookups: anchors, reach, convergence."""
    cut = f"WHERE session_ord <= {as_of}" if as_of is not None else ""
    return f"""{TURNS}, {CLAIMS}, {ENTITIES}, {HITS}, {NAMES}, {MENTIONS}, {DF}, {QUESTIONS},
a AS MATERIALIZED (SELECT DISTINCT qid, uid, unnest({sql_stems('question')}) AS stem FROM q),
led AS MATERIALIZED (SELECT a.qid, a.uid, a.stem, h.ckey, 1 AS hops FROM a JOIN hits h ON a.uid = h.uid AND a.stem = h.stem
  UNION ALL SELECT a.qid, a.uid, a.stem, m.ckey, 2 FROM a JOIN names n ON a.uid = n.uid AND a.stem = n.stem JOIN mentions m ON m.ekey = n.ekey),
one AS MATERIALIZED (SELECT qid, uid, stem, ckey, min(hops) AS hops FROM led GROUP BY ALL),
totals AS (SELECT uid, count(*) AS total FROM c GROUP BY uid),
w AS (SELECT one.*, ln(1.0 + coalesce(totals.total, 0) / greatest(1, coalesce(dfs.df, 0))) AS w FROM one LEFT JOIN dfs ON dfs.uid = one.uid AND dfs.stem = one.stem LEFT JOIN totals ON totals.uid = one.uid),
f AS (SELECT qid, ckey, count(*) AS convergence, min(hops) AS hops, round(sum(w ORDER BY stem), 9) AS score, list(stem ORDER BY stem) AS anchors FROM w GROUP BY qid, ckey),
r AS MATERIALIZED (SELECT f.*, c.session_ord, c.t_event, c.skey FROM f JOIN (SELECT * FROM c {cut}) c USING (ckey)),
found AS (SELECT qid, max(convergence) AS top, list_distinct(flatten(list(anchors))) AS anchors FROM r GROUP BY qid),
asked AS (SELECT qid, list(stem) AS asked FROM a GROUP BY qid),
v0 AS (SELECT q.qid, coalesce(found.top, 0) AS top_convergence, coalesce(len(found.anchors), 0) AS resolved, coalesce(found.anchors, []) AS f, coalesce(asked.asked, []) AS a FROM q LEFT JOIN found USING (qid) LEFT JOIN asked USING (qid)),
v1 AS (SELECT *, least(2, greatest(1, resolved)) AS threshold FROM v0),
v AS MATERIALIZED (SELECT qid, resolved, threshold, top_convergence, CASE WHEN resolved = 0 THEN 'A1_no_anchors' WHEN top_convergence < threshold THEN 'A2_no_convergence' END AS reason,
  list_sort(list_filter(a, lambda s: NOT list_contains(f, s))) AS unresolved FROM v1),
cand AS MATERIALIZED (SELECT r.*, row_number() OVER (PARTITION BY r.qid ORDER BY convergence DESC, score DESC, t_event DESC, session_ord DESC, ckey) AS rank
  FROM r JOIN v USING (qid) WHERE v.reason IS NULL AND r.convergence >= v.threshold QUALIFY rank <= 25)"""


def evidence(as_of: int | None = None) -> str:
    cut = f"session_ord <= {as_of}" if as_of is not None else "true"
    seen = f"at_session <= {as_of}" if as_of is not None else "true"
    return f"""{reached(as_of)},
mates AS (SELECT s.qid, c.ckey, c.session_ord, c.t_event FROM (SELECT DISTINCT qid, skey FROM cand WHERE skey IS NOT NULL AND skey <> '') s JOIN c USING (skey)
  WHERE {cut} AND NOT EXISTS (SELECT 1 FROM cand WHERE cand.qid = s.qid AND cand.ckey = c.ckey)
  QUALIFY row_number() OVER (PARTITION BY s.qid ORDER BY c.session_ord DESC, c.ckey) <= 40),
folded AS (SELECT older, min(at_session) AS at_session FROM supersession_edges WHERE at_session IS NOT NULL AND older IS NOT NULL AND newer IS NOT NULL AND {seen} GROUP BY older),
ev0 AS (SELECT qid, ckey, session_ord, t_event, convergence FROM cand UNION ALL SELECT qid, ckey, session_ord, t_event, 0 FROM mates),
ev AS MATERIALIZED (SELECT ev0.*, CASE WHEN older IS NULL THEN 'CURRENT' ELSE 'SUPERSEDED' END AS status,
  row_number() OVER (PARTITION BY qid ORDER BY older IS NOT NULL, CASE WHEN t_event = 0 THEN 2147483647 ELSE t_event END, session_ord, ckey) AS position FROM ev0 LEFT JOIN folded ON older = ckey)"""
