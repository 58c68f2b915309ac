"""Questions against what is remembered of their user, without a row for each pair of question and document.

Everything that a question is held against belongs to one user, so a user's
documents and questions are brought together once, in the order documents,
slots, sessions, questions. A task inverts the documents of a user and then
folds the postings of one question after another; what is written or shuffled
is what is asked for (the best, the evidence, a row for each session), and all
pairs only where all pairs are the result. The questions of a user with many of
them are dealt to several tasks, each of which gets that user's documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task folds about so many questions of one user; a user's documents are copied for at most so many tasks, which then fold more.
QUESTIONS, TASKS = 2_000, 8
#: Rows of a batch that a task hands on.
ROWS = 5_000

DOC, SLOT, POINT, QUESTION = range(4)
_TYPES = {"id": "string", "terms": "array<string>", "hop": "int", "ord": "bigint", "event": "bigint", "skey": "string", "superseded_by": "string", "at_session": "bigint"}
_REACHED = {"rank": "int", "ckey": "string", "session_ord": "bigint", "t_event": "bigint", "skey": "string", "superseded_by": "string", "at_session": "bigint", "position": "int", "convergence": "int", "hops": "int", "score": "double", "anchors": "array<string>", "found": "array<string>", "hash": "string"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def gathered(questions: DataFrame, **kinds: DataFrame) -> DataFrame:
    """The rows of each user together and in the order of their kinds. questions: uid, id, terms; docs, slots, points: uid and columns of _TYPES."""
    busy = questions.groupBy("uid").agg(F.least(F.ceil(F.count("*") / QUESTIONS), F.lit(TASKS)).cast("int").alias("_tasks")).where("_tasks > 1")
    rows = None
    for kind, df in ((DOC, kinds.get("docs")), (SLOT, kinds.get("slots")), (POINT, kinds.get("points")), (QUESTION, questions)):
        if df is None:
            continue
        # at most one row for every QUESTIONS questions
        spread = df.where("uid is not null").join(F.broadcast(busy), "uid", "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1)))
        dealt = F.array(F.pmod(F.xxhash64("id"), F.col("_tasks")).cast("int")) if kind == QUESTION else F.sequence(F.lit(0), F.col("_tasks") - 1)
        columns = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()]
        part = spread.select("uid", F.explode(dealt).alias("task"), F.lit(kind).alias("kind"), *columns)
        rows = part if rows is None else rows.unionByName(part)
    return rows.repartition("uid", "task").sortWithinPartitions("uid", "task", "kind")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("uid", "task", "kind")), strict=True))
        at = 0
        for (uid, task, kind), run in groupby(keys):
            n = len(list(run))
            yield (uid, task), kind, batch.slice(at, n)
            at += n


def _by_user(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[int, pa.Table], pa.RecordBatch]]:
    """What a user's questions are held against, by kind, and questions; the same dict for all questions of a user."""
    now, parts, tables = None, {}, None
    for user, kind, rows in _stretches(batches):
        if user != now:
            now, parts, tables = user, {}, None
        if kind != QUESTION:
            parts.setdefault(kind, []).append(rows)
            continue
        if tables is None:
            tables = {k: pa.Table.from_batches(p).combine_chunks() for k, p in parts.items()}
            parts = {}
        yield tables, rows


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def billionths(x: np.ndarray) -> np.ndarray:
    """Numbers rounded to nine places, halves up, in units of the ninth place."""
    y = x * 1e9
    low = np.floor(y)
    out = (low + (y - low >= 0.5)).astype(np.int64)
    near = np.nonzero(np.abs(y - low - 0.5) < 1e-3)[0]
    if len(near):
        values, where = np.unique(x[near], return_inverse=True)
        out[near] = np.array([int(Decimal(repr(float(v))).scaleb(9).to_integral_value(ROUND_HALF_UP)) for v in values], dtype=np.int64)[where]
    return out


class Postings:
    """Documents by term. Documents are numbered in the order that ties are settled by, postings of a term by document."""

    def __init__(self, rows: pa.Table, order: list[tuple[str, str]]) -> None:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[*order, ("id", "ascending")], null_placement="at_end"))
        ids, terms = _one(rows["id"]), _one(rows["terms"])
        if len(ids):
            first = np.concatenate(([True], pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False).astype(bool)))
        else:
            first = np.zeros(0, dtype=bool)
        self.rows = rows.filter(pa.array(first))
        self.n = self.rows.num_rows
        lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(first) - 1
        coded = terms.flatten().dictionary_encode()
        self.names = coded.dictionary
        self.code = {name: k for k, name in enumerate(self.names.to_pylist())}
        hop = rows["hop"].to_numpy()
        keys = (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, self.n) + np.repeat(number, lengths)) * 2 + np.repeat(hop > 1, lengths)
        keys.sort()
        self.lead = len(hop) - int((hop > 1).sum())
        new = np.concatenate(([True], keys[1:] >> 1 != keys[:-1] >> 1)) if len(keys) else np.zeros(0, dtype=bool)
        self.times = np.diff(np.append(np.nonzero(new)[0], len(keys)))
        keys = keys[new]
        self.hop = (keys & 1).astype(np.int8) + 1
        self.term, self.doc = (keys >> 1) // max(1, self.n), (keys >> 1) % max(1, self.n)
        self._starts()
        self.direct = np.bincount(self.term[self.hop == 1], minlength=len(self.names))

    def _starts(self) -> None:
        self.start = np.searchsorted(self.term, np.arange(len(self.names) + 1))

    def keep(self, docs: np.ndarray) -> None:
        """Only the documents marked are met from now on."""
        kept = docs[self.doc]
        self.hop, self.term, self.doc, self.times = self.hop[kept], self.term[kept], self.doc[kept], self.times[kept]
        self._starts()

    def asked(self, terms: list[str] | None) -> list[int]:
        """The codes of a question's terms that lead anywhere, in the terms' order."""
        codes = (self.code.get(t) for t in sorted(set(terms or ())))
        return [c for c in codes if c is not None and self.start[c + 1] > self.start[c]]

    def met(self, codes: list[int]) -> np.ndarray:
        """Places of the postings of some terms, term by term."""
        return np.concatenate([np.arange(self.start[c], self.start[c + 1]) for c in codes]) if codes else np.zeros(0, dtype=np.int64)


def best(keys: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest keys, in their order; among equals the first documents (docs ascend)."""
    place = np.arange(len(keys))
    if len(keys) > k:
        least = np.partition(keys, len(keys) - k)[len(keys) - k]
        above = np.nonzero(keys > least)[0]
        place = np.concatenate((above, np.nonzero(keys == least)[0][: k - len(above)]))
    return place[np.lexsort((docs[place], -keys[place]))]


class _Claims(Postings):
    def __init__(self, rows: pa.Table, as_of: int | None) -> None:
        super().__init__(rows, [("event", "descending"), ("ord", "descending")])
        # idf of all claims, also of those that aren't seen yet
        self.weight = np.array([math.log(1.0 + self.lead / max(1, int(d))) for d in self.direct], dtype=np.float64)
        self.ord = self.rows["ord"].to_numpy().astype(np.float64)  # nan where there is none
        if as_of is not None:
            self.keep(self.ord <= as_of)

    def fold(self, codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the postings met; the documents reached, how many terms reach each and their score in billionths, summed in the terms' order."""
        at = self.met(codes)
        doc = self.doc[at]
        times = np.bincount(doc, minlength=self.n)
        reached = np.nonzero(times)[0]
        score = np.bincount(doc, weights=self.weight[self.term[at]], minlength=self.n)[reached]
        return at, reached, times[reached], billionths(score)

    def anchors(self, at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents in ascending order the terms that reach them, one document after another, and their least hops."""
        wanted = np.zeros(self.n, dtype=bool)
        wanted[docs] = True
        at = at[wanted[self.doc[at]]]
        at = at[np.argsort(self.doc[at], kind="stable")]
        starts = np.concatenate(([0], np.nonzero(np.diff(self.doc[at]))[0] + 1)) if len(at) else np.zeros(0, dtype=np.int64)
        return self.term[at], np.minimum.reduceat(self.hop[at], starts) if len(at) else np.zeros(0, dtype=np.int8)


class _Slots:
    """The claims of slots, numbered from the newest."""

    def __init__(self, rows: pa.Table, claims: _Claims) -> None:
        self.rows = rows.take(pc.sort_indices(rows, sort_keys=[("ord", "descending"), ("id", "ascending")], null_placement="at_end"))
        self.doc = pc.fill_null(pc.index_in(self.rows["id"], value_set=_one(claims.rows["id"])), -1).to_numpy().astype(np.int64)
        self.of: dict[str, list[int]] = {}
        for k, skey in enumerate(self.rows["skey"].to_pylist()):
            self.of.setdefault(skey, []).append(k)

    def mates(self, skeys: set[str], docs: np.ndarray, most: int) -> np.ndarray:
        lists = [self.of[s] for s in skeys if s in self.of]
        if not lists:
            return np.zeros(0, dtype=np.int64)
        at = np.sort(np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]))
        return at[~np.isin(self.doc[at], docs)][:most]


_NOTHING = pa.table({c: pa.array([], _ARROW[t]) for c, t in _TYPES.items()})


class _Out:
    """Rows of lookups, gathered until they make a batch."""

    def __init__(self, kind: str) -> None:
        self.schema = pa.schema([("qid", _ARROW[kind]), *((c, _ARROW[t]) for c, t in _REACHED.items())])
        self.parts: list[pa.Table] = []
        self.n = 0

    def add(self, n: int, **columns) -> None:
        arrays = []
        for field in self.schema:
            x = columns.get(field.name)
            x = pa.nulls(n, field.type) if x is None else x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, field.type)
            arrays.append(x if x.type == field.type else x.cast(field.type))
        self.parts.append(pa.table(arrays, schema=self.schema))
        self.n += n

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from pa.concat_tables(self.parts).combine_chunks().to_batches()
        self.parts, self.n = [], 0


_NAMED = {"ckey": "id", "session_ord": "ord", "t_event": "event", "skey": "skey", "superseded_by": "superseded_by", "at_session": "at_session"}


def _columns(rows: pa.Table, at: np.ndarray) -> dict[str, pa.Array]:
    taken = rows.select([*dict.fromkeys(_NAMED.values())]).take(pa.array(at))
    return {c: _one(taken[v]) for c, v in _NAMED.items()}


def reached_all(rows: DataFrame, as_of: int | None = None) -> DataFrame:
    """qid, claim columns, convergence, hops, score, anchors: each claim that a question reaches. rows: gathered questions and docs."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, out = None, _Out("string")
        for now, asked in _by_user(batches):
            if now is not tables:
                tables, claims = now, _Claims(now.get(DOC, _NOTHING), as_of)
            for qid, terms in zip(asked.column("id").to_pylist(), asked.column("terms").to_pylist(), strict=True):
                at, docs, times, score = claims.fold(claims.asked(terms))
                if not len(docs):
                    continue
                codes, hops = claims.anchors(at, docs)
                anchors = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(times))), pa.int32()), claims.names.take(pa.array(codes)))
                out.add(len(docs), qid=[qid] * len(docs), **_columns(claims.rows, docs), convergence=times, hops=hops, score=score / 1e9, anchors=anchors)
                if out.n >= ROWS:
                    yield from out.drain()
        yield from out.drain()

    found = rows.mapInArrow(fold, ", ".join(f"{c} {t}" for c, t in ({"qid": "string"} | _REACHED).items()))
    return found.select("qid", "ckey", "session_ord", "t_event", "skey", "convergence", "hops", "score", "anchors")


def typed(found: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns in the types of the tables that they come from."""
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in ("session_ord", "t_event", "at_session") if c in found.columns and c in kinds})


def lookups(rows: DataFrame, as_of: int | None, historical: bool, top_k: int, most_mates: int, threshold: int) -> DataFrame:
    """Of each question that reaches a claim its top_k (rank from 1) and, if it gets an answer, the newest other claims of their slots (no rank).

    position is the place in the evidence, null for claims that are none of
    it. The first row of a question has in found all terms that lead to a
    claim, and the hash of its evidence. rows: gathered questions, docs, slots.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, out = None, _Out("string")
        for now, asked in _by_user(batches):
            if now is not tables:
                tables, claims = now, _Claims(now.get(DOC, _NOTHING), as_of)
                slots = _Slots(now.get(SLOT, _NOTHING), claims)
            for qid, terms in zip(asked.column("id").to_pylist(), asked.column("terms").to_pylist(), strict=True):
                codes = claims.asked(terms)
                at, docs, times, score = claims.fold(codes)
                if not len(docs):
                    continue
                top = best((times.astype(np.int64) << 44) | score, docs, top_k)
                docs, times, score = docs[top], times[top], score[top]
                up = np.argsort(docs)
                names, hops = claims.anchors(at, docs[up])
                lists = np.split(names, np.cumsum(times[up])[:-1])
                anchors = [None] * len(docs)
                hop = np.zeros(len(docs), dtype=np.int32)
                for place, of, h in zip(up, lists, hops, strict=True):
                    anchors[place] = claims.names.take(pa.array(of)).to_pylist()
                    hop[place] = h
                own = _columns(claims.rows, docs)
                chosen = int((times >= min(threshold, max(1, len(codes)))).sum())
                skeys = {s for s in own["skey"].slice(0, chosen).to_pylist() if s}
                mates = slots.mates(skeys, docs[:chosen], most_mates)
                others = _columns(slots.rows, mates)
                both = {c: own[c].slice(0, chosen).to_pylist() + others[c].to_pylist() for c in ("ckey", "session_ord", "t_event", "superseded_by")}
                keys = [(0 if historical or s is None else 1, 2**31 - 1 if e == 0 else math.inf if e is None else e, math.inf if o is None else o, k) for k, o, e, s in zip(*both.values(), strict=True)]
                position = np.empty(len(keys), dtype=np.int32)
                position[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(1, len(keys) + 1)
                digest = hashlib.sha256("\n".join(sorted(set(both["ckey"]))).encode()).hexdigest()
                n = len(docs)
                out.add(n, qid=[qid] * n, rank=np.arange(1, n + 1), **own, position=[*position[:chosen].tolist(), *[None] * (n - chosen)], convergence=times, hops=hop, score=score / 1e9, anchors=anchors, found=[claims.names.take(pa.array(codes)).to_pylist(), *[None] * (n - 1)], hash=[digest, *[None] * (n - 1)])
                if m := len(mates):
                    out.add(m, qid=[qid] * m, **others, position=position[chosen:], convergence=[0] * m, hops=[0] * m, score=[0.0] * m, anchors=[[]] * m)
                if out.n >= ROWS:
                    yield from out.drain()
        yield from out.drain()

    return rows.mapInArrow(fold, ", ".join(f"{c} {t}" for c, t in ({"qid": "string"} | _REACHED).items()))


def over_sessions(rows: DataFrame) -> DataFrame:
    """qid, k, resolved, top_convergence: of each question at each session k of its user how many of its terms led to a claim by then, and how far claims converged (null if none). rows: gathered questions, docs, points."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for now, asked in _by_user(batches):
            if now is not tables:
                tables, claims = now, _Claims(now.get(DOC, _NOTHING), None)
                points = now.get(POINT, _NOTHING)["ord"].to_pylist()
                ks = np.array(sorted(k for k in points if k is not None), dtype=np.int64)
                undated = len(points) - len(ks)
                claims.keep(~np.isnan(claims.ord))
                when = np.searchsorted(ks, np.nan_to_num(claims.ord))  # the first point that a claim is seen at
                first = np.full(len(claims.names), len(ks))
                np.minimum.at(first, claims.term, when[claims.doc])
            qids, resolved, tops = [], [], []
            for qid, terms in zip(asked.column("id").to_pylist(), asked.column("terms").to_pylist(), strict=True):
                codes = claims.asked(terms)
                times = np.bincount(claims.doc[claims.met(codes)], minlength=claims.n)
                docs = np.nonzero(times)[0]
                top = np.zeros(len(ks) + 1, dtype=np.int64)
                np.maximum.at(top, when[docs], times[docs])
                qids.append(qid)
                resolved.append(np.cumsum(np.bincount(first[codes], minlength=len(ks) + 1))[: len(ks)] if codes else np.zeros(len(ks), dtype=np.int64))
                tops.append(np.maximum.accumulate(top)[: len(ks)])
                if len(qids) * len(ks) >= ROWS:
                    yield _points(qids, ks, undated, resolved, tops)
                    qids, resolved, tops = [], [], []
            if qids:
                yield _points(qids, ks, undated, resolved, tops)

    return rows.mapInArrow(fold, "qid string, k bigint, resolved bigint, top_convergence int")


def _points(qids: list[str], ks: np.ndarray, undated: int, resolved: list[np.ndarray], tops: list[np.ndarray]) -> pa.RecordBatch:
    names = np.repeat(np.arange(len(qids)), len(ks))
    top = np.concatenate(tops).astype(np.int32)
    more = len(qids) * undated
    where = np.concatenate((names, np.repeat(np.arange(len(qids)), undated)))
    columns = [
        pa.array(qids, pa.string()).take(pa.array(where)),
        pa.concat_arrays([pa.array(np.tile(ks, len(qids)), pa.int64()), pa.nulls(more, pa.int64())]),
        pa.array(np.concatenate((*resolved, np.zeros(more, dtype=np.int64))), pa.int64()),
        pa.concat_arrays([pa.array(top, pa.int32(), mask=top == 0), pa.nulls(more, pa.int32())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["qid", "k", "resolved", "top_convergence"])


def ranked_turns(rows: DataFrame, k1: float, b: float, k: int) -> DataFrame:
    """qid, turn, session_ord, turn_idx, score, rank: BM25. rows: gathered questions and docs, with terms as often as they were said, ord and event the place of a turn."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for now, asked in _by_user(batches):
            if now is not tables:
                tables, turns = now, Postings(now.get(DOC, _NOTHING), [("ord", "ascending"), ("event", "ascending")])
                length = np.bincount(turns.doc, weights=turns.times, minlength=turns.n)
                mean = length.sum() / turns.n if turns.n and length.sum() > 0 else 1.0
                df = np.diff(turns.start)
                idf = np.array([math.log(1 + (turns.n - d + 0.5) / (d + 0.5)) for d in df.tolist()], dtype=np.float64)
                part = idf[turns.term] * turns.times * (k1 + 1) / (turns.times + k1 * (1 - b + b * length[turns.doc] / mean))
            out: tuple[list, ...] = ([], [], [], [])
            for qid, terms in zip(asked.column("id").to_pylist(), asked.column("terms").to_pylist(), strict=True):
                at = turns.met(turns.asked(terms))
                doc = turns.doc[at]
                docs = np.nonzero(np.bincount(doc, minlength=turns.n))[0]
                score = billionths(np.bincount(doc, weights=part[at], minlength=turns.n)[docs])
                docs, score = docs[score > 0], score[score > 0]
                top = best(score, docs, k)
                for column, values in zip(out, ([qid] * len(top), docs[top], score[top] / 1e9, np.arange(1, len(top) + 1)), strict=True):
                    column.extend(values)
            taken = turns.rows.take(pa.array(out[1], pa.int64()))
            columns = [pa.array(out[0], pa.string()), _one(taken["id"]), _one(taken["ord"]), _one(taken["event"]), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "turn", "session_ord", "turn_idx", "score", "rank"])

    return rows.mapInArrow(fold, "qid string, turn string, session_ord bigint, turn_idx bigint, score double, rank int")
