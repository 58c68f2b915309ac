"""The engine over a store: post sessions, ask, read and remove what is remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from memlattice.operators import memory, supersession
from memlattice.operators.upsert import MemoryError_, identifier
from memlattice.plans import ask as plan
from memlattice.sources.store import Store
from memlattice.streaming import ingest


class UnknownUser(MemoryError_):
    """A user that nothing is remembered of."""


class MemoryEngine:
    """Only add_sessions and remove_user change the store. Lookups are run as far as their written stages when they are asked for; reads are lazy."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def _read(self, name: str) -> DataFrame:
        return self.store.read(name, ingest.TABLES[name])

    def _entities(self) -> DataFrame:
        return memory.entities_of(self._read("entities"))

    def require_users(self, uids: DataFrame) -> None:
        """An error that names a user without sessions, if there is one."""
        missing = uids.select("uid").distinct().join(self._read("sessions"), "uid", "left_anti").limit(1).collect()
        if missing:
            raise UnknownUser(missing[0]["uid"])

    def add_sessions(self, posted: DataFrame, batch: int) -> dict[str, int]:
        """Rows written to each table; the batch is read by whatever is asked for after this returns."""
        return ingest.ingest_batch(self.store, posted, batch)

    def remove_user(self, uid: str) -> None:
        """Forget a user: sessions, turns, claims, entities, edges and counters."""
        self.require_users(self.spark.createDataFrame([(uid,)], "uid string"))
        self.store.remove_user(uid, {**ingest.TABLES, "posted": ingest.PLACED})

    def get(self, name: str, key: str, columns: list[str]) -> Row | None:
        """The columns of the one row of a table that a key names, None if there is none."""
        by = {"turns": "turn", "claims": "ckey", "entities": "ekey"}[name]
        rows = self._entities() if name == "entities" else self._read(name)
        return next(iter(rows.where(F.col(by) == key).select(*[identifier(c) for c in columns]).head(1)), None)

    def turn(self, uid: str, session_key: str, turn_idx: int) -> Row | None:
        """One turn in full, None if there is none."""
        return self.get("turns", f"{uid}|turn|{session_key}|{turn_idx}", ["sid", "turn_idx", "session_ord", "role", "text"])

    def query(self, statement: str, **parameters) -> DataFrame:
        """A SQL statement over the tables of the store, parameters by name (:name)."""
        frames = {name: self._read(name) for name in ingest.TABLES}
        return self.spark.sql(statement, args=parameters or None, **{n: f for n, f in frames.items() if "{" + n + "}" in statement})

    def ask(self, questions: DataFrame, as_of: int | None = None, historical: bool = False) -> plan.Answers:
        """Answers for questions (qid, uid, question) of known users."""
        self.require_users(questions)
        return plan.ask(questions, plan.Memory.of(self._read("claims"), self._entities(), self._read("edges").distinct()), as_of, historical)

    def sessions(self, uid: str) -> DataFrame:
        return self._read("sessions").where(F.col("uid") == uid).orderBy("session_ord")

    def slots(self, uid: str, as_of: int | None = None) -> DataFrame:
        """The user's slots, each claim with its status."""
        return supersession.chains(self._read("claims").where(F.col("uid") == uid), self._read("edges").distinct(), as_of)

    def stats(self) -> DataFrame:
        return memory.user_stats(self._read("claims"), self._entities(), self._read("turns"), self._read("edges"))
