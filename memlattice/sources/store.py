"""Tables on disk: batches of the memory, model replies, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.operators.upsert import identifier
from memlattice.runtime import materialize, release


class Store:
    """Parquet tables in a shared folder, one partition for each batch.

    A batch is open from begin() to commit(). Readers don't see open batches,
    nor what an attempt that failed left of one; a batch that is begun again
    replaces what it left, and one that was committed isn't begun again. The
    number of the last committed batch is what a reader may wait for.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _at(self, *parts: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> set[str]:
        where, system = self._at(folder)
        return {f.getPath().getName() for f in system.listStatus(where)} if system.exists(where) else set()

    def begin(self, batch: int) -> bool:
        """Open a batch; False, and nothing to do, if it is committed."""
        if f"batch={batch}" in self._names("_committed"):
            return False
        where, system = self._at("_open", f"batch={batch}")
        system.mkdirs(where)
        return True

    def commit(self, batch: int) -> None:
        where, system = self._at("_committed", f"batch={batch}")
        system.mkdirs(where)
        where, system = self._at("_open", f"batch={batch}")
        system.delete(where, True)

    def last_commit(self) -> int | None:
        """The number of the last committed batch, None before the first."""
        return max((int(n.removeprefix("batch=")) for n in self._names("_committed")), default=None)

    def append(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{identifier(name)}/batch={batch}")

    def exists(self, name: str) -> bool:
        where, system = self._at(identifier(name))
        return system.exists(where)

    def of_batch(self, name: str, schema: str, batch: int) -> DataFrame:
        """What a batch wrote so far, open or not."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{identifier(name)}/batch={batch}")

    def read(self, name: str, schema: str) -> DataFrame:
        """The table without open batches, or an empty one of the schema before anything is written."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        hidden = sorted(int(n.removeprefix("batch=")) for n in self._names("_open") - self._names("_committed"))
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{name}")
        return (rows.where(~F.col("batch").isin(hidden)) if hidden else rows).drop("batch")

    def remove_user(self, uid: str, tables: dict[str, str]) -> None:
        """Rewrite every batch that holds rows of a user without them."""
        for name, schema in tables.items():
            if self.exists(name):
                rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{name}")
                for found in rows.where(F.col("uid") == uid).select("batch").distinct().toLocalIterator():
                    n = found["batch"]
                    kept = materialize(self.of_batch(name, schema, n).where(~F.col("uid").eqNullSafe(F.lit(uid))), "kept")
                    self.append(name, kept, n)
                    release(kept)


CACHE = "kind string, key string, model string, value string, input_tokens bigint, output_tokens bigint"


def cache_key(model, system, prompt, schema):
    """Identity of a model call by its content."""
    return F.sha2(F.concat_ws(" | ", model, system, prompt, schema), 256)


def cache_misses(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """The calls, each key once, that no usable reply is kept for; a reply that is null is none."""
    return calls.dropDuplicates(["kind", "key"]).join(cache.where("value is not null").select("kind", "key").distinct(), ["kind", "key"], "left_anti")


def write_results(rows: DataFrame, path: str) -> None:
    """One JSON record for each system and question."""
    rows.write.mode("overwrite").json(path)


def markdown(summary: DataFrame, most: int = 64) -> str:
    """A small summary as a Markdown table: rates as percentages, what isn't counted as n/a. More than `most` rows are an error."""
    from memlattice.operators.upsert import bounded_rows

    def shown(v) -> str:
        if v is None:
            return "n/a"
        if isinstance(v, float):
            return f"{100 * v:.1f} %" if v <= 1 else f"{v:,.0f}"
        return f"{v:,}" if isinstance(v, int) else str(v)

    lines = [" | ".join(summary.columns), " | ".join("---" for _ in summary.columns)]
    lines += [" | ".join(shown(v) for v in row) for row in bounded_rows(summary, most)]
    return "\n".join(f"| {line} |" for line in lines)
