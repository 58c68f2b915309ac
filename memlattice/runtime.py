"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "memlattice", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MEMLATTICE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where the setting is missing the session must be local: then, and only
    then, a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    made = tempfile.mkdtemp(prefix="memlattice-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Where each table that materialize() wrote lies.
_written: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage with one computation of the plan and survives the loss of
    any executor, which a local checkpoint or a cache would not. The table is
    deleted when the session ends, or before by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memlattice-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    read = spark.read.schema(df.schema).parquet(path)
    _written[id(read)] = (read, path)
    return read


def release(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more; other tables are left alone."""
    _, path = _written.pop(id(df), (None, None))
    if path:
        where, system = _file_system(df.sparkSession, path)
        system.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
