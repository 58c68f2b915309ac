"""Upserts and deletes of keyed tables, as pure functions on DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: what may be a name in a statement.
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class MemoryError_(Exception):
    """Base of the engine's errors."""


class InvalidStatement(MemoryError_):
    """A statement names what it may not."""


class LimitExceeded(MemoryError_):
    """More rows than a bounded read allows."""


def identifier(name: str) -> str:
    """The name, if it is one; names are never quoted into statements otherwise."""
    if not IDENTIFIER.match(name):
        raise InvalidStatement(f"no identifier: {name!r}")
    return name


def merge_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert by key: properties that the new rows name (not null) replace the old ones, the others survive.

    The last of several new rows with a key wins by its content. Columns only
    one side has are kept; null keys are dropped.
    """
    props = [c for c in new.columns if c != key]
    if not props:
        raise InvalidStatement("an upsert needs properties")
    for c in new.columns:
        identifier(c)
    latest = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*props)).alias("_new"))
    joined = old.where(F.col(key).isNotNull()).withColumn("_old", F.lit(True)).join(latest, key, "full_outer")
    out = [F.col(key)]
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c != key:
            out.append(F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in props and c in old.columns else F.col("_new")[c].alias(c) if c in props else F.col(c))
    return joined.select(*out)


def merge_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges once each, of those whose two ends exist; sources and targets are one-column tables of keys, in the column named src and dst."""
    once = edges.dropDuplicates([src, dst])
    return once.join(sources.select(src).distinct(), src, "left_semi").join(targets.select(dst).distinct(), dst, "left_semi").select(*edges.columns)


def delete_keys(vertices: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose keys are not to be deleted; null keys stay."""
    return vertices.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti")


def detach_delete(edges: DataFrame, ends: list[str], keys: DataFrame) -> DataFrame:
    """The edges that touch none of the deleted keys."""
    for end in ends:
        edges = edges.join(keys.select(F.col(keys.columns[0]).alias(end)).distinct(), end, "left_anti").select(*edges.columns)
    return edges


def bounded_rows(df: DataFrame, most: int) -> list:
    """All rows of a result known to be small; an error, never a part, if there are more."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise LimitExceeded(f"more than {most} rows")
    return rows
