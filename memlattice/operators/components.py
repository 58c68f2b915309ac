"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.runtime import materialize, release


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node, component: the least node that each node is connected with; links are pairs (a, b) of any type that has an order.

    Nodes without links are left out, null ends link nothing. Labels spread to
    neighbours and then jump to their label's label, so a chain of n closes in
    some log n rounds. Every round is a written table; the one before is deleted
    once the next is there.
    """
    pairs = links.where("a is not null and b is not null").select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = materialize(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{tag}-edges")
    labels = materialize(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("c")).withColumn("was", F.col("x")), tag)
    while True:
        now = labels.select("x", "c")
        offered = edges.join(now.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("o"))
        spread = now.join(offered, "x").select("x", F.least("c", "o").alias("n"), F.col("c").alias("was"))
        jumped = spread.join(now.select(F.col("x").alias("n"), F.col("c").alias("j")), "n").select("x", F.least("n", "j").alias("c"), "was")
        new = materialize(jumped, tag)
        release(labels)
        labels = new
        if new.where("c <> was").limit(1).count() == 0:
            release(edges)
            return labels.select(F.col("x").alias("node"), F.col("c").alias("component"))
