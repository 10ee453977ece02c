"""Connected components of a link table: minimum labels with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlake.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, root): the smallest node that each linked node reaches.

    Every round each node looks at the parents of its neighbours, hooks its own parent below the
    smallest of them, and then jumps to its grandparent, so the number of rounds grows with the
    logarithm of the longest path. All rounds are joins and minima over stored tables: no
    component and no link passes through the driver, which only reads how many parents moved.
    A parent that many nodes share is the hot side of one join of two plain exchanges, which
    adaptive execution splits. Self-links and nulls are ignored; no links give no rows.
    """
    both = links.where(F.col(a) != F.col(b)).select(
        F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")),
                          F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("e")).select("e.*").distinct()
    both = stored(both, "links")
    parents = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("parent")), "parents")
    while True:
        near = both.join(parents, both["v"] == parents["node"]).groupBy("u").agg(F.min("parent").alias("near"))
        seen = parents.join(near, F.col("node") == F.col("u")).select(
            F.explode(F.array(F.struct("node", F.least("parent", "near").alias("parent")),
                              F.struct(F.col("parent").alias("node"), F.least("parent", "near").alias("parent"))
                              )).alias("p")).select("p.*")
        hooked = stored(seen.groupBy("node").agg(F.min("parent").alias("parent")), "hooked")
        up = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = stored(hooked.join(up, "parent").select("node", F.col("grand").alias("parent")), "parents")
        moved = jumped.join(parents.select("node", F.col("parent").alias("old")), "node").where(
            F.col("parent") != F.col("old")).limit(1).count()
        parents = jumped
        if moved == 0:
            return parents.select("node", F.col("parent").alias("root"))
