"""Connected components by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.workspace import Workspace


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """``(node, component)`` for every end of ``edges(a, b)``; a component is named by its smallest node.

    Large-star links a node's larger neighbours to its smallest one, small-star its smaller neighbours
    and itself. Each step is an aggregate and an equi-join of written tables, so hot nodes are merged
    before they are shuffled or split by the adaptive join. The driver sees only a count and a checksum.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = ws.save(pairs.filter(F.col("a") != F.col("b")).distinct(), f"{label}-0")
    step, state = 0, _state(now)
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = ws.save(both, f"{label}-both-{step}")
        least = ws.save(both.groupBy("a").agg(F.min("b").alias("m")), f"{label}-min-{step}")
        large = both.join(least, "a").filter(F.col("b") > F.col("a"))
        large = large.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = ws.save(large.distinct(), f"{label}-large-{step}")
        least = ws.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-small-min-{step}")
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = ws.save(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), f"{label}-{step}")
        before, state = state, _state(now)
        for name in (f"{label}-both-{step}", f"{label}-min-{step}", f"{label}-large-{step}", f"{label}-small-min-{step}", f"{label}-{step - 1}"):
            ws.drop(name)
        if state == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
