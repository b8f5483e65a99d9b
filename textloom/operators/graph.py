"""Transitive closure of a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def closure(edges: DataFrame, a: str, b: str, most: int = 40) -> DataFrame:
    """Pairs (a, b) with a path of one to ``most`` edges; cycles are fine, rows with a null are left out.

    Lengths double: pairs of up to 2n edges are those of up to n, and those of exactly n followed by up to n. So each
    pair is found from one middle, not from all on its way, and where each node has one edge never twice. What makes
    up the rest of ``most`` is added in the same way. Each step is cut off from its lineage; it ends as soon as
    doubling finds nothing new.
    """

    def through(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.withColumnRenamed("y", "m").join(y.withColumnRenamed("x", "m").hint("merge"), "m").select("x", "y")

    def more(exact: DataFrame, upto: DataFrame, near: DataFrame) -> DataFrame:
        """near, and what lies exact and then up to some edges away."""
        return cut(near.union(through(exact, upto)).distinct())

    exact = [cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct())]
    upto = [exact[0]]
    n = upto[0].count()
    while 2 ** len(upto) <= most:
        upto.append(more(exact[-1], upto[-1], upto[-1]))
        m = upto[-1].count()
        if m == n:
            return upto[-1].select(F.col("x").alias(a), F.col("y").alias(b))
        n = m
        exact.append(cut(through(exact[-1], exact[-1]).distinct()))
    known = None  # of the rest the least power first
    for k in range(len(upto)):
        if most >> k & 1:
            known = upto[k] if known is None else more(exact[k], known, upto[k])
    return known.select(F.col("x").alias(a), F.col("y").alias(b))
