"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join on edges, cut from its past by a
written table; no component and no edge list reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    """A count and checksums that tell whether two edge sets are the same."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1000003)).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join can split the edges of a hub, which the tasks that look for its least node couldn't.
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = down.join(least, "u")
    return joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that isn't the least of its component, with that least node.

    ``edges`` has columns u and v of one comparable type; loops and repeated
    edges are allowed, nulls are ignored.
    """
    now = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = materialize(_small(materialize(_large(now), "edges")), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
