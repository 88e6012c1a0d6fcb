"""Connected components by alternating large and small stars.

Every step is a grouped minimum joined back on the same key, so a node with many
neighbours is pre-aggregated before the shuffle and its rows can be split by the
join. Rounds are stored in the shared folder; no links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points from the larger to the smaller node
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node with a link.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type. Links to
    oneself, repeated links and links with a null are allowed and ignored.
    """
    now = cut_lineage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        now = cut_lineage(
            _small_star(_large_star(now)).where(F.col("a") != F.col("b")).distinct()
        )
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
