"""Connected components by alternating star contractions, all of it in joins and aggregates.

Every round replaces each link by links to the smallest neighbour. A round is
a minimum with map-side combine and an equi-join, so a node with very many
links costs no more than its share of rows; adaptive execution splits the
join's large partitions. Rounds needed: about the logarithm of the diameter.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.plans.scratch import remove, stored


def _large_star(links: DataFrame) -> DataFrame:
    """links (a, b), b < a: every larger neighbour of a node is tied to that node's smallest neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = links.select(F.col("a").alias("m_node"), F.col("b").alias("m")).unionByName(
        links.select(F.col("b").alias("m_node"), F.col("b").alias("m"))
    ).groupBy("m_node").agg(F.min("m").alias("m"))
    return (
        both.where("b > a")
        .join(least, F.col("a") == F.col("m_node"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """links (a, b), b < a: all of a node's smaller neighbours and itself are tied to the smallest."""
    least = links.groupBy(F.col("a").alias("m_node")).agg(F.min("b").alias("m"))
    moved = links.join(least, F.col("a") == F.col("m_node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select(F.col("m_node").alias("a"), F.col("m").alias("b")).unionByName(moved).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", kind: str = "long") -> tuple[DataFrame, str]:
    """Smallest reachable id for each linked node.

    links: any two columns of integers of that ``kind``, in any direction; self-links, repeats and
    rows with a null end are ignored. Returns a table (node, component) of the
    nodes that are linked to another one and are not the smallest of their
    component themselves, and the folder that holds it. Nodes that are absent
    are their own component. An empty input gives an empty table.
    """
    spark = links.sparkSession
    x, y = F.col(a).cast(kind), F.col(b).cast(kind)
    now, uri = stored(
        links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(),
        "links",
    )
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))]
    mark = tuple(now.agg(*digest).first())
    while mark[0]:
        large, large_uri = stored(_large_star(now), "star")
        after, after_uri = stored(_small_star(large), "star")
        was, mark = mark, tuple(after.agg(*digest).first())
        remove(spark, uri, large_uri)
        now, uri = after, after_uri
        if mark == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")), uri
