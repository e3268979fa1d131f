"""Snapshots: symmetrised edges, presence, degrees, density, subgraphs, connectivity."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweft.operators.components import connected_components


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("t", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def prepare(edges: DataFrame, directed: bool = False, deg_corr: bool = False) -> DataFrame:
    """Edges as the model takes them: both ways and 1, both ways and averaged, 1 as they are, or unchanged."""
    if directed:
        return edges if deg_corr else edges.where("w > 0").withColumn("w", F.lit(1.0))
    both = edges.unionByName(reversed_edges(edges)).groupBy("t", "src", "dst")
    return both.agg((F.sum("w") / 2).alias("w")) if deg_corr else both.agg(F.max((F.col("w") > 0).cast("double")).alias("w")).where("w > 0")


def messages(edges: DataFrame) -> DataFrame:
    """(t, recv, send, w_fwd, w_rev): a row for each ordered pair of neighbours; w_fwd is the weight from send to recv."""
    ways = edges.select("t", F.col("dst").alias("recv"), F.col("src").alias("send"), F.col("w").alias("f"), F.lit(0.0).alias("r")).unionByName(
        edges.select("t", F.col("src").alias("recv"), F.col("dst").alias("send"), F.lit(0.0).alias("f"), F.col("w").alias("r"))
    )
    return ways.groupBy("t", "recv", "send").agg(F.sum("f").cast("double").alias("w_fwd"), F.sum("r").cast("double").alias("w_rev"))


def presence(edges: DataFrame) -> DataFrame:
    """(node, t) that have an edge in either direction."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), "t").distinct()


def transition_presence(present: DataFrame) -> DataFrame:
    """(node, t) of nodes that are present at t and t + 1."""
    after = F.max("t").over(W.partitionBy("node").orderBy("t").rangeBetween(1, 1))
    return present.withColumn("after", after).where("after is not null").drop("after")


def new_arrivals(present: DataFrame) -> DataFrame:
    """(node, t) of nodes that are present at t and weren't at t - 1."""
    before = present.select("node", (F.col("t") + 1).alias("t"))
    return present.join(before, ["node", "t"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, t, d_in, d_out)."""
    ends = edges.select("t", F.col("dst").alias("node"), F.col("w").alias("i"), F.lit(0.0).alias("o")).unionByName(
        edges.select("t", F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("w").alias("o"))
    )
    return ends.groupBy("node", "t").agg(F.sum("i").cast("double").alias("d_in"), F.sum("o").cast("double").alias("d_out"))


def density(edges: DataFrame) -> DataFrame:
    """(t, n_nodes, n_edges, density): weight over the square of the number of all nodes."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    by_t = edges.groupBy("t").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("total"))
    return by_t.crossJoin(F.broadcast(nodes)).select("t", "n_nodes", "n_edges", (F.col("total") / (F.col("n_nodes") * F.col("n_nodes"))).alias("density"))


def missing_nodes(present: DataFrame) -> DataFrame:
    """(t, n_missing) of nodes that some snapshot has and this one hasn't, counted without a grid of nodes and times."""
    every = present.select("node").distinct().agg(F.count(F.lit(1)).alias("n"))
    return present.groupBy("t").agg(F.count(F.lit(1)).alias("here")).crossJoin(F.broadcast(every)).select("t", (F.col("n") - F.col("here")).alias("n_missing"))


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes (node, t) of the set."""
    at = lambda end: nodes.select(F.col("node").alias(end), "t")
    return edges.join(at("src"), ["src", "t"], "left_semi").join(at("dst"), ["dst", "t"], "left_semi").select("t", "src", "dst", "w")


def induced_fields(fields: Sequence[tuple[DataFrame, str]], nodes: DataFrame) -> list[tuple[DataFrame, str]]:
    """Metadata (meta, distribution) of the nodes (node, t) of the set."""
    return [(meta.join(nodes.select("node", "t"), ["node", "t"], "left_semi"), dist) for meta, dist in fields]


def weak_components(edges: DataFrame) -> DataFrame:
    """(t, node, component): the smallest node reachable in the snapshot. Nodes of different snapshots are apart."""
    wide = "decimal(38,0)"
    base = (F.col("t").cast(wide) * F.lit(1 << 32).cast("decimal(11,0)")).cast(wide) * F.lit(1 << 32).cast("decimal(11,0)")  # snapshots are 2 ** 64 apart
    key = lambda c: (base.cast(wide) + F.col(c).cast("decimal(20,0)")).cast(wide)
    found, _ = connected_components(edges.select(key("src").alias("a"), key("dst").alias("b")), kind=wide)
    return (
        presence(edges)
        .withColumn("key", key("node"))
        .join(found.withColumnRenamed("node", "k"), F.col("key") == F.col("k"), "left")
        .select("t", "node", F.coalesce((F.col("component") - F.col("key") + F.col("node")).cast("long"), F.col("node").cast("long")).alias("component"))
    )


def is_connected(edges: DataFrame) -> DataFrame:
    """(t, connected): one component that holds every node of the network."""
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count(F.lit(1)).alias("n"))
    return (
        weak_components(edges)
        .groupBy("t")
        .agg(F.count_distinct("component").alias("c"), F.count(F.lit(1)).alias("here"))
        .crossJoin(F.broadcast(every))
        .select("t", ((F.col("c") == 1) & (F.col("here") == F.col("n"))).alias("connected"))
    )
