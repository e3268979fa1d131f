"""Temporal networks and node metadata from ordinary tables, and the tables that results are kept in.

edges(t int, src long, dst long, w): a row for each edge of a snapshot; meta(s int, node long, t int, x array<double>): a
row for each node, time and field that has data; missing is no row or NULL, never NaN.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_snapshots(edges: DataFrame, when: str = "t") -> DataFrame:
    """Snapshot numbers 0, 1, ... in the order of any sortable column; the distinct values are few."""
    order = edges.select(when).distinct().select(when, (F.dense_rank().over(W.orderBy(when)) - 1).cast("int").alias("__t"))
    return edges.join(F.broadcast(order), when).withColumn(when, F.col("__t")).drop("__t")


def load_edges(spark: SparkSession, path: str, weight: str | None = None, keep_self_loops: bool = False) -> DataFrame:
    """An edge table from parquet; weight: the column to weigh by, else every edge counts 1. NaN weights are missing, hence 1."""
    df = spark.read.parquet(path)
    w: Column = F.lit(1.0) if weight is None else F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(None).cast("double")), F.lit(1.0))
    out = dense_snapshots(df.select("t", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w")))
    return out if keep_self_loops else out.where("src <> dst")


def last_snapshots(edges: DataFrame, n: int = 4) -> DataFrame:
    """The latest n snapshots, numbered from 0."""
    top = edges.agg(F.max("t").alias("top"))
    return edges.crossJoin(F.broadcast(top)).where(F.col("t") > F.col("top") - n).drop("top").transform(dense_snapshots)


def copurchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought in one order and shipped in one year; t = year - 1995, src < dst, w = how often."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.year("l_shipdate").alias("y"))
    a, b = items.alias("a"), items.alias("b")
    return (
        a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.l_partkey") < F.col("b.l_partkey")))
        .groupBy((F.col("a.y") - 1995).cast("int").alias("t"), F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"))
        .agg(F.count(F.lit(1)).alias("w"))
    )


def succession_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event's user to the next event's; t = six-day slots of the first event.

    The next event is looked for within the hour; an hour's last event takes the first one of the next hour that has any, out of
    a table with a row for each hour. No window spans more than an hour of events.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    order = W.partitionBy("hour").orderBy("ts", "event_id")
    hours = ev.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    following = hours.select("hour", F.lead("first_user").over(W.orderBy("hour")).alias("next_hour_user"))
    return (
        ev.withColumn("next_user", F.lead("user_id").over(order))
        .join(following, "hour")
        .select(
            F.least(F.lit(4), F.floor((F.dayofmonth("ts") - 1) / 6)).cast("int").alias("t"),
            F.col("user_id").alias("src"),
            F.coalesce("next_user", "next_hour_user").alias("dst"),
        )
        .where("dst is not null and src <> dst")
        .groupBy("t", "src", "dst")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def extract_metadata(snapshots: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(s, node, t, x) from a wide table (node, t, columns); fields: columns of each field in order. NaN becomes NULL; a row that
    has nothing in a field has no row there."""
    parts = []
    for s, columns in enumerate(fields.values()):
        values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
        row = snapshots.select(F.lit(s).alias("s"), F.col("node").cast("long").alias("node"), F.col("t").cast("int").alias("t"), F.array(*values).alias("x"))
        parts.append(row.where(F.exists("x", lambda v: v.isNotNull())))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# The fixtures' flags, and their pairs with the line status, in order.
FLAGS = ("A", "N", "R")
FLAG_STATUS = (("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O"))


def part_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, t, n, n_a, n_n, n_r, pair0..pair5) of the parts' sales by year: the source of the metadata fixtures."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", (F.year("l_shipdate") - 1995).cast("int").alias("t"), "l_returnflag", "l_linestatus")
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    return items.groupBy(F.col("l_partkey").alias("node"), "t").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *(count(F.col("l_returnflag") == x).alias(f"n_{x.lower()}") for x in FLAGS),
        *(F.max(((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b)).cast("double")).alias(f"pair{i}") for i, (a, b) in enumerate(FLAG_STATUS)),
    )


def order_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, t, n_regions): of how many regions the customers are that ordered a part in a year."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") - 1995).cast("int").alias("t"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("node", "t").agg(F.count_distinct("n_regionkey").alias("n_regions"))


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Labels, probabilities, transitions, blocks or scores as parquet."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def save_test_results(scores: DataFrame, labels: DataFrame | None, path: str) -> None:
    """Scores and times of a study (number, sample, t, ...), and its labels where they are wanted, a folder for each setting."""
    save(scores, f"{path}/scores", "number")
    if labels is not None:
        save(labels, f"{path}/labels", "number")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(node, t, x) of a field from parquet with columns node, t and x, an array or a number; NaN is missing."""
    df = spark.read.parquet(path)
    x = F.col("x") if isinstance(df.schema["x"].dataType, ArrayType) else F.array("x")
    values = F.transform(x.cast("array<double>"), lambda v: F.nanvl(v, F.lit(None).cast("double")))
    rows = df.select(F.col("node").cast("long").alias("node"), F.col("t").cast("int").alias("t"), values.alias("x"))
    return rows.where(F.exists("x", lambda v: v.isNotNull()))


def export_profiles(age: DataFrame, region: DataFrame) -> DataFrame:
    """(node, t, career_age, region): whatever either table has."""
    return age.join(region, ["node", "t"], "full_outer")


def export_topics(meta: DataFrame) -> DataFrame:
    """(node, t, topic): a row for each set position of a multi-hot field."""
    return meta.select("node", "t", F.posexplode("x").alias("topic", "v")).where("v > 0").drop("v")
