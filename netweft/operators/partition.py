"""Statistics of labels (node, t, q), and scores between two partitions."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_sizes(labels: DataFrame) -> DataFrame:
    """(t, q, n)."""
    return labels.groupBy("t", "q").agg(F.count(F.lit(1)).alias("n"))


def group_degrees(degs: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, q, k_in, k_out)."""
    return degs.join(labels, ["node", "t"]).groupBy("t", "q").agg(F.sum("d_in").alias("k_in"), F.sum("d_out").alias("k_out"))


def block_edge_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, q, r, m): weight of edges from group q to group r."""
    end = lambda node, q: labels.select(F.col("node").alias(node), "t", F.col("q").alias(q))
    return edges.join(end("src", "q"), ["src", "t"]).join(end("dst", "r"), ["dst", "t"]).groupBy("t", "q", "r").agg(F.sum("w").alias("m"))


def effective_beta(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, q, r, beta): half the mean of the adjacency between two groups; groups of a snapshot without edges between them have 0."""
    sizes = group_sizes(labels)
    pairs = sizes.join(sizes.select("t", F.col("q").alias("r"), F.col("n").alias("n_r")), "t")
    return pairs.join(block_edge_counts(edges, labels), ["t", "q", "r"], "left").select(
        "t", "q", "r", (F.coalesce(F.col("m"), F.lit(0.0)) / (F.col("n") * F.col("n_r")) / 2).alias("beta")
    )


def effective_pi(labels: DataFrame) -> DataFrame:
    """(q, r, n, pi): transitions between present labels one step apart, and their shares by row."""
    after = F.max("q").over(W.partitionBy("node").orderBy("t").rangeBetween(1, 1))
    moves = labels.withColumn("r", after).where("r is not null").groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"))
    return moves.withColumn("pi", F.col("n") / F.sum("n").over(W.partitionBy("q")))


def majority_label(labels: DataFrame) -> DataFrame:
    """(node, q, n): a node's most frequent label; the smallest one of equals."""
    counts = labels.groupBy("node", "q").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("node").agg(F.max_by(F.struct("q", "n"), F.struct("n", -F.col("q"))).alias("x")).select("node", "x.q", "x.n")


def contingency(true: DataFrame, pred: DataFrame) -> DataFrame:
    """(t, q, r, n) of pairs of a true and a predicted label."""
    return true.join(pred.withColumnRenamed("q", "r"), ["node", "t"]).groupBy("t", "q", "r").agg(F.count(F.lit(1)).alias("n"))


def _with_margins(table: DataFrame, by: str) -> DataFrame:
    """Cells n with the sums a of their true and b of their predicted label, and the total. Cells are few; they are dealt out once."""
    over = lambda *keys: F.sum("n").over(W.partitionBy(by, *keys))
    return table.repartition(by).select(by, "n", over("q").alias("a"), over("r").alias("b"), over().alias("total"))


def ari_by_time(table: DataFrame, by: str = "t") -> DataFrame:
    """(t, ari) of a contingency table; 1 where neither partition splits anything or both split everything."""
    n = F.col("n")
    pairs = lambda of: F.sum(n * (F.col(of) - 1) / 2)  # noqa: E731  # over the cells of a label, that is a * (a - 1) / 2
    return (
        _with_margins(table, by)
        .groupBy(by)
        .agg(pairs("n").alias("s"), pairs("a").alias("sa"), pairs("b").alias("sb"), F.first("total").alias("total"))
        .withColumn("all", F.col("total") * (F.col("total") - 1) / 2)
        .withColumn("expected", F.when(F.col("total") > 1, F.col("sa") * F.col("sb") / F.nullif(F.col("all"), F.lit(0.0))).otherwise(0.0))
        .withColumn("top", (F.col("sa") + F.col("sb")) / 2)
        .select(by, F.when(F.col("top") == F.col("expected"), 1.0).otherwise((F.col("s") - F.col("expected")) / F.nullif(F.col("top") - F.col("expected"), F.lit(0.0))).alias("ari"))
    )


def mutual_information(table: DataFrame, by: str = "t") -> DataFrame:
    """(t, mi, h_true, h_pred, nmi): natural logs; nmi divides by the mean entropy and is 1 where that is 0."""
    share, total = F.col("n") / F.col("total"), F.col("total")
    both = (
        _with_margins(table, by)
        .groupBy(by)
        .agg(
            F.sum(share * F.log(total * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"),
            F.sum(-share * F.log(F.col("a") / total)).alias("h_true"),
            F.sum(-share * F.log(F.col("b") / total)).alias("h_pred"),
        )
    )
    mean = (F.col("h_true") + F.col("h_pred")) / 2
    return both.withColumn("nmi", F.when(mean > 0, F.col("mi") / F.nullif(mean, F.lit(0.0))).otherwise(1.0))


def assignment(gain: Sequence[Sequence[float]]) -> list[int]:
    """The column of each row of a square matrix, each once, of the largest sum; by shortest augmenting paths, in cubic time."""
    n = len(gain)
    row_price, col_price, row_of = [0.0] * n, [0.0] * n, [-1] * n
    for start in range(n):
        slack, came, done, free, row = [math.inf] * n, [-1] * n, [False] * n, -1, start
        last = -1
        while free < 0:
            for c in range(n):
                left = -gain[row][c] - row_price[row] - col_price[c]
                if not done[c] and left < slack[c]:
                    slack[c], came[c] = left, last
            best = min((c for c in range(n) if not done[c]), key=lambda c: slack[c])
            step = slack[best]
            row_price[start] += step
            for c in range(n):
                if done[c]:
                    row_price[row_of[c]] += step
                    col_price[c] -= step
                else:
                    slack[c] -= step
            done[best], last = True, best
            row = row_of[best]
            free = best if row < 0 else -1
        while free >= 0:
            before = came[free]
            row_of[free] = start if before < 0 else row_of[before]
            free = before
    out = [0] * n
    for c, r in enumerate(row_of):
        out[r] = c
    return out


def max_overlap(table: DataFrame, q: int) -> DataFrame:
    """One row (overlap): the largest share of equal labels under any renaming, less chance. The table has q * q sums at most."""
    cells = {(r["q"], r["r"]): r["n"] for r in table.groupBy("q", "r").agg(F.sum("n").alias("n")).collect()}
    total = sum(cells.values())
    gain = [[cells.get((a, b), 0) for b in range(q)] for a in range(q)]
    best = sum(gain[a][b] for a, b in enumerate(assignment(gain)))
    value = max(0.0, (best / total - 1 / q) / (1 - 1 / q)) if total and q > 1 else 0.0
    return table.sparkSession.createDataFrame([(value,)], "overlap double")
