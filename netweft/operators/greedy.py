"""What moving one node to another group at one time would gain in likelihood, for all nodes and groups at once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.functions import formulas as X
from netweft.functions.formulas import xlogx
from netweft.operators import partition


def edge_gain(edges: DataFrame, labels: DataFrame, groups: int) -> DataFrame:
    """(node, t, q, r, gain) under the degree-corrected model; edges both ways, without self-loops.

    A node's weights to the groups are one row, and so are a snapshot's weights between the groups, which are their sums;
    so the edges are joined with the labels once, and everything else is arithmetic within a row.
    """
    g = range(groups)
    near = (
        edges.join(labels.select(F.col("node").alias("dst"), "t", F.col("q").alias("s")), ["dst", "t"])
        .groupBy(F.col("src").alias("node"), "t")
        .agg(*(F.sum(F.when(F.col("s") == i, F.col("w")).otherwise(0.0)).cast("double").alias(f"k{i}") for i in g))
    )
    rows = near.join(labels, ["node", "t"])
    cells = (F.coalesce(F.sum(F.when(F.col("q") == i, F.col(f"k{j}"))), F.lit(0.0)) for i in g for j in g)
    between = rows.groupBy("t").agg(F.array(*cells).alias("m"))  # a row for each snapshot
    moves = rows.join(F.broadcast(between), "t").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("r <> q")
    known = moves.select("node", "t", "q", "r", F.array(*(f"k{i}" for i in g)).alias("k"), *(F.expr(f"slice(m, {x} * {groups} + 1, {groups})").alias(f"m_{x}") for x in "qr"))
    other = lambda s: f"({_x(f'(m_q[{s}] - k[{s}])')}) - ({_x(f'm_q[{s}]')}) + ({_x(f'(m_r[{s}] + k[{s}])')}) - ({_x(f'm_r[{s}]')})"
    total = lambda x: X.add([f"{x}[{i}]" for i in g])
    named = {
        "rest": X.add([f"CASE WHEN q = {s} OR r = {s} THEN CAST(0 AS DOUBLE) ELSE 2 * ({other(s)}) END" for s in g]),
        "m_qr": "m_q[r]", "m_qq": "m_q[q]", "m_rr": "m_r[r]", "k_q": "k[q]", "k_r": "k[r]", "k_i": total("k"), "kappa_q": total("m_q"), "kappa_r": total("m_r"),
    }
    return known.select("node", "t", "q", "r", *(F.expr(e).alias(c) for c, e in named.items())).select("node", "t", "q", "r", F.expr(edge_gain_formula()).alias("gain"))


def _x(x: str) -> str:
    return xlogx(x)


def edge_gain_formula() -> str:
    return (
        f"rest + 2 * (({_x('(m_qr + k_q - k_r)')}) - ({_x('m_qr')}) - ({_x('(kappa_q - k_i)')}) + ({_x('kappa_q')}) - ({_x('(kappa_r + k_i)')}) + ({_x('kappa_r')}))"
        f" + (({_x('(m_qq - 2 * k_q)')}) - ({_x('m_qq')}) + ({_x('(m_rr + 2 * k_r)')}) - ({_x('m_rr')}))"
    )


def categorical_gain(meta: DataFrame, labels: DataFrame, groups: int) -> DataFrame:
    """(node, t, q, r, gain) of a field (node, t, l) with one category for each row."""
    rows = labels.join(meta, ["node", "t"])
    cells = rows.groupBy("t", "q", "l").agg(F.count(F.lit(1)).cast("double").alias("x"))
    sizes = labels.groupBy("t", "q").agg(F.count(F.lit(1)).cast("double").alias("n"))
    moves = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("r <> q")
    joined = (
        moves.join(cells.withColumnRenamed("x", "x_q"), ["t", "q", "l"])
        .join(cells.select("t", F.col("q").alias("r"), "l", F.col("x").alias("x_r")), ["t", "r", "l"], "left")
        .join(F.broadcast(sizes.withColumnRenamed("n", "n_q")), ["t", "q"])
        .join(F.broadcast(sizes.select("t", F.col("q").alias("r"), F.col("n").alias("n_r"))), ["t", "r"], "left")
        .na.fill(0.0, ["x_r", "n_r"])
    )
    return joined.select("node", "t", "q", "r", F.expr(categorical_gain_formula()).alias("gain"))


def categorical_gain_formula() -> str:
    return (
        f"({_x('(x_q - 1)')}) - ({_x('x_q')}) + ({_x('(x_r + 1)')}) - ({_x('x_r')})"
        f" + ({_x('n_q')}) - ({_x('(n_q - 1)')}) + ({_x('n_r')}) - ({_x('(n_r + 1)')})"
    )


def _poisson(total: str, n: str) -> str:
    """A group's log-likelihood at its best rate, up to a constant."""
    return f"(({_x(total)}) - ({total}) * ln(CASE WHEN {n} > 0 THEN {n} ELSE CAST(1 AS DOUBLE) END))"


def _bernoulli(ones: str, n: str) -> str:
    return f"(({_x(ones)}) + ({_x(f'({n} - {ones})')}) - ({_x(n)}))"


def poisson_gain_formula() -> str:
    return f"{_poisson('(x_q - x)', '(n_q - 1)')} - {_poisson('x_q', 'n_q')} + {_poisson('(x_r + x)', '(n_r + 1)')} - {_poisson('x_r', 'n_r')}"


def bernoulli_gain_formula() -> str:
    """Of one position."""
    return f"{_bernoulli('(x_q - x)', '(n_q - 1)')} - {_bernoulli('x_q', 'n_q')} + {_bernoulli('(x_r + x)', '(n_r + 1)')} - {_bernoulli('x_r', 'n_r')}"


def cell_gain_formula() -> str:
    """Of one position of counts, before the totals' part."""
    return f"({_x('(x_q - x)')}) - ({_x('x_q')}) + ({_x('(x_r + x)')}) - ({_x('x_r')})"


def metadata_gain(meta: DataFrame, labels: DataFrame, groups: int, dist: str) -> DataFrame:
    """(node, t, q, r, gain) of a field (node, t, x array<double>): poisson, indep bernoulli or multinomial."""
    rows = labels.join(meta, ["node", "t"]).select("node", "t", "q", F.posexplode("x").alias("l", "x")).where("x is not null")
    if dist == "multinomial":  # the total is one more position, with the opposite sign
        total = rows.groupBy("node", "t", "q").agg(F.sum("x").alias("x")).select("node", "t", "q", F.lit(-1).alias("l"), "x")
        rows = rows.unionByName(total)
    cells = rows.groupBy("t", "q", "l").agg(F.sum("x").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    moves = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("r <> q")
    joined = (
        moves.join(F.broadcast(cells.select("t", "q", "l", F.col("s").alias("x_q"), F.col("n").alias("n_q"))), ["t", "q", "l"])
        .join(F.broadcast(cells.select("t", F.col("q").alias("r"), "l", F.col("s").alias("x_r"), F.col("n").alias("n_r"))), ["t", "r", "l"], "left")
        .na.fill(0.0, ["x_r", "n_r"])
    )
    one = {"poisson": poisson_gain_formula(), "indep bernoulli": bernoulli_gain_formula(), "multinomial": f"CASE WHEN l < 0 THEN -1 ELSE 1 END * ({cell_gain_formula()})"}[dist]
    return joined.groupBy("node", "t", "q", "r").agg(F.sum(F.expr(one)).alias("gain"))


def transition_gain(labels: DataFrame, groups: int) -> DataFrame:
    """(node, t, q, r, gain): transitions' log-likelihood at its best matrix, by the labels before and after.

    A gain depends on four labels, so each combination, of which there are groups ** 2 * (groups + 1) ** 2, is worked out once.
    """
    spark = labels.sparkSession
    near = labels.selectExpr(
        "node", "t", "q",
        "max(q) OVER (PARTITION BY node ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before",
        "max(q) OVER (PARTITION BY node ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS after",
    )
    counts = {(r["q"], r["r"]): r["n"] for r in partition.effective_pi(labels).select("q", "r", "n").collect()}
    some = [*range(groups), -1]
    rows = [
        (a, q, b, r, transition_change(counts, groups, a, q, b, r)) for a in some for q in range(groups) for b in some for r in range(groups) if q != r
    ]
    table = spark.createDataFrame(rows, "before int, q int, after int, r int, gain double")
    return near.na.fill(-1, ["before", "after"]).join(F.broadcast(table), ["before", "q", "after"]).select("node", "t", "q", "r", "gain")


def transition_change(counts: dict[tuple[int, int], int], groups: int, before: int, q: int, after: int, r: int) -> float:
    """What relabelling one node from q to r between labels ``before`` and ``after`` (-1: absent) does to the transitions' likelihood."""
    import math

    changes: dict[tuple[int, int], int] = {}
    for cell, d in (((before, q), -1), ((before, r), 1)) if before >= 0 else ():
        changes[cell] = changes.get(cell, 0) + d
    for cell, d in (((q, after), -1), ((r, after), 1)) if after >= 0 else ():
        changes[cell] = changes.get(cell, 0) + d
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    total = sum(f(counts.get(c, 0) + d) - f(counts.get(c, 0)) for c, d in changes.items())
    for g in {c[0] for c in changes}:
        was = sum(counts.get((g, k), 0) for k in range(groups))
        total -= f(was + sum(d for c, d in changes.items() if c[0] == g)) - f(was)
    return float(total)
