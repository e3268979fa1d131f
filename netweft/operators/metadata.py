"""Node metadata: cleaning, log-likelihoods and estimates, for four distributions.

meta(node, t, x array<double>) holds one field; a position that is missing is NULL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweft.functions.formulas import LANCZOS, TOL


def _long(meta: DataFrame) -> DataFrame:
    return meta.select("node", "t", F.posexplode("x").alias("l", "v"))


def drop_null_dims(meta: DataFrame) -> DataFrame:
    """(node, t, l, v) without positions whose sum over all rows is 0; the rest are numbered anew."""
    long = _long(meta)
    live = long.groupBy("l").agg(F.sum("v").alias("total")).where("total > 0").select("l", (F.row_number().over(W.orderBy("l")) - 1).cast("int").alias("new_l"))
    return long.join(F.broadcast(live), "l").select("node", "t", F.col("new_l").alias("l"), "v")


def bernoulli_topk(meta: DataFrame, k: int = 20) -> DataFrame:
    """(node, t, l) set in a wide multi-hot field: a row's k largest values other than 0, of equals those of larger positions."""
    order = W.partitionBy("node", "t").orderBy(F.desc("v"), F.desc("l"))
    return _long(meta).where("v <> 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("node", "t", "l")


def bernoulli(meta: DataFrame) -> DataFrame:
    """x > 0 as 1; what is missing stays so."""
    return meta.withColumn("x", F.transform("x", lambda v: F.when(v > 0, 1.0).when(v.isNotNull(), 0.0)))


def categorical_top1(meta: DataFrame) -> DataFrame:
    """(node, t, l): the position of a row's largest positive value, of equals the largest; rows without one are left out."""
    return _long(meta).where("v > 0").groupBy("node", "t").agg(F.max_by("l", F.struct("v", "l")).alias("l"))


def multinomial_counts(meta: DataFrame, literal_rescale: bool = False) -> DataFrame:
    """Values as counts: rounded half to even if more than 70 % of the positive ones are whole, else stretched to 1 to 1001 row by row."""
    whole = _long(meta).where("v > 0").agg((F.avg(F.when(F.col("v") % 1 == 0, 1.0).otherwise(0.0)) > 0.7).alias("whole"))
    positive = F.filter("x", lambda v: v > 0)
    low, high = F.array_min(positive), F.array_max("x")
    share = lambda v: F.when(high > low, (v - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0)
    stretched = F.transform("x", lambda v: F.when(v > 0, F.rint(share(v) + 1000 if literal_rescale else share(v) * 1000 + 1)).otherwise(v))
    return meta.crossJoin(F.broadcast(whole)).select(
        "node", "t", F.when(F.coalesce("whole", F.lit(True)), F.transform("x", F.rint)).otherwise(stretched).alias("x")
    )


def poisson_shift(meta: DataFrame) -> DataFrame:
    """Counts from the smallest value of all: round(x - min)."""
    low = _long(meta).agg(F.min("v").alias("low"))
    return meta.crossJoin(F.broadcast(low)).select("node", "t", F.transform("x", lambda v: F.rint(v - F.col("low"))).alias("x"))


def clean(meta: DataFrame, dist: str, max_cats: int = 20, literal_rescale: bool = False) -> DataFrame:
    """(node, t, x) as the distribution takes it; rows in which nothing is left to say have no row.

    Counts are shifted and rounded, flags 1 where positive (a row's ``max_cats`` largest at most, of equals those of larger
    positions), categories 1 at the largest positive value (the last of equals), multinomial values counts.
    """
    if dist == "poisson":
        return poisson_shift(meta)
    if dist == "multinomial":
        return multinomial_counts(meta, literal_rescale)
    if dist not in ("indep bernoulli", "categorical"):
        raise ValueError(f"no such distribution: {dist}")
    most = 1 if dist == "categorical" else max_cats
    positive = F.filter(F.transform("x", lambda v, l: F.struct(v.alias("v"), l.alias("l"))), lambda c: c["v"] > 0)
    chosen = F.transform(F.slice(F.sort_array(positive, asc=False), 1, most), lambda c: c["l"])
    rows = meta.withColumn("chosen", chosen)
    if dist == "categorical":
        rows = rows.where(F.size("chosen") > 0)
    flags = F.transform("x", lambda v, l: F.when(v.isNull() & F.lit(dist != "categorical"), F.lit(None).cast("double")).otherwise(F.array_contains("chosen", l).cast("double")))
    return rows.withColumn("x", flags).drop("chosen")


def _ln(x: Column) -> Column:
    return F.log(F.when(x > 0, x).otherwise(F.lit(TOL)))


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def _lgamma_of(x: Column) -> Column:
    """ln of the gamma function at x + 1."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + i)
    return F.lit(0.9189385332046727) + (x + 0.5) * F.log(x + 7.5) - (x + 7.5) + F.log(series)


def log_likelihood(dist: str, x: Column, theta: Column) -> Column:
    """ln P(x | theta) of one row and group, both arrays; a missing value adds 0."""
    if dist == "poisson":
        return F.coalesce(x[0] * _ln(theta[0]) - theta[0] - _lgamma_of(x[0]), F.lit(0.0))
    if dist == "indep bernoulli":
        return _sum(F.zip_with(x, theta, lambda v, p: v * _ln(p) + (1 - v) * _ln(1 - p)))
    own = _sum(F.zip_with(x, theta, lambda v, p: v * _ln(p)))
    if dist == "categorical":
        return own
    if dist == "multinomial":
        return own - _sum(F.transform(x, _lgamma_of))
    raise ValueError(f"no such distribution: {dist}")


def score(meta: DataFrame, params: DataFrame, dist: str) -> DataFrame:
    """(node, t, q, loglik) of rows under the parameters (t, q, theta array<double>), which are few."""
    return meta.join(F.broadcast(params), "t").select("node", "t", "q", log_likelihood(dist, F.col("x"), F.col("theta")).alias("loglik"))


def estimate(meta: DataFrame, shares: DataFrame, dist: str, mask_missing: bool = False) -> DataFrame:
    """(t, q, l, v): parameters from shares (node, t, q, p) of groups, 1 for each row of hard labels.

    Rates of Poisson and Bernoulli fields divide by the shares of all present rows, with data or without, unless
    ``mask_missing`` is set; categories are shares of their sum, and multinomial ones of the group's total count.
    """
    seen = shares.join(meta, ["node", "t"])
    cells = seen.select("t", "q", "p", F.posexplode("x").alias("l", "v")).groupBy("t", "q", "l").agg(F.sum(F.col("p") * F.col("v")).alias("a"))
    if dist in ("poisson", "indep bernoulli"):
        whole = (seen if mask_missing else shares).groupBy("t", "q").agg(F.sum("p").alias("b"))
    else:
        whole = cells.groupBy("t", "q").agg(F.sum("a").alias("b"))
    return cells.join(whole, ["t", "q"]).select("t", "q", "l", F.when(F.col("b") > 0, F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).otherwise(0.0).alias("v"))


def as_vectors(estimates: DataFrame) -> DataFrame:
    """(t, q, theta) from (t, q, l, v)."""
    return estimates.groupBy("t", "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "v"))), lambda x: x["v"]).alias("theta"))

