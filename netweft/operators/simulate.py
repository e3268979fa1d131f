"""Networks with known groups, reproducible however the work is dealt out: every draw is a hash of its row and the seed."""
from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*key: Column | str, seed: int = 0) -> Column:
    """From 0 to 1, without either."""
    return (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)


def transition_matrix(q: int, p_stay: float) -> list[list[float]]:
    return [[p_stay if i == j else (1 - p_stay) / max(1, q - 1) for j in range(q)] for i in range(q)]


def block_matrix(q: int, inside: float, outside: float) -> list[list[float]]:
    return [[inside if i == j else outside for j in range(q)] for i in range(q)]


def detectable(c: float, lam: float, eta: float) -> bool:
    """Whether groups can be found: c * lam ** 2 above (1 - eta ** 2) / (1 + eta ** 2)."""
    return c * lam * lam > (1 - eta * eta) / (1 + eta * eta)


def _draw(u: Column, weights: Sequence[float]) -> Column:
    """A category by its weight, from a uniform number."""
    out, total = F.lit(len(weights) - 1), sum(weights)
    for k in range(len(weights) - 2, -1, -1):
        out = F.when(u < sum(weights[: k + 1]) / total, F.lit(k)).otherwise(out)
    return out


def label_chain(spark: SparkSession, n: int, snapshots: int, pi: Sequence[Sequence[float]], alpha: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """(node, t, q): labels that evolve by ``pi`` from ``alpha``."""
    q = len(pi)
    rows = spark.range(n).select(F.col("id").alias("node"), F.array(_draw(uniform("id", F.lit(0), seed=seed), alpha or [1 / q] * q)).alias("z"))
    for t in range(1, snapshots):
        u, last = uniform("node", F.lit(t), seed=seed), F.element_at("z", -1)
        step = F.lit(0)
        for k in range(q):
            step = F.when(last == k, _draw(u, pi[k])).otherwise(step)
        rows = rows.select("node", F.concat("z", F.array(step)).alias("z"))
    return rows.select("node", F.posexplode("z").alias("t", "q"))


def planted_edges(labels: DataFrame, beta: Sequence[Sequence[float]], directed: bool = False, seed: int = 1) -> DataFrame:
    """(t, src, dst, w): independent edges with their groups' probability.

    Skip sampling: for each node, snapshot and group the gaps between its edges to the group's members, in order, are
    geometric, so that work follows the edges and not the pairs of nodes.
    """
    q = len(beta)
    from pyspark.sql import Window as W

    ranked = labels.withColumn("rank", F.row_number().over(W.partitionBy("t", "q").orderBy("node")) - 1)
    sizes = labels.groupBy("t", "q").agg(F.count(F.lit(1)).alias("n_r")).withColumnRenamed("q", "r")
    rate = F.lit(0.0)
    for i in range(q):
        for j in range(q):
            rate = F.when((F.col("q") == i) & (F.col("r") == j), F.lit(float(beta[i][j]))).otherwise(rate)
    most = F.when(F.col("p") >= 1, F.col("n_r")).otherwise(F.least(F.col("n_r"), F.ceil(F.col("n_r") * F.col("p") + 12 * F.sqrt(F.col("n_r") * F.col("p")) + 12)))
    draws = labels.join(F.broadcast(sizes), "t").withColumn("p", rate).where("p > 0").withColumn("k", F.explode(F.sequence(F.lit(1), most.cast("int"))))
    gap = F.when(F.col("p") >= 1, 1).otherwise(F.floor(F.log(uniform("node", "t", "r", "k", seed=seed)) / F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-12)))) + 1)
    place = F.sum(gap).over(W.partitionBy("node", "t", "r").orderBy("k")) - 1
    hits = draws.withColumn("rank", place).where("rank < n_r").select("t", F.col("node").alias("src"), "r", "rank")
    ends = ranked.select("t", F.col("q").alias("r"), "rank", F.col("node").alias("dst"))
    edges = hits.join(ends, ["t", "r", "rank"])
    edges = edges.where("src <> dst") if directed else edges.where("src < dst")
    return edges.select("t", "src", "dst", F.lit(1.0).alias("w"))


def poisson_cdf(rate: float, least: int = 0) -> tuple[int, list[float]]:
    """(first, cumulated shares) of the counts from ``least`` on that have a share of 1e-18 of the most probable one at
    least. Shares come from logarithms, so that no rate is too large for them."""
    log = lambda k: k * math.log(rate) - rate - math.lgamma(k + 1) if rate > 0 else (0.0 if k == 0 else -math.inf)
    low = high = top = max(least, math.floor(rate))
    while low > least and log(low - 1) - log(top) > math.log(1e-18):
        low -= 1
    while log(high + 1) - log(top) > math.log(1e-18):
        high += 1
    shares = [math.exp(log(k) - log(top)) if rate > 0 else 1.0 for k in range(low, high + 1)]
    total = math.fsum(shares)
    return low, [math.fsum(shares[: k + 1]) / total for k in range(len(shares))]


def _poisson(u: Column, rate: float, least: int = 0) -> Column:
    """A count from a uniform number, by inversion."""
    first, cdf = poisson_cdf(rate, least)
    return F.least(F.size(F.filter(F.array(*(F.lit(c) for c in cdf)), lambda c: c <= u)), F.lit(len(cdf) - 1)) + first


def truncated_poisson_weights(edges: DataFrame, rate: float, seed: int = 2) -> DataFrame:
    """Weights of 1 and more with a Poisson distribution without 0."""
    return edges.withColumn("w", _poisson(uniform("t", "src", "dst", seed=seed), rate, 1).cast("double"))


def poisson_metadata(labels: DataFrame, rates: Sequence[float], seed: int = 3) -> DataFrame:
    """(node, t, x): counts with the group's rate."""
    u, out = uniform("node", "t", seed=seed), F.lit(0)
    for g, rate in enumerate(rates):
        out = F.when(F.col("q") == g, _poisson(u, rate)).otherwise(out)
    return labels.select("node", "t", F.array(out.cast("double")).alias("x"))


def normal_metadata(labels: DataFrame, means: Sequence[float], deviations: Sequence[float], seed: int = 7) -> DataFrame:
    """(node, t, x): normal values with the group's mean and standard deviation, from two uniform numbers."""
    u, v = uniform("node", "t", seed=seed), uniform("t", "node", seed=seed + 1)
    z, out = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v), F.lit(0.0)
    for g, (mean, deviation) in enumerate(zip(means, deviations)):
        out = F.when(F.col("q") == g, F.lit(float(mean)) + F.lit(float(deviation)) * z).otherwise(out)
    return labels.select("node", "t", F.array(out).alias("x"))


def negative_binomial_metadata(labels: DataFrame, successes: Sequence[float], chances: Sequence[float], seed: int = 9) -> DataFrame:
    """(node, t, x): counts of failures before the group's number of successes, which need not be whole, each with its chance."""
    u, out = uniform("node", "t", seed=seed), F.lit(0)
    for g, (r, p) in enumerate(zip(successes, chances)):
        if not (r > 0 and 0 < p <= 1):
            raise ValueError("successes must be positive and chances above 0 and at most 1")
        log = lambda k: math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(p) + (k * math.log1p(-p) if k else 0.0)  # noqa: B023, E731
        shares, total = [], 0.0
        while total < 1 - 1e-12 and (p < 1 or not shares):
            shares.append(math.exp(log(len(shares))))
            total += shares[-1]
            if len(shares) > r * (1 - p) / p and shares[-1] < 1e-18:
                break
        cdf = [math.fsum(shares[: k + 1]) for k in range(len(shares))]
        value = F.least(F.size(F.filter(F.array(*(F.lit(c) for c in cdf)), lambda c: c <= u)), F.lit(len(cdf) - 1))
        out = F.when(F.col("q") == g, value).otherwise(out)
    return labels.select("node", "t", F.array(out.cast("double")).alias("x"))


def bernoulli_metadata(labels: DataFrame, chances: Sequence[Sequence[float]], seed: int = 4) -> DataFrame:
    """(node, t, x): flags with the group's chances."""
    width, cells = len(chances[0]), []
    for j in range(width):
        chance = F.lit(0.0)
        for g, c in enumerate(chances):
            chance = F.when(F.col("q") == g, F.lit(float(c[j]))).otherwise(chance)
        cells.append((uniform("node", "t", F.lit(j), seed=seed) < chance).cast("double"))
    return labels.select("node", "t", F.array(*cells).alias("x"))


def categorical_metadata(labels: DataFrame, q: int, rho: float = 1.0, seed: int = 5) -> DataFrame:
    """(node, t, x): the label with probability rho, else any category."""
    u = uniform("node", "t", seed=seed)
    shown = F.when(u < rho, F.col("q")).otherwise(F.floor(uniform("t", "node", seed=seed + 1) * q).cast("int"))
    return labels.select("node", "t", F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda k: (k == shown).cast("double")).alias("x"))


def masked_labels(labels: DataFrame, q: int, share: float, seed: int = 6) -> DataFrame:
    """Labels of which a share is redrawn: the step by which metadata is brought to a wanted alignment."""
    u = uniform("node", "t", seed=seed)
    return labels.select("node", "t", F.when(u < share, F.floor(uniform("t", "node", seed=seed + 1) * q).cast("int")).otherwise(F.col("q")).alias("q"))


def aligned_labels(labels: DataFrame, q: int, target: float, score: str = "ari", step: float = 0.01, most: int = 100, seed: int = 6) -> DataFrame:
    """Labels redrawn, a share of the rows more in each trial, until every snapshot's score against the first ones is below ``target``.

    The redrawn rows of a trial include those of the one before, so the share is found by halving.
    """
    from netweft.operators import partition

    table = lambda share: partition.contingency(labels, masked_labels(labels, q, share, seed))
    below = lambda share: max(
        (r[0] for r in (partition.ari_by_time(table(share)).select("ari") if score == "ari" else partition.mutual_information(table(share)).select("nmi")).collect()), default=0.0
    ) < target
    low, high = 0, min(most, int(1 / step))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if below(mid * step) else (mid + 1, high)
    return masked_labels(labels, q, high * step, seed)


def expected_degree(n: int, q: int, p_in: float, p_out: float) -> tuple[float, float]:
    """Mean and variance of a node's degree."""
    size = n / q
    return size * (p_in + (q - 1) * p_out), size * (p_in * (1 - p_in) + (q - 1) * p_out * (1 - p_out))


# Fixed values of the recovery experiments, a setting in each place.
_DEFAULT_C_IN = (10, 10, 6, 6, 10, 6, 10, 6)
_DEFAULT_P_STAY = (0.8, 0.6, 0.8, 0.6, 0.6, 0.8, 0.6, 0.6)
_DEFAULT_ALIGNED = (True, True, True, True, False, False, False, False)
_OG_BLOCKS = ((0.2, 0.1, 0.15), (0.25, 0.1, 0.2), (0.3, 0.1, 0.2), (0.4, 0.1, 0.2), (0.3, 0.1, 0.3))  # first group's, between, second's
_OG_P_STAY = (0.6, 0.75, 0.9)
_OG_SNAPSHOTS = (5, 10)


def _evenly(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * k / (n - 1) for k in range(n)]


def _setting(number: int, n: int, q: int, snapshots: int, beta: list[list[float]], p_stay: float, aligned: bool | float, samples: int, drawn: bool = False) -> dict:
    return {"number": number, "n": n, "q": q, "snapshots": snapshots, "beta": beta, "p_stay": p_stay, "aligned": aligned, "samples": samples, "drawn": drawn}


def default_grid() -> list[dict]:
    """Eight settings of 100 nodes, four groups and five snapshots; metadata shows the groups, or others of its own."""
    return [
        _setting(k + 1, 100, 4, 5, block_matrix(4, c / 100, 0.02), p, a, 20) for k, (c, p, a) in enumerate(zip(_DEFAULT_C_IN, _DEFAULT_P_STAY, _DEFAULT_ALIGNED))
    ]


def og_grid() -> list[dict]:
    """Thirty settings of 100 nodes and two groups of different density; the metadata's parameters are drawn for each sample."""
    cases = [(b, p, t) for b in _OG_BLOCKS for p in _OG_P_STAY for t in _OG_SNAPSHOTS]
    return [_setting(13 + k, 100, 2, t, [[b[0], b[1]], [b[1], b[2]]], p, True, 20, True) for k, (b, p, t) in enumerate(cases)]


def scaling_grid() -> list[dict]:
    """Twenty settings of 148 to 2,980 nodes, with the logarithm of that as the number of groups."""
    sizes = [int(math.exp(x) + 1e-9) for x in _evenly(5, 8, 20)]
    return [_setting(400 + k, n, int(math.log(n)), 5, block_matrix(int(math.log(n)), 20 / n, 5 / n), 0.8, True, 3) for k, n in enumerate(sizes)]


def align_grid() -> list[dict]:
    """Forty settings of 100 nodes, in which the metadata's agreement with the groups goes from 0.1 to 1, twice."""
    share = _evenly(0.1, 1.0, 10) * 2
    return [_setting(500 + k, 100, 4, 5, block_matrix(4, (40 if k < 20 else 30) / 100, 0.1), 0.6 if k % 2 == 0 else 0.8, share[k // 2], 20) for k in range(40)]


def toy_grid(
    n: int = 200, snapshots: int = 10, q: int = 2, c: float = 10.0, samples: int = 20, eps: Sequence[float] | None = None, eta: Sequence[float] | None = None,
    rho: Sequence[float] | None = None, literal: bool = False,
) -> list[dict]:
    """Settings around the limit of detection: eps is the ratio of densities outside and inside, eta the memory of labels, rho how
    often the one categorical field shows the group. c is the mean degree; literal: inside is c * q / n times what it is divided by."""
    out = []
    for e in eps or _evenly(0.3, 0.6, 10):
        inside = q * c / n * (1 + (q - 1) * e) if literal else q * c / n / (1 + (q - 1) * e)
        for m in eta or _evenly(0.4, 0.8, 10):
            for r in rho or _evenly(0.6, 1.0, 10):
                out.append({**_setting(len(out), n, q, snapshots, block_matrix(q, inside, e * inside), m + (1 - m) / q, True, samples), "eps": e, "eta": m, "rho": r})
    return out


GRIDS = {"default": default_grid, "og": og_grid, "scaling": scaling_grid, "align": align_grid, "toy": toy_grid}


def field_parameters(setting: dict, sample: int = 0) -> list[tuple[str, list[list[float]]]]:
    """(distribution, parameters of each group) of a setting's metadata: a Poisson field and four flags, or the toy's category."""
    q = setting["q"]
    if "rho" in setting:
        return [("categorical", transition_matrix(q, setting["rho"]))]
    if setting["drawn"]:
        draw = random.Random(setting["number"] * 1000 + sample)
        return [("poisson", [[float(draw.randrange(3, 12))] for _ in range(q)]), ("indep bernoulli", [[draw.random() for _ in range(4)] for _ in range(q)])]
    chances = [0.1 * x for x in (_evenly(1, 9, q) if q > 1 else [1.0])]
    return [("poisson", [[5.0 * (g + 1)] for g in range(q)]), ("indep bernoulli", [[x] * 4 for x in chances])]


def sampled_network(spark: SparkSession, setting: dict, sample: int = 0, directed: bool = False) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, str]]]:
    """(edges, labels, fields) of a sample of a setting.

    aligned: True, metadata follows the groups; False, groups of its own that evolve alike; a number, the groups redrawn until
    their adjusted Rand index is below it in every snapshot.
    """
    q, seed = setting["q"], 10_000 * setting["number"] + 20 * sample
    pi = transition_matrix(q, setting["p_stay"])
    labels = label_chain(spark, setting["n"], setting["snapshots"], pi, seed=seed)
    edges = planted_edges(labels, setting["beta"], directed, seed=seed + 1)
    aligned = setting["aligned"]
    if aligned is True:
        shown = labels
    elif aligned is False:
        shown = label_chain(spark, setting["n"], setting["snapshots"], pi, seed=seed + 2)
    else:
        shown = aligned_labels(labels, q, aligned, seed=seed + 2)
    fields = []
    for dist, params in field_parameters(setting, sample):
        if dist == "poisson":
            meta = poisson_metadata(shown, [x[0] for x in params], seed=seed + 4)
        elif dist == "indep bernoulli":
            meta = bernoulli_metadata(shown, params, seed=seed + 6)
        else:  # the field redraws among all categories, its own with them
            rho = params[0][0] if q > 1 else 1.0
            if rho * q < 1:
                raise ValueError("rho must be at least that of chance")
            meta = categorical_metadata(shown, q, (rho * q - 1) / (q - 1) if q > 1 else 1.0, seed=seed + 8)
        fields.append((meta, dist))
    return edges, labels, fields


def network(spark: SparkSession, n: int, q: int, snapshots: int, c_in: float, c_out: float, p_stay: float, seed: int = 0, **_) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of one setting; c_in and c_out are mean degrees inside and outside a group."""
    labels = label_chain(spark, n, snapshots, transition_matrix(q, p_stay), seed=seed)
    inside, outside = min(1.0, c_in * q / n), min(1.0, c_out * q / n / max(1, q - 1))
    return planted_edges(labels, block_matrix(q, inside, outside), seed=seed + 1), labels
