"""Belief propagation on a temporal network, in joins and aggregates over unrolled group columns.

State. messages(t, recv, send, w_fwd, w_rev, psi0..): what the receiver holds of each sender. nodes(node, t, p0.., fwd0..,
bwd0..): marginals and temporal messages; fwd and bwd are NULL unless the node is present at t + 1 too. Parameters are
few: alpha and pi are literals, block probabilities a table (t, b00..) of a row for each snapshot.

A sweep aggregates the messages by receiver, with partial sums first, so that a hub costs its share; joins the small node
table, whose windows span one node's snapshots; and joins back to make the outgoing messages.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.functions import formulas as X


def blocks(spark: SparkSession, beta: dict[int, Sequence[Sequence[float]]]) -> DataFrame:
    """Block probabilities by snapshot as a table: a row for each snapshot."""
    q = len(next(iter(beta.values()))) if beta else 0
    names = ", ".join(f"b{i}{j} double" for i in range(q) for j in range(q))
    return spark.createDataFrame([(t, *(float(v) for row in b for v in row)) for t, b in sorted(beta.items())], f"t int, {names}")


def initial_blocks(edges: DataFrame, present: DataFrame, q: int) -> DataFrame:
    """(t, b00..): inside twice as probable as outside, at the snapshot's mean degree. edges: both ways."""
    out = edges.groupBy("t").agg(F.sum("w").alias("total")).join(present.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t")
    low = F.col("total") / F.col("n") / (F.col("n") * (q + 1))
    return out.select("t", *((low * (2 if i == j else 1)).alias(f"b{i}{j}") for i in range(q) for j in range(q)))


def beta_columns(q: int) -> list[list[str]]:
    return [[f"b{i}{j}" for j in range(q)] for i in range(q)]


def planted_nodes(labels: DataFrame, q: int, weight: float = 0.8) -> DataFrame:
    """Marginals near labels (node, t, q); temporal messages are the marginals at their origin."""
    p = X.cols("p", q)
    own = labels.select("node", "t", *(F.expr(e).alias(c) for e, c in zip(X.planted("q", "node", "t", q, weight), p)))
    return with_temporal(own, q)


def with_temporal(nodes: DataFrame, q: int) -> DataFrame:
    """fwd of (node, t) is the marginal at t and bwd that at t + 1, where both exist."""
    after = "OVER (PARTITION BY node ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)"
    out = nodes.select("*", *(F.expr(f"max(p{i}) {after}").alias(f"bwd{i}") for i in range(q)))
    return out.select("*", *(F.expr(f"CASE WHEN bwd0 IS NOT NULL THEN p{i} END").alias(f"fwd{i}") for i in range(q)))


def planted_messages(pairs: DataFrame, labels: DataFrame, q: int, weight: float = 0.8) -> DataFrame:
    """Messages near the senders' labels."""
    own = pairs.join(labels.select(F.col("node").alias("send"), "t", "q"), ["send", "t"])
    psi = X.planted("q", "send * 13 + recv", "t", q, weight)
    return own.select("t", "recv", "send", "w_fwd", "w_rev", *(F.expr(e).alias(f"psi{i}") for i, e in enumerate(psi)))


def initial_state(pairs: DataFrame, labels: DataFrame, q: int, mode: str = "planted", weight: float = 0.6, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(messages, nodes) to start from: ``planted`` near labels (node, t, q), ``uniform``, or ``random`` by a hash of the row.

    With metadata that has one category for each group, its labels make ``planted`` start from the metadata.
    """
    if mode == "planted":
        return planted_messages(pairs, labels, q, weight), planted_nodes(labels, q, weight)
    if mode == "uniform":
        draw = lambda *key: [F.lit(1.0)] * q
    elif mode == "random":
        draw = lambda *key: [(F.pmod(F.xxhash64(*key, F.lit(k), F.lit(seed)), F.lit(1 << 20)) + 1) / (1 << 20) for k in range(q)]
    else:
        raise ValueError(f"no such start: {mode}")

    def shares(df: DataFrame, name: str, *key: str) -> list:
        own = draw(*key)
        total = own[0]
        for x in own[1:]:
            total = total + x
        return [(x / total).alias(f"{name}{k}") for k, x in enumerate(own)]

    nodes = labels.select("node", "t", *shares(labels, "p", "node", "t"))
    return pairs.select("*", *shares(pairs, "psi", "send", "recv", "t")), with_temporal(nodes, q)


def field_terms(messages: DataFrame, beta: DataFrame, q: int, directed: bool = False) -> DataFrame:
    """Adds f0..: what the sender's message says of each group of the receiver."""
    b, psi = beta_columns(q), X.cols("psi", q)
    power = lambda x, w: f"CASE WHEN {w} = 0 THEN CAST(1 AS DOUBLE) ELSE power({x}, {w}) END"
    if directed:
        f = [X.dot(psi, [f"{power(b[r][k], 'w_fwd')} * {power(b[k][r], 'w_rev')}" for r in range(q)]) for k in range(q)]
    else:
        f = [X.dot(psi, [b[r][k] for r in range(q)]) for k in range(q)]
    joined = messages.join(F.broadcast(beta), "t")
    return joined.select(*messages.columns, *(F.expr(e).alias(f"f{k}") for k, e in enumerate(f)))


def field_terms_dc(messages: DataFrame, degs: DataFrame, lam: DataFrame, q: int, directed: bool = False) -> DataFrame:
    """Adds f0.. of the degree-corrected model: Poisson probabilities of the edge's weight, scaled by their largest one.

    The undirected edge has one weight, so its probability is used as it is; a directed one multiplies both directions'.
    """
    psi = X.cols("psi", q)
    logged, top = dc_logs(messages, degs, lam, q, directed), _largest_log(q)
    return logged.select(*messages.columns, *(F.expr(X.dot(psi, [f"exp(d{r}{k} - {top})" for r in range(q)])).alias(f"f{k}") for k in range(q)))


def _largest_log(q: int) -> str:
    return "greatest(" + ", ".join(f"d{r}{k}" for r in range(q) for k in range(q)) + ")"


def dc_logs(messages: DataFrame, degs: DataFrame, lam: DataFrame, q: int, directed: bool = False) -> DataFrame:
    """Adds d00..: logs of the edge's Poisson probability by the sender's and the receiver's group; directed: of both directions'."""
    at = lambda end, x: degs.select(F.col("node").alias(end), "t", F.col("d_out").alias(f"{x}_out"), F.col("d_in").alias(f"{x}_in"))
    b, logs = beta_columns(q), []
    for r in range(q):
        for k in range(q):
            e = X.poisson_logpmf("w_fwd", f"(s_out * r_in * {b[r][k]})")
            logs.append(f"({e} + {X.poisson_logpmf('w_rev', f'(r_out * s_in * {b[k][r]})')})" if directed else e)
    joined = messages.join(at("send", "s"), ["send", "t"]).join(at("recv", "r"), ["recv", "t"]).join(F.broadcast(lam), "t")
    return joined.select(*messages.columns, *(F.expr(e).alias(f"d{i // q}{i % q}") for i, e in enumerate(logs)))


def external_field(nodes: DataFrame, beta: DataFrame, q: int, directed: bool = False, degs: DataFrame | None = None) -> DataFrame:
    """(t, h0..): the snapshot's marginals through the block probabilities; a row for each snapshot.

    directed: both ways' probabilities. degs: marginals weigh by out-degrees and h counts for each degree of the receiver; if
    directed, h counts for its in-degree and g0.., of in-degrees the other way, for its out-degree.
    """
    b, p = beta_columns(q), X.cols("p", q)
    if degs is None:
        total = nodes.groupBy("t").agg(*(F.sum(c).alias(c) for c in p))
        both = lambda r, k: f"({b[r][k]} + {b[k][r]})" if directed else b[r][k]
        return total.join(F.broadcast(beta), "t").select("t", *(F.expr(X.dot(p, [both(r, k) for r in range(q)])).alias(f"h{k}") for k in range(q)))
    rows = _degree_sums(nodes, degs, q).join(F.broadcast(beta), "t")
    h = [F.expr(X.dot(X.cols("o", q), [b[r][k] for r in range(q)])).alias(f"h{k}") for k in range(q)]
    g = [F.expr(X.dot(X.cols("i", q), [b[k][r] for r in range(q)])).alias(f"g{k}") for k in range(q)] if directed else []
    return rows.select("t", *h, *g)


def _degree_sums(nodes: DataFrame, degs: DataFrame, q: int) -> DataFrame:
    """(t, o0.., i0..): marginals weighed by out- and by in-degrees."""
    of = lambda d, x: (F.sum(F.col(f"p{k}") * F.col(d)).alias(f"{x}{k}") for k in range(q))
    return nodes.join(degs, ["node", "t"]).groupBy("t").agg(*of("d_out", "o"), *of("d_in", "i"))


def _temporal(q: int, pi: Sequence[Sequence[float]], direction: str) -> list[str]:
    """forward: what fwd says of the next step; backward: what bwd says of this one."""
    lit = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
    if direction == "forward":
        return [X.dot(X.cols("old_fwd", q), [lit(pi[r][k]) for r in range(q)]) for k in range(q)]
    return [X.dot(X.cols("bwd", q), [lit(pi[k][r]) for r in range(q)]) for k in range(q)]


_BEFORE = "OVER (PARTITION BY node ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
_AFTER = "OVER (PARTITION BY node ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)"


def temporal_terms(nodes: DataFrame, pi: Sequence[Sequence[float]], q: int) -> DataFrame:
    """(node, t, lf0.., lb0..): logs of the forward term into t and the backward one from t + 1; 0 where there is none."""
    rows = nodes.select("*", *(F.expr(f"max(fwd{i}) {_BEFORE}").alias(f"old_fwd{i}") for i in range(q)))
    lf = [f"CASE WHEN old_fwd0 IS NULL THEN CAST(0 AS DOUBLE) ELSE {X.ln_or_zero(e)} END" for e in _temporal(q, pi, "forward")]
    lb = [f"CASE WHEN bwd0 IS NULL THEN CAST(0 AS DOUBLE) ELSE {X.ln_or_zero(e)} END" for e in _temporal(q, pi, "backward")]
    return rows.select(*nodes.columns, (F.col("old_fwd0").isNotNull()).alias("continues"), *(F.expr(e).alias(f"lf{i}") for i, e in enumerate(lf)), *(F.expr(e).alias(f"lb{i}") for i, e in enumerate(lb)))


def site_terms(fields: DataFrame, nodes: DataFrame, beta: DataFrame, q: int, directed: bool = False, degs: DataFrame | None = None, tol: float = X.TOL) -> DataFrame:
    """(node, t, s0..): logs of what all neighbours say of the node, less the external field."""
    site = fields.groupBy(F.col("recv").alias("node"), "t").agg(*(F.sum(F.expr(X.safe_ln(f"f{k}", tol))).alias(f"s{k}") for k in range(q)))
    site = site.join(F.broadcast(external_field(nodes, beta, q, directed, degs)), "t")
    if degs is not None:
        site = site.join(degs.select("node", "t", "d_in", "d_out"), ["node", "t"])
    outside = lambda k: f"h{k}" if degs is None else f"(h{k} * d_in + g{k} * d_out)" if directed else f"h{k} * d_out"
    return site.select("node", "t", *(F.expr(f"s{k} - {outside(k)}").alias(f"s{k}") for k in range(q)))


def smallest_positive(fields: DataFrame, q: int) -> float | None:
    """The smallest positive field term of the system; None where there is none."""
    least = F.least(*(F.min(F.when(F.col(f"f{k}") > 0, F.col(f"f{k}"))) for k in range(q))) if q > 1 else F.min(F.when(F.col("f0") > 0, F.col("f0")))
    return fields.agg(least).first()[0]


def suggested_tuning(site: DataFrame, meta: DataFrame, q: int, tuning: float) -> float | None:
    """A weight of metadata for which it says as much as the edges do, where it says over twice as much in over a quarter of cells.

    Else None. site: ``site_terms``; meta: (node, t, m0..), which counts ``tuning`` times now. The weight is the mean of their
    ratio over cells that have both, clamped to [1e-4, 50].
    """
    cells = F.array(*(F.struct(F.col(f"s{k}").alias("s"), F.col(f"m{k}").alias("m")) for k in range(q)))
    long = site.join(meta, ["node", "t"], "left").select(F.explode(cells).alias("x")).select("x.s", "x.m")
    r = long.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("m") * tuning < 2 * F.col("s")).cast("long")).alias("over"), F.avg(F.when(F.col("m") != 0, F.col("s") / F.nullif("m", F.lit(0.0)))).alias("ratio")).first()
    if r["over"] is None or r["ratio"] is None or r["over"] <= r["n"] / 4:
        return None
    return min(50.0, max(1e-4, r["ratio"]))


def sweep_nodes(fields: DataFrame, nodes: DataFrame, beta: DataFrame, alpha: Sequence[float], pi: Sequence[Sequence[float]], q: int, meta: DataFrame | None = None, tuning: float = 1.0, directed: bool = False, degs: DataFrame | None = None, tol: float = X.TOL) -> DataFrame:
    """One synchronous sweep of the node table: (node, t, p0.., fwd0.., bwd0.., w0..).

    fields: ``field_terms``, or ``field_terms_dc`` with degs (node, t, d_in, d_out). meta: (node, t, m0..), log-likelihoods. w: the nodes' log-weights, of which messages are made.
    A node that wasn't present a step earlier begins by alpha. Logs of what isn't positive are those of tol.
    """
    rows = temporal_terms(nodes.select("node", "t", *X.cols("p", q), *X.cols("fwd", q), *X.cols("bwd", q)), pi, q)
    rows = rows.join(site_terms(fields, nodes, beta, q, directed, degs, tol), ["node", "t"])
    if meta is not None:
        rows = rows.join(meta, ["node", "t"], "left")
    own = lambda k: f"s{k}" + (f" + CAST({tuning!r} AS DOUBLE) * coalesce(m{k}, CAST(0 AS DOUBLE))" if meta is not None else "")
    # Before the forward term, alpha counts at the first snapshot only; with it, wherever a node begins.
    start = [f"ln(CAST({float(a)!r} AS DOUBLE))" for a in alpha]
    pre = [f"{own(k)} + lb{k} + CASE WHEN t = 0 THEN {start[k]} ELSE CAST(0 AS DOUBLE) END" for k in range(q)]
    rows = rows.select("node", "t", "continues", "bwd0", *X.cols("lf", q), *X.cols("lb", q), *(F.expr(e).alias(f"pre{k}") for k, e in enumerate(pre)))
    full = [f"pre{k} + CASE WHEN t > 0 THEN CASE WHEN continues THEN lf{k} ELSE {start[k]} END ELSE CAST(0 AS DOUBLE) END" for k in range(q)]
    back = X.softmax(X.cols("pre", q))
    rows = rows.select("*", *(F.expr(e).alias(f"w{k}") for k, e in enumerate(full)), *(F.expr(e).alias(f"back{k}") for k, e in enumerate(back)))
    rows = rows.select("*", *(F.expr(f"max(back{k}) {_AFTER}").alias(f"new_bwd{k}") for k in range(q)))
    ahead = X.softmax([f"(w{k} - lb{k})" for k in range(q)])
    return rows.select(
        "node",
        "t",
        *(F.expr(e).alias(f"p{k}") for k, e in enumerate(X.softmax(X.cols("w", q)))),
        *(F.expr(f"CASE WHEN new_bwd0 IS NOT NULL THEN {e} END").alias(f"fwd{k}") for k, e in enumerate(ahead)),
        *(F.col(f"new_bwd{k}").alias(f"bwd{k}") for k in range(q)),
        *X.cols("w", q),
    )


def sweep_messages(fields: DataFrame, swept: DataFrame, q: int, tol: float = X.TOL) -> DataFrame:
    """The messages that receivers send back: each neighbour's own word is taken out of the node's weight."""
    at = swept.select(F.col("node").alias("recv"), "t", *X.cols("w", q))
    out = X.softmax([f"(w{k} - {X.safe_ln(f'f{k}', tol)})" for k in range(q)])
    return fields.join(at, ["recv", "t"]).select(
        "t", F.col("send").alias("recv"), F.col("recv").alias("send"), F.col("w_rev").alias("w_fwd"), F.col("w_fwd").alias("w_rev"), *(F.expr(e).alias(f"psi{k}") for k, e in enumerate(out))
    )


def paired(messages: DataFrame, q: int, others: DataFrame | None = None) -> DataFrame:
    """Messages with the opposite ones: back0.. is what the sender holds of the receiver."""
    other = (messages if others is None else others).select("t", F.col("send").alias("recv"), F.col("recv").alias("send"), *(F.col(f"psi{k}").alias(f"back{k}") for k in range(q)))
    return messages.join(other, ["t", "recv", "send"])


def _pair_weights(messages: DataFrame, beta: DataFrame, q: int, directed: bool, degs: DataFrame | None, both_ways: bool) -> tuple[DataFrame, dict[tuple[int, int], str]]:
    """Paired messages and the unnormalised weight of each group pair; with degs by the degree-corrected probabilities."""
    factor = beta_columns(q) if degs is None else [[f"exp(d{r}{k} - {_largest_log(q)})" for k in range(q)] for r in range(q)]
    known = messages.join(F.broadcast(beta), "t") if degs is None else dc_logs(messages, degs, beta, q, both_ways)
    raw = {
        (r, k): f"(psi{r} * back{k}" + (f" + psi{k} * back{r}" if r != k and not directed else "") + f") * {factor[r][k]}" for r in range(q) for k in range(q)
    }
    return paired(known, q, messages), raw


def edge_pairs(messages: DataFrame, beta: DataFrame, q: int, directed: bool = False, degs: DataFrame | None = None) -> DataFrame:
    """Adds e00..: shares of group pairs (sender's, receiver's) for each ordered pair of neighbours.

    An undirected edge's off-diagonal pairs count in both orders. With degs, a directed edge counts by its own direction alone.
    """
    known, raw = _pair_weights(messages, beta, q, directed, degs, both_ways=False)
    rows = known.select(*messages.columns, *(F.expr(e).alias(f"u{r}{k}") for (r, k), e in raw.items()))
    total = X.add([f"u{r}{k}" for r, k in raw])
    return rows.select(*messages.columns, *(F.expr(X.ratio(f"u{r}{k}", total)).alias(f"e{r}{k}") for r, k in raw))


def time_pairs(nodes: DataFrame, pi: Sequence[Sequence[float]], q: int) -> DataFrame:
    """(node, t, g00..): shares of group pairs at t and t + 1, of nodes that are present at both."""
    raw = {(r, k): f"fwd{r} * bwd{k} * CAST({float(pi[r][k])!r} AS DOUBLE)" for r in range(q) for k in range(q)}
    rows = nodes.where("bwd0 IS NOT NULL").select("node", "t", *(F.expr(e).alias(f"u{r}{k}") for (r, k), e in raw.items()))
    total = X.add([f"u{r}{k}" for r, k in raw])
    return rows.select("node", "t", *(F.expr(X.ratio(f"u{r}{k}", total)).alias(f"g{r}{k}") for r, k in raw))


def alpha_estimate(nodes: DataFrame, q: int, use_all: bool = True) -> DataFrame:
    """One row a0..: mean shares of groups, of all rows or of those where a node begins."""
    rows = nodes if use_all else nodes.select("*", F.expr(f"max(p0) {_BEFORE}").alias("was")).where("t = 0 OR was IS NULL")
    return rows.agg(*(F.avg(f"p{k}").alias(f"a{k}") for k in range(q)))


def pi_estimate(pairs: DataFrame, q: int) -> DataFrame:
    """One row pi00..: transition shares by row, from ``time_pairs``."""
    sums = pairs.agg(*(F.sum(f"g{r}{k}").alias(f"g{r}{k}") for r in range(q) for k in range(q)))
    return sums.select(*(F.expr(X.ratio(f"g{r}{k}", X.add([f"g{r}{j}" for j in range(q)]))).alias(f"pi{r}{k}") for r in range(q) for k in range(q)))


def beta_estimate(pairs: DataFrame, nodes: DataFrame, q: int, directed: bool = False) -> DataFrame:
    """(t, b00..) from ``edge_pairs``: diagonals are one number over all time; undirected ones are symmetric."""
    num = pairs.where("w_fwd > 0").groupBy("t").agg(*(F.sum(f"e{r}{k}").alias(f"n{r}{k}") for r in range(q) for k in range(q)))
    size = nodes.groupBy("t").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(q)))
    rows = size.join(num, "t", "left").na.fill(0.0)
    pooled = rows.agg(*(F.sum(f"n{k}{k}").alias(f"dn{k}") for k in range(q)), *(F.sum(F.col(f"p{k}") * F.col(f"p{k}")).alias(f"dd{k}") for k in range(q)))
    cell = lambda r, k: X.ratio(f"dn{r}", f"dd{r}") if r == k else X.ratio(f"n{r}{k}", f"(p{r} * p{k})")
    value = lambda r, k: cell(r, k) if directed or r == k else f"(({cell(r, k)}) + ({cell(k, r)})) / 2"
    return rows.crossJoin(F.broadcast(pooled)).select("t", *(F.expr(value(r, k)).alias(f"b{r}{k}") for r in range(q) for k in range(q)))


def lambda_estimate(pairs: DataFrame, nodes: DataFrame, degs: DataFrame, q: int, directed: bool = False) -> DataFrame:
    """(t, b00..) of the degree-corrected model: edges weigh by their weight, nodes by their degrees."""
    num = pairs.groupBy("t").agg(*(F.sum(F.col(f"e{r}{k}") * F.col("w_fwd")).alias(f"n{r}{k}") for r in range(q) for k in range(q)))
    size = nodes.join(degs, ["node", "t"]).groupBy("t").agg(
        *(F.sum(F.col(f"p{k}") * F.col("d_out")).alias(f"o{k}") for k in range(q)), *(F.sum(F.col(f"p{k}") * F.col("d_in")).alias(f"i{k}") for k in range(q))
    )
    rows = size.join(num, "t", "left").na.fill(0.0)
    pooled = rows.agg(*(F.sum(f"n{k}{k}").alias(f"dn{k}") for k in range(q)), *(F.sum(F.col(f"o{k}") * F.col(f"i{k}")).alias(f"dd{k}") for k in range(q)))
    cell = lambda r, k: X.ratio(f"dn{r}", f"dd{r}") if r == k else X.ratio(f"n{r}{k}", f"(o{r} * i{k})")
    value = lambda r, k: cell(r, k) if directed or r == k else f"(({cell(r, k)}) + ({cell(k, r)})) / 2"
    return rows.crossJoin(F.broadcast(pooled)).select("t", *(F.expr(value(r, k)).alias(f"b{r}{k}") for r in range(q) for k in range(q)))


def free_energy(messages: DataFrame, nodes: DataFrame, weights: DataFrame, beta: DataFrame, pi: Sequence[Sequence[float]], q: int, directed: bool = False, degs: DataFrame | None = None) -> DataFrame:
    """One row (edge, time, site, pair, energy), for each present row; lower is better.

    weights: (node, t, w0..), log-weights of a sweep. Ordered pairs: an undirected edge counts twice.
    """
    b = beta_columns(q)
    known, raw = _pair_weights(messages, beta, q, directed, degs, both_ways=directed)
    edge = known.agg(F.sum(F.expr(X.ln_or_zero(X.add(list(raw.values()))))).alias("edge"))
    moves = X.add([f"fwd{r} * bwd{k} * CAST({float(pi[r][k])!r} AS DOUBLE)" for r in range(q) for k in range(q)])
    time = nodes.where("bwd0 IS NOT NULL").agg(F.coalesce(F.sum(F.expr(X.ln_or_zero(moves))), F.lit(0.0)).alias("time"))
    w = X.cols("w", q)
    top = f"greatest({', '.join(w)})"
    site = weights.agg(F.sum(F.expr(f"{top} + ln({X.add([f'exp({x} - {top})' for x in w])})")).alias("site"), F.count(F.lit(1)).alias("n"))
    size, out, into = (nodes.groupBy("t").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(q))), "p", "p") if degs is None else (_degree_sums(nodes, degs, q), "o", "i")
    pair = size.join(F.broadcast(beta), "t").agg(F.sum(F.expr(X.add([f"{out}{r} * {b[r][k]} * {into}{k}" for r in range(q) for k in range(q)]))).alias("pair"))
    one = edge.crossJoin(time).crossJoin(site).crossJoin(pair)  # one row each
    return one.select(*((F.col(c) / F.col("n")).alias(c) for c in ("edge", "time", "site", "pair"))).withColumn("energy", F.expr("edge + time - site + pair"))


def map_labels(nodes: DataFrame, q: int) -> DataFrame:
    """(node, t, q): the group of the largest share, the first of equals."""
    return nodes.select("node", "t", F.expr(X.argmax(X.cols("p", q))).cast("int").alias("q"))


def largest_change(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> float:
    """The largest absolute difference of any of the columns."""
    was = old.select(*keys, *(F.col(c).alias(f"was_{c}") for c in columns))
    top = F.greatest(*(F.abs(F.col(c) - F.col(f"was_{c}")) for c in columns)) if len(columns) > 1 else F.abs(F.col(columns[0]) - F.col(f"was_{columns[0]}"))
    return new.join(was, keys).agg(F.max(top)).first()[0] or 0.0
