"""Expectation-maximisation with belief propagation as the E step.

The driver holds the parameters, of which there are a few for each group and snapshot; messages and nodes are tables, written
to the shared folder after every sweep so that plans stay short and a lost executor costs the running tasks only.
"""
from __future__ import annotations

import copy
import threading
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.config import Semantics, Settings
from netweft.functions import formulas as X
from netweft.operators import graph, metadata, packed, partition
from netweft.operators import propagation as bp
from netweft.plans.scratch import remove, stored


@dataclass
class Fit:
    labels: DataFrame
    marginals: DataFrame
    alpha: list[float]
    pi: list[list[float]]
    beta: dict[int, list[list[float]]]
    energy: float
    converged: bool
    history: list[dict] = field(default_factory=list)
    score: float | None = None  # mean adjusted Rand index over snapshots, where a truth was given
    highest: DataFrame | None = None  # labels at the highest energy of the run
    tuning: float = 1.0


Matrix = Sequence[Sequence[float]]


@dataclass(frozen=True)
class Params:
    """Parameters given to a fit, any of them. beta: one matrix, or one for each snapshot; theta: a table (t, q, theta) for each field."""

    alpha: Sequence[float] | None = None
    pi: Matrix | None = None
    beta: dict[int, Matrix] | Matrix | None = None
    theta: Sequence[DataFrame] | None = None


def kmeans_labels(edges: DataFrame, present: DataFrame, q: int, seed: int = 0, fields: Sequence[tuple[DataFrame, str]] = (), width: int = 64) -> DataFrame:
    """(node, t, q): one label for each node, by k-means on its neighbours over all time, hashed to ``width`` columns.

    fields: (meta, distribution) of metadata whose values are columns, too, hashed alike to as many others.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    column = lambda *key: F.pmod(F.xxhash64(*key), F.lit(width))
    both = edges.unionByName(graph.reversed_edges(edges)).select(F.col("src").alias("node"), column("t", "dst").alias("c"), F.col("w").cast("double").alias("v"))
    for k, (meta, _) in enumerate(fields):
        values = meta.select("node", "t", F.posexplode("x").alias("l", "v")).where("v is not null")
        both = both.unionByName(values.join(present, ["node", "t"], "left_semi").select("node", (width + column(F.lit(k), "t", "l")).alias("c"), F.col("v").cast("double").alias("v")))
    # A column for each sum: k-means reads the rows again and again, and maps are slow to look into.
    sums = both.groupBy("node").agg(*(F.sum(F.when(F.col("c") == i, F.col("v")).otherwise(0.0)).alias(f"c{i}") for i in range(width * (2 if fields else 1))))
    vectors, _ = stored(sums.select("node", array_to_vector(F.array(*sums.columns[1:])).alias("features")), "vectors")
    model = KMeans(k=q, maxIter=10, seed=seed).fit(vectors)
    return present.join(model.transform(vectors).select("node", F.col("prediction").cast("int").alias("q")), "node")


def perturbed(labels: DataFrame, q: int, share: float = 0.05, seed: int = 0) -> DataFrame:
    """A share of the labels replaced by others, by a hash of the row: the same ones however the table is dealt out."""
    u = F.pmod(F.xxhash64("node", "t", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    new = F.pmod(F.xxhash64("t", "node", F.lit(seed + 1)), F.lit(q)).cast("int")
    return labels.select("node", "t", F.when(u < share, new).otherwise(F.col("q")).alias("q"))


def hashed_labels(present: DataFrame, q: int, seed: int = 0) -> DataFrame:
    return present.select("node", "t", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(q)).cast("int").alias("q"))


class TemporalBlockModel:
    """Groups of a temporal network.

    edges(t, src, dst, w) as they come; fields: (meta, distribution) of each metadata field, meta(node, t, x). arrays: fits
    keep messages as arrays (``packed``) and not in tables; for undirected networks without metadata or degree correction.
    """

    def __init__(self, edges: DataFrame, q: int, fields: Sequence[tuple[DataFrame, str]] = (), settings: Settings = Settings(), directed: bool = False, deg_corr: bool = False, semantics: Semantics = Semantics(), arrays: bool = False):
        if q < 2:
            raise ValueError("a model needs two groups at least")
        if arrays and (fields or directed or deg_corr or semantics.literal_floor):
            raise ValueError("arrays are for undirected networks without metadata, degree correction or literal_floor")
        self.arrays = arrays
        self.q, self.fields, self.settings, self.directed, self.deg_corr, self.semantics = q, list(fields), settings, directed, deg_corr, semantics
        self.stopping = threading.Event()
        self.edges, self.edges_uri = stored(graph.prepare(edges, directed, deg_corr), "edges")
        self.present, self.present_uri = stored(graph.presence(self.edges), "presence")
        # The undirected preparation has each edge both ways already, and its weight counts for both.
        both = self.edges.select("t", F.col("dst").alias("recv"), F.col("src").alias("send"), *(F.col("w").cast("double").alias(c) for c in ("w_fwd", "w_rev")))
        self.pairs, self.pairs_uri = stored(graph.messages(self.edges) if directed else both, "pairs")
        self.degrees, self.degrees_uri = stored(graph.degrees(self.edges), "degrees") if deg_corr else (None, None)

    def with_groups(self, q: int) -> TemporalBlockModel:
        """The same network for another number of groups."""
        other = copy.copy(self)
        other.q = q
        return other

    def initial(self, labels: DataFrame, weight: float | None = None, start: str = "planted") -> tuple[DataFrame, DataFrame]:
        """Messages and nodes to begin with. start: ``planted`` near the labels, ``planted_meta`` near those that metadata
        shows, ``uniform`` or ``random``."""
        weight = self.settings.planted_p if weight is None else weight
        if start == "planted_meta":
            labels, start = self._shown(labels), "planted"
        if start == "planted":
            return bp.planted_messages(self.pairs, labels, self.q, weight), bp.planted_nodes(labels, self.q, weight)
        return bp.initial_state(self.pairs, labels, self.q, start)

    def _shown(self, labels: DataFrame) -> DataFrame:
        """The categories of the one field, as labels; rows without data keep theirs."""
        if [dist for _, dist in self.fields] != ["categorical"]:
            raise ValueError("planted_meta needs one categorical field and no other")
        own = metadata.categorical_top1(self.fields[0][0]).select("node", "t", F.col("l").alias("shown"))
        if (own.agg(F.max("shown")).first()[0] or 0) >= self.q:
            raise ValueError("the field has more categories than there are groups")
        return labels.join(own, ["node", "t"], "left").select("node", "t", F.coalesce("shown", "q").cast("int").alias("q"))

    def _thetas(self, shares: DataFrame) -> list[DataFrame]:
        return [metadata.as_vectors(metadata.estimate(meta, shares, dist, self.semantics.mask_missing)) for meta, dist in self.fields]

    def _meta(self, thetas: Sequence[DataFrame]) -> DataFrame:
        """(node, t, m0..): log-likelihoods of all fields together under their parameters (t, q, theta)."""
        out = None
        for (meta, dist), theta in zip(self.fields, thetas):
            one = metadata.score(meta, theta, dist)
            out = one if out is None else out.unionByName(one)
        return out.groupBy("node", "t").agg(*(F.sum(F.when(F.col("q") == k, F.col("loglik"))).alias(f"m{k}") for k in range(self.q)))

    def _shares(self, nodes: DataFrame) -> DataFrame:
        pieces = F.array(*(F.struct(F.lit(k).alias("q"), F.col(f"p{k}").alias("p")) for k in range(self.q)))
        return nodes.select("node", "t", F.explode(pieces).alias("x")).select("node", "t", "x.q", "x.p")

    def _first(self, labels: DataFrame, frozen: bool) -> tuple[list[float], list[list[float]], dict[int, list[list[float]]]]:
        """Parameters that nothing is known of; mixed with those of the labels, by ``planted_p``, where settings say informative."""
        q, s = self.q, self.settings
        alpha = [1 / q] * q
        pi = [[1 / q] * q for _ in range(q)] if not frozen else [[0.7 if i == j else 0.3 / max(1, q - 1) for j in range(q)] for i in range(q)]
        if self.deg_corr:
            n = self.present.select("node").distinct().count()
            beta = {r["t"]: [[r["w"] / n**2] * q for _ in range(q)] for r in self.edges.groupBy("t").agg(F.sum("w").cast("double").alias("w")).collect()}
        else:
            first = bp.initial_blocks(self.edges, self.present, q).collect()
            beta = {r["t"]: [[r[f"b{i}{j}"] for j in range(q)] for i in range(q)] for r in first}
        if not s.informative:
            return alpha, pi, beta
        mix = lambda own, other: s.planted_p * own + (1 - s.planted_p) * other
        sizes = {r["q"]: r["n"] for r in labels.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
        moves = {(r["q"], r["r"]): r["pi"] for r in partition.effective_pi(labels).collect()}
        alpha = [mix(sizes.get(k, 0) / max(1, sum(sizes.values())), alpha[k]) for k in range(q)]
        # A group without transitions says nothing of its row.
        known = {g for g, _ in moves}
        pi = [[mix(moves.get((i, j), 0.0), pi[i][j]) if i in known else pi[i][j] for j in range(q)] for i in range(q)]
        if not self.deg_corr:  # effective_beta is half the mean of the adjacency
            seen = {(r["t"], r["q"], r["r"]): 2 * r["beta"] for r in partition.effective_beta(self.edges, labels).collect()}
            beta = {t: [[mix(seen.get((t, i, j), b[i][j]), b[i][j]) for j in range(q)] for i in range(q)] for t, b in beta.items()}
        return alpha, pi, beta

    def fit(
        self, labels: DataFrame, beta: dict | None = None, frozen: bool = False, max_iter: int | None = None, max_msg_iter: int | None = None,
        given: Params = Params(), frozen_meta: bool | None = None, truth: DataFrame | None = None, start: str = "planted", tuning: float | None = None,
    ) -> Fit:
        """From initial labels (node, t, q); the result is the state of the lowest energy or, with truth (node, t, q), of the highest score.

        given: parameters to begin with. frozen: those of groups and edges stay as they are; frozen_meta: those of metadata do,
        which are the given ones, or the estimates from the start. It is what frozen is unless stated. With everything frozen,
        only messages are passed.
        """
        s, q = self.settings, self.q
        frozen_meta = frozen if frozen_meta is None else frozen_meta
        only_messages = frozen and (frozen_meta or not self.fields)
        rounds, sweeps = 1 if only_messages else max_iter or s.max_iter, max_msg_iter or s.max_msg_iter
        spark = self.edges.sparkSession
        alpha, pi, first = self._first(labels, frozen)
        alpha = list(given.alpha) if given.alpha is not None else alpha
        pi = [list(row) for row in given.pi] if given.pi is not None else pi
        beta = given.beta if beta is None else beta
        beta = first if beta is None else beta if isinstance(beta, dict) else {t: beta for t in first}
        tuning = s.tuning if tuning is None else tuning
        thetas = list(given.theta) if given.theta is not None else None
        if self.arrays:  # messages and nodes are folders there
            work = packed.Packed(*self.initial(labels, start=start), q)
            msgs, nodes = m_uri, n_uri = work.first
        else:
            work = None
            (msgs, m_uri), (nodes, n_uri) = (stored(x, name) for x, name in zip(self.initial(labels, start=start), ("messages", "nodes")))
        as_rows = lambda x: x if work is None else work.rows(x)
        kept: dict[str, tuple] = {}

        def keep(name: str) -> None:
            before = kept.get(name)
            kept[name] = (n_uri, nodes, alpha, pi, beta, tuning)
            if before and before[0] not in {x[0] for x in kept.values()}:
                remove(spark, before[0])

        # The first steps, whose parameters are far off, take fewer sweeps.
        plan = [min(sweeps, sweeps // 3 + 1) if it < 5 and rounds > 1 else sweeps for it in range(rounds)]
        lowest, top, score, history, stale, converged = None, None, None, [], 0, False
        done: list[tuple] = []  # steps of arrays, by the one that is looked at next
        for it in range(rounds):
            energy = ari = None
            if work is not None and not done:  # up to the next whose state is asked for
                upto = it if truth is not None else next(x for x in range(it, rounds) if x % s.fe_freq == 0 or x == rounds - 1)
                rule = packed.Rule(s.tol, s.msg_conv_tol, s.conv_tol, s.learning_rate, s.alpha_use_all, frozen, upto % s.fe_freq == 0 or upto == rounds - 1)
                *state, done = work.steps(msgs, nodes, alpha, pi, beta, plan[it : upto + 1], rule, {x[0] for x in kept.values()})
                msgs, nodes = m_uri, n_uri = state
            if work is not None:
                alpha, pi, beta, moved, energy = done.pop(0)
            table = bp.blocks(spark, beta) if work is None else None
            meta = meta_uri = None
            if self.fields:  # the first sweep removes the nodes that it is made of
                if thetas is None or (not frozen_meta and it > 0):
                    thetas = self._thetas(self._shares(nodes))
                if frozen_meta and given.theta is None and it == 0:
                    thetas = [stored(x, "theta")[0] for x in thetas]
                meta, meta_uri = stored(self._meta(thetas), "meta")
            change = 0.0
            for k in range(plan[it] if work is None else 0):
                fields = bp.field_terms(msgs, table, q, self.directed) if self.degrees is None else bp.field_terms_dc(msgs, self.degrees, table, q, self.directed)
                floor = (bp.smallest_positive(fields, q) if self.semantics.literal_floor else None) or s.tol
                if s.auto_tune and meta is not None and k == 0:
                    tuning = bp.suggested_tuning(bp.site_terms(fields, nodes, table, q, self.directed, self.degrees, floor), meta, q, tuning) or tuning
                swept, swept_uri = stored(bp.sweep_nodes(fields, nodes, table, alpha, pi, q, meta, tuning, self.directed, self.degrees, floor), "nodes")
                new, new_uri = stored(bp.sweep_messages(fields, swept, q, floor), "messages")
                change = bp.largest_change(new, msgs, ["t", "recv", "send"], X.cols("psi", q))
                remove(spark, m_uri, *(() if n_uri in {x[0] for x in kept.values()} else (n_uri,)))
                (msgs, m_uri), (nodes, n_uri) = (new, new_uri), (swept, swept_uri)
                if change < s.msg_conv_tol:
                    break
            if meta_uri is not None:
                remove(spark, meta_uri)
            if work is None:
                moved = change if frozen else 0.0
            if not frozen and work is None:
                rate = s.learning_rate
                mix = lambda new, old: rate * float(new or 0.0) + (1 - rate) * old
                pairs = bp.edge_pairs(msgs, table, q, self.directed, self.degrees)
                a = bp.alpha_estimate(nodes, q, s.alpha_use_all).first()
                p = bp.pi_estimate(bp.time_pairs(nodes, pi, q), q).first()
                estimate = bp.beta_estimate(pairs, nodes, q, self.directed) if self.degrees is None else bp.lambda_estimate(pairs, nodes, self.degrees, q, self.directed)
                b = {r["t"]: r for r in estimate.collect()}
                few, was = [*alpha, *sum(pi, [])], [v for t in sorted(beta) for row in beta[t] for v in row]
                alpha = [mix(a[f"a{k}"], alpha[k]) for k in range(q)]
                pi = [[mix(p[f"pi{r}{k}"], pi[r][k]) for k in range(q)] for r in range(q)]
                beta = {t: [[mix(b[t][f"b{r}{k}"], beta[t][r][k]) for k in range(q)] for r in range(q)] if t in b else beta[t] for t in beta}
                now = [v for t in sorted(beta) for row in beta[t] for v in row]
                # Degree-corrected rates can be of any size: theirs is the relative change.
                by = lambda y: (1 / y if y > 0 else 0.0) if self.deg_corr else 1.0
                moved = max(*(abs(x - y) for x, y in zip([*alpha, *sum(pi, [])], few)), *(abs(x - y) * by(y) for x, y in zip(now, was)))
            stops = self.stopping.is_set() and not done
            ends = it == rounds - 1 or moved < s.conv_tol or stops
            if it % s.fe_freq == 0 or ends:
                if work is not None:
                    energy = work.energy(msgs, nodes, work.params(alpha, pi, beta)) if energy is None else energy
                else:
                    energy = bp.free_energy(msgs, nodes, nodes, bp.blocks(spark, beta), pi, q, self.directed, self.degrees).first()["energy"]
                if lowest is None or energy < lowest:
                    lowest, stale = energy, 0
                    keep("best") if truth is None else None
                else:
                    stale += 1
                if top is None or energy > top:
                    top = energy
                    keep("highest")
            if truth is not None:
                ari = ari_score(truth, bp.map_labels(as_rows(nodes), q))
                if score is None or ari >= score:
                    score = ari
                    keep("best")
            history.append({"iteration": it, "moved": moved, "energy": energy, "ari": ari})
            if moved < s.conv_tol:
                converged = True
            if converged or stops or (s.patience is not None and stale > s.patience):
                break
        remove(spark, m_uri, *(() if n_uri in {x[0] for x in kept.values()} else (n_uri,)))
        _, best, alpha, pi, beta, tuning = kept["best"]
        highest = kept["highest"][1]
        if work is not None:  # as tables, in place of the folders of arrays
            table = {uri: stored(as_rows(uri), "nodes")[0] for uri in {best, highest}}
            remove(spark, *table)
            work.close()
            best, highest = table[best], table[highest]
        return Fit(bp.map_labels(best, q), best, alpha, pi, beta, lowest, converged, history, score, bp.map_labels(highest, q), tuning)

    def fit_best(self, starts: Sequence[DataFrame], **options) -> Fit:
        """The fit of the lowest energy, or the highest score, from several initial partitions, ``at_once`` at a time.

        Interrupted, running fits end with their step; the best of what is there stays.
        """
        best: Fit | None = None
        self.stopping.clear()
        with ThreadPoolExecutor(max(1, self.settings.at_once)) as pool:
            jobs = [pool.submit(self.fit, labels, **options) for labels in starts]
            for job in jobs:
                try:
                    one = job.result()
                except KeyboardInterrupt:
                    self.stopping.set()
                    for x in jobs:
                        x.cancel()
                    if best is None:
                        raise
                    break
                best = one if best is None else better(best, one)
        if best is None:
            raise ValueError("no initial partition")
        return best

    def starts(self, n: int | None = None) -> Iterator[DataFrame]:
        """A k-means partition and perturbed copies of it; of metadata too where settings say so."""
        s = self.settings
        base, _ = stored(kmeans_labels(self.edges, self.present, self.q, fields=self.fields if s.init_meta else (), width=s.init_width), "start")
        for k in range(n or s.n_runs):
            yield base if k == 0 else perturbed(base, self.q, seed=k)


def ari_score(truth: DataFrame, labels: DataFrame) -> float:
    """The mean over snapshots of the adjusted Rand index of rows that have a label in both."""
    found = partition.ari_by_time(partition.contingency(truth, labels)).agg(F.avg("ari")).first()[0]
    return 0.0 if found is None else found


def better(a: Fit, b: Fit) -> Fit:
    """The fit of the higher score where both have one, else of the lower energy; the first of equals."""
    if a.score is not None and b.score is not None:
        return b if b.score > a.score else a
    return b if b.energy < a.energy else a


def best_fit(fits: Sequence[Fit]) -> Fit:
    out = fits[0]
    for x in fits[1:]:
        out = better(out, x)
    return out


def fit_tunings(model: TemporalBlockModel, labels: DataFrame, tunings: Sequence[float], **options) -> tuple[float, Fit]:
    """The weight of metadata, clamped to [1e-4, 50], whose fit has the lowest energy."""
    fits = [model.fit(labels, tuning=min(50.0, max(1e-4, x)), **options) for x in tunings]
    best = best_fit(fits)
    return best.tuning, best


def trial_groups(groups: int, low: int | None = None, high: int | None = None, trials: int | None = None) -> list[int]:
    """Numbers of groups to try: ``trials`` of them evenly from low to high, rounded down; else ``groups`` alone."""
    if low is None and high is None and trials is None:
        return [groups]
    if low is None or high is None or trials is None or trials < 1 or not 2 <= low <= high:
        raise ValueError("a search needs the least and the largest number of groups and how many to try")
    return [int(low + (high - low) * k / max(1, trials - 1)) for k in range(trials)]


def split_groups(nodes: int, most: int, least_nodes: int) -> int:
    """Into how many groups that many nodes are split: ``most``, or fewer so that each can have ``least_nodes``, but two at least."""
    return most if most < nodes / least_nodes else max(2, nodes // least_nodes)


def fit_groups(model: TemporalBlockModel, qs: Sequence[int], tunings: Sequence[float] = (), **options) -> list[Fit]:
    """A fit for each number of groups: the best of all starts and weights of metadata, and once more from its labels.

    ``best_fit`` chooses among them.
    """
    out = []
    for q in qs:
        at = model.with_groups(q)
        starts = list(at.starts())
        found = best_fit([at.fit_best(starts, tuning=x, **options) for x in tunings or (model.settings.tuning,)])
        again = at.fit(found.labels, tuning=found.tuning, **options)
        out.append(better(found, again))
    return out


@dataclass
class Hierarchy:
    """labels (level, node, t, q), and each level's fits by the group that they split, None above all: (groups, fit)."""

    labels: DataFrame
    levels: list[dict[int | None, tuple[list[int], Fit]]]

    def transitions(self) -> tuple[list[int], list[list[float]]]:
        """Leaf groups and the transitions between them."""
        return leaf_transitions([{g: (ids, f.pi) for g, (ids, f) in level.items()} for level in self.levels])

    def blocks(self, t: int) -> tuple[list[int], list[list[float]]]:
        """Leaf groups and the block probabilities between them in a snapshot."""
        zero = lambda f: [[0.0] * len(f.pi) for _ in f.pi]
        return leaf_transitions([{g: (ids, f.beta.get(t, zero(f))) for g, (ids, f) in level.items()} for level in self.levels], divide=False)


def hierarchy(edges: DataFrame, q: int, levels: int, settings: Settings = Settings(), directed: bool = False, deg_corr: bool = False, arrays: bool = False, **options) -> DataFrame:
    """(level, node, t, q): the labels of ``hierarchy_fits``."""
    return hierarchy_fits(edges, q, levels, (), settings, directed, deg_corr, arrays=arrays, **options).labels


def hierarchy_fits(edges: DataFrame, q: int, levels: int, fields: Sequence[tuple[DataFrame, str]] = (), settings: Settings = Settings(), directed: bool = False, deg_corr: bool = False, semantics: Semantics = Semantics(), arrays: bool = False, **options) -> Hierarchy:
    """Groups split again while more than ``h_min_n`` nodes have them as their majority label, into ``q`` groups or fewer.

    A level keeps labels of groups that it doesn't split, and numbers new groups from there on. The groups of a level are
    split ``at_once`` at a time.
    """
    model = TemporalBlockModel(edges, q, fields, settings, directed, deg_corr, semantics, arrays)
    fit = model.fit_best(list(model.starts()), **options)
    now, _ = stored(fit.labels, "labels")
    out, fits = now.withColumn("level", F.lit(0)), [{None: (list(range(q)), fit)}]
    # Each of the fits that run side by side is one at a time.
    alone = replace(settings, at_once=1)

    def split(g: int, n: int, nodes: DataFrame, shift: int) -> tuple[DataFrame, tuple | None]:
        nodes, _ = stored(nodes, "labels")
        sub, _ = stored(graph.induced_subgraph(edges, nodes), "edges")
        if sub.isEmpty():
            return nodes, None
        k = split_groups(n, q, settings.h_min_n)
        inner = TemporalBlockModel(sub, k, graph.induced_fields(fields, nodes), alone, directed, deg_corr, semantics, arrays)
        found = inner.fit_best(list(inner.starts()), **options)
        relabelled = found.labels.select("node", "t", (F.col("q") + shift).cast("int").alias("new"))
        # Nodes without an edge inside the group keep its label.
        return nodes.join(relabelled, ["node", "t"], "left").select("node", "t", F.coalesce("new", "q").alias("q")), (list(range(shift, shift + k)), found)

    for level in range(1, levels):
        major = partition.majority_label(now)
        sizes = {r["q"]: r["n"] for r in major.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
        large = [g for g, n in sorted(sizes.items()) if n > settings.h_min_n]
        if not large:
            break
        # Every group there has been is below: majority labels alone could miss one that some snapshot has.
        shift = max(x for at in fits for ids, _ in at.values() for x in ids) + 1
        of = {g: now.join(major.where(F.col("q") == g).select("node"), "node", "left_semi") for g in large}
        with ThreadPoolExecutor(max(1, settings.at_once)) as pool:
            found = list(pool.map(lambda x: split(x[1], sizes[x[1]], of[x[1]], shift + x[0] * q), enumerate(large)))
        joined = now.join(major.where(~F.col("q").isin(large)).select("node"), "node", "left_semi")
        for x, _ in found:
            joined = joined.unionByName(x)
        now, _ = stored(joined.select("node", "t", "q"), "labels")
        out = out.unionByName(now.withColumn("level", F.lit(level)))
        fits.append({g: one for g, (_, one) in zip(large, found) if one})
    return Hierarchy(out.select("level", "node", "t", "q"), fits)


def children(labels: DataFrame) -> DataFrame:
    """(level, q, members): for each group of a level, the groups of the next one that its majority nodes have."""
    major = labels.groupBy("level", "node", "q").agg(F.count(F.lit(1)).alias("n")).groupBy("level", "node").agg(F.max_by("q", F.struct("n", -F.col("q"))).alias("parent"))
    below = labels.select((F.col("level") - 1).alias("level"), "node", F.col("q").alias("child"))
    return major.join(below, ["level", "node"]).groupBy("level", F.col("parent").alias("q")).agg(F.array_sort(F.collect_set("child")).alias("members"))


def leaf_transitions(levels: Sequence[dict[int | None, tuple[list[int], list[list[float]]]]], divide: bool = True) -> tuple[list[int], list[list[float]]]:
    """Leaf groups and their transition matrix out of each level's: levels[l][parent] = (groups, matrix between them).

    Between leaves it is the entry of their ancestors below the lowest common one, times the persistence of the source's
    ancestors above, over the number of leaves under the target's (transitions only; ``divide``).
    """
    parent = {g: p for level in levels for p, (groups, _) in level.items() for g in groups}
    matrix = {p: (groups, m) for level in levels for p, (groups, m) in level.items()}
    leaves = sorted(g for g in parent if g not in matrix)

    def path(g: int) -> list[int]:
        return [g] if parent[g] is None else [*path(parent[g]), g]

    under = {g: sum(g in path(x) for x in leaves) for g in parent}
    out = []
    for a in leaves:
        row = []
        for b in leaves:
            pa, pb, value = path(a), path(b), 1.0
            for k, (x, y) in enumerate(zip(pa, pb)):
                groups, m = matrix[pa[k - 1] if k else None]
                entry = m[groups.index(x)][groups.index(y)]
                if x != y:
                    value = value * entry / (under[y] if divide else 1)
                    break
                value = value * entry if divide or x == a else value
            row.append(value)
        out.append(row)
    return leaves, out
