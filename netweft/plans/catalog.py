"""Every query of the library by name, with the SQL that gives the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.config import Settings
from netweft.functions import formulas as X
from netweft.operators import em, graph, greedy, metadata, partition, simulate
from netweft.operators import propagation as bp
from netweft.plans import fixtures as T
from netweft.plans.oracles import ORACLES
from netweft.sources import network as N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
Q, PI, ALPHA = T.Q, T.PI, T.ALPHA
_DISTS = {"poisson": "poisson", "bernoulli": "indep bernoulli", "categorical": "categorical", "multinomial": "multinomial"}
_RATE = Settings().learning_rate


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order; what is compared is rounded. 0 has no sign."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def long_blocks(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """(t, q, r, value) of a wide table (t, b00..)."""
    cells = F.array(*(F.struct(F.lit(r).alias("q"), F.lit(k).alias("r"), F.col(f"{prefix}{r}{k}").alias(name)) for r in range(Q) for k in range(Q)))
    keys = [c for c in ("t",) if c in df.columns]
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


@query
def net_edges(s, d):
    return T.edges(s, d)


@query
def net_edges_symmetric(s, d):
    return T.symmetric(s, d)


@query
def net_presence(s, d):
    return T.present(s, d)


@query
def net_transition_presence(s, d):
    return graph.transition_presence(T.present(s, d))


@query
def net_new_arrivals(s, d):
    return graph.new_arrivals(T.present(s, d))


@query
def net_degrees(s, d):
    return graph.degrees(N.succession_edges(s, d))


@query
def net_density(s, d):
    return rounded(graph.density(T.edges(s, d)), "density", digits=9)


@query
@T.each_once
def net_missing_nodes(s, d):
    return graph.missing_nodes(T.present(s, d))


@query
def net_succession_directed(s, d):
    return N.succession_edges(s, d)


@query
def net_last_snapshots(s, d):
    return N.last_snapshots(T.edges(s, d), 4)


@query
def group_sizes(s, d):
    return partition.group_sizes(T.labels(s, d))


@query
@T.each_once
def group_degrees(s, d):
    return partition.group_degrees(graph.degrees(T.edges(s, d)), T.labels(s, d))


@query
@T.each_once
def block_edge_counts(s, d):
    return partition.block_edge_counts(T.edges(s, d), T.labels(s, d))


@query
@T.each_once
def effective_beta(s, d):
    return rounded(partition.effective_beta(T.symmetric(s, d), T.labels(s, d)), "beta", digits=9)


@query
def effective_pi(s, d):
    return rounded(partition.effective_pi(T.labels(s, d)), "pi")


@query
def majority_label(s, d):
    return partition.majority_label(T.labels(s, d))


@query
@T.each_once
def induced_subgraph(s, d):
    return graph.induced_subgraph(T.edges(s, d), T.labels(s, d).where("q = 1"))


def _contingency(s, d):
    return partition.contingency(T.labels(s, d), T.other_labels(s, d))


@query
@T.each_once
def contingency(s, d):
    return _contingency(s, d)


@query
@T.each_once
def ari_by_time(s, d):
    return rounded(partition.ari_by_time(_contingency(s, d)), "ari")


@query
@T.each_once
def mutual_information(s, d):
    return rounded(partition.mutual_information(_contingency(s, d)).select("t", "mi"), "mi")


@query
@T.each_once
def nmi_by_time(s, d):
    return rounded(partition.mutual_information(_contingency(s, d)).select("t", "nmi"), "nmi")


@query
@T.each_once
def max_overlap(s, d):
    return rounded(partition.max_overlap(_contingency(s, d), Q), "overlap")


@query
def meta_bernoulli_topk(s, d):
    """Each part and year's three most frequent of thirty supplier classes."""
    items = N.table(s, d, "lineitem").select(F.col("l_partkey").alias("node"), (F.year("l_shipdate") - 1995).cast("int").alias("t"), (F.col("l_suppkey") % 30).cast("int").alias("l"))
    counts = items.groupBy("node", "t", "l").agg(F.count(F.lit(1)).cast("double").alias("v"))
    by = counts.groupBy("node", "t").agg(F.map_from_entries(F.collect_list(F.struct("l", "v"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return metadata.bernoulli_topk(by.select("node", "t", x.alias("x")), 3)


@query
def meta_categorical_top1(s, d):
    return metadata.categorical_top1(T.part_fields(s, d)["multinomial"])


@query
def meta_poisson_shift(s, d):
    return metadata.poisson_shift(T.part_fields(s, d)["poisson"]).select("node", "t", F.col("x")[0].alias("x"))


@query
def meta_multinomial_counts(s, d):
    scaled = T.part_fields(s, d)["multinomial"].select("node", "t", F.transform("x", lambda v: v * 0.37).alias("x"))
    return metadata.multinomial_counts(scaled).select("node", "t", *(F.col("x")[i].alias(f"x{i}") for i in range(3)))


@query
def meta_drop_null_dims(s, d):
    return metadata.drop_null_dims(T.part_fields(s, d)["indep bernoulli"])


@query
def meta_extract(s, d):
    parts = N.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.lit(0).alias("t"), "p_size", "p_retailprice")
    return N.extract_metadata(parts, {"size": ["p_size"], "price": ["p_retailprice"]}).select("s", "node", "t", F.col("x")[0].alias("v"))


def _loglik(dist: str) -> Query:
    def f(s, d):
        rows = T.part_fields(s, d)[dist]
        return rounded(metadata.score(rows, T.params(rows, dist), dist), "loglik")

    return f


def _mstep(dist: str) -> Query:
    def f(s, d):
        fields = T.part_fields(s, d)
        return rounded(metadata.estimate(fields[dist], fields["shares"], dist), "v")

    return f


for _name, _dist in _DISTS.items():
    QUERIES[f"loglik_{_name}"] = _loglik(_dist)
    QUERIES[f"mstep_{_name}"] = _mstep(_dist)


@query
def beta_noninformative_init(s, d):
    return rounded(long_blocks(T.beta(s, d), "b", "beta"), "beta", digits=9)


@query
@T.each_once
def beta_planted_init(s, d):
    """Counts from labels, mixed with the start that knows nothing."""
    counted = partition.effective_beta(T.symmetric(s, d), T.labels(s, d)).select("t", "q", "r", (F.col("beta") * 2).alias("own"))
    flat = long_blocks(T.beta(s, d), "b", "flat")
    return rounded(counted.join(flat, ["t", "q", "r"]).select("t", "q", "r", (0.6 * F.col("own") + 0.4 * F.col("flat")).alias("beta")), "beta", digits=9)


@query
@T.each_once
def lambda_planted_init(s, d):
    weighted = graph.prepare(T.edges(s, d), deg_corr=True)
    k = partition.group_degrees(graph.degrees(weighted), T.labels(s, d)).select("t", "q", F.col("k_out").alias("k"))
    pairs = k.join(k.select("t", F.col("q").alias("r"), F.col("k").alias("k_r")), "t")
    found = pairs.join(partition.block_edge_counts(weighted, T.labels(s, d)), ["t", "q", "r"], "left")
    return rounded(found.select("t", "q", "r", (F.coalesce("m", F.lit(0.0)) / (F.col("k") * F.col("k_r"))).alias("lam")), "lam", digits=9)


@query
def pi_planted_init(s, d):
    return rounded(partition.effective_pi(T.labels(s, d)).select("q", "r", (0.6 * F.col("pi") + 0.4 / Q).alias("pi")), "pi")


@query
@T.each_once
def bp_field_terms(s, d):
    f = X.cols("f", Q)
    return rounded(bp.field_terms(T.messages(s, d), T.beta(s, d), Q).select("t", "recv", "send", *f), *f, digits=9)


@query
def bp_field_terms_directed(s, d):
    """The succession network's weights as exponents; block probabilities lean from higher to lower groups."""
    f = X.cols("f", Q)
    pairs = graph.messages(N.succession_edges(s, d))
    labels = T.labelled(pairs.select(F.col("send").alias("node"), "t").distinct())
    beta = bp.blocks(s, {t: [[0.02 if r == k else 0.01 + 0.001 * (r - k) for k in range(Q)] for r in range(Q)] for t in range(5)})
    found = bp.field_terms(bp.planted_messages(pairs, labels, Q), beta, Q, directed=True)
    return rounded(found.select("t", "recv", "send", *f), *f, digits=12)


def _weighted(s, d) -> tuple[DataFrame, DataFrame]:
    """Messages and degrees of the network with averaged weights."""
    net = graph.prepare(T.edges(s, d), deg_corr=True)
    pairs = net.select("t", F.col("dst").alias("recv"), F.col("src").alias("send"), F.col("w").alias("w_fwd"), F.col("w").alias("w_rev"))
    return bp.planted_messages(pairs, T.labels(s, d), Q), graph.degrees(net)


@query
@T.each_once
def bp_field_terms_dc(s, d):
    f = X.cols("f", Q)
    messages, degs = _weighted(s, d)
    lam = bp.blocks(s, {t: simulate.block_matrix(Q, 0.02, 0.01) for t in range(10)})
    return rounded(bp.field_terms_dc(messages, degs, lam, Q).select("t", "recv", "send", *f), *f)


@query
@T.each_once
def bp_external_field(s, d):
    return rounded(bp.external_field(T.nodes(s, d), T.beta(s, d), Q), *X.cols("h", Q))


@query
def bp_temporal_terms(s, d):
    names = [*X.cols("lf", Q), *X.cols("lb", Q)]
    return rounded(bp.temporal_terms(T.nodes(s, d), PI, Q).select("node", "t", *names), *names)


def _swept(s, d) -> tuple[DataFrame, DataFrame]:
    fields = bp.field_terms(T.messages(s, d), T.beta(s, d), Q)
    return fields, bp.sweep_nodes(fields, T.nodes(s, d), T.beta(s, d), ALPHA, PI, Q)


@query
@T.each_once
def bp_node_marginals_1sweep(s, d):
    p = X.cols("p", Q)
    return rounded(_swept(s, d)[1].select("node", "t", *p), *p)


@query
@T.each_once
def bp_messages_1sweep(s, d):
    psi = X.cols("psi", Q)
    return rounded(bp.sweep_messages(*_swept(s, d), Q).select("t", "recv", "send", *psi), *psi)


@query
@T.each_once
def bp_temporal_messages_1sweep(s, d):
    names = [*X.cols("fwd", Q), *X.cols("bwd", Q)]
    return rounded(_swept(s, d)[1].where("bwd0 IS NOT NULL").select("node", "t", *names), *names)


def _edge_pairs(s, d) -> DataFrame:
    return bp.edge_pairs(T.messages(s, d), T.beta(s, d), Q)


@query
@T.each_once
def twopoint_edge_1sweep(s, d):
    sums = _edge_pairs(s, d).groupBy("t").agg(*(F.sum(f"e{r}{k}").alias(f"e{r}{k}") for r in range(Q) for k in range(Q)))
    return rounded(long_blocks(sums, "e", "v"), "v")


def _time_pairs(s, d) -> DataFrame:
    return bp.time_pairs(T.nodes(s, d), PI, Q)


@query
def twopoint_time_1sweep(s, d):
    sums = _time_pairs(s, d).agg(*(F.sum(f"g{r}{k}").alias(f"g{r}{k}") for r in range(Q) for k in range(Q)))
    return rounded(long_blocks(sums, "g", "v"), "v")


@query
def alpha_update(s, d):
    a = X.cols("a", Q)
    return rounded(bp.alpha_estimate(T.nodes(s, d), Q).select(*((_RATE * F.col(c) + (1 - _RATE) / Q).alias(c) for c in a)), *a)


@query
def pi_update(s, d):
    old = F.when(F.col("q") == F.col("r"), PI[0][0]).otherwise(PI[0][1])
    new = long_blocks(bp.pi_estimate(_time_pairs(s, d), Q), "pi", "pi")
    return rounded(new.withColumn("pi", _RATE * F.col("pi") + (1 - _RATE) * old), "pi")


@query
@T.each_once
def beta_update(s, d):
    return rounded(long_blocks(bp.beta_estimate(_edge_pairs(s, d), T.nodes(s, d), Q), "b", "beta"), "beta", digits=8)


@query
@T.each_once
def lambda_update(s, d):
    messages, degs = _weighted(s, d)
    pairs = bp.edge_pairs(messages, T.beta(s, d), Q)
    return rounded(long_blocks(bp.lambda_estimate(pairs, T.nodes(s, d), degs, Q), "b", "lam"), "lam", digits=8)


@query
@T.each_once
def free_energy(s, d):
    swept = _swept(s, d)[1]
    found = bp.free_energy(T.messages(s, d), T.nodes(s, d), swept, T.beta(s, d), PI, Q)
    return rounded(found, "edge", "time", "site", "pair", "energy")


@query
def map_labels(s, d):
    return bp.map_labels(T.nodes(s, d), Q)


@query
@T.each_once
def components_weak(s, d):
    """Of the first snapshot, as its SQL is; ``components_weak_all`` has every one."""
    return graph.weak_components(T.edges(s, d).where("t = 0"))


@query
@T.each_once
def components_weak_all(s, d):
    """Of every snapshot. No SQL: the recursive one lists a row for each node and smaller node that reaches it."""
    return graph.weak_components(T.edges(s, d))


@query
def profile_outer_join(s, d):
    """Of parts of the catalog by a rule on their ids, as its SQL is; ``profile_outer_join_sources`` is of two whole sources."""
    years = N.part_years(s, d)
    age = years.where("node % 3 <> 0").select("node", "t", F.col("n").alias("career_age"))
    return N.export_profiles(age, years.where("node % 2 = 0").select("node", "t", F.col("n_r").alias("region")))


@query
def profile_outer_join_sources(s, d):
    """Sales by the year of shipping, and the customers' regions by the year of the order: each has rows that the other hasn't."""
    age = N.part_years(s, d).select("node", "t", F.col("n").alias("career_age"))
    return N.export_profiles(age, N.order_regions(s, d).select("node", "t", F.col("n_regions").alias("region")))


@query
def topics_export(s, d):
    return N.export_topics(T.part_fields(s, d)["indep bernoulli"])


@query
@T.each_once
def greedy_edge_gain(s, d):
    return rounded(greedy.edge_gain(T.symmetric(s, d), T.labels(s, d), Q), "gain")


@query
def greedy_categorical_gain(s, d):
    field = N.part_years(s, d).select("node", "t", (F.col("node") % 5).cast("int").alias("l"))
    return rounded(greedy.categorical_gain(field, T.labelled(field.select("node", "t")), Q), "gain")


def _metadata_gain(dist: str) -> Query:
    def f(s, d):
        fields = T.part_fields(s, d)
        return rounded(greedy.metadata_gain(fields[dist], fields["shares"].select("node", "t", "q"), Q, dist), "gain")

    return f


for _name in ("poisson", "bernoulli", "multinomial"):
    QUERIES[f"greedy_{_name}_gain"] = _metadata_gain(_DISTS[_name])


# What follows has no oracle: inference, simulation and learning. Registered fits have all starts, steps and sweeps of Settings.
REGISTERED = Settings()


def _fit(s, d) -> em.Fit:
    model = em.TemporalBlockModel(T.edges(s, d), 3, settings=REGISTERED, arrays=True)
    return model.fit_best(list(model.starts()))


@query
@T.each_once
def em_fit_labels(s, d):
    return _fit(s, d).labels


@query
@T.each_once
def em_fit_block_probs(s, d):
    return s.createDataFrame([(t, q, r, v) for t, b in _fit(s, d).beta.items() for q, row in enumerate(b) for r, v in enumerate(row)], "t int, q int, r int, beta double")


@query
@T.each_once
def em_hierarchy(s, d):
    return em.hierarchy(T.edges(s, d), 2, 2, REGISTERED, arrays=True)


@query
def greedy_transition_gain(s, d):
    return rounded(greedy.transition_gain(T.labels(s, d), Q), "gain")


@query
def simulate_network(s, d):
    return simulate.network(s, 200, 4, 5, 10.0, 2.0, 0.8)[0]


@query
def kmeans_init(s, d):
    net = T.symmetric(s, d)
    return em.kmeans_labels(net, graph.presence(net), Q)
