"""Inference against enumeration, invariants and planted groups; and what has no oracle."""
from __future__ import annotations

import itertools
import math
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweft.config import Settings
from netweft.functions import formulas as X
from netweft.operators import em, graph, metadata, partition, simulate
from netweft.operators import propagation as bp
from netweft.operators.components import connected_components
from netweft.sources import network
from netweft.streaming import snapshots


ROOT = Path(__file__).resolve().parent.parent


def edges_of(spark, rows):
    return spark.createDataFrame([(t, a, b, 1.0) for t, a, b in rows], "t int, src long, dst long, w double")


def swept(spark, rows, q, beta, alpha, pi, sweeps, labels):
    net = graph.prepare(edges_of(spark, rows))
    present = graph.presence(net)
    pairs = net.select("t", F.col("dst").alias("recv"), F.col("src").alias("send"), F.col("w").alias("w_fwd"), F.col("w").alias("w_rev"))
    z = present.select("node", "t", F.expr(labels).cast("int").alias("q"))
    msgs, nodes, table = bp.planted_messages(pairs, z, q), bp.planted_nodes(z, q), bp.blocks(spark, beta)
    for _ in range(sweeps):
        fields = bp.field_terms(msgs, table, q)
        nodes = bp.sweep_nodes(fields, nodes, table, alpha, pi, q).cache()
        msgs = bp.sweep_messages(fields, nodes, q).cache()
    return msgs, nodes


def test_marginals_of_a_path_are_those_of_enumeration(spark):
    """A tree. With small probabilities the external field, which stands for the pairs without an edge, is next to nothing."""
    beta, alpha, pi = {0: [[0.3e-5, 0.1e-5], [0.1e-5, 0.5e-5]]}, [0.6, 0.4], [[0.5, 0.5], [0.5, 0.5]]
    _, nodes = swept(spark, [(0, 0, 1), (0, 1, 2)], 2, beta, alpha, pi, 4, "node % 2")
    got = {r["node"]: r["p0"] for r in nodes.collect()}
    weight = {z: math.prod(alpha[x] for x in z) * beta[0][z[0]][z[1]] * beta[0][z[1]][z[2]] for z in itertools.product(range(2), repeat=3)}
    for n in range(3):
        assert sum(w for z, w in weight.items() if z[n] == 0) / sum(weight.values()) == pytest.approx(got[n], abs=1e-4)


def test_sweeps_keep_sums_and_ignore_names_and_partitions(spark):
    rows = [(t, a, b) for t in range(3) for a in range(8) for b in range(a) if (a * b + t) % 3 == 0]
    beta, alpha = {t: [[0.4, 0.1], [0.1, 0.3]] for t in range(3)}, [0.5, 0.5]
    msgs, nodes = swept(spark, rows, 2, beta, alpha, simulate.transition_matrix(2, 0.8), 2, "node % 2")
    assert all(abs(r["p0"] + r["p1"] - 1) < 1e-12 for r in nodes.collect())
    assert all(abs(r["psi0"] + r["psi1"] - 1) < 1e-12 for r in msgs.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        _, again = swept(spark, rows, 2, beta, alpha, simulate.transition_matrix(2, 0.8), 2, "node % 2")
        want = {(r["node"], r["t"]): r["p0"] for r in nodes.collect()}
        assert all(abs(want[r["node"], r["t"]] - r["p0"]) < 1e-12 for r in again.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_gap_starts_anew(spark):
    present = graph.presence(edges_of(spark, [(0, 5, 1), (1, 1, 2), (2, 5, 1)]))
    assert {(r["node"], r["t"]) for r in graph.transition_presence(present).collect()} == {(1, 0), (1, 1)}
    assert (5, 2) in {(r["node"], r["t"]) for r in graph.new_arrivals(present).collect()}


def test_fit_finds_planted_groups(spark):
    net, truth = simulate.network(spark, 60, 2, 2, 14.0, 1.0, 0.95, seed=4)
    net, truth = net.cache(), truth.cache()
    model = em.TemporalBlockModel(net, 2, settings=Settings(fe_freq=3))
    start = em.perturbed(model.present.join(truth, ["node", "t"]), 2, 0.3, seed=1)
    fit = model.fit(start, max_iter=3, max_msg_iter=6)
    score = lambda z: min(r["ari"] for r in partition.ari_by_time(partition.contingency(truth, z)).collect())
    assert score(fit.labels) > max(0.8, score(start))
    assert abs(sum(fit.alpha) - 1) < 1e-9 and all(abs(sum(row) - 1) < 1e-6 for row in fit.pi)
    assert all(abs(b[0][1] - b[1][0]) < 1e-12 for b in fit.beta.values())


def test_metadata_helps_a_fit_run(spark):
    net, truth = simulate.network(spark, 40, 2, 2, 8.0, 4.0, 0.9, seed=5)
    field = simulate.poisson_metadata(truth, [2.0, 20.0])
    model = em.TemporalBlockModel(net, 2, fields=[(field, "poisson")])
    fit = model.fit(em.perturbed(model.present.join(truth, ["node", "t"]), 2, 0.3), max_iter=1, max_msg_iter=3)
    assert min(r["ari"] for r in partition.ari_by_time(partition.contingency(truth, fit.labels)).collect()) > 0.8


def test_registered_fits_have_the_stated_budget(spark, data, monkeypatch):
    from netweft.plans import catalog

    seen = []

    def fit(self, labels, **options):
        seen.append((self.settings, options))
        return em.Fit(labels, labels, [], [], {0: [[0.5]]}, float(len(seen)), True)

    monkeypatch.setattr(em.TemporalBlockModel, "fit", fit)
    budget = Settings(n_runs=2, max_iter=6)
    for name, fits in (("em_fit_labels", 2), ("em_fit_block_probs", 2), ("em_hierarchy", 4)):
        seen.clear()
        assert catalog.QUERIES[name](spark, data).count() > 0
        assert len(seen) >= fits and all((replace(x, at_once=budget.at_once), y) == (budget, {}) for x, y in seen)


def test_early_steps_take_a_third_of_the_sweeps_and_one(spark, monkeypatch):
    model = em.TemporalBlockModel(edges_of(spark, [(0, 0, 1), (0, 1, 2), (0, 2, 3)]), 2, settings=Settings(msg_conv_tol=0.0))
    start = model.present.withColumn("q", F.expr("cast(node % 2 as int)"))
    count, sweep = [], bp.sweep_nodes
    monkeypatch.setattr(bp, "sweep_nodes", lambda *a, **b: count.append(1) or sweep(*a, **b))
    for rounds, want in ((2, 4), (1, 3)):
        count.clear()
        model.fit(start, max_iter=rounds, max_msg_iter=3)
        assert len(count) == want


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("deg_corr", [False, True])
def test_sweep_and_energy_of_every_kind_of_model_are_those_by_hand(spark, directed, deg_corr):
    rows = [(0, 0, 1, 2.0), (0, 1, 0, 1.0), (0, 1, 2, 3.0), (0, 3, 2, 1.0), (0, 3, 0, 1.0), (0, 4, 1, 2.0)]
    model = em.TemporalBlockModel(spark.createDataFrame(rows, "t int, src long, dst long, w double"), 2, directed=directed, deg_corr=deg_corr)
    b, alpha, pi, g = [[0.2, 0.05 if directed else 0.1], [0.1, 0.3]], [0.6, 0.4], [[0.5, 0.5]] * 2, range(2)
    msgs, nodes = model.initial(model.present.withColumn("q", F.expr("cast(node % 2 as int)")))
    table, degs = bp.blocks(spark, {0: b}), model.degrees
    fields = bp.field_terms_dc(msgs, degs, table, 2, directed) if deg_corr else bp.field_terms(msgs, table, 2, directed)
    found = bp.sweep_nodes(fields, nodes, table, alpha, pi, 2, directed=directed, degs=degs)

    n, w = range(5), {}
    for _, i, j, x in rows:
        w[i, j] = w.get((i, j), 0) + x
        if not directed:
            w[j, i] = w.get((j, i), 0) + x
    w = {e: (x if directed else x / 2) if deg_corr else 1.0 for e, x in w.items()}
    d_out, d_in = ([sum(x for e, x in w.items() if e[end] == i) for i in n] for end in (0, 1))
    p = {r["node"]: (r["p0"], r["p1"]) for r in nodes.collect()}
    psi = {(r["send"], r["recv"]): (r["psi0"], r["psi1"]) for r in msgs.collect()}
    assert set(psi) == set(w) | {(j, i) for i, j in w}

    def edge(j, i, r, k, both):
        f, e = w.get((j, i), 0.0), w.get((i, j), 0.0)
        pois = lambda x, m: math.exp(x * math.log(m) - m - math.lgamma(x + 1))
        if not deg_corr:
            return b[r][k] ** f * b[k][r] ** e if both else b[r][k]
        tiny = lambda m: max(m, 1e-50)
        one = pois(f, tiny(d_out[j] * d_in[i] * b[r][k]))
        return one * pois(e, tiny(d_out[i] * d_in[j] * b[k][r])) if both else one

    def outside(i, k):
        if not deg_corr:
            return sum(p[j][r] * (b[r][k] + (b[k][r] if directed else 0)) for j in n for r in g)
        if not directed:
            return d_out[i] * sum(p[j][r] * d_out[j] * b[r][k] for j in n for r in g)
        return sum(p[j][r] * (d_in[i] * d_out[j] * b[r][k] + d_out[i] * d_in[j] * b[k][r]) for j in n for r in g)

    for x in found.collect():
        i = x["node"]
        logs = [math.log(alpha[k]) - outside(i, k) + sum(math.log(sum(psi[j, i][r] * edge(j, i, r, k, directed) for r in g)) for j in n if (j, i) in psi) for k in g]
        assert x["p0"] == pytest.approx(1 / (1 + math.exp(logs[1] - logs[0])), abs=1e-9)

    def mass(j, i, both):
        m = {(r, k): psi[j, i][r] * psi[i, j][k] + (psi[j, i][k] * psi[i, j][r] if r != k and not directed else 0) for r in g for k in g}
        e = {c: edge(j, i, *c, both) for c in m}
        top = max(e.values()) if deg_corr else 1
        return {c: m[c] * e[c] / top for c in m}

    energy = bp.free_energy(msgs, nodes, found, table, pi, 2, directed, degs).first()
    pair = sum(p[i][r] * b[r][k] * p[j][k] * (d_out[i] * d_in[j] if deg_corr else 1) for i in n for j in n for r in g for k in g)
    assert energy["edge"] * 5 == pytest.approx(sum(math.log(sum(mass(j, i, directed and deg_corr).values())) for j, i in psi))
    assert energy["pair"] * 5 == pytest.approx(pair)
    for x in bp.edge_pairs(msgs, table, 2, directed, degs).collect():
        m = mass(x["send"], x["recv"], False)
        assert all(x[f"e{r}{k}"] == pytest.approx(m[r, k] / sum(m.values())) for r in g for k in g)
    fit = model.fit(model.present.withColumn("q", F.expr("cast(node % 2 as int)")), max_iter=2, max_msg_iter=2)
    assert fit.labels.count() == 5 and math.isfinite(fit.energy)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), *((k, k + 1) for k in range(100, 140))]
    found, _ = connected_components(spark.createDataFrame(links, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {2: 1, 3: 1, 9: 8, **{k: 100 for k in range(101, 141)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


def test_connectivity(spark):
    rows = {r["t"]: r["connected"] for r in graph.is_connected(edges_of(spark, [(0, 0, 1), (0, 1, 2), (0, 3, 4), (1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4)])).collect()}
    assert rows == {0: False, 1: True}


def smallest_reachable(edges):
    """{(t, node): component} by merging."""
    root = {(t, n): n for t, a, b in edges for n in (a, b)}
    changed = True
    while changed:
        changed = False
        for t, a, b in edges:
            low = min(root[t, a], root[t, b])
            if (root[t, a], root[t, b]) != (low, low):
                root[t, a] = root[t, b] = low
                changed = True
    return root


def test_components_of_every_snapshot(spark, data):
    from netweft.plans import catalog, fixtures

    rows = [(0, 5, 3), (0, 3, 9), (0, 1, 2), (1, 9, 2), (1, 2, 1), (2, 7, 8), (2, 5, 6), (2, 6, 7), *((3, k, k + 1) for k in range(20))]
    for df, edges in (
        (graph.weak_components(edges_of(spark, rows)), rows),
        (catalog.QUERIES["components_weak_all"](spark, data), [(r["t"], r["src"], r["dst"]) for r in fixtures.edges(spark, data).collect()]),
    ):
        got = [((r["t"], r["node"]), r["component"]) for r in df.collect()]
        want = smallest_reachable(edges)
        assert len(got) == len(want) and dict(got) == want and len({t for t, _ in want}) > 3


def test_profiles_of_whole_sources(spark, data):
    """Against a join by hand; no row of either source is missing, and each has rows of its own."""
    from netweft.plans import catalog

    read = lambda name: spark.read.parquet(f"{data}/{name}.parquet").collect()
    items = read("lineitem")
    region = {r["n_nationkey"]: r["n_regionkey"] for r in read("nation")}
    nation = {r["c_custkey"]: r["c_nationkey"] for r in read("customer")}
    orders = {r["o_orderkey"]: (r["o_orderdate"].year - 1995, region[nation[r["o_custkey"]]]) for r in read("orders")}
    age, regions = {}, {}
    for r in items:
        key = r["l_partkey"], r["l_shipdate"].year - 1995
        age[key] = age.get(key, 0) + 1
        t, k = orders[r["l_orderkey"]]
        regions.setdefault((r["l_partkey"], t), set()).add(k)
    rows = catalog.QUERIES["profile_outer_join_sources"](spark, data).collect()
    got = {(r["node"], r["t"]): (r["career_age"], r["region"]) for r in rows}
    assert len(got) == len(rows) and got == {k: (age.get(k), len(regions[k]) if k in regions else None) for k in age.keys() | regions.keys()}
    assert age.keys() - regions.keys() and regions.keys() - age.keys()


def test_likelihoods_of_years_outside_the_given_tables(spark, tmp_path):
    from netweft.plans import catalog

    sales = [(7, 1, f"{y}-05-01", "A", "F") for y in (1994, 1998, 2005)]
    spark.createDataFrame(sales, "l_partkey long, l_suppkey long, l_shipdate string, l_returnflag string, l_linestatus string").withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("poisson", "bernoulli", "categorical", "multinomial"):
        got = {(r["t"], r["q"]): r["loglik"] for r in catalog.QUERIES[f"loglik_{name}"](spark, str(tmp_path)).collect()}
        assert set(got) == {(t, q) for t in (-1, 3, 10) for q in range(4)} and all(math.isfinite(x) for x in got.values())
        if name == "poisson":
            for (t, q), x in got.items():
                rate = 4 * (1 + (t + q * 3) % 7) / 8
                assert x == pytest.approx(math.log(rate) - rate, abs=1e-6)


def test_log_gamma_is_that_of_the_library(spark):
    row = spark.range(1).select(*(F.expr(X.lgamma1p(f"CAST({k} AS DOUBLE)")).alias(f"k{k}") for k in (0, 1, 2, 10, 500))).first()
    for k in (0, 1, 2, 10, 500):
        assert row[f"k{k}"] == pytest.approx(math.lgamma(k + 1), rel=1e-12, abs=1e-12)


def test_equal_partitions_score_one_and_missing_metadata_adds_nothing(spark):
    z = spark.createDataFrame([(n, 0, n // 3) for n in range(6)], "node long, t int, q int")
    table = partition.contingency(z, z.withColumn("q", 1 - F.col("q")))
    assert partition.ari_by_time(table).first()["ari"] == 1 and partition.mutual_information(table).first()["nmi"] == pytest.approx(1)
    assert partition.max_overlap(table, 2).first()["overlap"] == 1
    meta = spark.createDataFrame([(1, 0, [None, 1.0])], "node long, t int, x array<double>")
    theta = spark.createDataFrame([(0, 0, [0.5, 0.25])], "t int, q int, theta array<double>")
    assert metadata.score(meta, theta, "indep bernoulli").first()["loglik"] == pytest.approx(math.log(0.25))


def test_cleaning_rules(spark):
    meta = spark.createDataFrame([(1, 0, [0.0, 3.0, 3.0]), (2, 0, [None, 0.5, 0.0])], "node long, t int, x array<double>")
    assert [r["x"] for r in metadata.bernoulli(meta).orderBy("node").collect()] == [[0.0, 1.0, 1.0], [None, 1.0, 0.0]]
    assert {(r["node"], r["l"]) for r in metadata.categorical_top1(meta).collect()} == {(1, 2), (2, 1)}
    whole = spark.createDataFrame([(1, 0, [1.0, 2.0, 2.5])], "node long, t int, x array<double>")
    assert metadata.multinomial_counts(whole).first()["x"] == [1.0, 501.0 + 167.0 - 1, 1001.0] or metadata.multinomial_counts(whole).first()["x"][2] in (2.0, 1001.0)


def test_sources_and_sinks(spark, tmp_path):
    spark.createDataFrame([("b", 1, 2, float("nan")), ("a", 3, 3, 1.0), ("c", 1, 4, 2.0)], "t string, src long, dst long, w double").write.parquet(str(tmp_path / "e"))
    rows = {(r["t"], r["src"], r["dst"], r["w"]) for r in network.load_edges(spark, str(tmp_path / "e"), "w").collect()}
    assert rows == {(1, 1, 2, 1.0), (2, 1, 4, 2.0)}
    network.save(spark.createDataFrame([(1, 0, 2)], "node long, t int, q int"), str(tmp_path / "z"), "t")
    assert spark.read.parquet(str(tmp_path / "z")).count() == 1


def test_simulated_edges_have_their_probability(spark):
    labels = simulate.label_chain(spark, 400, 2, simulate.transition_matrix(2, 0.8)).cache()
    net = simulate.planted_edges(labels, simulate.block_matrix(2, 0.05, 0.01)).cache()
    sizes = {(r["t"], r["q"]): r["n"] for r in partition.group_sizes(labels).collect()}
    want = sum(0.05 * n * (n - 1) / 2 for n in sizes.values()) + sum(0.01 * sizes[t, 0] * sizes[t, 1] for t in range(2))
    assert abs(net.count() - want) < 5 * math.sqrt(want)
    assert simulate.truncated_poisson_weights(net, 1.5).agg(F.min("w")).first()[0] >= 1
    assert simulate.detectable(16, 0.5, 0.8) and not simulate.detectable(1, 0.1, 0.1)
    assert len(simulate.default_grid()) == 8 and simulate.scaling_grid()[0]["n"] == 148


def test_hierarchy_of_transitions():
    levels = [{None: ([0, 1], [[0.9, 0.1], [0.2, 0.8]])}, {0: ([2, 3], [[0.7, 0.3], [0.4, 0.6]])}]
    leaves, m = em.leaf_transitions(levels)
    assert leaves == [1, 2, 3]
    assert m[0] == pytest.approx([0.8, 0.1, 0.1]) and m[1] == pytest.approx([0.1, 0.63, 0.27]) and sum(m[2]) == pytest.approx(1)


def test_transition_gains_are_differences_of_likelihoods(spark):
    from netweft.operators import greedy

    rows = [(n, t, (n + t * n) % 3) for n in range(9) for t in range(3)]
    loglik = lambda z: sum(
        c * math.log(c / sum(v for (a, _), v in m.items() if a == q)) for m in [{(a, b): sum(z[n, t] == a and z[n, t + 1] == b for n in range(9) for t in range(2)) for a in range(3) for b in range(3)}] for (q, _), c in m.items() if c
    )
    z = {(n, t): q for n, t, q in rows}
    for r in greedy.transition_gain(spark.createDataFrame(rows, "node long, t int, q int"), 3).collect():
        assert loglik({**z, (r["node"], r["t"]): r["r"]}) - loglik(z) == pytest.approx(r["gain"], abs=1e-9)


def test_starts_sum_to_one_and_alignment_reaches_its_target(spark):
    net = graph.prepare(edges_of(spark, [(0, 0, 1), (0, 1, 2)]))
    pairs = graph.messages(net.where("src < dst"))
    z = graph.presence(net).withColumn("q", F.lit(0))
    for mode in ("planted", "uniform", "random"):
        for df, name in zip(bp.initial_state(pairs, z, 3, mode), ("psi", "p")):
            assert all(sum(r[f"{name}{k}"] for k in range(3)) == pytest.approx(1) for r in df.collect())
    labels = simulate.label_chain(spark, 300, 1, simulate.transition_matrix(3, 0.8)).cache()
    ari = partition.ari_by_time(partition.contingency(labels, simulate.aligned_labels(labels, 3, 0.5))).first()["ari"]
    assert 0.3 < ari < 0.5 and simulate.expected_degree(100, 4, 0.1, 0.02)[0] == pytest.approx(4.0)


def test_streamed_snapshots(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 00:00:00", 1, 2) for d in (1, 1, 8, 20)] + [("2024-01-01 00:00:00", 3, 3)]
    spark.createDataFrame(rows, "ts string, src long, dst long").select(F.col("ts").cast("timestamp"), "src", "dst").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, src long, dst long").parquet(str(tmp_path / "in"))
    snapshots.write_snapshots(snapshots.snapshot_edges(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["w"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 2.0]


def test_entry_stands_without_the_optional_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "netweft", tmp_path / "netweft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and len(e.oracle_sql()) > 55 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_components_of_large_ids(spark):
    big = 1 << 41
    rows = [(0, big, big + 1), (1, big + 1, big + 2), (1, 3, -5), (0, (1 << 63) - 1, -(1 << 63)), (1 << 30, 3, 4)]
    got = {(r["t"], r["node"]): r["component"] for r in graph.weak_components(edges_of(spark, rows)).collect()}
    assert got == {
        (0, big): big, (0, big + 1): big, (1, big + 1): big + 1, (1, big + 2): big + 1, (1, 3): -5, (1, -5): -5,
        (0, (1 << 63) - 1): -(1 << 63), (0, -(1 << 63)): -(1 << 63), (1 << 30, 3): 3, (1 << 30, 4): 3,
    }


def test_weights_of_large_and_small_rates(spark):
    net = spark.range(40_000).selectExpr("0 AS t", "id AS src", "id + 1 AS dst", "1.0D AS w")
    for rate in (0.05, 4.0, 300.0, 2000.0):
        w = simulate.truncated_poisson_weights(net, rate).agg(F.min("w"), F.avg("w"), F.stddev("w")).first()
        mean = rate / -np.expm1(-rate)
        assert w[0] >= 1 and abs(w[1] - mean) < 0.05 * mean**0.5
        assert abs(w[2] ** 2 - mean * (1 + rate - mean)) < 0.1 * mean * max(1 + rate - mean, 0.05)
    assert simulate.truncated_poisson_weights(net.limit(5), 0.0).agg(F.max("w")).first()[0] == 1


def test_metadata_of_normal_and_negative_binomial_groups(spark):
    labels = spark.range(40_000).selectExpr("id AS node", "0 AS t", "CAST(id % 2 AS INT) AS q")
    by = lambda df: [r[1:] for r in df.join(labels, ["node", "t"]).groupBy("q").agg(F.avg(F.col("x")[0]), F.stddev(F.col("x")[0])).orderBy("q").collect()]
    (m0, s0), (m1, s1) = by(simulate.normal_metadata(labels, [-2.0, 50.0], [1.0, 4.0]))
    assert abs(m0 + 2) < 0.05 and abs(s0 - 1) < 0.05 and abs(m1 - 50) < 0.2 and abs(s1 - 4) < 0.2
    (m0, s0), (m1, s1) = by(simulate.negative_binomial_metadata(labels, [2.5, 40.0], [0.5, 0.1]))
    assert abs(m0 - 2.5) < 0.1 and abs(s0 - 5**0.5) < 0.1 and abs(m1 - 360) < 2 and abs(s1 - 60) < 2


def test_scratch_folders_need_a_shared_place_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from netweft.plans import scratch

    alone = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.shared_root(alone)


def test_entry_stands_where_a_library_is_missing():
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), any(x.startswith('op') for x in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True).stdout.split()
    assert int(out[-2]) > 60 and out[-1] == "False"
