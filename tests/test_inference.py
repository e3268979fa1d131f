"""Trial numbers of groups, given and frozen parameters, scores, tuning, studies and the command line."""
from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from netweft import cli
from netweft.config import Semantics, Settings, load_settings
from netweft.operators import em, metadata, partition, simulate, study
from netweft.operators import propagation as bp

FEW = Settings(max_iter=2, max_msg_iter=3, n_runs=2, fe_freq=1)


@pytest.fixture(scope="module")
def net(spark):
    edges, truth = simulate.network(spark, 60, 2, 2, 14.0, 1.0, 0.95, seed=4)
    return edges.cache(), truth.cache()


@pytest.fixture(scope="module")
def model(net):
    return em.TemporalBlockModel(net[0], 2, settings=FEW)


@pytest.fixture(scope="module")
def start(model, net):
    return em.perturbed(model.present.join(net[1], ["node", "t"]), 2, 0.3, seed=1).cache()


def test_numbers_of_groups():
    assert em.trial_groups(4) == [4] and em.trial_groups(4, 2, 9, 4) == [2, 4, 6, 9] and em.trial_groups(4, 3, 3, 1) == [3]
    for bad in ((2, None, 3), (None, 5, 2), (5, 2, 2), (2, 5, 0), (1, 5, 2)):
        with pytest.raises(ValueError):
            em.trial_groups(4, *bad)
    assert em.split_groups(1000, 8, 20) == 8 and em.split_groups(100, 8, 20) == 5 and em.split_groups(25, 8, 20) == 2


def test_scores_choose_the_state(model, net, start):
    fit = model.fit(start, truth=net[1])
    assert fit.score == max(h["ari"] for h in fit.history) == pytest.approx(em.ari_score(net[1], fit.labels))
    assert fit.score > em.ari_score(net[1], start)
    worse = em.Fit(start, start, [], [], {}, fit.energy - 1, True, score=fit.score - 0.1)
    assert em.best_fit([worse, fit]) is fit and em.best_fit([em.Fit(start, start, [], [], {}, 1.0, True), em.Fit(start, start, [], [], {}, 0.5, True)]).energy == 0.5


def test_the_state_of_the_lowest_energy_stays(model, start):
    fit = model.fit(start, max_iter=3)
    energies = [h["energy"] for h in fit.history]
    assert fit.energy == min(energies) and fit.labels.count() == model.present.count() == fit.highest.count()
    again = model.fit(start, max_iter=energies.index(min(energies)) + 1) if energies.index(min(energies)) else None
    if again is not None:
        assert again.labels.exceptAll(fit.labels).isEmpty()


def test_given_parameters_stay_where_frozen(spark, net, start, monkeypatch):
    field = simulate.poisson_metadata(net[1], [2.0, 20.0])
    model = em.TemporalBlockModel(net[0], 2, [(field, "poisson")], FEW)
    theta = spark.createDataFrame([(t, g, [x]) for t in range(2) for g, x in enumerate((2.0, 20.0))], "t int, q int, theta array<double>")
    given = em.Params([0.5, 0.5], [[0.95, 0.05], [0.05, 0.95]], [[0.4, 0.03], [0.03, 0.4]], [theta])
    calls, estimate = [], metadata.estimate
    monkeypatch.setattr(metadata, "estimate", lambda *a: calls.append(1) or estimate(*a))
    fit = model.fit(start, given=given, frozen=True)
    assert (fit.alpha, fit.pi, fit.beta) == (given.alpha, given.pi, {0: given.beta, 1: given.beta}) and not calls
    assert em.ari_score(net[1], fit.labels) > 0.9 and len(fit.history) == 1
    loose = model.fit(start, given=given, frozen=True, frozen_meta=False)
    assert loose.pi == given.pi and (calls or len(loose.history) == 1)
    calls.clear()
    kept = model.fit(start, frozen_meta=True, max_iter=3)
    assert len(calls) == 1 and kept.pi != given.pi  # once, from the start


def test_starts_of_messages(spark, net, start):
    field = simulate.categorical_metadata(net[1], 2, 0.9)
    model = em.TemporalBlockModel(net[0], 2, [(field, "categorical")], FEW)
    for mode in ("uniform", "random", "planted_meta"):
        assert model.fit(start, start=mode, max_iter=1, max_msg_iter=1).labels.count() == model.present.count()
    shown = model._shown(start.withColumn("q", F.lit(0)))
    assert em.ari_score(net[1], shown) > 0.6
    for fields in ([(field, "multinomial")], [(field, "categorical")] * 2, []):
        with pytest.raises(ValueError):
            em.TemporalBlockModel(net[0], 2, fields, FEW).initial(start, start="planted_meta")
    with pytest.raises(ValueError):
        em.TemporalBlockModel(net[0], 2, [(simulate.categorical_metadata(net[1], 3, 0.1), "categorical")], FEW).initial(start, start="planted_meta")
    with pytest.raises(ValueError):
        em.TemporalBlockModel(net[0], 1)


def test_suggested_weight_of_metadata(spark):
    site = spark.createDataFrame([(0, 0, -1.0, -2.0), (1, 0, -3.0, -4.0)], "node long, t int, s0 double, s1 double")
    meta = lambda *rows: spark.createDataFrame(rows, "node long, t int, m0 double, m1 double")
    # All four cells are over twice as much; ratios are 0.1, 0.2, 0.1 and 0.4.
    assert bp.suggested_tuning(site, meta((0, 0, -10.0, -10.0), (1, 0, -30.0, -10.0)), 2, 1.0) == pytest.approx(0.2)
    assert bp.suggested_tuning(site, meta((0, 0, -1.0, -2.0), (1, 0, -3.0, -30.0)), 2, 1.0) is None  # one of four is no more than a quarter
    assert bp.suggested_tuning(site, meta((0, 0, -1e9, -1e9)), 2, 1.0) == 1e-4
    assert bp.suggested_tuning(site, meta(), 2, 1.0) is None


def test_tuning_and_floor_run(spark, net, start):
    field = simulate.poisson_metadata(net[1], [2.0, 200.0])
    model = em.TemporalBlockModel(net[0], 2, [(field, "poisson")], Settings(max_iter=1, max_msg_iter=1, auto_tune=True), semantics=Semantics(literal_floor=True, mask_missing=True))
    fit = model.fit(start)
    assert 1e-4 <= fit.tuning <= 50
    terms = spark.createDataFrame([(0.0, 0.5), (-1.0, 0.25)], "f0 double, f1 double")
    assert bp.smallest_positive(terms, 2) == 0.25 and bp.smallest_positive(terms.select("f0"), 1) is None


def test_informative_first_parameters(net, start):
    model = em.TemporalBlockModel(net[0], 2, settings=Settings(informative=True, planted_p=1.0))
    alpha, pi, beta = model._first(start, False)
    sizes = {r["q"]: r["n"] for r in start.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert alpha == pytest.approx([sizes[k] / sum(sizes.values()) for k in range(2)]) and all(sum(row) == pytest.approx(1) for row in pi)
    n = {r["q"]: r["n"] for r in partition.group_sizes(start).where("t = 0").collect()}
    m = {(r["q"], r["r"]): r["m"] for r in partition.block_edge_counts(model.edges, start).where("t = 0").collect()}
    assert all(beta[0][i][j] == pytest.approx(m[i, j] / n[i] / n[j]) for i in range(2) for j in range(2))


def test_kmeans_takes_metadata(spark, net, model):
    field = simulate.poisson_metadata(net[1].withColumn("q", (F.col("node") % 2).cast("int")), [0.0, 500.0])
    own = em.kmeans_labels(model.edges, model.present, 2, fields=[(field, "poisson")])
    want = model.present.withColumn("q", (F.col("node") % 2).cast("int"))
    assert em.ari_score(want, own) == pytest.approx(1.0)


def test_fits_for_several_numbers_of_groups(model, net, monkeypatch):
    fits = em.fit_groups(model, [2, 3], max_iter=1, max_msg_iter=2)
    assert [len(f.alpha) for f in fits] == [2, 3] and em.best_fit(fits).energy == min(f.energy for f in fits)
    n = iter(range(9))

    def interrupted(self, labels, **options):
        if next(n):
            raise KeyboardInterrupt
        return fits[0]

    monkeypatch.setattr(em.TemporalBlockModel, "fit", interrupted)
    model.settings = Settings(at_once=1)
    assert model.fit_best([net[1]] * 3) is fits[0]
    with pytest.raises(KeyboardInterrupt):
        model.fit_best([net[1]])
    model.settings = FEW


def test_hierarchy_with_metadata(spark, net):
    field = simulate.poisson_metadata(net[1], [2.0, 20.0])
    found = em.hierarchy_fits(net[0], 2, 2, [(field, "poisson")], Settings(max_iter=1, max_msg_iter=2, n_runs=1, h_min_n=10))
    rows = found.labels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["level"] for r in rows} == {0, 1} and len({r["n"] for r in rows}) == 1
    groups, matrix = found.transitions()
    split = set(found.levels[1])
    assert split and groups == sorted({g for ids, _ in found.levels[1].values() for g in ids} | ({0, 1} - split))
    assert len(matrix) == len(groups) and len(found.blocks(0)[1]) == len(groups)


def test_grids():
    grids = {k: f() for k, f in simulate.GRIDS.items()}
    assert {k: len(v) for k, v in grids.items()} == {"default": 8, "og": 30, "scaling": 20, "align": 40, "toy": 1000}
    assert [x["number"] for x in grids["og"]][::29] == [13, 42] and grids["og"][-1]["beta"] == [[0.3, 0.1], [0.1, 0.3]] and grids["og"][1]["snapshots"] == 10
    assert [(x["beta"][0][0], x["p_stay"]) for x in grids["default"][4:]] == [(0.1, 0.6), (0.06, 0.8), (0.1, 0.6), (0.06, 0.6)]
    assert (grids["scaling"][0]["n"], grids["scaling"][-1]["n"], grids["scaling"][-1]["q"]) == (148, 2980, 7)
    assert [x["aligned"] for x in grids["align"]][:4] == [0.1, 0.1, 0.2, 0.2] and grids["align"][20]["beta"][0] == [0.3, 0.1, 0.1, 0.1]
    toy = simulate.toy_grid(eps=[0.5], eta=[0.4], rho=[1.0])[0]
    assert (toy["beta"][0][0] + toy["beta"][0][1]) * toy["n"] / 2 == pytest.approx(10) and toy["p_stay"] == pytest.approx(0.7)
    assert simulate.toy_grid(eps=[0.5], eta=[0.4], rho=[1.0], literal=True)[0]["beta"][0][0] == pytest.approx(0.15)


def test_samples_of_settings(spark):
    setting = {**simulate.default_grid()[0], "n": 2000, "snapshots": 1, "beta": simulate.block_matrix(4, 0.002, 0.001)}
    _, labels, fields = simulate.sampled_network(spark, setting)
    means = {r["q"]: r["m"] for r in labels.join(fields[0][0], ["node", "t"]).groupBy("q").agg(F.avg(F.col("x")[0]).alias("m")).collect()}
    assert all(means[g] == pytest.approx(5 * (g + 1), rel=0.1) for g in range(4))
    flags = {r["q"]: r["m"] for r in labels.join(fields[1][0], ["node", "t"]).groupBy("q").agg(F.avg(F.col("x")[3]).alias("m")).collect()}
    assert all(flags[g] == pytest.approx(0.1 + 0.8 * g / 3, abs=0.08) for g in range(4))
    other = simulate.sampled_network(spark, {**setting, "aligned": False})[2][0][0]
    apart = {r["q"]: r["m"] for r in labels.join(other, ["node", "t"]).groupBy("q").agg(F.avg(F.col("x")[0]).alias("m")).collect()}
    assert max(apart.values()) - min(apart.values()) < 3
    toy = {**simulate.toy_grid(eps=[0.5], eta=[0.4], rho=[0.8])[0], "n": 3000, "snapshots": 1}
    _, labels, fields = simulate.sampled_network(spark, toy)
    assert labels.join(fields[0][0], ["node", "t"]).agg(F.avg(F.expr("x[q]"))).first()[0] == pytest.approx(0.8, abs=0.03)
    assert simulate.field_parameters(simulate.og_grid()[0], 1) != simulate.field_parameters(simulate.og_grid()[0], 2)


def test_cleaning_by_distribution(spark):
    rows = [(0, 0, [0.5, 2.0, 2.0]), (1, 0, [0.0, 0.0, None]), (2, 0, [3.0, 1.0, 2.0])]
    meta = spark.createDataFrame(rows, "node long, t int, x array<double>")
    got = lambda dist, **o: {r["node"]: r["x"] for r in metadata.clean(meta, dist, **o).collect()}
    assert got("categorical") == {0: [0.0, 0.0, 1.0], 2: [1.0, 0.0, 0.0]}
    top = {(r["node"], r["l"]) for r in metadata.categorical_top1(meta).collect()}
    assert {(n, x.index(1.0)) for n, x in got("categorical").items()} == top
    assert got("indep bernoulli", max_cats=2) == {0: [0.0, 1.0, 1.0], 1: [0.0, 0.0, None], 2: [1.0, 0.0, 1.0]}
    assert {(n, k) for n, x in got("indep bernoulli", max_cats=2).items() for k, v in enumerate(x) if v} == {(r["node"], r["l"]) for r in metadata.bernoulli_topk(meta, 2).collect()}
    with pytest.raises(ValueError):
        got("normal")


def test_settings_of_a_file(tmp_path):
    file = tmp_path / "settings"
    file.write_text("max_iter: 7 # steps\n\ntol: 1.0e-20\nuse_fastmath: True\nnon_informative_init: False\npatience: none\nauto_tune: true\n")
    assert load_settings(file) == Settings(max_iter=7, tol=1e-20, informative=True, auto_tune=True)
    file.write_text("max_itr: 7\n")
    with pytest.raises(ValueError):
        load_settings(file)


def test_command_line_fits_and_searches(spark, net, tmp_path):
    edges, truth = net
    at = lambda x: str(tmp_path / x)
    edges.write.parquet(at("edges"))
    truth.write.parquet(at("truth"))
    simulate.poisson_metadata(truth, [2.0, 20.0]).write.parquet(at("meta"))
    few = ["--max-iter", "1", "--max-msg-iter", "2", "--n-runs", "1"]
    cli.main([at("edges"), at("out"), "--meta", "poisson", at("meta"), "--min-groups", "2", "--max-groups", "3", "--trials", "2", "--truth", at("truth"), "--check-connected", *few])
    assert spark.read.parquet(at("out/labels")).count() == spark.read.parquet(at("out/marginals")).count() > 0
    assert (tmp_path / "out/trials/trial=1/groups=3/labels").exists()
    assert {r["connected"] for r in spark.read.parquet(at("out/connected")).collect()} <= {True, False}
    cli.main([at("edges"), at("levels"), "--groups", "2", "--levels", "2", *few])
    assert {r["level"] for r in spark.read.parquet(at("levels/labels")).select("level").distinct().collect()} == {0, 1}
    assert (tmp_path / "levels/fits/level=0/parent=all/transitions").exists()


def test_studies_score_every_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(simulate.GRIDS, "toy", lambda: simulate.toy_grid(60, 2, 2, 14.0, 1, eps=[0.1], eta=[0.8], rho=[0.9]))
    cli.main(["--study", "toy", "--freeze", "--max-msg-iter", "3", "--n-runs", "1", str(tmp_path / "toy")])
    scores = spark.read.parquet(str(tmp_path / "toy/scores")).collect()
    assert len(scores) == 2 and all(r["ari"] > 0.7 and r["fit_seconds"] > 0 for r in scores) and spark.read.parquet(str(tmp_path / "toy/labels")).count() > 100


def test_assignments_are_the_best_of_all():
    from itertools import permutations
    from random import Random

    for n in range(1, 7):
        for seed in range(20):
            draw = Random(100 * n + seed)
            gain = [[draw.choice([0, 0, 1, 5, draw.randrange(100)]) for _ in range(n)] for _ in range(n)]
            got = partition.assignment(gain)
            assert sorted(got) == list(range(n))
            assert sum(gain[r][c] for r, c in enumerate(got)) == max(sum(gain[r][c] for r, c in enumerate(p)) for p in permutations(range(n)))
    big = [[(r * 7 + c * 13) % 31 for c in range(30)] for r in range(30)]
    assert sorted(partition.assignment(big)) == list(range(30))


def test_missing_values_of_wide_tables(spark):
    from netweft.sources import network

    nan = float("nan")
    wide = spark.createDataFrame([(1, 0, 2.0, nan), (2, 0, nan, nan), (3, 0, None, 0.0)], "node long, t int, a double, b double")
    got = {(r["s"], r["node"]): r["x"] for r in network.extract_metadata(wide, {"first": ["a"], "both": ["a", "b"]}).collect()}
    assert got == {(0, 1): [2.0], (1, 1): [2.0, None], (1, 3): [None, 0.0]}
    flags = spark.createDataFrame([(0, 0, [0.5, 0.0, None, -2.0])], "node long, t int, x array<double>")
    assert metadata.bernoulli(flags).first()["x"] == [1.0, 0.0, None, 0.0]
    halves = spark.createDataFrame([(0, 0, [0.5, 1.5, 0.25]), (1, 0, [0.5, 0.5, 0.0])], "node long, t int, x array<double>")
    assert [r["x"] for r in metadata.multinomial_counts(halves).sort("node").collect()] == [[201.0, 1001.0, 1.0], [1.0, 1.0, 0.0]]
    assert [r["x"] for r in metadata.multinomial_counts(halves, True).sort("node").collect()] == [[1000.0, 1001.0, 1000.0], [1000.0, 1000.0, 0.0]]


@pytest.mark.parametrize("settings", [{}, {"alpha_use_all": False, "informative": True, "msg_conv_tol": 0.05}])
def test_arrays_give_the_fit_of_the_tables(spark, monkeypatch, settings):
    """Several blocks, a hub, snapshots that nodes miss, one before 0, a self-loop, large and negative ids."""
    from netweft.operators import packed

    big = 1 << 41
    rows = [(t, a, b) for t in (-1, 0, 1, 2, 4) for a in range(24) for b in range(a) if (a * b + a + 2 * t) % 5 == 0]
    rows += [(t, big, a) for t in (0, 1, 2) for a in range(24)] + [(1, -7, 3), (2, -7, big), (2, -7, 4), (1, 5, 5)]
    edges = spark.createDataFrame([(*x, 1.0) for x in rows], "t int, src long, dst long, w double")
    monkeypatch.setattr(packed, "FEW", 9)
    named, fits = [f"{x}{k}" for x in ("p", "fwd", "bwd", "w") for k in range(3)], []
    for arrays in (False, True):
        model = em.TemporalBlockModel(edges, 3, settings=Settings(max_iter=3, max_msg_iter=7, fe_freq=2, **settings), arrays=arrays)
        fits.append(model.fit(em.hashed_labels(model.present, 3)))
    want, got = fits
    assert got.energy == pytest.approx(want.energy, abs=1e-9) and got.converged == want.converged
    assert got.alpha == pytest.approx(want.alpha, abs=1e-9) and sum(got.pi, []) == pytest.approx(sum(want.pi, []), abs=1e-9)
    assert got.beta.keys() == want.beta.keys() and all(sum(got.beta[t], []) == pytest.approx(sum(want.beta[t], []), abs=1e-9) for t in want.beta)
    assert [h["moved"] for h in got.history] == pytest.approx([h["moved"] for h in want.history], abs=1e-9)
    a, b = ({(r["node"], r["t"]): [r[c] for c in named] for r in f.marginals.collect()} for f in (want, got))
    assert a.keys() == b.keys() and len(a) == model.present.count()
    assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)) for k in a for x, y in zip(a[k], b[k]))
    for name in ("labels", "highest"):
        assert {tuple(r) for r in getattr(want, name).collect()} == {tuple(r) for r in getattr(got, name).collect()}


def test_arrays_refuse_what_they_do_not_hold(spark, net):
    for wrong in ({"directed": True}, {"deg_corr": True}, {"fields": [(net[1], "poisson")]}, {"semantics": Semantics(literal_floor=True)}):
        with pytest.raises(ValueError):
            em.TemporalBlockModel(net[0], 2, arrays=True, **wrong)
    model = em.TemporalBlockModel(net[0], 2, arrays=True)
    for labels in (net[1].where("node > 5"), net[1].unionByName(spark.createDataFrame([(-1, 0, 1)], net[1].schema))):
        with pytest.raises(Exception, match="a label for every row"):
            model.fit(labels.select("node", "t", "q"), max_iter=1, max_msg_iter=1)


def test_registered_fits_keep_messages_as_arrays(spark, data, monkeypatch):
    from netweft.plans import catalog

    monkeypatch.setattr(catalog, "REGISTERED", Settings(n_runs=1, max_iter=1, max_msg_iter=2))
    monkeypatch.setattr(bp, "sweep_messages", None)
    rows = {name: catalog.QUERIES[name](spark, data).count() for name in ("em_fit_labels", "em_fit_block_probs", "em_hierarchy")}
    assert rows["em_fit_labels"] * 2 == rows["em_hierarchy"] > 0 and rows["em_fit_block_probs"] == 9 * 7


@pytest.mark.parametrize("query, fits", [("em_fit_block_probs", 5), ("em_fit_labels", 5), ("em_hierarchy", 15)])
def test_registered_fits_run_all_starts_steps_and_sweeps(spark, data, monkeypatch, query, fits):
    from netweft.plans import catalog

    seen = []

    def fit(self, labels, **options):
        seen.append((replace(self.settings, at_once=4), options))
        return em.Fit(labels, labels, [], [], {0: [[0.5]]}, float(len(seen)), True)

    monkeypatch.setattr(em.TemporalBlockModel, "fit", fit)
    assert catalog.QUERIES[query](spark, data).count() > 0
    assert len(seen) == fits and all(x == (Settings(), {}) for x in seen)


@pytest.mark.parametrize("options", [{}, {"frozen": True}, {"truth": True}])
def test_blocks_give_the_fit_of_one_block(spark, monkeypatch, options):
    from netweft.operators import packed

    rows = [(t, a, b) for t in (-1, 0, 1, 2, 4) for a in range(24) for b in range(a) if (a * b + a + 2 * t) % 5 == 0]
    edges = spark.createDataFrame([(*x, 1.0) for x in rows], "t int, src long, dst long, w double")
    model = em.TemporalBlockModel(edges, 3, settings=Settings(max_iter=4, max_msg_iter=4, fe_freq=3), arrays=True)
    labels, fits, blocks, init = em.hashed_labels(model.present, 3), [], [], packed.Packed.__init__
    options = {**options, "truth": labels} if "truth" in options else options
    monkeypatch.setattr(packed.Packed, "__init__", lambda self, *a: (init(self, *a), blocks.append(self.blocks))[0])
    monkeypatch.setattr(packed, "FEW", 150)
    for whole in (packed.WHOLE, 0):
        monkeypatch.setattr(packed, "WHOLE", whole)
        fits.append(model.fit(labels, **options))
    one, many = fits
    assert blocks[0] == 1 < blocks[1] and one.energy == pytest.approx(many.energy, abs=1e-9) and one.score == many.score
    assert one.alpha == pytest.approx(many.alpha, abs=1e-9) and all(sum(one.beta[t], []) == pytest.approx(sum(many.beta[t], []), abs=1e-9) for t in one.beta)
    near = lambda f: [(h["iteration"], h["moved"], h["energy"] or 0.0) for h in f.history]
    assert all(x == pytest.approx(y, abs=1e-9) for x, y in zip(near(one), near(many), strict=True))
    assert {tuple(r) for r in one.labels.collect()} == {tuple(r) for r in many.labels.collect()}
