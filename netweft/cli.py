"""python -m netweft.cli EDGES OUT: fits groups to an edge table (t, src, dst and a weight, parquet) and writes labels and parameters.

With --study, EDGES is left out: networks of known groups are made, fitted and scored.
"""
from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from netweft.config import Semantics, Settings, load_settings
from netweft.operators import em, metadata, simulate, study
from netweft.sources import network

# What an option sets where it is given; a file of settings comes first.
_SETTINGS = (
    "max_iter max_msg_iter conv_tol msg_conv_tol learning_rate patience planted_p n_runs at_once tuning fe_freq h_min_n max_cats init_width"
).split()
_FLAGS = ("auto_tune", "informative", "init_meta")
_SEMANTICS = ("literal_rescale", "mask_missing", "literal_floor", "keep_self_loops")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("edges", nargs="?")
    p.add_argument("out")
    p.add_argument("--study", choices=sorted(simulate.GRIDS), help="make and fit the networks of these settings")
    p.add_argument("--samples", type=int, help="of each setting of a study")
    p.add_argument("--numbers", type=int, nargs="*", help="of the settings of a study to run; else all")
    p.add_argument("--meta", nargs=2, action="append", default=[], metavar=("DISTRIBUTION", "PATH"), help="a metadata field: node, t and x")
    p.add_argument("--ignore-meta", action="store_true")
    p.add_argument("--config", help="a file of settings, name: value")
    p.add_argument("--groups", type=int, default=4)
    p.add_argument("--min-groups", type=int)
    p.add_argument("--max-groups", type=int)
    p.add_argument("--trials", type=int, help="numbers of groups to try, from the least to the largest")
    p.add_argument("--best-only", action="store_true", help="of the numbers of groups; else results of each are written")
    p.add_argument("--tunings", type=float, nargs="*", default=[], help="weights of metadata to choose from")
    p.add_argument("--weight", help="the column that edges are weighed by; else each counts 1")
    p.add_argument("--directed", action="store_true")
    p.add_argument("--deg-corr", action="store_true", help="correct for degrees; edges count by their weight")
    p.add_argument("--truth", help="labels (node, t, q), parquet: fits are chosen by their agreement with them")
    p.add_argument("--by-truth", action="store_true", help="studies: fits are chosen by their agreement with the groups")
    p.add_argument("--freeze", action="store_true", help="studies: the true parameters are given and kept")
    p.add_argument("--unfreeze-meta", action="store_true", help="metadata parameters are estimated though the others are kept")
    p.add_argument("--start", choices=["planted", "planted_meta", "uniform", "random"], default="planted")
    p.add_argument("--alpha-use-first", action="store_true", help="alpha is of rows where a node begins")
    p.add_argument("--levels", type=int, default=1, help="of the hierarchy; 1 is none")
    p.add_argument("--last", type=int, help="snapshots, the latest ones, to use")
    p.add_argument("--check-connected", action="store_true", help="write whether each snapshot is one component")
    defaults = Settings()
    for name in _SETTINGS:
        kind = int if name == "patience" else type(getattr(defaults, name))
        p.add_argument("--" + name.replace("_", "-"), type=kind, default=None)
    for name in (*_FLAGS, *_SEMANTICS):
        p.add_argument("--" + name.replace("_", "-"), action="store_true")
    return p


def settings_of(a: argparse.Namespace) -> Settings:
    from dataclasses import replace

    base = load_settings(a.config) if a.config else Settings()
    given = {n: getattr(a, n) for n in _SETTINGS if getattr(a, n) is not None} | {n: True for n in _FLAGS if getattr(a, n)}
    return replace(base, **given, **({"alpha_use_all": False} if a.alpha_use_first else {}))


def save_fit(spark: SparkSession, fit: em.Fit, out: str) -> None:
    """Labels, marginals, transitions, blocks and the run's history."""
    network.save(fit.labels, f"{out}/labels")
    network.save(fit.marginals, f"{out}/marginals")
    cells = lambda m: [(q, r, v) for q, row in enumerate(m) for r, v in enumerate(row)]
    network.save(spark.createDataFrame(cells(fit.pi), "q int, r int, v double"), f"{out}/transitions")
    network.save(spark.createDataFrame([(t, *x) for t, b in fit.beta.items() for x in cells(b)], "t int, q int, r int, v double"), f"{out}/blocks")
    rows = [(h["iteration"], float(h["moved"]), h["energy"], h["ari"]) for h in fit.history]
    network.save(spark.createDataFrame(rows, "iteration int, moved double, energy double, ari double"), f"{out}/history")


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("netweft").getOrCreate()
    settings, semantics = settings_of(a), Semantics(**{n: getattr(a, n) for n in _SEMANTICS})
    if a.study:
        grid = [x for x in simulate.GRIDS[a.study]() if a.numbers is None or x["number"] in a.numbers]
        scores, labels = study.run(
            spark, grid, a.samples, settings, not a.ignore_meta, a.directed, a.deg_corr, a.freeze, False if a.unfreeze_meta else None, a.start, a.by_truth, semantics
        )
        network.save_test_results(scores, labels, a.out)
        return
    if a.edges is None:
        raise SystemExit("an edge table or --study is needed")
    edges = network.load_edges(spark, a.edges, a.weight, semantics.keep_self_loops)
    fields = [] if a.ignore_meta else [(metadata.clean(network.load_metadata(spark, path), dist, settings.max_cats, semantics.literal_rescale), dist) for dist, path in a.meta]
    if a.last:
        if fields:
            raise SystemExit("--last numbers snapshots anew; cut the metadata's with the edges' first")
        edges = network.last_snapshots(edges, a.last)
    if a.check_connected:
        from netweft.operators import graph

        network.save(graph.is_connected(edges), f"{a.out}/connected")
    options = {"start": a.start, **({"truth": spark.read.parquet(a.truth)} if a.truth else {})}
    if a.levels > 1:
        if a.min_groups or a.max_groups or a.trials:
            raise SystemExit("a hierarchy does not search for the number of groups")
        found = em.hierarchy_fits(edges, a.groups, a.levels, fields, settings, a.directed, a.deg_corr, semantics, **options)
        network.save(found.labels, f"{a.out}/labels", "level")
        for level, fits in enumerate(found.levels):
            for parent, (_, fit) in fits.items():
                save_fit(spark, fit, f"{a.out}/fits/level={level}/parent={'all' if parent is None else parent}")
        return
    model = em.TemporalBlockModel(edges, a.groups, fields, settings, a.directed, a.deg_corr, semantics)
    qs = em.trial_groups(a.groups, a.min_groups, a.max_groups, a.trials)
    fits = em.fit_groups(model, qs, a.tunings, **options)
    save_fit(spark, em.best_fit(fits), a.out)
    if len(qs) > 1 and not a.best_only:
        for k, (q, fit) in enumerate(zip(qs, fits)):
            save_fit(spark, fit, f"{a.out}/trials/trial={k}/groups={q}")


if __name__ == "__main__":
    main()
