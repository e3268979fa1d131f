"""Recovery experiments: networks of known groups, fitted and scored."""
from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.config import Semantics, Settings
from netweft.operators import em, partition, simulate
from netweft.plans.scratch import stored


def true_parameters(spark: SparkSession, setting: dict, sample: int = 0) -> em.Params:
    """Those that a setting's networks are made with; metadata's hold where it is aligned."""
    q, times = setting["q"], range(setting["snapshots"])
    thetas = [
        spark.createDataFrame([(t, g, [float(x) for x in row]) for t in times for g, row in enumerate(params)], "t int, q int, theta array<double>")
        for _, params in simulate.field_parameters(setting, sample)
    ]
    return em.Params([1 / q] * q, simulate.transition_matrix(q, setting["p_stay"]), setting["beta"], thetas)


def run(
    spark: SparkSession, settings: Iterable[dict], samples: int | None = None, fit: Settings = Settings(), use_meta: bool = True, directed: bool = False, deg_corr: bool = False,
    freeze: bool = False, freeze_meta: bool | None = None, start: str = "planted", by_truth: bool = False, semantics: Semantics = Semantics(),
) -> tuple[DataFrame, DataFrame]:
    """(scores, labels) of each sample of each setting; they are small, so one comes after the other.

    scores(number, sample, t, ari, ari_highest, ari_start, overlap, init_seconds, fit_seconds): agreement of the best labels, of
    those at the highest energy and of the k-means start with the truth, by snapshot; overlap is of all snapshots together.
    freeze: the true parameters are given and kept; by_truth: fits are chosen by their score instead of their energy.
    """
    scores, kept = [], None
    for setting in settings:
        for sample in range(samples or setting["samples"]):
            began = time.monotonic()
            edges, truth, fields = simulate.sampled_network(spark, setting, sample, directed)
            truth, _ = stored(truth, "truth")
            model = em.TemporalBlockModel(edges, setting["q"], [(stored(m, "meta")[0], d) for m, d in fields] if use_meta else (), fit, directed, deg_corr, semantics)
            starts = list(model.starts())
            ready = time.monotonic()
            options = {"given": true_parameters(spark, setting, sample), "frozen": True, "frozen_meta": freeze_meta} if freeze else {}
            found = model.fit_best(starts, start=start, truth=truth if by_truth else None, **options)
            done = time.monotonic()
            tables = [partition.contingency(truth, x) for x in (found.labels, found.highest, starts[0])]
            ari, high, first = ({r["t"]: r["ari"] for r in partition.ari_by_time(x).collect()} for x in tables)
            overlap = partition.max_overlap(tables[0], setting["q"]).first()["overlap"]
            scores += [(setting["number"], sample, t, ari[t], high.get(t), first.get(t), overlap, ready - began, done - ready) for t in sorted(ari)]
            one = found.labels.select(F.lit(setting["number"]).alias("number"), F.lit(sample).alias("sample"), "node", "t", "q")
            kept = one if kept is None else kept.unionByName(one)
    if kept is None:
        kept = spark.createDataFrame([], "number int, sample int, node long, t int, q int")
    names = "number int, sample int, t int, ari double, ari_highest double, ari_start double, overlap double, init_seconds double, fit_seconds double"
    return spark.createDataFrame(scores, names), kept
