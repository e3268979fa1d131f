"""Document quality from weak labels.

Several heuristic labellers vote good, bad or nothing on each document. Expectation
maximisation over the counts of all documents' vote patterns, of which there
are at most 3 to the power of the number of labellers, estimates how each
labeller votes on good and on bad documents, and with that how probable it is
for each pattern that its documents are good. A linear scorer on hashed shape
n-grams is then fitted to those probabilities on a bounded sample (``sample``
documents, those with the smallest hash of their id) and scores every document.

Two passes over the texts: votes, and scores. The first is shuffled as counts
of patterns only. A null or empty text gets no votes and is not kept. Repeated
rows have one result each; other columns are ignored. An empty table: no rows.
A very long text is read whole; its features are shares, so length alone says
nothing. A quality that equals the threshold keeps the document.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm.batches import bounded, keyed_texts, pieces, sampled

#: Heuristics that vote.
LABELLERS = 9
#: Documents that the scorer is fitted to; dimensions of the scorer.
SAMPLE, DIMENSIONS = 3_000, 4_096

# Frequent words of the languages in the corpus.
STOP_WORDS = frozenset(
    "a and are as at be by for from in is it of on that the this to was with "
    "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "al con de del el en es la las los no para por que se su un una y "
    "au dans de des du elle en et il la le les par pas pour que qui sur un une".split()
)
# Signs that plain prose seldom has.
SIGNS = "#$%&*<=>@[\\]^_`{|}~"

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")


def _votes(text: str) -> list[int]:
    """1 good, -1 bad, 0 nothing; by measures of which each sees several sorts of bad text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * LABELLERS
    between = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    raw = text.encode()
    signs = len(raw) - len(raw.translate(None, SIGNS.encode()))
    letters = max(1, len(_LETTER.findall(text)))
    counts = Counter(words)
    stops = sum(counts[x] for x in counts.keys() & STOP_WORDS)
    marks = sum(v for w, v in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'" or not w[0].isalnum() and len(w) == 1)
    lines = [x for x in text.split("\n") if x]
    return [
        between(signs / len(raw), 0.01, 0.05),
        between(len(_UPPER.findall(text)) / letters, 0.15, 0.4) if n >= 5 else 0,
        between(-stops / n, -0.1, -0.03) if n >= 10 else 0,
        between(counts.most_common(1)[0][1] / n, 0.15, 0.3) if n >= 10 else 0,
        between(marks / n, 0.05, 0.3),
        between(-len(counts) / n, -0.4, -0.2) if n >= 30 else 0,
        between(sum(map(str.__eq__, words, words[1:])) / n, 0.1, 0.3) if n >= 10 else 0,
        between(-len(set(zip(words, words[1:]))) / n, -0.6, -0.35) if n >= 10 else 0,
        between(1 - len(set(lines)) / len(lines), 0.2, 0.5) if len(lines) >= 3 else 0,
    ]


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        votes = ["".join("-0+"[v + 1] for v in _votes(x)) for x in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(votes)], ["key", "votes"])


class WeakLabels:
    """Two classes, and labellers whose votes are independent within a class; that one doesn't vote says nothing."""

    def __init__(self, patterns: dict[str, int], rounds: int = 200, tolerance: float = 1e-9):
        self.good = 0.8
        votes = [p for p in patterns if p.strip("0")]
        m = len(votes[0]) if votes else 0
        self.given = np.ones((2, m, 3))  # class, labeller, vote; 1 where it doesn't vote
        if not votes:
            return
        seen = np.array([["-0+".index(x) for x in p] for p in votes])
        n = np.array([patterns[p] for p in votes], float)
        one = np.eye(3)[seen]
        # To begin with, a document is bad if any labeller says so and no more than twice as many say good.
        bad, good = (seen == 0).sum(1), (seen == 2).sum(1)
        post = np.where(bad * 3 >= good, np.where(bad > 0, 0.1, 0.5), 0.9)
        for _ in range(rounds):
            self.good = float(np.clip((n * post).sum() / n.sum(), 1e-3, 1 - 1e-3))
            for c, w in enumerate((n * (1 - post), n * post)):
                cast = np.einsum("p,pmv->mv", w, one)[:, ::2] + 1
                self.given[c][:, ::2] = cast / cast.sum(axis=1, keepdims=True)
            before, post = post, self._posterior(one)
            if np.abs(before - post).max() < tolerance:
                break

    def _posterior(self, one: np.ndarray) -> np.ndarray:
        logs = np.einsum("pmv,cmv->pc", one, np.log(self.given)) + np.log([1 - self.good, self.good])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))

    def probability(self, votes: str) -> float:
        """That a document with these votes is good; the share of good documents where no one votes."""
        if not votes.strip("0") or not self.given.shape[1]:
            return self.good
        return float(self._posterior(np.eye(3)[[["-0+".index(x) for x in votes]]])[0])

    def accuracies(self) -> list[float]:
        """Of each labeller: how probable it is that a vote of its is right."""
        return (self.good * self.given[1, :, 2] + (1 - self.good) * self.given[0, :, 0]).tolist()


def _classes() -> bytes:
    """A byte's class: letters by case, digits, line ends, blanks, and each sign by itself."""
    own = {ord(x): 6 + i for i, x in enumerate("!\"#$%&'()*+,-./:;<=>?@|~")}
    return bytes(
        5 if x == 10 else 4 if x <= 32 else 3 if x >= 128 else own.get(x) or (0 if chr(x).islower() else 1 if chr(x).isupper() else 2 if chr(x).isdigit() else 31)
        for x in range(256)
    )


_CLASS = _classes()
_BUCKET = ((np.arange(1 << 15, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % (DIMENSIONS - 64)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed shape n-grams, and of bins of word repetition; length 1 each."""
    shape = np.frombuffer(text.encode().translate(_CLASS), np.uint8).astype(np.int64)
    out = np.zeros(DIMENSIONS, np.float32)
    if len(shape) >= 3:
        grams = (shape[:-2] << 10) | (shape[1:-1] << 5) | shape[2:]
        counts = np.bincount(_BUCKET[grams], minlength=DIMENSIONS - 64)
        out[: DIMENSIONS - 64] = np.sqrt(counts / len(grams))
    words = text.split()
    n = len(words)
    if n >= 10:
        counts = Counter(words)
        stops = sum(counts[x] for x in counts.keys() & STOP_WORDS)
        for k, x in enumerate((len(counts) / n, counts.most_common(1)[0][1] / n, stops / n, sum(map(str.__eq__, words, words[1:])) / n)):
            out[DIMENSIONS - 64 + 16 * k + min(15, int(x * 16))] = 0.5
    return out


def fit_scorer(rows: np.ndarray, wanted: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression to probabilities by gradient steps that adapt to each weight; deterministic."""
    weights, bias = np.zeros(rows.shape[1], np.float32), 0.0
    if not len(rows):
        return weights, bias
    past, past_bias = np.full(rows.shape[1], 1e-6, np.float32), 1e-6
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(rows @ weights + bias, -30, 30))) - wanted
        step = (error.astype(np.float32) @ rows) / len(rows) + np.float32(decay) * weights
        past += step * step
        weights -= np.float32(rate) * step / np.sqrt(past)
        past_bias += error.mean() ** 2
        bias -= rate * error.mean() / np.sqrt(past_bias)
    return weights, float(bias)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        texts = part.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["".join("-0+"[v + 1] for v in _votes(x)) for x in texts]),
                pa.array([features(x).astype(np.float16).tobytes() for x in texts], pa.binary()),
            ],
            ["votes", "row"],
        )


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[WeakLabels, np.ndarray, float]:
    """(labels' model, weights, bias) of a corpus."""
    rows = keyed_texts(docs, key, text).where("text <> ''")
    patterns = rows.mapInArrow(_voted, "key long, votes string").groupBy("votes").count().collect()
    model = WeakLabels({r["votes"]: r["count"] for r in sorted(patterns)})
    taken = sampled(rows, sample).mapInArrow(_featured, "votes string, row binary").collect()
    x = np.stack([np.frombuffer(r["row"], np.float16) for r in taken]).astype(np.float32) if taken else np.empty((0, DIMENSIONS), np.float32)
    return model, *fit_scorer(x, np.array([model.probability(r["votes"]) for r in taken]))


def _quality(text: str, weights: np.ndarray, bias: float) -> float:
    return 1 / (1 + float(np.exp(-np.clip(float(features(text) @ weights) + bias, -30, 30)))) if text.strip() else 0.0


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(key, quality, kept), a row for each row of ``docs``: the scorer's probability that it is good, and whether that reaches ``threshold``."""
    _, weights, bias = fit(docs, key, text, sample)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            scores = [_quality(x, weights, bias) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(scores, pa.float64())], ["key", "quality"])

    return (
        keyed_texts(docs, key, text)
        .mapInArrow(mapped, "key long, quality double")
        .select(F.col("key").alias(key), F.round("quality", 6).alias("quality"), (F.col("quality") >= threshold).alias("kept"))
    )


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify`` keeps."""
    _, weights, bias = fit(docs, key, text, sample)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            yield part.filter(pa.array([_quality(x or "", weights, bias) >= threshold for x in part.column(text).to_pylist()], pa.bool_()))

    return bounded(docs).mapInArrow(mapped, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores whole ``documents``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
