"""Language by Bayesian fusion of a text's likelihood with what its markup, address and host say.

Likelihood: byte 3-grams under naive Bayes, counted over all labelled
documents, tempered because neighbouring 3-grams overlap. Declared language
and address suffix: the probability of what is seen given each language,
estimated from all other rows by what their texts say. Host: a prior whose
counts are smoothed towards those of the host's domain, which are smoothed
towards its suffix's, and these towards the corpus, all by grouped aggregation.
A row's own text is taken out of every count before the row uses it, so that it
speaks once. The language is the most probable one, of equals the first listed.

The texts are read twice: for the counts and for the likelihoods; very long
ones whole. What is then shuffled are a few numbers for each row, and counts by host,
which are summed within each task first. The counts are a table of their own
before they are joined, so that adaptive execution can split a host that has
a third of all rows.

Null or empty texts have no likelihood of their own and get what the other
evidence says. A null or odd url has no host or suffix; they share one prior.
Rows with a language that isn't among ``languages`` train nothing. Repeated
rows have one result each; other columns are ignored; empty tables give no rows.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm.batches import bounded, pieces
from netweft.plans.scratch import stored

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 14
#: A text of n 3-grams counts as n * TEMPER independent ones.
TEMPER = 0.2
#: Rows that a host's prior takes from its domain, a domain's from its suffix, and a suffix's from the corpus.
SMOOTHING = 5.0

# Country suffixes of the languages.
SUFFIXES = {"at": "de", "ch": "de", "de": "de", "us": "en", "uk": "en", "au": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "be": "fr"}

_TAG = re.compile(r"<html\b([^>]*)", re.I)
_DECLARED = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def grams(text: str) -> np.ndarray:
    """Hashed 3-grams of the lower-case UTF-8 bytes."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(18)).astype(np.int64)


def visible(html: str) -> str:
    """The text of a page without tags, scripts and styles; one pass."""
    out, hidden = [], ""
    for k, x in enumerate(html.split("<")):
        tag, _, text = x.partition(">") if k else ("", "", x)
        name = tag[:8].lower()
        if hidden:
            if name.startswith("/" + hidden):
                hidden = ""
            else:
                continue
        elif name.startswith(("script", "style")):
            hidden = "script" if name.startswith("script") else "style"
            continue
        out.append(text)
    return " ".join(out)


def declared_language(html: str) -> str:
    """What the first tag of the page that has it says, in lower case; empty if none does."""
    found = (_DECLARED.search(x[1]) for x in _TAG.finditer(html))
    return next((m[1].lower() for m in found if m), "")


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of a url in lower case; empty where there is none."""
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        host = ""
    parts = host.rsplit(".", 2)
    return host, ".".join(parts[-2:]), parts[-1] if len(parts) > 1 else ""


def _counted(batches: Iterator[pa.RecordBatch], languages: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(languages), BUCKETS), np.int64)
    at = {x: k for k, x in enumerate(languages)}
    for part in pieces(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            if lang in at:
                counts[at[lang]] += np.bincount(grams(text), minlength=BUCKETS)
    lang, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[lang, bucket], pa.int64())], ["lang", "bucket", "n"]
    )


def likelihoods(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Log-probabilities of each bucket under each language, from all labelled rows; as many numbers as languages times BUCKETS."""
    rows = bounded(labelled).select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in rows.mapInArrow(lambda x: _counted(x, languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"], r["bucket"]] += r["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _seen(batches: Iterator[pa.RecordBatch], table: np.ndarray, markup: bool) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        logs, declared, places = [], [], []
        for url, text in zip(part.column("url").to_pylist(), part.column("text").to_pylist()):
            declared.append(declared_language(text) if markup else "")
            g = grams(visible(text) if markup else text)
            logs.append((TEMPER * (table @ np.bincount(g, minlength=BUCKETS)) if len(g) else np.zeros(len(table))).tolist())
            places.append(address(url) if markup else (url or "", "", ""))
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), pa.array(logs, pa.list_(pa.float64())), pa.array(declared), *(pa.array(x, pa.string()) for x in (zip(*places) if places else ((), (), ())))],
            ["key", "logs", "declared", "host", "domain", "suffix"],
        )


def evidence(rows: DataFrame, key: str, text: str, url: str | None, table: np.ndarray, markup: bool) -> DataFrame:
    """(key, logs, declared, host, domain, suffix). markup: the text is a page and ``url`` its address; else ``url`` names a host as it is."""
    held = bounded(rows).sparkSession.sparkContext.broadcast(table)
    named = F.col(f"`{url}`").cast("string") if url else F.lit(None).cast("string")
    return rows.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), named.alias("url")
    ).mapInArrow(lambda x: _seen(x, held.value, markup), "key long, logs array<double>, declared string, host string, domain string, suffix string")


def fused(found: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds lang and probability to rows of ``evidence`` by all of it together."""
    n, index = len(languages), range(len(languages))
    soft = lambda logs: F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    share = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    known = [*languages, ""]
    rows = found.select(
        "*",
        share(soft(F.col("logs"))).alias("own"),
        F.when(F.col("declared").isin(known), F.col("declared")).otherwise("other").alias("said"),
        F.coalesce(*(F.when(F.col("suffix") == s, F.lit(x)) for s, x in SUFFIXES.items()), F.lit("")).alias("country"),
    )
    sums = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in index]
    total = [float(x or 0) for x in rows.agg(*sums).first()]
    # Of the counts, what the others leave: rounding may take a little too much away.
    others = lambda count, i: F.greatest(count - F.col("own")[i], F.lit(0.0))

    def given(column: str, values: list[str]) -> list[Column]:
        """Log-probabilities, by language, of what the row has in ``column``; as many counts as values times languages."""
        seen = {r[column]: [float(r[f"s{i}"]) for i in index] for r in rows.groupBy(column).agg(*sums).collect()}
        counts = F.array(*(F.lit(0.0) for _ in index))
        for v in values:
            counts = F.when(F.col(column) == v, F.array(*(F.lit(x) for x in seen.get(v, [0.0] * n)))).otherwise(counts)
        return [F.log((others(counts[i], i) + 1) / (others(F.lit(total[i]), i) + len(values))) for i in index]

    said, country = given("said", [*known, "other"]), given("country", ["", *sorted(set(SUFFIXES.values()))])
    counts, _ = stored(rows.groupBy("host", "domain", "suffix").agg(*sums), "hosts")
    level = lambda column: counts.groupBy(column).agg(*(F.sum(f"s{i}").alias(f"{column}{i}") for i in index))
    array = lambda name: F.array(*(F.col(f"{name}{i}") for i in index)).alias(f"{name}_counts")
    levels, _ = stored(
        counts.join(level("domain"), "domain").join(level("suffix"), "suffix").select("host", "domain", "suffix", array("s"), array("domain"), array("suffix")), "levels"
    )

    def smooth(name: str, above: list[Column]) -> list[Column]:
        own = [others(F.col(f"{name}_counts")[i], i) for i in index]
        return [(own[i] + SMOOTHING * above[i]) / (sum(own, F.lit(0.0)) + SMOOTHING) for i in index]

    overall = [(others(F.lit(total[i]), i) + 1) / (sum((others(F.lit(total[j]), j) for j in index), F.lit(0.0)) + n) for i in index]
    joined = rows.join(levels, ["host", "domain", "suffix"])
    # One level after the other is a column, or else its expression would be repeated for each language above it.
    for name, above in (("suffix", overall), ("domain", None), ("s", None)):
        above = above or [F.col("above")[i] for i in index]
        joined = joined.withColumn("above", F.array(*smooth(name, above)))
    logs = F.array(*(F.col("logs")[i] + F.log(F.col("above")[i]) + said[i] + country[i] for i in index))
    weights = joined.withColumn("posterior", share(soft(logs)))
    best = F.array_max("posterior")
    names = F.array(*(F.lit(x) for x in languages))
    return weights.select("key", F.element_at(names, F.array_position("posterior", best).cast("int")).alias("lang"), F.round(best, 6).alias("probability"), "declared", "host")


def identify(
    docs: DataFrame, pages: DataFrame, languages: tuple[str, ...] = LANGUAGES, threshold: float = 0.5
) -> DataFrame:
    """(doc_id, page_id, lang, probability, kept): a row for each document, by text and source, and for each page, by text, markup
    and address. kept: whether the language's probability reaches ``threshold``."""
    table = likelihoods(docs, languages)
    # A source names a host of its own kind, apart from the pages' hosts.
    of_docs = evidence(docs.withColumn("source", F.concat(F.lit("source:"), F.col("source").cast("string"))), "doc_id", "text", "source", table, False)
    of_pages = evidence(pages, "page_id", "html", "url", table, True)
    found, _ = stored(of_docs.withColumn("page", F.lit(False)).unionByName(of_pages.withColumn("page", F.lit(True))), "evidence")
    of_kind = lambda page: fused(found.where(F.col("page") == page).drop("page"), languages)
    d = of_kind(False).select(F.col("key").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "lang", "probability")
    p = of_kind(True).select(F.lit(None).cast("long").alias("doc_id"), F.col("key").alias("page_id"), "lang", "probability")
    return d.unionByName(p).withColumn("kept", F.col("probability") >= threshold)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` and whole ``pages``."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet"))
