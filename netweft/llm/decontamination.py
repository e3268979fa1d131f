"""Benchmark passages in documents by greedy string tiling.

Running Karp-Rabin: windows of a search length are hashed in both texts, equal
ones that are free of marks are extended as far as they go, and the longest
matches are marked first; what marks leave of a match waits for its turn by
its new length. Then the search length falls, down to ``least`` words. So at
every step the longest match of unmarked words is marked, of equally long ones
that which stands first in the document, and then in the item. An item leaks
into a document if the tiles cover a share ``threshold`` of its words, in
whatever order its parts stand there.

Only items that share a seed, that is ``least`` words in a row, with a document
are compared with it. Items with fewer words are their own seed. The items go
to the tasks in blocks of bounded size. One block is looked up as the documents
are read, and nothing is shuffled. Of several, each is a pass of its own over
the documents, and one broadcast is held at a time; what a pass finds is kept by
the digest of the text, for texts with a seed only, and joined with the rows.

Words are runs of letters, digits and bytes beyond ASCII, in lower case, and are
compared by 64-bit hashes. Null or empty texts and items without words have no
matches. Items with equal ids are separate texts of one id. Repeated rows have
one result each; other columns are ignored. An empty benchmark or an empty
table gives no leaks or no rows. Very long texts are compared whole; the time
that takes grows with the length of text and item where both repeat a word.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm.batches import bounded, keyed_texts, pieces
from netweft.llm.shingles import sequence_hashes, word_hashes
from netweft.plans.scratch import stored

#: Bytes of benchmark text that one block may have.
BLOCK_BYTES = 8 << 20
LEAST, THRESHOLD = 5, 0.5
_FIRST_SEARCH = 20
_TO_BLANK = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TO_BLANK).split()


def tiles(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in a, start in b, length), longest first."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    found, search = [], max(least, _FIRST_SEARCH)
    while True:
        waiting = _matches(a, b, free_a, free_b, search)
        heapify(waiting)
        while waiting:
            n, i, j = heappop(waiting)
            clear = free_a[i : i - n] & free_b[j : j - n]
            if clear.all():
                free_a[i : i - n] = free_b[j : j - n] = False
                found.append((i, j, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([False], clear, [False])).astype(np.int8)))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if y - x >= search:
                    heappush(waiting, (x - y, i + x, j + x))
        if search == least:
            return found
        search = max(least, search // 2)


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(-length, start in a, start in b) of the matches of at least n unmarked words that can't be extended either way."""
    if min(len(a), len(b)) < n:
        return []
    ha, hb = sequence_hashes(a, n), sequence_hashes(b, n)
    marked = lambda free: np.concatenate(([0], np.cumsum(~free)))
    ca, cb = marked(free_a), marked(free_b)
    at_a = np.flatnonzero((ca[n:] == ca[:-n]) & np.isin(ha, hb))
    if not len(at_a):
        return []
    at_b = np.flatnonzero(cb[n:] == cb[:-n])
    at_b = at_b[np.argsort(hb[at_b], kind="stable")]
    low, high = np.searchsorted(hb[at_b], ha[at_a]), np.searchsorted(hb[at_b], ha[at_a], "right")
    out = []
    for i, x, y in zip(at_a.tolist(), low.tolist(), high.tolist()):
        own = at_b[x:y]
        if i and free_a[i - 1]:
            own = own[(own == 0) | ~free_b[own - 1] | (b[own - 1] != a[i - 1])]
        for j in own.tolist():
            m = min(len(a) - i, len(b) - j)
            apart = (a[i : i + m] != b[j : j + m]) | ~free_a[i : i + m] | ~free_b[j : j + m]
            end = int(apart.argmax())
            out.append((-(end if apart[end] else m), i, j))
    return out


class Seeds:
    """The seeds of a block of items: from a document's windows to the items worth comparing."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int):
        self.least = least
        self.ids = [i for i, _ in items]
        self.items = [word_hashes(words(t)) for _, t in items]
        pairs: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, w in enumerate(self.items):
            if len(w):
                n = min(least, len(w))
                pairs.setdefault(n, []).append((np.unique(sequence_hashes(w, n)), k))
        self.by_length = {}
        for n, found in pairs.items():
            hashes = np.concatenate([h for h, _ in found])
            of = np.repeat([k for _, k in found], [len(h) for h, _ in found])
            order = np.argsort(hashes, kind="stable")
            there = np.zeros(1 << 20, bool)
            there[hashes >> np.uint64(44)] = True
            self.by_length[n] = hashes[order], of[order], there

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Items that share a seed with the document."""
        found: set[int] = set()
        for n, (seeds, of, there) in self.by_length.items():
            own = sequence_hashes(hashes, n)
            own = own[there[own >> np.uint64(44)]]
            own = own[seeds[np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)] == own]
            if len(own):
                own = np.unique(own)
                for x, y in zip(np.searchsorted(seeds, own).tolist(), np.searchsorted(seeds, own, "right").tolist()):
                    found.update(of[x:y].tolist())
        return sorted(found)

    def leaks(self, text: str | None) -> list[dict]:
        w = words(text)
        hashes = word_hashes(w)
        out = []
        for k in self.candidates(hashes):
            item = self.items[k]
            got = tiles(hashes, item, min(self.least, len(item)))
            out.append({"item_id": self.ids[k], "coverage": sum(n for _, _, n in got) / len(item), "tiles": len(got)})
        return out


_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64())]))
_TYPE = "array<struct<item_id long, coverage double, tiles long>>"


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST
) -> DataFrame:
    """(key, leaks): for each row of ``docs``, the items that share a seed with it, with the share of their words that tiles cover."""
    rows, (items, blocks) = keyed_texts(docs, key, text), _items(benchmark, item, item_text)
    if blocks <= 1:
        out = rows.mapInArrow(_compared(_block(items, 0, blocks, least)), f"key long, leaks {_TYPE}")
    else:
        found = _by_digest(rows, items, blocks, least)
        out = rows.select("key", F.md5("text").alias("digest")).join(found, "digest", "left").select("key", F.coalesce("leaks", F.expr(f"cast(array() as {_TYPE})")).alias("leaks"))
    return out.withColumnRenamed("key", key)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs``, with all their columns, into which no item leaks."""
    items, blocks = _items(benchmark, item, item_text)
    if blocks > 1:
        found = _by_digest(docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")), items, blocks, least).where(F.exists("leaks", lambda x: x["coverage"] >= threshold))
        return docs.join(found.select(F.col("digest").alias("__leaking")), F.md5(F.col(f"`{text}`").cast("string")) == F.col("__leaking"), "left_anti")
    held = _block(items, 0, blocks, least)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            clean = [all(x["coverage"] < threshold for x in held.value.leaks(t)) for t in part.column(text).to_pylist()]
            yield part.filter(pa.array(clean, pa.bool_()))

    return bounded(docs).mapInArrow(mapped, docs.schema)


def _items(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    """(i, t) of the items, and in how many blocks of about BLOCK_BYTES they go out."""
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    return items, -(-(items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0) // BLOCK_BYTES)


def _block(items: DataFrame, k: int, blocks: int, least: int) -> Broadcast:
    """Seeds of one block of the items."""
    rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(max(1, blocks))) == k).collect()
    return items.sparkSession.sparkContext.broadcast(Seeds(sorted(((r.i, r.t) for r in rows), key=lambda x: (x[0] is not None, x)), least))


def _compared(held: Broadcast):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = pa.array([held.value.leaks(t) for t in part.column("text").to_pylist()], _LEAKS)
            yield pa.RecordBatch.from_arrays([part.column("key"), found], ["key", "leaks"])

    return mapped


def _with_seeds(held: Broadcast):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = [held.value.leaks(t) for t in part.column("text").to_pylist()]
            some = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(some, pa.int64())), pa.array([found[i] for i in some], _LEAKS)], ["digest", "leaks"])

    return mapped


def _by_digest(rows: DataFrame, items: DataFrame, blocks: int, least: int) -> DataFrame:
    """(digest, leaks) of the texts that share a seed with an item, a pass over the rows for each block."""
    texts, tables = bounded(rows).select("text", F.md5("text").alias("digest")), []
    for k in range(blocks):
        held = _block(items, k, blocks, least)
        found, _ = stored(texts.mapInArrow(_with_seeds(held), f"digest string, leaks {_TYPE}").groupBy("digest").agg(F.first("leaks").alias("leaks")), "leaks")
        held.destroy()
        tables.append(found.select("digest", F.lit(k).alias("block"), "leaks"))
    both = reduce(DataFrame.unionByName, tables)
    merged, _ = stored(
        both.groupBy("digest").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "leaks"))), lambda x: x["leaks"])).alias("leaks")), "leaks"
    )
    return merged


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, **names) -> DataFrame:
    """(key, contaminated, item_ids, coverage): the items that leak, in order, and the largest share of any item."""
    key = names.get("key", "doc_id")
    found = F.filter("leaks", lambda x: x["coverage"] >= threshold)
    return leaks(docs, benchmark, **names).select(
        key,
        (F.size(found) > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform(found, lambda x: x["item_id"]))).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
