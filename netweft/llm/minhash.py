"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``chunks * size`` positions, each the low ``bits`` bits of one
minimum over the shingle set. Two signatures that differ in at most
``chunks * (errors + 1) - 1`` positions have, by the pigeonhole principle, a
chunk that differs in at most ``errors`` positions. So every way of leaving out
``errors`` positions of every chunk gives a key, and any two such signatures
share a key: no pair under that distance is missed. Beyond it a pair of
similarity s is still found unless every chunk differs in more; with the
defaults and s = 0.8 that is 1 pair in a million. What shares a key is compared
on full sets, so that links are exact.

Large groups. Equal sets are one representative from the start. What shares a
key with the key's smallest id is in one family; families are components, found
without making pairs. In a family all sets are compared exactly, by counting
common shingles in a task that holds the family, or two blocks of it if it is
large; only the links that it takes to connect what is linked leave the task.
Keys that one row has, which most are, go no further than the count.

The first pass makes a signature for each document. Only texts of documents
that are in a family with others are read again.

Null or empty texts and texts without words have the empty set and are linked
with nothing. Equal ids are one node, whatever their texts; every row has its
row in the result. A null id is in the component of its equal set's ids but
links no one; alone, its component is null. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm.batches import keyed_texts, pieces
from netweft.llm.shingles import mixed, shingle_set
from netweft.operators.components import connected_components
from netweft.plans.scratch import remove, stored


#: Of one block of a family: representatives, and members of their sets.
BLOCK_ROWS, BLOCK_SHINGLES = 1_000, 1 << 20


class Signatures(NamedTuple):
    chunks: int = 13
    size: int = 6
    errors: int = 1
    bits: int = 12
    seed: int = 7

    @property
    def positions(self) -> int:
        return self.chunks * self.size

    @property
    def guaranteed(self) -> int:
        """Any two signatures that differ in so many positions at most share a key."""
        return self.chunks * (self.errors + 1) - 1


def signatures(sets: list[np.ndarray], form: Signatures) -> np.ndarray:
    """A row of ``positions`` small integers for each non-empty set."""
    rng = np.random.Generator(np.random.PCG64(form.seed))
    factors = rng.integers(1, 1 << 31, form.positions, np.uint32) * np.uint32(2) + np.uint32(1)
    terms = rng.integers(0, 1 << 32, form.positions, np.uint64).astype(np.uint32)
    out = np.empty((len(sets), form.positions), np.uint16)
    start = 0
    while start < len(sets):  # so many sets at a time as the processor's cache holds
        end, held = start, 0
        while end < len(sets) and (end == start or held + len(sets[end]) <= 1 << 15):
            held += len(sets[end])
            end += 1
        x = (np.concatenate(sets[start:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[start : end - 1]]))).astype(np.intp)
        for k in range(form.positions):
            v = x * factors[k]
            v += terms[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[start:end, k] = np.minimum.reduceat(v, at) & np.uint32((1 << form.bits) - 1)
        start = end
    return out


def chunk_keys(signed: np.ndarray, form: Signatures) -> np.ndarray:
    """For each signature, a key for every chunk and every choice of ``errors`` positions that it leaves out."""
    parts = signed.astype(np.uint64).reshape(len(signed), form.chunks, form.size)
    out = []
    for k, gone in enumerate(combinations(range(form.size), form.errors)):
        key = np.full((len(signed), form.chunks), k, np.uint64) + np.arange(form.chunks, dtype=np.uint64) * np.uint64(1 << 20)
        for i in set(range(form.size)) - set(gone):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
        out.append(key)
    return np.concatenate(out, axis=1).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], words: int, form: Signatures) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        sets = [shingle_set(x, words) for x in part.column("text").to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        signed: list[bytes | None] = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full], form)):
                signed[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                part.column("key"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(signed, pa.binary()),
            ],
            ["key", "n", "set_hash", "signature"],
        )


def _keyed(batches: Iterator[pa.RecordBatch], form: Signatures) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            some = batch.slice(start, 2000)
            signed = np.frombuffer(b"".join(some.column("signature").to_pylist()), np.uint16).reshape(-1, form.positions)
            keys = chunk_keys(signed, form)
            ids = np.repeat(some.column("rep").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids, pa.int64())], ["chunk_key", "rep"])


def alike(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Every pair i < j of sets that is similar enough, by counting for each set how often the others have its members."""
    sizes = np.array([len(x) for x in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(whole := np.concatenate(sets), kind="stable")
    whole, of = whole[order], of[order]
    first = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
    widths = np.diff(np.concatenate((first, [len(whole)])))
    # Of each set's members, where the list of those who have it begins and ends; members that no other set has are left out.
    group = np.repeat(np.arange(len(first)), widths)
    shared = widths[group] > 1
    back = np.argsort(of[shared], kind="stable")
    mine, owner = group[shared][back], of[shared][back]
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
    for i in range(len(sets)):
        g = mine[cuts[i] : cuts[i + 1]]
        if len(g):
            w = widths[g]
            at = np.repeat(first[g] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            both = np.bincount(of[at], minlength=len(sets))[i + 1 :]
            for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)).tolist():
                yield i, i + 1 + j


def _spanning(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (family, i, j, key): for each group, links that connect all that its links connect."""
    held: list[tuple[int, np.ndarray]] = []
    group = None

    def linked() -> list[tuple[int, int]]:
        top = list(range(len(held)))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        out = []
        for i, j in alike([x for _, x in held], percent) if len(held) > 1 else ():
            a, b = find(i), find(j)
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((held[i][0], held[j][0]))
        return out

    def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    for batch in batches:
        links = []
        for family, i, j, key, data in zip(*(batch.column(x).to_pylist() for x in ("family", "i", "j", "key", "shingles"))):
            if (family, i, j) != group:
                links += linked()
                held, group = [], (family, i, j)
            held.append((key, np.frombuffer(data, np.uint64)))
        yield made(links)
    yield made(linked())


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        sets = pa.array([shingle_set(x, words).tobytes() for x in part.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("family", "key", "block", "blocks")), sets], ["family", "key", "block", "blocks", "shingles"])


def _links(families: DataFrame, known: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) on full sets within families (node, component), enough to connect whatever is linked.

    A family of more than BLOCK_ROWS representatives, or of sets that are larger together than BLOCK_SHINGLES, is cut into
    blocks by hash, and every two blocks meet in a task of their own.
    """
    members = families.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = members.unionByName(members.select(F.col("family").alias("rep"), "family").distinct()).join(known.select("rep", "n"), "rep")
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("family").agg(needed.alias("blocks"))
    asked = members.join(sizes, "family").select(F.col("rep").alias("key"), "family", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    sets = rows.join(asked, "key").select("family", "key", "block", "blocks", "text").mapInArrow(
        lambda x: _sets(x, words), "family long, key long, block int, blocks int, shingles binary"
    )
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return (
        sets.select("family", "key", "block", "shingles", met)
        .select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "shingles")
        .repartition("family", "i", "j")
        .sortWithinPartitions("family", "i", "j", "key")
        .mapInArrow(lambda x: _spanning(x, percent), "a long, b long")
        .where("a <> b")
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, form: Signatures = Signatures()
) -> DataFrame:
    """(key, n_shingles, component_id, kept), a row for each row of ``docs``.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their
    sets of ``words``-word shingles. component_id: the smallest id reachable by
    links; kept: whether that is the row's own.
    """
    spark = docs.sparkSession
    rows = keyed_texts(docs, key, text)
    sketches, _ = stored(rows.mapInArrow(lambda x: _sketched(x, words, form), "key long, n long, set_hash binary, signature binary"), "sketches")
    reps, reps_uri = stored(
        sketches.where("n > 0").groupBy("set_hash").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")), "representatives"
    )
    known = reps.where("rep is not null")
    keys = known.select("rep", "signature").mapInArrow(lambda x: _keyed(x, form), "chunk_key long, rep long")
    pivots = keys.groupBy("chunk_key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot <> last").drop("last")
    shared, shared_uri = stored(keys.join(pivots, "chunk_key"), "shared")
    families, families_uri = connected_components(shared.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    links, links_uri = stored(_links(families, known, rows, words, percent), "links")
    found, _ = connected_components(links)
    remove(spark, shared_uri, families_uri, links_uri)
    classes, _ = stored(
        known.select("set_hash", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component")), "classes"
    )
    remove(spark, reps_uri)
    return (
        sketches.select("key", "n", "set_hash")
        .join(classes, "set_hash", "left")
        .select(
            F.col("key").alias(key),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "key").alias("component_id"),
            F.coalesce(F.col("key") == F.coalesce("component", "key"), F.col("component").isNull()).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, form: Signatures = Signatures()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps; rows that repeat an id and its text are one.

    Rows with a null id stay if any of them is kept.
    """
    kept = near_duplicates(docs, key, text, words, percent, form).where("kept").select(F.col(key).alias("__kept_key"))
    return docs.join(kept, F.col(f"`{key}`").eqNullSafe(F.col("__kept_key")), "left_semi").dropDuplicates([key, text])


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates in whole ``documents``, by shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
