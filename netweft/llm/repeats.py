"""Repeated byte strings by sorted suffixes, built column by column.

What is removed: every byte that is covered by a string of ``length`` bytes
which starts anywhere else too. A string is a window of ``length`` bytes; the
work is to find windows that occur twice.

1. Each window has an anchor, the place of the smallest hash of ``_GRAM`` bytes
   in it, which depends on the window's bytes alone. Windows that follow each
   other mostly share it, so a document is a list of stretches, one for each
   anchor: about one for 180 bytes. Equal windows have equal anchors.
2. Stretches of an anchor that occurs once hold no repeat and are done with.
   Stretches with equal bytes are repeats throughout. Both are decided by
   counting hashes of anchors and stretches, without any text.
3. Stretches that are left share an anchor with different ones. Their suffixes
   are sorted for all stretches of an anchor together, column by column: in
   each round every string of the collection is extended to the left by one
   symbol, and the new suffixes are put in their places among the sorted ones,
   given by their first symbol and the place of what follows it. The collection's
   transform, order and common prefixes are kept in files that each round reads
   and writes from front to end. A symbol is a block of ``length / 4`` bytes,
   and each stretch is a string for each way of cutting it into blocks, so that
   every byte starts a suffix. Neighbours with four symbols in common are repeats.
   Symbols are ordered by their 64-bit hashes, not by their bytes: what repeats
   does not depend on the order. Strings are cut at symbols that occur once.

The rounds of one symbol for each document of the corpus would be as many as
the longest document has bytes, each over all of what is sorted; here they are
as many as a stretch has blocks, 7 at most, and over the stretches of some
anchors only, in tasks that need nothing of each other. A round holds its arrays
in memory; ``SORTED`` bounds them. An anchor with more bytes of stretches is dealt out to
several tasks by the ways of cutting, counted from the anchor, since equal
windows are equally far from it, and at last by the block that holds the
anchor too. One with more than ``most`` different stretches isn't
sorted: its windows are counted by their hashes instead, exactly, which Spark
deals out by window.

Passages of ``words`` words, whatever their bytes, are found the same way, in
documents of which each word is a code of four bytes (a hash; different words
have one code once in 2^32). They are told of, not removed.

Documents are known by a digest of their bytes, so null and repeated ids are no
matter: equal texts have equal results. A null text is empty and keeps nothing;
an empty table has no rows; other columns are ignored. A very long text is read
in segments of 8 MB, and where it repeats a few bytes over and over, a row stands
for all those stretches.
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.llm.batches import keyed_texts, pieces
from netweft.llm.shingles import mixed
from netweft.plans.scratch import remove, stored

LENGTH = 400
#: Words of a passage that is told of.
WORDS = 51
#: Different stretches that an anchor may have to be sorted; suffixes that a task sorts at a time.
MOST, SORTED = 200_000, 600_000
_GRAM, _SYMBOLS, _SEGMENT = 32, 4, 1 << 23
_CODE = 4
_MULTIPLIER = 0x9E3779B97F4A7C15


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` bytes in a row, put together from those of powers of two."""
    if len(data) < width:
        return np.empty(0, np.uint64)
    factor = lambda n: np.uint64(pow(_MULTIPLIER, n, 1 << 64))
    h, n, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if width & n:
            have = len(data) - done - n + 1
            out = h if out is None else out[:have] * factor(n) + h[done : done + have]
            done += n
        if 2 * n > width:
            return mixed(out[: len(data) - width + 1])
        h = h[:-n] * factor(n) + h[n:]
        n *= 2


def stretches(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(anchor hash, first window, windows, times) of the stretches that a text's windows form; none if it is shorter than a window.

    times: so many stretches with the same bytes begin one after the other, each where the windows of the one before
    end; text that repeats a few bytes has no more rows than other text.
    """
    out = []
    windows = len(data) - length + 1
    for start in range(0, max(0, windows), _SEGMENT):
        some = np.frombuffer(data, np.uint8)[start : start + _SEGMENT + length - 1]
        h = _hashes(some, _GRAM)
        # 40 bits of the hash and then the place: the smallest is the leftmost of the smallest hashes.
        low, n, wide = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64), 1, length - _GRAM + 1
        while n * 2 <= wide:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < wide:
            low = np.minimum(low[: len(low) - (wide - n)], low[wide - n :])
        at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        edges = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
        anchors, first, sizes = h[at[edges[:-1]]].view(np.int64), edges[:-1], np.diff(edges)
        times = np.ones(len(first), np.int64)
        like = (anchors[1:] == anchors[:-1]) & (sizes[1:] == sizes[:-1])
        if like.any():
            turns = np.flatnonzero(np.diff(np.concatenate(([False], like, [False])).astype(np.int8)))
            for x, y in zip(turns[::2].tolist(), turns[1::2].tolist()):  # stretches x to y, y included
                run = some[first[x] : first[y] + sizes[y] + length - 1]
                if np.array_equal(run[sizes[x] :], run[: -sizes[x]]):
                    times[x], times[x + 1 : y + 1] = y - x + 1, 0
        one = times > 0
        out += zip(anchors[one].tolist(), (first[one] + start).tolist(), sizes[one].tolist(), times[one].tolist())
    return out


class _Files:
    """Named arrays in files of a task's own, gone with it; each is written and read from front to end.

    A file that is written over is flushed to the disk by some file systems; a new one that is soon removed is not.
    """

    def __init__(self, folder: str):
        self.folder, self.number = folder, 0

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.{self.number}")

    def put(self, **arrays: np.ndarray) -> None:
        old = [self._path(x) for x in arrays] if self.number else []
        self.number += 1
        for name, x in arrays.items():
            with open(self._path(name), "wb") as f:
                x.tofile(f)
        for x in old:
            os.remove(x)

    def get(self, name: str, kind: str) -> np.ndarray:
        return np.fromfile(self._path(name), kind)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of values[low : high] for each pair; low < high."""
    out = np.full(len(low), 255, np.uint8)
    span = high - low
    table, n = values, 1
    while len(low) and n <= span.max():
        now = (span >= n) & (span < 2 * n)
        out[now] = np.minimum(table[low[now]], table[high[now] - n])
        if 2 * n > len(values):
            break
        table = np.minimum(table[:-n], table[n:])
        n *= 2
    return out


def sorted_suffixes(symbols: np.ndarray, lengths: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, symbols, common) of all suffixes in order: whose they are, how many symbols they have, and how many
    of them, _SYMBOLS at most, they share with the one before. symbols: those of all strings in turn, as ranks.

    Sorted so far are the suffixes of fewer symbols than the round's number; the empty ones come first, in the
    strings' order. For each, kept are its first symbol and the place of the rest of it.
    """
    m, files = len(lengths), _Files(folder)
    ends = np.cumsum(lengths)
    kinds = {"first": "<i4", "rest": "<i4", "string": "<i4", "size": "<i2"}
    put = {"first": np.full(m, -1), "rest": np.zeros(m), "string": np.arange(m), "size": np.zeros(m)}
    files.put(**{x: v.astype(kinds[x]) for x, v in put.items()}, common=np.zeros(m, np.uint8))
    place = np.arange(m)  # of each string's longest suffix so far
    for j in range(1, int(lengths.max(initial=0)) + 1):
        first, rest, string, size = (files.get(x, kind) for x, kind in kinds.items())
        common = files.get("common", "u1")
        new = np.flatnonzero(lengths >= j)
        c = symbols[ends[new] - j]
        order = np.lexsort((place[new], c))
        new, c = new[order], c[order]
        wide = np.int64(len(first) + 1)
        at = np.searchsorted(first[m:] * wide + rest[m:], c * wide + place[new]) + m  # wide makes 64 bits of them
        # Every old place moves by the number of suffixes put before it.
        moved = np.arange(len(first)) + np.searchsorted(at, np.arange(len(first)), "right")
        total = len(first) + len(new)
        where = at + np.arange(len(new))
        put = {x: np.empty(total, kind) for x, kind in kinds.items()}
        old_rest = np.empty(total, np.int64)
        for name, old, add in (("first", first, c), ("string", string, new), ("size", size, np.full(len(new), j))):
            put[name][moved], put[name][where] = old, add
        old_rest[moved], old_rest[where] = rest, place[new]
        put["rest"] = moved[old_rest].astype(kinds["rest"])
        joint = np.zeros(total, np.uint8)
        joint[moved] = common
        # Common prefixes change only where a new suffix is on either side.
        touched = np.unique(np.concatenate((where, where + 1)))
        touched = touched[(touched > m) & (touched < total)]
        same = put["first"][touched] == put["first"][touched - 1]
        joint[touched[~same]] = 0
        pair = touched[same]
        joint[pair] = np.minimum(_least(common, old_rest[pair - 1] + 1, old_rest[pair] + 1), _SYMBOLS - 1) + 1
        place[new] = where
        files.put(**put, common=joint)
    return files.get("string", kinds["string"]).astype(np.int64), files.get("size", kinds["size"]).astype(np.int64), files.get("common", "u1")


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, the starts of windows that occur in any of the texts, or in this one, at another place too."""
    block = length // _SYMBOLS
    whole, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts)), np.int64)
    h, base = _hashes(whole, block), np.cumsum(sizes) - sizes
    phase = np.tile(np.arange(block), len(texts))
    of = np.repeat(np.arange(len(texts)), block)
    counts = (sizes[of] - phase) // block
    some = counts >= _SYMBOLS
    of, phase, counts = of[some], phase[some], counts[some]
    return _sorted(h[_ranges(base[of] + phase, counts, block)], counts, phase, of, len(texts), block)


def _ranges(first: np.ndarray, counts: np.ndarray, step: int) -> np.ndarray:
    """first, first + step, ... of each, so many as its count says, one after the other."""
    return np.repeat(first - step * (np.cumsum(counts) - counts), counts) + step * np.arange(counts.sum())


def _sorted(symbols: np.ndarray, counts: np.ndarray, first: np.ndarray, of: np.ndarray, texts: int, block: int) -> list[np.ndarray]:
    """For each text the starts, in order, of four symbols that the strings have more than once.

    symbols: those of all strings in turn; counts: of each string; first: the place in its text where it begins; of: its text.
    A symbol that occurs once is in no repeat, so that strings are cut there before they are sorted.
    """
    _, ranks, times = np.unique(symbols, return_inverse=True, return_counts=True)
    alive = times[ranks] > 1
    string = np.repeat(np.arange(len(counts)), counts)
    apart = (string[1:] != string[:-1]) | ~alive[1:] | ~alive[:-1]
    begin = np.flatnonzero(alive & np.concatenate(([True], apart))[: len(alive)])
    lengths = np.flatnonzero(alive & np.concatenate((apart, [True]))[: len(alive)]) + 1 - begin
    begin, lengths = begin[lengths >= _SYMBOLS], lengths[lengths >= _SYMBOLS]
    of = of[string[begin]]
    first = first[string[begin]] + (begin - (np.cumsum(counts) - counts)[string[begin]]) * block
    with tempfile.TemporaryDirectory() as folder:
        own, size, common = sorted_suffixes(ranks[_ranges(begin, lengths, 1)], lengths, folder)
    alike = common >= _SYMBOLS
    alike[:-1] |= alike[1:]
    own, size = own[alike], size[alike]
    starts, of = first[own] + (lengths[own] - size) * block, of[own]
    order = np.lexsort((starts, of))
    of, starts = of[order], starts[order]
    cuts = np.searchsorted(of, np.arange(texts + 1))
    return [starts[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _phases(size: int, place: int, turn: int, turns: int, block: int) -> list[tuple[int, int]]:
    """(place of the first block, blocks) of the ways of cutting a stretch that belong to a turn, if they have four blocks.

    Ways of cutting are numbered from the anchor, whose place this is, so that equal windows have theirs in the same turn.
    """
    ways = [(place + c) % block for c in range(turn, block, turns)]
    return [(p, (size - p) // block) for p in ways if (size - p) // block >= _SYMBOLS]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as codes of their words, which whitespace as in ASCII divides."""
    for part in pieces(batches):
        codes = [b"".join(map(xxhash.xxh32_digest, text.encode().split())) for text in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(codes, pa.binary())], ["digest", "text"])


def _bytes(text: str | bytes) -> bytes:
    return text if isinstance(text, bytes) else text.encode()


def _listed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        columns: list[list] = [[], [], [], [], [], []]
        for digest, text in zip(part.column("digest").to_pylist(), part.column("text").to_pylist()):
            data = _bytes(text)
            found = stretches(data, length)
            if not found:
                continue
            anchors, starts, sizes, times = zip(*found)
            columns[0] += [digest] * len(found)
            columns[1] += anchors
            columns[2] += [xxhash.xxh3_128_digest(data[start : start + n + length - 1]) for start, n in zip(starts, sizes)]
            columns[3] += starts
            columns[4] += sizes
            columns[5] += times
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["digest", "anchor", "stretch", "start", "n", "run"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches that are asked for. Rows of equal texts mostly follow each other; the first will do."""
    last = None
    for part in pieces(batches):
        rows = []
        for digest, text, asked in zip(*(part.column(x).to_pylist() for x in ("digest", "text", "asked"))):
            if digest != last:
                data, last = _bytes(text), digest
                rows += [x | {"digest": digest, "data": data[x["start"] : x["start"] + x["n"] + length - 1]} for x in asked]
        yield pa.RecordBatch.from_pylist(rows, _CUT)


_CUT = pa.schema([("anchor", pa.int64()), ("stretch", pa.binary()), ("once", pa.bool_()), ("turns", pa.int32()), ("digest", pa.binary()), ("start", pa.int64()), ("data", pa.binary())])
_TURNS = pa.schema([("anchor", pa.int64()), ("turn", pa.int32()), ("turns", pa.int32()), ("symbol", pa.int64()), ("stretch", pa.binary()), ("once", pa.bool_()), ("digest", pa.binary()), ("start", pa.int64()), ("size", pa.int64()), ("place", pa.int64()), ("symbols", pa.binary())])
_SPANS = pa.schema([("digest", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])


def _place(data: bytes, anchor: int) -> int:
    """Where a stretch's anchor is: the first place of its hash."""
    return int(np.flatnonzero(_hashes(np.frombuffer(data, np.uint8), _GRAM).view(np.int64) == anchor)[0])


def _runs(starts: np.ndarray, base: int, length: int) -> Iterator[tuple[int, int]]:
    """Bytes covered by windows at these starts."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > length)
        for a, b in zip(np.concatenate(([0], cut + 1)).tolist(), np.concatenate((cut, [len(starts) - 1])).tolist()):
            yield base + int(starts[a]), base + int(starts[b]) + length


def _span_rows(rows: list[dict], starts: list[np.ndarray], length: int) -> pa.RecordBatch:
    found = [{"digest": x["digest"], "start": a, "end": b} for x, own in zip(rows, starts) if x["once"] for a, b in _runs(own, x["start"], length)]
    return pa.RecordBatch.from_pylist(found, _SPANS)


def _gathered(batches: Iterator[pa.RecordBatch], group: tuple[str, ...], data: str, limit: int) -> Iterator[list[dict]]:
    """Rows in order of (*group, stretch), each stretch once, in lists that end with a group once they have ``limit`` bytes of ``data``."""
    held: list[dict] = []
    size, last, stretch = 0, None, None
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[x] for x in group)
            if own == last and row["stretch"] == stretch:
                continue
            if own != last and size > limit:
                yield held
                held, size = [], 0
            last, stretch = own, row["stretch"]
            held.append(row)
            size += len(row[data])
    if held:
        yield held


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, stretch): sorts the suffixes of whole anchors, several at a time."""
    for rows in _gathered(batches, ("anchor",), "data", SORTED):
        yield _span_rows(rows, repeated_starts([x["data"] for x in rows], length), length)


def _turned(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each stretch and turn, with the symbols of the turn's ways of cutting.

    symbol: where a turn is one way of cutting, the block that holds the anchor's first byte; equal windows have equal ones.
    """
    block = length // _SYMBOLS
    for part in pieces(batches, "data", 1 << 18):
        rows = []
        for x in part.to_pylist():
            place, size = _place(x["data"], x["anchor"]), len(x["data"])
            h = _hashes(np.frombuffer(x["data"], np.uint8), block)
            own = {k: x[k] for k in ("anchor", "turns", "stretch", "once", "digest", "start")} | {"size": size, "place": place}
            for turn in range(x["turns"]):
                ways = _phases(size, place, turn, x["turns"], block)
                symbol = 0
                if x["turns"] == block and ways:
                    first, n = ways[0]
                    if not 0 <= (place - first) // block < n:
                        continue  # no window of this way of cutting holds the anchor
                    symbol = int(h[first + (place - first) // block * block].view(np.int64))
                if ways:
                    symbols = np.concatenate([h[p : p + n * block : block] for p, n in ways])
                    rows.append(own | {"turn": turn, "symbol": symbol, "symbols": symbols.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, _TURNS)


def _sorted_turns(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, turn, symbol, stretch): sorts the suffixes of whole turns, several at a time."""
    block = length // _SYMBOLS
    for rows in _gathered(batches, ("anchor", "turn", "symbol"), "symbols", 8 * SORTED):
        ways = [_phases(x["size"], x["place"], x["turn"], x["turns"], block) for x in rows]
        of = np.repeat(np.arange(len(rows)), list(map(len, ways)))
        first, counts = (np.array([w[k] for own in ways for w in own], np.int64) for k in (0, 1))
        symbols = np.frombuffer(b"".join(x["symbols"] for x in rows), np.uint64)
        yield _span_rows(rows, _sorted(symbols, counts, first, of, len(rows), block), length)


def _windowed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of stretches of an anchor that has too many."""
    for part in pieces(batches, "data", 1 << 16):
        rows = []
        for x in part.to_pylist():
            data = x["data"]
            rows += [
                {"window": xxhash.xxh3_128_digest(data[k : k + length]), "digest": x["digest"], "at": x["start"] + k, "once": x["once"]}
                for k in range(len(data) - length + 1)
            ]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("window", pa.binary()), ("digest", pa.binary()), ("at", pa.int64()), ("once", pa.bool_())]))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        spans, kept = [], []
        for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
            data, merged = text.encode(), []
            for x in sorted(found or (), key=lambda x: x["start"]):
                if merged and x["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                else:
                    merged.append(dict(x))
            edges = [0, *(e for x in merged for e in (x["start"], x["end"])), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append(merged)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        told = [x for x in part.schema.names if x == "passage"]
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), pa.array(spans, kind), pa.array(kept, pa.binary()), *map(part.column, told)], ["key", "spans", "kept", *told]
        )


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> tuple[DataFrame, list[str]]:
    """(digest, start, end) of covered bytes, overlapping ones not yet joined, of docs (digest, text or bytes); and the folders in use.

    Sums by anchor are tables of their own before they are joined, so that adaptive execution can split an anchor or a
    text that has many rows.
    """
    block = length // _SYMBOLS
    listed, listed_uri = stored(
        docs.where(F.octet_length("text") >= length)
        .select("digest", "text")
        .mapInArrow(lambda x: _listed(x, length), "digest binary, anchor long, stretch binary, start long, n long, run long"),
        "stretches",
    )
    shared, shared_uri = stored(
        listed.groupBy("anchor")
        .agg(F.sum("run").alias("times"), (F.min("stretch") != F.max("stretch")).alias("differ"))
        .where("times > 1")
        .select("anchor", "differ"),
        "anchors",
    )
    occurring, occurring_uri = stored(listed.join(shared, "anchor"), "occurring")
    remove(docs.sparkSession, listed_uri, shared_uri)
    # Of equal stretches one stands for all.
    distinct, distinct_uri = stored(
        occurring.groupBy("anchor", "stretch")
        .agg(F.sum("run").alias("times"), F.first("differ").alias("differ"), F.min(F.struct("digest", "start", "n")).alias("x"))
        .select("anchor", "stretch", "times", "differ", "x.*"),
        "distinct",
    )
    whole = (
        occurring.join(distinct.where("times > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi")
        .select("digest", "start", (F.col("start") + F.col("n") * F.col("run") + (length - 1)).alias("end"))
    )
    mixed_anchors = distinct.where("differ")
    turns = F.least(F.lit(block), F.ceil(F.sum(F.col("n") + (length - 1)) / SORTED))
    sizes, sizes_uri = stored(
        mixed_anchors.groupBy("anchor").agg(F.when(F.count(F.lit(1)) > most, 0).otherwise(turns).cast("int").alias("turns")), "sizes"
    )
    asked, asked_uri = stored(
        mixed_anchors.join(sizes, "anchor")
        .groupBy("digest")
        .agg(F.collect_list(F.struct("anchor", "stretch", "start", "n", (F.col("times") == 1).alias("once"), "turns")).alias("asked")),
        "asked",
    )
    cut, cut_uri = stored(
        docs.select("digest", "text")
        .join(asked, "digest")
        .mapInArrow(lambda x: _cut(x, length), "anchor long, stretch binary, once boolean, turns int, digest binary, start long, data binary"),
        "cut",
    )
    spans = "digest binary, start long, end long"
    by_anchor = cut.where("turns = 1").repartition("anchor").sortWithinPartitions("anchor", "stretch").mapInArrow(lambda x: _sorted_groups(x, length), spans)
    by_turn = (
        cut.where("turns > 1")
        .mapInArrow(lambda x: _turned(x, length), "anchor long, turn int, turns int, symbol long, stretch binary, once boolean, digest binary, start long, size long, place long, symbols binary")
        .repartition("anchor", "turn", "symbol")
        .sortWithinPartitions("anchor", "turn", "symbol", "stretch")
        .mapInArrow(lambda x: _sorted_turns(x, length), spans)
    )
    windows = cut.where("turns = 0").dropDuplicates(["anchor", "stretch"]).mapInArrow(
        lambda x: _windowed(x, length), "window binary, digest binary, at long, once boolean"
    )
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("window")
    by_count = windows.where("once").join(twice, "window", "left_semi").select("digest", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return whole.unionByName(by_anchor).unionByName(by_turn).unionByName(by_count), [occurring_uri, distinct_uri, sizes_uri, asked_uri, cut_uri]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = MOST, words: int | None = None) -> DataFrame:
    """(key, spans array<struct<start, end>>, kept binary): the removed runs of bytes and what is left, for each row of ``docs``.

    length: a multiple of four, and at least 40.
    words: asks for a column more, passage boolean: the text has as many words in a row that are anywhere else too, the
    same text included; 10 at least.
    """
    if length % _SYMBOLS or length < _GRAM + 8:
        raise ValueError("length must be a multiple of 4 and at least 40")
    if words is not None and words * _CODE < _GRAM + 8:
        raise ValueError("words must be at least 10")
    rows = keyed_texts(docs, key, text).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    spans, uris = repeated_spans(rows, length, most)
    found, _ = stored(spans.groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans")
    remove(docs.sparkSession, *uris)
    told = []
    if words is not None:
        coded = rows.select("digest", "text").mapInArrow(_coded, "digest binary, text binary")
        spans, uris = repeated_spans(coded, words * _CODE, most)
        passages, _ = stored(spans.select("digest").distinct().withColumn("passage", F.lit(True)), "passages")
        remove(docs.sparkSession, *uris)
        found, told = found.join(passages, "digest", "full"), ["passage"]
    return (
        rows.join(found, "digest", "left")
        .select("key", "text", "found", *(F.coalesce(x, F.lit(False)).alias(x) for x in told))
        .mapInArrow(_kept, "key long, spans array<struct<start long, end long>>, kept binary" + ", passage boolean" * len(told))
        .withColumnRenamed("key", key)
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes in whole ``documents``; ``repeated`` also tells of passages of over 50 words that are shorter and stay."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=WORDS).select(
        "doc_id",
        (F.octet_length("kept") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])).alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        ((F.size("spans") > 0) | F.col("passage")).alias("repeated"),
    )
