"""Texts cut at white space without copying them, and ids looked up once for each distinct part.

What a batch costs in Python then follows its distinct parts, not its words; the
rest are array operations.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def layout(texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where each text begins and the last one ends, from 0 on, and the bytes of all of them."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return at - at[0], data.slice(int(at[0]), int(at[-1] - at[0])) if data is not None else pa.py_buffer(b"")


def _space(b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether a white space character of two or three bytes ends before each of the places p."""
    last, mid, lead = b[p - 1], b[np.maximum(p - 2, 0)], b[np.maximum(p - 3, 0)]
    general = (mid == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)) | (mid == 0x81) & (last == 0x9F)
    return (
        (mid == 0xC2) & ((last == 0x85) | (last == 0xA0))
        | (lead == 0xE1) & (mid == 0x9A) & (last == 0x80)
        | (lead == 0xE2) & general
        | (lead == 0xE3) & (mid == 0x80) & (last == 0x80)
    )


def cut(texts: pa.Array, marks: bytes = b"") -> tuple[pa.LargeStringArray, np.ndarray]:
    """(parts, first): text i is parts[first[i]:first[i + 1]] put together; no text is null.

    A text is cut before every blank and line end that follows something other than white space, so a part is a run of
    white space and then a run of anything else; other white space cuts nothing. It is also cut before each of ``marks``,
    single ASCII characters, that follows an ASCII letter or digit.
    """
    at, data = layout(texts)
    b = np.frombuffer(data, np.uint8)
    starts = np.zeros(len(b), bool)
    starts[1:] = ((b[1:] == 32) | (b[1:] == 10)) & (b[:-1] > 32)
    p = np.flatnonzero(starts)
    p = p[b[p - 1] >= 0x80]
    starts[p[_space(b, p)]] = False
    if marks:
        mark, word = np.zeros(256, bool), np.array([x < 128 and chr(x).isalnum() for x in range(256)])
        mark[list(marks)] = True
        starts[1:] |= mark[b[1:]] & word[b[:-1]]
    starts[at[:-1][at[:-1] < at[1:]]] = True
    places = np.append(np.flatnonzero(starts), len(b))
    return pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), data), np.searchsorted(places, at)


def lists_of(ids: list[int], sizes: list[int]) -> pa.LargeListArray:
    """The ids of several parts in turn, so many of each, as lists."""
    ends = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.array(ids, np.uint32)))


class Known:
    """Ids of parts that were asked for: ``held`` of them, or as many as one call asks for. Full, it keeps those last asked for.

    learn: the lists of ids of different parts.
    """

    def __init__(self, learn: Callable[[list[str]], pa.LargeListArray], held: int):
        self.learn, self.held, self.calls = learn, held, 0
        self.parts, self.lists = pa.array([], pa.large_string()), lists_of([], [])
        self.used = np.empty(0, np.int64)  # the last call that asked for each part

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where different parts' lists are."""
        self.calls += 1
        if len(self.parts) > self.held:
            kept = pa.array(self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2])
            self.parts, self.lists, self.used = self.parts.filter(kept), self.lists.filter(kept), self.used[kept.to_numpy(zero_copy_only=False)]
        found = pc.index_in(parts, value_set=self.parts)
        new = parts.filter(pc.is_null(found))
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            at[at < 0] = len(self.parts) + np.arange(len(new))
            learnt = self.learn(new.to_pylist())
            self.parts, self.lists = pa.concat_arrays([self.parts, new]), pa.concat_arrays([self.lists, learnt])
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] = self.calls
        return at

    def __call__(self, parts: pa.Array) -> pa.LargeListArray:
        """A list for each part; parts may repeat."""
        found = parts.cast(pa.large_string()).dictionary_encode()
        places = self._places(found.dictionary)
        return self.lists.take(pa.array(places[found.indices.to_numpy()]))


def encoded(texts: pa.Array, known: Known, marks: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the ids of all texts in turn, those of text i in ids[first[i]:first[i + 1]]."""
    parts, first = cut(texts, marks)
    lists = known(parts)
    return lists.flatten().to_numpy(), lists.offsets.to_numpy()[first]


def sliced(values: np.ndarray | pa.Buffer, first: np.ndarray) -> pa.LargeBinaryArray:
    """A binary value for each two neighbours of ``first``, which are places in the bytes of ``values``."""
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(first, np.int64)), pa.py_buffer(values)])
