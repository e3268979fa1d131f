"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can be the last of
the prefix's encoding (the encoding of a prefix that ends where a token of the
whole ends is that of the whole, cut off). The table of those last tokens is
the encoder's whole state: following it backwards gives the tokens, appended
bytes only add entries, pieces that begin alike share entries, and after an edit entries are made again only until
they agree with the old ones for as many positions as the longest token has
bytes. A token may follow another one if merging the two of them would not have
met across their boundary; that is decided by undoing merges on either side.

``encode`` and ``decode`` work on tables without a shuffle. Null or empty text
has no tokens. Repeated rows have one result each; other columns are ignored. A
very long text is encoded whole, and a very long piece in time that grows with
its length. An empty table: no rows.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweft.llm.batches import keyed_texts, merged, pieces
from netweft.llm.parts import Known, encoded, layout, lists_of, sliced

_NONE = -1


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """The vocabulary of a rank file, and how each token arose."""

    def __init__(self, path: str):
        self.ranks = _ranks(path)
        self.token = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.met: dict[int, int] = {}  # left << 32 | right -> the token that the two become
        self.usable: dict[bytes, int] = {}
        for t, i in self.ranks.items():
            parts = self._merged(t, i)
            if len(parts) == 2:
                a, b = (self.ranks[x] for x in parts)
                self.left[i], self.right[i] = a, b
                self.met[a << 32 | b] = i
            elif len(parts) == 1:
                self.left[i] = self.right[i] = i
            else:
                continue  # no merges lead to it; only a piece that is this very token becomes it
            self.usable[t] = i
        #: By the last bytes, three at most, the lengths that usable tokens with that end have, longest first.
        self.sizes: dict[bytes, tuple[int, ...]] = {}
        ends: dict[bytes, set[int]] = {}
        for t in self.usable:
            ends.setdefault(t[-3:], set()).add(len(t))
        for t, own in ends.items():
            for shorter in (t[1:], t[2:]):
                own |= {len(shorter)} & {n for n in (1, 2) if shorter in self.usable}
            self.sizes[t] = tuple(sorted(own, reverse=True))
        self.pairs: dict[int, bool] = {}

    def _merged(self, word: bytes, below: int) -> list[bytes]:
        """The word by plain merging with tokens of a rank under ``below``."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def sizes_at(self, piece: bytes, i: int) -> tuple[int, ...]:
        """The lengths, longest first, that a token which ends at byte ``i`` may have."""
        get = self.sizes.get
        return (i > 2 and get(piece[i - 3 : i])) or (i > 1 and get(piece[i - 2 : i])) or get(piece[i - 1 : i], ())

    def follows(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are side by side."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        # Undo the later merge first. A merge across the boundary counts only if it came before the one just undone.
        met, left, right, limit = self.met, self.left, self.right, 1 << 40
        while True:
            if met.get(a << 32 | b, limit) < limit:
                return False
            whole_a, whole_b = left[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            # Between equals the left side was merged first, so that the right one is undone first.
            if not whole_a and (whole_b or a > b):
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]


class PrefixState:
    """The last tokens of all prefixes of one piece, open to appends and edits."""

    def __init__(self, merges: Merges, piece: bytes = b""):
        self.merges, self.piece, self.last = merges, b"", [_NONE]
        self.append(piece)

    def _entry(self, i: int) -> int:
        m, piece, last = self.merges, self.piece, self.last
        usable, follows = m.usable, m.follows
        for n in m.sizes_at(piece, i):
            t = usable.get(piece[i - n : i]) if n <= i else None
            if t is not None and (n == i or follows(last[i - n], t)):
                return t
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Only the new prefixes are worked out."""
        old, self.piece = len(self.piece), self.piece + more
        for i in range(old + 1, len(self.piece) + 1):
            self.last.append(self._entry(i))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of bytes start to end; returns how many entries were made again."""
        tail, size = self.last[end + 1 :], len(self.piece) - (end - start) + len(new)
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.last[start + 1 :]
        settled = start + len(new)  # entries after this one belong to bytes that were there before
        same = made = 0
        for i in range(start + 1, size + 1):
            if same >= self.merges.longest:
                self.last += tail[i - settled - 1 :]
                break
            self.last.append(self._entry(i))
            made += 1
            same = same + 1 if i > settled and self.last[i] == tail[i - settled - 1] else 0
        return made

    def tokens(self) -> list[int]:
        out, i = [], len(self.piece)
        while i:
            out.append(self.last[i])
            i -= len(self.merges.token[self.last[i]])
        return out[::-1]


def encode_pieces(merges: Merges, found: list[bytes]) -> list[list[int]]:
    """The ids of pieces in ascending order. Neighbours share prefixes, whose last tokens are kept.

    A piece that is a token is that token; any other is encoded by its prefixes.
    """
    usable, sizes, pairs, follows, token, ranks = merges.usable.get, merges.sizes.get, merges.pairs, merges.follows, merges.token, merges.ranks.get
    last, before, out = [_NONE], b"", []
    for piece in found:
        whole = ranks(piece)
        if whole is not None:
            out.append([whole])
            continue
        size, same = len(piece), min(len(piece), len(before))
        if piece[:same] != before[:same]:
            same = next(k for k in range(same) if piece[k] != before[k])
        del last[same + 1 :]
        before = piece
        for i in range(same + 1, size + 1):
            for n in (i > 2 and sizes(piece[i - 3 : i])) or (i > 1 and sizes(piece[i - 2 : i])) or sizes(piece[i - 1 : i], ()):
                if n < i:
                    t = usable(piece[i - n : i])
                    if t is not None:
                        known = pairs.get(last[i - n] << 32 | t)
                        if known or known is None and follows(last[i - n], t):
                            break
                elif n == i:
                    t = usable(piece[:i])
                    if t is not None:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
        ids, i = [], size
        while i:
            ids.append(last[i])
            i -= len(token[last[i]])
        out.append(ids[::-1])
    return out


def encode_piece(merges: Merges, piece: bytes) -> list[int]:
    return encode_pieces(merges, [piece])[0]


#: Signs that no piece of the default pattern has after a letter or a digit.
MARKS = b",.;:!?"


class Encoder:
    """Texts to ids: parts between blanks are split into pieces, and pieces encoded, once and then looked up."""

    def __init__(self, path: str, pattern: str, held: int = 1_000_000):
        self.path, self.split = path, regex.compile(pattern)
        self.apart = pattern == public_tokenizers.PATTERN  # of another pattern it isn't known where its pieces end
        self.pieces, self.parts = Known(self._pieces, held), Known(self._parts, held)

    @cached_property
    def merges(self) -> Merges:
        return Merges(self.path)

    @cached_property
    def tokens(self) -> tuple[np.ndarray, pa.Array]:
        """Of which ids there are tokens, and the bytes of all of them by id."""
        by_id = {i: t for t, i in _ranks(self.path).items()}
        there = np.zeros(max(by_id) + 1, bool)
        there[list(by_id)] = True
        return there, pa.array([by_id.get(i, b"") for i in range(len(there))], pa.large_binary())

    def _pieces(self, found: list[str]) -> pa.LargeListArray:
        raw = [x.encode() for x in found]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        own: list[list[int]] = [[]] * len(raw)
        for k, ids in zip(order, encode_pieces(self.merges, [raw[k] for k in order])):
            own[k] = ids
        return lists_of([i for ids in own for i in ids], list(map(len, own)))

    def _parts(self, texts: list[str]) -> pa.LargeListArray:
        split = list(map(self.split.findall, texts))
        lists = self.pieces(pa.array([x for own in split for x in own], pa.large_string()))
        ends = np.concatenate(([0], np.cumsum(np.array(list(map(len, split)), np.int64))))
        return pa.LargeListArray.from_arrays(pa.array(lists.offsets.to_numpy()[ends]), lists.flatten())

    def encode_all(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """For each text its ids, little-endian unsigned 32-bit integers; no text is null."""
        if self.apart:
            ids, first = encoded(texts, self.parts, MARKS)
        else:
            lists = self._parts(texts.to_pylist())
            ids, first = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        return sliced(ids, first * 4)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def decode_all(self, ids: pa.Array) -> pa.LargeBinaryArray:
        """The bytes that each value's ids stand for; null ids are none."""
        at, data = layout(ids.fill_null(b""))
        if (at % 4).any():
            raise ValueError("ids have four bytes each")
        own, (there, tokens) = np.frombuffer(data, "<u4"), self.tokens
        if len(own) and (own.max() >= len(there) or not there[own].all()):
            raise ValueError("an id is not in the vocabulary")
        taken = tokens.take(pa.array(own, pa.uint32()))
        ends, out = layout(taken)
        return sliced(out, ends[at // 4])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all(pa.array([ids], pa.binary()))[0].as_py()


_made: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python process, whatever the number of tasks."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Encoder(path, pattern)
    return _made[path, pattern]


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, ids binary): little-endian unsigned 32-bit ids of the whole text."""
    path = ranks or default_ranks()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for part in pieces(merged(batches, 6 << 20), limit=8 << 20):
            yield pa.RecordBatch.from_arrays([part.column("key"), e.encode_all(part.column("text")).cast(pa.binary())], ["key", "ids"])

    return keyed_texts(docs, key, text).mapInArrow(mapped, "key long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``decoded`` (binary) to (key, ids); null ids decode to no bytes."""
    path = ranks or default_ranks()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for part in pieces(batches, "ids"):
            yield part.append_column("decoded", e.decode_all(part.column("ids")).cast(pa.binary()))

    return (
        encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
        .mapInArrow(mapped, "key long, ids binary, decoded binary")
        .withColumnsRenamed({"key": key, "ids": ids})
    )


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Per document: its number of tokens, the digest of its ids and of the bytes that they decode to."""
    return decode(encode(docs)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """``encode`` and ``decode`` over whole ``documents``."""
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
