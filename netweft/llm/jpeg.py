"""Progressive JPEG: a decoder for many images at a time, and the encoder that media columns need.

The decoder takes 8-bit progressive Huffman files of one or three components
with any sampling factors from 1 to 4 that divide the largest one, any spectral
selection and successive approximation, and restart intervals. Scans are
accumulated into coefficient arrays; those are dequantised, transformed back,
the chroma brought to full resolution by repetition, and converted to RGB.

Entropy-coded segments, of which every restart interval is one, are decoded
side by side: a step takes one code of each segment that isn't at its end. So
the work is numpy's, in as many steps as the longest segment has codes, and
all images of a batch share the steps.

The inverse transform uses integers held in doubles, none of which exceeds 53
bits: its results don't depend on the order of additions or the batch's size.
"""
from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

# The zigzag order of a block's coefficients, row by row.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)

_BASIS_BITS = 13
_k = np.arange(8)
_BASIS = np.rint(np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None] * (1 << _BASIS_BITS))


class Component(NamedTuple):
    id: int
    h: int
    v: int
    table: int
    blocks: np.ndarray  # rows, columns, 64 coefficients in zigzag order
    across: int  # blocks that a scan of this component alone has in a row
    down: int


class Scan(NamedTuple):
    image: int
    parts: list[tuple[int, int]]  # component, Huffman table
    start: int
    end: int
    high: int
    low: int
    segments: list[bytes]
    every: int
    tables: dict[tuple[int, int], np.ndarray]


class Image(NamedTuple):
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    scans: list[Scan]
    comments: list[bytes]


def _lookup(counts: bytes, values: bytes) -> np.ndarray:
    """By the next 16 bits: the code's length << 8 | its value; 0 where no code begins so."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_lookups: dict[bytes, np.ndarray] = {}


def parse(data: bytes, number: int = 0) -> Image:
    """The headers and the undecoded scans of a file; number: what its scans call it."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, every = 2, 0
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], np.ndarray] = {}
    components: list[Component] = []
    scans: list[Scan] = []
    comments: list[bytes] = []
    width = height = 0
    while True:
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            return Image(width, height, components, quantisers, scans, comments)
        size = data[at] << 8 | data[at + 1]
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                quantisers[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.int64)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                whole = bytes(body[1:n])
                if whole not in _lookups:
                    if len(_lookups) > 256:
                        _lookups.clear()
                    _lookups[whole] = _lookup(whole[:16], whole[16:])
                tables[body[0] >> 4, body[0] & 15] = _lookups[whole]
                body = body[n:]
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xDD:
            every = body[0] << 8 | body[1]
        elif marker == 0xC2:
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3):
                raise ValueError("only 8-bit images of one or three components")
            of = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            hm, vm = max(x[1] >> 4 for x in of), max(x[1] & 15 for x in of)
            cols, rows = -(-width // (8 * hm)), -(-height // (8 * vm))
            for x in of:
                h, v = x[1] >> 4, x[1] & 15
                own = -(-width * h // (8 * hm)), -(-height * v // (8 * vm))
                components.append(Component(x[0], h, v, x[2], np.zeros((rows * v, cols * h, 64), np.int16), *own))
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF:
            raise ValueError("not a progressive Huffman file")
        elif marker == 0xDA:
            n = body[0]
            ids = [c.id for c in components]
            start, end, approx = body[1 + 2 * n : 4 + 2 * n]
            parts = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4 if start == 0 else body[2 + 2 * i] & 15) for i in range(n)]
            segments, at = _segments(data, at)
            scans.append(Scan(number, parts, start, end, approx >> 4, approx & 15, segments, every, dict(tables)))


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded segments from ``at`` without stuffed zeros, and where the next marker is."""
    end = at
    while True:
        end = data.index(b"\xff", end)
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
        else:
            break
    body = np.frombuffer(data, np.uint8)[at:end]
    marks = np.flatnonzero((body[:-1] == 0xFF) & (body[1:] >= 0xD0) & (body[1:] <= 0xD7)).tolist() if len(body) else []
    cuts = [0, *(m + 2 for m in marks)]
    return [data[at + a : at + b].replace(b"\xff\x00", b"\xff") for a, b in zip(cuts, [*marks, len(body)])], end


def _windows(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 24 bits from every byte of the segments, one after the other, and the bit where each begins; ones follow each."""
    sizes = np.array([len(x) for x in segments], np.int64) + 8
    data = np.frombuffer(b"".join(x + b"\xff" * 8 for x in segments), np.uint8).astype(np.int32)
    wide = np.zeros(len(data), np.int32)
    wide[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return wide, (np.cumsum(sizes) - sizes) * 8


def _peek(wide: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next 16 bits of each."""
    return (wide.take(at >> 3) >> (8 - (at & 7))) & 0xFFFF


def _value(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number of n bits with the sign that JPEG gives it."""
    return np.where((n > 0) & (bits < (1 << np.maximum(n - 1, 0))), bits - (1 << n) + 1, bits)


def _whole(table: np.ndarray) -> np.ndarray:
    """For AC codes, by the next 16 bits: value << 16 | run << 8 | bits of code and value, where these are 16 at most and the
    value isn't 0; else the bits are 0."""
    ahead = np.arange(1 << 16)
    length, run, n = table >> 8, table >> 4 & 15, table & 15
    fits = (length > 0) & (n > 0) & (length + n <= 16)
    value = _value(ahead >> np.maximum(16 - length - n, 0) & ((1 << n) - 1), n)
    return np.where(fits, value << 16 | run << 8 | length + n, 0).astype(np.int64)


_wholes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _whole_of(table: np.ndarray) -> np.ndarray:
    known = _wholes.get(id(table))
    if known is None or known[0] is not table:
        if len(_wholes) > 64:
            _wholes.clear()
        known = _wholes[id(table)] = table, _whole(table)
    return known[1]


_NO_TABLE = np.zeros(1 << 16, np.int32)


def accumulate(images: list[Image]) -> None:
    """Decodes every scan of every image into the components' coefficient arrays."""
    for r in range(max((len(im.scans) for im in images), default=0)):
        kinds: dict[tuple, list[Scan]] = {}
        for im in images:
            if r < len(im.scans):
                s = im.scans[r]
                kinds.setdefault((s.start, s.end, s.high, s.low), []).append(s)
        for (start, end, high, low), scans in kinds.items():
            _accumulate(images, scans, start, end, high, low)


def _accumulate(images: list[Image], scans: list[Scan], start: int, end: int, high: int, low: int) -> None:
    """Scans of one kind: their blocks' coefficients are gathered in one array, in coding order, and put back."""
    segments: list[bytes] = []
    counts: list[int] = []  # blocks of each segment
    tables: list[np.ndarray] = []
    numbers: dict[int, int] = {}
    gathered: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # a component's blocks, their places here, first row, step
    which: list[np.ndarray] = []  # for each segment, or for DC for each row: the table
    components: list[np.ndarray] = []
    total = 0
    for s in scans:
        im, own = images[s.image], []
        for _, t in s.parts:
            table = s.tables.get((int(start > 0), t), _NO_TABLE)
            if id(table) not in numbers:
                numbers[id(table)] = len(tables)
                tables.append(table)
            own.append(numbers[id(table)])
        if len(s.parts) == 1:
            c = im.components[s.parts[0][0]]
            places = ((np.arange(c.down) * c.blocks.shape[1])[:, None] + np.arange(c.across)).ravel()
            units, per = len(places), 1
            gathered.append((c.blocks.reshape(-1, 64), places, total, 1))
        else:
            cells = []
            first = im.components[s.parts[0][0]]
            rows, cols = first.blocks.shape[0] // first.v, first.blocks.shape[1] // first.h
            units = rows * cols
            for k, (n, _) in enumerate(s.parts):
                c = im.components[n]
                for y in range(c.v):
                    for x in range(c.h):
                        cells.append((k, c, ((np.arange(rows) * c.v + y) * c.blocks.shape[1])[:, None] + np.arange(cols) * c.h + x))
            per = len(cells)
            gathered += [(c.blocks.reshape(-1, 64), places.ravel(), total + j, per) for j, (_, c, places) in enumerate(cells)]
            own = [own[k] for k, _, _ in cells]
        every = s.every or units
        if len(s.segments) != -(-units // every):
            raise ValueError("a scan has too few or too many restart intervals")
        segments += s.segments
        counts += [per * min(every, units - k) for k in range(0, units, every)]
        if start:
            which.append(np.full(len(s.segments), own[0]))
        else:
            which.append(np.tile(own, units))
            components.append(np.tile([k for k, _, _ in cells] if per > 1 else [0], units))
        total += units * per
    coefs = np.zeros((total, end - start + 1), np.int32)
    if high:
        for blocks, places, at, step in gathered:
            coefs[at : at + step * len(places) : step] = blocks[places, start : end + 1]
    sizes = np.array(counts)
    base = np.cumsum(sizes) - sizes
    wide, at = _windows(segments)
    if start == 0 and high:
        _dc_refine(wide, at, coefs, base, sizes, low)
    elif start == 0:
        _dc_first(wide, at, tables, np.concatenate(which), np.concatenate(components), coefs, base, sizes, low)
    elif high:
        _ac_refine(wide, at, tables, np.concatenate(which), coefs, base, sizes, low)
    else:
        _ac_first(wide, at, tables, np.concatenate(which), coefs, base, sizes, low)
    for blocks, places, at, step in gathered:
        blocks[places, start : end + 1] = coefs[at : at + step * len(places) : step]


def _codes(wide: np.ndarray, at: np.ndarray, flat: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Takes a code of each: moves ``at`` and returns the values."""
    found = flat.take((which << 16) + _peek(wide, at))
    if not found.all():
        raise ValueError("no Huffman code starts so")
    at += found >> 8
    return found & 255


def _dc_refine(wide, at, coefs, base, sizes, low) -> None:
    """One bit for each block."""
    lane = np.repeat(np.arange(len(sizes)), sizes)
    bit = at[lane] + np.arange(len(coefs)) - base[lane]
    coefs[:, 0] |= (_peek(wide, bit) >> 15) << low


def _dc_first(wide, at, tables, which, components, coefs, base, sizes, low) -> None:
    """Differences from the component's last block of the segment."""
    flat, last = np.concatenate(tables), np.zeros((len(sizes), 4), np.int64)
    for step in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > step)
        row, here = base[on] + step, at[on]
        n = _codes(wide, here, flat, which[row]).astype(np.int64)
        last[on, components[row]] += _value(_peek(wide, here) >> (16 - n), n)
        at[on] = here + n
        coefs[row, 0] = last[on, components[row]] << low


def _ac_first(wide, at, tables, which, coefs, base, sizes, low) -> None:
    width, out = coefs.shape[1], coefs.reshape(-1)
    flat, whole = np.concatenate(tables), np.concatenate([_whole_of(x) for x in tables])
    on = np.flatnonzero(sizes)
    # Of segments that aren't at their end: next bit, next coefficient, the end of its block and of the segment, the table.
    at, go, end, which = at[on], base[on] * width, (base[on] + sizes[on]) * width, which[on] << 16
    stop = go + width
    several = len(tables) > 1
    while len(at):
        ahead = _peek(wide, at)
        found = whole.take(ahead + which) if several else whole.take(ahead)
        bits = found & 255
        if bits.all():
            at += bits
            go += found >> 8 & 15
            if (go >= stop).any():
                raise ValueError("a run leaves its block")
            out[go] = (found >> 16) << low
            go += 1
        else:
            code = flat.take(ahead + which)
            if not code.all():
                raise ValueError("no Huffman code starts so")
            at += code >> 8
            run, n = code >> 4 & 15, code & 15
            value = _value(_peek(wide, at) >> (16 - n), n)
            at += n
            ended = (n == 0) & (run < 15)
            go += np.where(ended, 0, run)
            if (go >= stop).any():
                raise ValueError("a run leaves its block")
            put = n > 0
            out[go[put]] = value[put] << low
            go += 1
            if ended.any():  # this block, and as many as are named
                r = run[ended]
                more = (1 << r) + (_peek(wide, at[ended]) >> (16 - r))
                at[ended] += r
                stop[ended] += (more - 1) * width
                go[ended] = stop[ended]
        full = go >= stop
        if full.any():
            stop[full] += width
            if (go >= end).any():
                left = go < end
                at, go, end, which, stop = at[left], go[left], end[left], which[left], stop[left]


def _corrected(old: np.ndarray, fix: np.ndarray, one: int) -> np.ndarray:
    return np.where(fix & ((np.abs(old) & one) == 0), old + np.sign(old) * one, old)


def _ac_refine(wide, at, tables, which, coefs, base, sizes, low) -> None:
    """One bit for each coefficient that is known, and new ones among those that are not."""
    width, one, flat = coefs.shape[1], 1 << low, np.concatenate(tables)
    which = which << 16
    block, k, skip, value = (np.zeros(len(sizes), np.int64) for _ in range(4))  # skip: blocks that get correction bits only
    zeros = np.full(len(sizes), -1, np.int64)  # to pass before the value is put
    on = np.flatnonzero(sizes)
    while len(on):
        ask = on[(skip[on] == 0) & (zeros[on] < 0)]
        if len(ask):
            here = at[ask]
            found = flat.take(which[ask] + _peek(wide, here))
            if not found.all():
                raise ValueError("no Huffman code starts so")
            here += found >> 8
            run, n = (found >> 4 & 15).astype(np.int64), found & 15
            ended = (n == 0) & (run < 15)
            more = _peek(wide, here)
            skip[ask] = np.where(ended, (1 << run) + (more >> (16 - run)), 0)
            zeros[ask] = np.where(ended, -1, run)
            value[ask] = np.where(n > 0, np.where(more >> 15 > 0, one, -one), 0)
            at[ask] = here + np.where(ended, run, np.minimum(n, 1))
        rest = skip[on] > 0
        # What is left of a block that only gets correction bits is taken at once.
        e = on[rest]
        if len(e):
            rows = base[e] + block[e]
            old = coefs[rows]
            known = (old != 0) & (np.arange(width) >= k[e][:, None])
            count = np.cumsum(known, axis=1)
            bit = _peek(wide, (at[e][:, None] + np.maximum(count - 1, 0)).ravel()).reshape(old.shape) >> 15 > 0
            coefs[rows] = _corrected(old, bit & known, one)
            at[e] += count[:, -1]
            k[e] = width
        g = on[~rest]
        if len(g):
            row = base[g] + block[g]
            old = coefs[row, k[g]]
            known = old != 0
            c = g[known]
            coefs[row[known], k[c]] = _corrected(old[known], _peek(wide, at[c]) >> 15 > 0, one)
            at[c] += 1
            z = g[~known]
            put = z[zeros[z] == 0]
            coefs[base[put] + block[put], k[put]] = value[put]
            zeros[z] -= 1
            k[g] += 1
        done = on[k[on] >= width]
        if (zeros[done][skip[done] == 0] >= 0).any():
            raise ValueError("a run leaves its block")
        block[done] += 1
        skip[done] = np.maximum(skip[done] - 1, 0)
        k[done] = 0
        on = on[block[on] < sizes[on]]


def _samples(c: Component, quantiser: np.ndarray) -> np.ndarray:
    """A component's samples, in whole blocks."""
    flat = np.zeros((c.blocks.shape[0] * c.blocks.shape[1], 64))
    flat[:, ZIGZAG] = c.blocks.reshape(-1, 64) * quantiser
    half = (flat.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    full = (half.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    out = np.floor(full / (1 << 2 * _BASIS_BITS) + 0.5) + 128
    rows, cols = c.blocks.shape[:2]
    return np.clip(out, 0, 255).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def rgb(im: Image) -> np.ndarray:
    """height x width x 3 unsigned bytes of an image whose scans are accumulated."""
    hm, vm = max(c.h for c in im.components), max(c.v for c in im.components)
    planes = []
    for c in im.components:
        x = _samples(c, im.quantisers[c.table])
        planes.append(x.repeat(vm // c.v, 0).repeat(hm // c.h, 1)[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    # The conversion of JFIF, in 65536ths.
    out = np.stack((y * 65536 + 91881 * cr, y * 65536 - 22554 * cb - 46802 * cr, y * 65536 + 116130 * cb), axis=2)
    return np.clip(np.floor(out / 65536 + 0.5), 0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[Image]:
    """The images with their coefficients; ``rgb`` gives their samples."""
    images = [parse(x, i) for i, x in enumerate(files)]
    accumulate(images)
    return images
