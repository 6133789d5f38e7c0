"""Lossless WebP (VP8L): payloads as pixels, written and read many images at a time.

The reader takes one token from each image a step (a literal, a cache hit or a back-reference), so
that its work is in array operations over all images of a group, whatever codes these have.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.llm.common import table, text_or_empty

#: Fixed values of the format: the order in which lengths of the code length code are sent, the
#: multiplier of the colour cache, and the offsets (x, y) of the 120 shortest distance codes.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = np.uint32(0xFF000000)  # opaque
LOW, HIGH = np.uint32(0x7F7F7F7F), np.uint32(0x80808080)

#: Kinds of the predictor modes: means of two neighbours (or of one with itself), of two means, and three others; modes 14 and 15 are black.
#: The neighbours that means are of: left, top, top right, top left, black. Which modes look at the row above only.
KIND = np.array([0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 2, 3, 4, 0, 0], np.uint8)
LEFT_AT, TOP_AT, RIGHT_AT, CORNER_AT, BLACK_AT = range(5)
NEIGHBOURS = np.full((16, 4), BLACK_AT)
for _m, _n in {
    1: (LEFT_AT, LEFT_AT), 2: (TOP_AT, TOP_AT), 3: (RIGHT_AT, RIGHT_AT), 4: (CORNER_AT, CORNER_AT), 5: (LEFT_AT, RIGHT_AT, TOP_AT, TOP_AT), 6: (LEFT_AT, CORNER_AT),
    7: (LEFT_AT, TOP_AT), 8: (CORNER_AT, TOP_AT), 9: (TOP_AT, RIGHT_AT), 10: (LEFT_AT, CORNER_AT, TOP_AT, RIGHT_AT),
}.items():
    NEIGHBOURS[_m, : len(_n)] = _n
ROW_FREE = np.isin(np.arange(16), (0, 2, 3, 4, 8, 9, 14, 15))
ROW, MAX_SIDE, MAX_RUN, MAX_BITS = 16, 16384, 4096, 15

_REVERSED = np.zeros(1 << MAX_BITS, np.uint16)
for _b in range(MAX_BITS):
    _REVERSED |= ((np.arange(1 << MAX_BITS) >> _b & 1) << (MAX_BITS - 1 - _b)).astype(np.uint16)


# ---------------------------------------------------------------- writing


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete prefix code lengths of at most 15 for each row of counts; rows with one symbol get length 1 for it.

    A symbol starts with the bits that its share asks for, rounded up, which leaves room; the room
    is then given to symbols in order of count until the code is complete.
    """
    row, symbol = np.nonzero(counts)
    c = counts[row, symbol].astype(np.int64)
    c = np.maximum(c, np.maximum(1, -(-counts.sum(axis=1) >> 13))[row])
    total = np.bincount(row, weights=c, minlength=len(counts)).astype(np.int64)[row]
    length = np.clip(np.frexp((-(-total // c) - 1).astype(float))[1].astype(np.int64), 1, MAX_BITS)
    lens = np.zeros(counts.shape, np.int64)
    lens[row, symbol] = length
    unit, used = 1 << MAX_BITS, np.bincount(row, minlength=len(counts))
    room = np.where(used > 1, unit - np.bincount(row, weights=unit >> length, minlength=len(counts)).astype(np.int64), 0)
    by_count = np.argsort(row * (int(c.max(initial=0)) + 1) - c, kind="stable")
    first = np.cumsum(used) - used
    while len(live := np.nonzero(room > 0)[0]):
        for k in range(int(used[live].max())):
            live = r = live[(used[live] > k) & (room[live] > 0)]
            if not len(r):
                break
            s = symbol[by_count[first[r] + k]]
            own = lens[r, s]
            cost = np.where(own > 1, unit >> own, unit + 1)
            take = cost <= room[r]
            lens[r[take], s[take]] -= 1
            room[r[take]] -= cost[take]
    return lens


def canonical(lens: np.ndarray) -> np.ndarray:
    """Codes as sent (first bit lowest) for each row of lengths: the share of the code space before a symbol, cut to its length."""
    out = np.zeros(lens.shape, np.int64)
    row, symbol = np.nonzero(lens)
    length = lens[row, symbol]
    order = np.argsort((row << 4 | length).astype(np.uint16 if len(lens) <= 4096 else np.int64), kind="stable")
    row, symbol, length = row[order], symbol[order], length[order]
    share = (1 << MAX_BITS) >> length
    before = np.cumsum(share) - share
    begins = np.searchsorted(row, row)
    out[row, symbol] = _REVERSED[np.minimum(before - before[begins], (1 << MAX_BITS) - 1)] & ((1 << length) - 1)
    return out


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and extra bits of lengths and distances (from 1)."""
    v = value.astype(np.int64) - 1
    top = np.maximum(1, np.frexp(np.maximum(v, 1).astype(float))[1] - 1)
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + (v >> (top - 1) & 1))
    return symbol, extra, v & ((1 << extra) - 1)


class Bits:
    """Bit fields put at given places, many at once."""

    def __init__(self, size: int):
        self.words = np.zeros(size // 32 + 3, np.uint64)

    def put(self, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
        use = widths > 0
        at, values = at[use].astype(np.int64), values[use].astype(np.uint64)
        shifted = values << (at & 31).astype(np.uint64)
        np.add.at(self.words, at >> 5, shifted & np.uint64(0xFFFFFFFF))
        np.add.at(self.words, (at >> 5) + 1, shifted >> np.uint64(32))

    def bytes(self) -> bytes:
        return self.words.astype("<u4").tobytes()


def _previous(key: np.ndarray) -> np.ndarray:
    """For each place the last one before it with an equal key, or -1."""
    order = np.argsort(key)
    run = np.cumsum(np.concatenate(([0], key[order[1:]] != key[order[:-1]])))
    both = np.sort(run << 40 | order)  # equal keys by place
    order, same = both & ((1 << 40) - 1), np.diff(both >> 40) == 0
    out = np.full(len(key), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)


def tokens_of(pixels: np.ndarray, image: np.ndarray, cache_bits: int, references: bool) -> tuple[np.ndarray, ...]:
    """(place, kind, a, b) of the tokens of pixels, by place: kind 0 literal, 1 cache hit with index a, 2 run of a pixels from b before."""
    n = len(pixels)
    start, length, back = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if references and n > 3:
        p = pixels.astype(np.uint64)
        three = _mixed(_mixed(_mixed(image[:-2].astype(np.uint64) << np.uint64(32) | p[:-2]) + p[1:-1]) + p[2:])
        last = _previous(three)
        i = np.arange(n - 2)
        ok = (last >= 0) & (image[2:] == image[:-2])
        ok[ok] &= (pixels[last[ok]] == pixels[i[ok]]) & (pixels[last[ok] + 1] == pixels[i[ok] + 1]) & (pixels[last[ok] + 2] == pixels[i[ok] + 2]) & (image[last[ok]] == image[i[ok]])
        gap = np.where(ok, i - last, 0)
        gap[gap > 1 << 18] = 0
        begins = (gap > 0) & np.concatenate(([True], gap[1:] != gap[:-1]))
        at = np.nonzero(begins)[0]
        if len(at):
            stops = np.nonzero((gap > 0) & np.concatenate((gap[1:] != gap[:-1], [True])))[0] + 3
            sizes = np.minimum(stops, np.concatenate((at[1:], [n]))) - at
            pieces = -(-sizes // MAX_RUN)  # runs over the longest are sent in pieces
            part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.repeat(at, pieces) + part * MAX_RUN
            length = np.minimum(MAX_RUN, np.repeat(at + sizes, pieces) - start)
            back = np.repeat(gap[at], pieces)
            good = length >= 3
            start, length, back = start[good], length[good], back[good]
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + length, -1)
    free = np.cumsum(inside)[:n] == 0
    kind, a, b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if cache_bits:
        slot = (pixels * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        last = np.full(n, -1, np.int64)
        last[order[1:]] = np.where((slot[order[1:]] == slot[order[:-1]]) & (image[order[1:]] == image[order[:-1]]), order[:-1], -1)
        hit = (last >= 0) & free
        hit[hit] = pixels[last[hit]] == pixels[hit]
        kind[hit], a[hit] = 1, slot[hit]
    kind[start], a[start], b[start] = 2, length, back
    free[start] = True
    at = np.nonzero(free)[0]
    return at, kind[at], a[at], b[at]


@dataclass
class Image:
    """An image to write: pixels are ARGB numbers in rows; head holds the (value, width) fields before its codes."""

    pixels: np.ndarray
    width: int
    height: int
    head: list[tuple[int, int]] = field(default_factory=list)


def _distance_codes(back: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The distance code of each number of pixels: that of the pixel above or to the left if it is one, else past the near ones."""
    return np.where(back == width, 1, np.where(back == 1, 2, back + len(NEAR)))


def write_entropy(images: list[Image], cache_bits: int = 0, references: bool = True, main: bool = True) -> list[tuple[bytes, int]]:
    """The bit stream of each image, and its length in bits: head, cache and meta flags (if main), five codes, tokens."""
    n = len(images)
    image = np.repeat(np.arange(n), [len(i.pixels) for i in images])
    pixels = np.concatenate([i.pixels for i in images]).astype(np.uint32)
    at, kind, a, b = tokens_of(pixels, image, cache_bits, references)
    own, px = image[at], pixels[at].astype(np.int64)
    width = np.array([i.width for i in images])[own]
    literal, run = kind == 0, kind == 2
    runs = np.nonzero(run)[0]
    run_symbol, run_extra, run_bits, far_symbol, far_extra, far_bits = np.zeros((6, len(at)), np.int64)
    run_symbol[runs], run_extra[runs], run_bits[runs] = prefix_of(a[runs])
    far_symbol[runs], far_extra[runs], far_bits[runs] = prefix_of(_distance_codes(b[runs], width[runs]))
    green = np.where(literal, px >> 8 & 255, np.where(run, 256 + run_symbol, 280 + a))
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    symbols = (green, px >> 16 & 255, px & 255, px >> 24, far_symbol)
    use = (np.ones(len(at), bool), literal, literal, literal, run)
    lens, codes, single = [], [], []
    for size, s, u in zip(sizes, symbols, use, strict=True):
        counts = np.bincount(own[u] * size + s[u], minlength=n * size).reshape(n, size)
        alone = (counts > 0).sum(axis=1) < 2
        lengths = code_lengths(counts)
        value = np.where(counts.any(axis=1), counts.argmax(axis=1), 0)
        codes.append(np.where(alone[:, None], 0, canonical(lengths)))
        single.append((alone, value))
        lens.append(np.where(alone[:, None], 0, lengths))

    # Fields before the tokens: images, places in their streams, values, widths. Bits that are 0 are not put.
    fields, before, every = [], np.zeros(n, np.int64), np.arange(n)

    def add(value, bits):
        bits = np.broadcast_to(np.asarray(bits), (n,))
        fields.append((every, before.copy(), np.broadcast_to(np.asarray(value), (n,)), bits))
        before[:] += bits

    held = np.array([len(i.head) for i in images])
    if held.any():
        value, width_ = np.array([f for i in images for f in i.head], np.int64).T
        whose, stops = np.repeat(every, held), np.cumsum(width_)
        begins = np.concatenate(([0], stops))[np.cumsum(held) - held]
        fields.append((whose, stops - width_ - begins[whose], value, width_))
        before += np.concatenate(([0], stops))[np.cumsum(held)] - begins
    add(1 if cache_bits else 0, 1)
    if cache_bits:
        add(cache_bits, 4)
    if main:
        add(0, 1)  # one group of codes
    for (alone, value), lengths in zip(single, lens, strict=True):
        add(np.where(alone, 0b101 | value << 3, 0), np.where(alone, 11, 1))
        for k in range(0, CODE_LENGTH_HEAD_BITS, 24):
            add(CODE_LENGTH_HEAD >> k & 0xFFFFFF, np.where(alone, 0, min(24, CODE_LENGTH_HEAD_BITS - k)))
        add(0, np.where(alone, 0, 1))
        bits = np.where(alone[:, None], 0, CODE_LENGTH_BITS[lengths]).astype(np.uint8)
        stops = np.cumsum(bits, axis=1, dtype=np.int32)
        row, symbol = np.nonzero(lengths)
        sent = bits[row, symbol]
        fields.append((row, before[row] + stops[row, symbol] - sent, CODE_LENGTH_CODES[lengths[row, symbol]], sent))
        before += stops[:, -1]

    def bits_of(k: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = (codes[k] << 4 | lens[k]).ravel()[own * sizes[k] + np.where(u, symbols[k], 0)]
        both = np.where(u, both, 0)
        return both >> 4, both & 15

    (gv, gw), (rv, rw), (bv, bw), (av, aw), (dv, dw) = (bits_of(k, u) for k, u in enumerate(use))
    first_v, first_w = gv | rv << gw, gw + rw
    first_v, first_w = np.where(run, first_v | run_bits << first_w, first_v), np.where(run, first_w + run_extra, first_w)
    second_v, second_w = np.where(run, dv | far_bits << dw, bv | av << bw), np.where(run, dw + far_extra, bw + aw)
    token_bits = np.bincount(own, weights=first_w + second_w, minlength=n).astype(np.int64)
    total = before + token_bits
    room = (total + 31) // 32 * 32
    base = np.concatenate(([0], np.cumsum(room)))
    out = Bits(int(base[-1]))
    for whose, place, value, bits in fields:
        out.put(base[whose] + place, value, bits)
    both = first_w + second_w
    place = np.cumsum(both) - both
    place += (base[:-1] + before - (np.cumsum(token_bits) - token_bits))[own]
    out.put(place, first_v, first_w)
    out.put(place + first_w, second_v, second_w)
    flat = out.bytes()
    return [(flat[base[i] // 8 : base[i + 1] // 8], int(total[i])) for i in range(n)]


def _code_length_code() -> tuple[int, int, np.ndarray, np.ndarray]:
    """The fixed code in which lengths are sent: 1 bit for 0, 4 for 15, 5 for the others; and its own description."""
    lens = np.zeros((1, 19), np.int64)
    lens[0, 0], lens[0, 15], lens[0, 1:15] = 1, 4, 5
    value, width = len(CODE_ORDER) - 4, 4
    for s in CODE_ORDER:
        value |= int(lens[0, s]) << width
        width += 3
    return value, width, canonical(lens)[0, :16], lens[0, :16]


CODE_LENGTH_HEAD, CODE_LENGTH_HEAD_BITS, CODE_LENGTH_CODES, CODE_LENGTH_BITS = _code_length_code()


def container(stream: bytes) -> bytes:
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def write_images(images: list[Image], cache_bits: int = 0, references: bool = True) -> list[bytes]:
    """WebP files of images whose head holds their transforms' fields (see `transforms`)."""
    for i in images:
        size = [(0x2F, 8), (i.width - 1, 14), (i.height - 1, 14), (1, 1), (0, 3)]
        i.head = size + i.head + [(0, 1)]
    return [container(s[: -(-n // 8)]) for s, n in write_entropy(images, cache_bits, references)]


# ---------------------------------------------------------------- transforms


def _channels(pixels: np.ndarray) -> np.ndarray:
    """A, R, G, B of pixels as a last axis of signed numbers."""
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


# The four channels of pixels at once, without carries between them.


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a & LOW) + (b & LOW)) ^ ((a ^ b) & HIGH)


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a | HIGH) - (b & LOW)) ^ (~(a ^ b) & HIGH)


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> np.uint32(1) & LOW)


def _blocks(width: int, height: int, bits: int) -> tuple[int, int]:
    return (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits


def _rows(heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of images stacked: which image each is of, and its place there."""
    own = np.repeat(np.arange(len(heights)), heights)
    return own, np.arange(len(own)) - (np.cumsum(heights) - heights)[own]


def _spread(blocks: list[np.ndarray], bits: list[int], width: int, heights: np.ndarray) -> np.ndarray:
    """The values of each image's blocks at its pixels, images of one width stacked."""
    own, y = _rows(heights)
    shift, across = np.array(bits)[own], np.array([b.shape[1] for b in blocks])
    first = np.cumsum([0, *(b.size for b in blocks[:-1])])
    row = first[own] + (y >> shift) * across[own]
    return np.concatenate([b.ravel() for b in blocks])[row[:, None] + (np.arange(width) >> shift[:, None])]


def _bordered(modes: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Modes with those of borders: the first pixel of an image is predicted black, its first row from the left, its first column from above."""
    first = np.cumsum(heights) - heights
    modes = modes.astype(np.uint8)
    modes[:, 0] = 2
    modes[first] = 1
    modes[first, 0] = 0
    return modes


def _sources(kind: int, modes: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The places of the neighbours that modes of one kind look at from each place."""
    if kind > 1:
        return [at - 1, at - width, at - width - 1]
    back = np.array([1, width, width - 1, width + 1, 0])
    return [np.where(which == BLACK_AT, 0, at - back[which]) for which in (NEIGHBOURS[modes, k] for k in range(2 + 2 * kind))]


def predict(kind: int, seen: list[np.ndarray]) -> np.ndarray:
    """What modes of a kind (KIND) predict from the neighbours that `_sources` names: means of two, means of two means, and modes 11, 12, 13."""
    if kind == 0:
        return _mean(*seen)
    if kind == 1:
        return _mean(_mean(seen[0], seen[1]), _mean(seen[2], seen[3]))
    left, top, corner = (np.ascontiguousarray(s).view(np.uint8).reshape(-1, 4).astype(np.int16) for s in seen)
    if kind == 2:
        return np.where(np.abs(top - corner).sum(-1) < np.abs(left - corner).sum(-1), seen[0], seen[1])
    if kind == 3:
        p = left + top - corner
    else:
        a = (left + top) >> 1
        half = a - corner
        p = a + (np.abs(half) >> 1) * np.sign(half)
    return np.clip(p, 0, 255).astype(np.uint8).view(np.uint32).ravel()


def _framed(pixels: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels behind a black one and room for what lies before the first; and their places."""
    return np.concatenate((np.full(1, BLACK), np.zeros(width + 1, np.uint32), pixels.ravel())), np.arange(pixels.size) + width + 2


def forward_predictors(pixels: np.ndarray, heights: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """What predictors leave of stacked images (rows by columns), each pixel by its mode."""
    width = pixels.shape[1]
    flat, at = _framed(pixels, width)
    modes = _bordered(modes, heights).ravel()
    guess, kinds = np.empty(pixels.size, np.uint32), KIND[modes]
    for kind in np.unique(kinds).tolist():
        use = np.nonzero(kinds == kind)[0]
        guess[use] = predict(kind, [flat[s] for s in _sources(kind, modes[use], at[use], width)])
    return _difference(pixels, guess.reshape(pixels.shape))


def inverse_predictors(pixels: np.ndarray, heights: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Stacked images (rows by columns) from what predictors left of them, each pixel by its mode.

    Pixels are taken in steps, of all images at once: those whose neighbours are done. That is a row,
    after its first pixel, where an image's modes look at the row above only, and else a slanting line.
    """
    width = pixels.shape[1]
    flat, at = _framed(pixels, width)
    own, y = _rows(heights)
    free = (ROW_FREE[modes[:, 1:]].all(axis=1)) | (y == 0)
    free = np.bincount(own[~free], minlength=len(heights))[own] == 0
    x, y = np.arange(width), y[:, None]
    step = np.where(free[:, None] & (y > 0), width + 2 * (y - 1) + (x > 0), np.where(free[:, None], x, x + 2 * y)).ravel().astype(np.uint16)
    modes = _bordered(modes, heights).ravel()
    kinds, plans, most = KIND[modes], [], int(step.max()) + 1
    for kind in np.unique(kinds).tolist():
        use = np.nonzero(kinds == kind)[0]
        use = use[np.argsort(step[use], kind="stable")]
        stops = np.cumsum(np.bincount(step[use], minlength=most))
        plans.append((kind, at[use], _sources(kind, modes[use], at[use], width), [0, *stops.tolist()]))
    for k in range(most):
        for kind, places, sources, stops in plans:
            a, b = stops[k], stops[k + 1]
            if a < b:
                to = places[a:b]
                flat[to] = _sum(flat[to], predict(kind, [flat[s[a:b]] for s in sources]))
    return flat[width + 2 :].reshape(pixels.shape)


def inverse_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    heights = np.array([height])
    return inverse_predictors(pixels.reshape(height, width), heights, _spread([modes], [bits], width, heights)).ravel()


def _signed(x: np.ndarray, shift: int) -> np.ndarray:
    return (x >> np.uint32(shift)).astype(np.int8).astype(np.int16)


def cross_colour(pixels: np.ndarray, parts: np.ndarray, sign: int) -> np.ndarray:
    """Add (sign 1) or take off (-1) what red and blue owe to green, and blue to red, by parts: pixels of (red to blue, green to blue, green to red)."""
    green, red = _signed(pixels, 8), _signed(pixels, 16)
    new = red + sign * (_signed(parts, 0) * green >> 5)
    whole = new.astype(np.int8).astype(np.int16) if sign > 0 else red
    blue = _signed(pixels, 0) + sign * ((_signed(parts, 8) * green >> 5) + (_signed(parts, 16) * whole >> 5))
    return pixels & np.uint32(0xFF00FF00) | new.astype(np.uint8).astype(np.uint32) << np.uint32(16) | blue.astype(np.uint8)


def subtract_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    green |= green << np.uint32(16)
    return _sum(pixels, green) if sign > 0 else _difference(pixels, green)


def palette_bits(colours: int) -> int:
    """How many doublings of pixels share a palette index byte."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def pack_palette(pixels: np.ndarray, width: int, height: int, colours: np.ndarray) -> tuple[np.ndarray, int]:
    share = palette_bits(len(colours))
    index = np.searchsorted(colours, pixels).reshape(height, width)
    narrow = (width + (1 << share) - 1) >> share
    wide = np.zeros((height, narrow << share), np.int64)
    wide[:, :width] = index
    at = np.arange(1 << share) * (8 >> share)
    packed = (wide.reshape(height, narrow, -1) << at).sum(-1)
    return (np.uint32(0xFF000000) | packed.ravel().astype(np.uint32) << np.uint32(8)), narrow


def unpack_palette(pixels: np.ndarray, narrow: int, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    share = palette_bits(len(colours))
    byte = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64).reshape(height, narrow, 1)
    each = 8 >> share
    index = (byte >> (np.arange(1 << share) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width].ravel()
    table_ = np.concatenate([colours, np.zeros(256, np.uint32)])  # indices past the palette are transparent black
    return table_[index]


def _fields(data: bytes, n: int) -> list[tuple[int, int]]:
    """The fields of a bit stream, to stand inside a head."""
    words = np.frombuffer(data, "<u4").tolist()  # 0 past the stream
    return [*zip(words, [32] * (n // 32)), *([(words[n // 32], n % 32)] if n % 32 else [])]


def _by_width(images: list[Image]) -> list[list[Image]]:
    groups: dict[int, list[Image]] = {}
    for i in images:
        groups.setdefault(i.width, []).append(i)
    return list(groups.values())


def _stacked(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """Images of one width as rows, and their heights."""
    return np.concatenate([i.pixels for i in images]).reshape(-1, images[0].width), np.array([i.height for i in images])


def _unstacked(rows: np.ndarray, images: list[Image]) -> None:
    at, flat = 0, rows.ravel()
    for i in images:
        i.pixels = flat[at : at + i.width * i.height]
        at += i.width * i.height


def transform(images: list[Image], steps: list[tuple]) -> None:
    """Apply its transforms to each image, in order: ("predictor", modes, bits), ("cross", parts, bits), ("green",) or ("palette",).

    Images of one width go through a transform together, and the images inside their heads are written together.
    """
    inner: list[Image] = []
    heads: list[list] = [[] for _ in images]  # fields, or the number of an image inside
    for k in range(max(map(len, steps), default=0)):
        kinds: dict[str, list[tuple[Image, tuple]]] = {}
        for image, own, head in zip(images, steps, heads, strict=True):
            if k >= len(own):
                continue
            step = own[k]
            kinds.setdefault(step[0], []).append((image, step))
            head.append((1, 1))
            if step[0] == "predictor":
                head += [(PREDICTOR, 2), (step[2] - 2, 3), len(inner)]
                inner.append(Image(step[1].astype(np.uint32).ravel() << np.uint32(8), step[1].shape[1], step[1].shape[0]))
            elif step[0] == "cross":
                head += [(CROSS_COLOUR, 2), (step[2] - 2, 3), len(inner)]
                inner.append(Image(_factors(step[1]).ravel(), step[1].shape[1], step[1].shape[0]))
            elif step[0] == "green":
                head.append((SUBTRACT_GREEN, 2))
            else:
                colours = np.unique(image.pixels)
                head += [(PALETTE, 2), (len(colours) - 1, 8), len(inner)]
                inner.append(Image(_joined(np.diff(_channels(colours), axis=0, prepend=0)), len(colours), 1))
                image.pixels, image.width = pack_palette(image.pixels, image.width, image.height, colours)
        for kind, both in kinds.items():
            step_of = {id(i): step for i, step in both}
            for same in _by_width([i for i, _ in both]) if kind != "palette" else ():
                rows, heights = _stacked(same)
                own = [step_of[id(i)] for i in same]
                if kind == "green":
                    rows = subtract_green(rows, -1)
                else:
                    values = _spread([s[1] if kind == "predictor" else _factors(s[1]) for s in own], [s[2] for s in own], same[0].width, heights)
                    rows = forward_predictors(rows, heights, values) if kind == "predictor" else cross_colour(rows, values, -1)
                _unstacked(rows, same)
    streams = [_fields(*s) for s in write_entropy(inner, main=False)] if inner else []
    for image, head in zip(images, heads, strict=True):
        for h in head:
            image.head += streams[h] if isinstance(h, int) else [h]


def _factors(parts: np.ndarray) -> np.ndarray:
    """Blocks' factors (last axis) as pixels."""
    return _joined(np.concatenate([np.full((*parts.shape[:2], 1), 255), parts], axis=-1))


def prepared(pixels: np.ndarray, width: int, height: int, steps: tuple = ()) -> Image:
    """An image under transforms (see `transform`)."""
    image = Image(pixels, width, height)
    transform([image], [steps])
    return image


# ---------------------------------------------------------------- reading


class Reader:
    """Bit fields from the lowest bit of each byte on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return (int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)


def _direct(lens: np.ndarray) -> tuple[np.ndarray, int]:
    """A lookup table over the next bits: symbol << 4 | length; and the number of those bits."""
    used = np.nonzero(lens)[0]
    if len(used) == 1:
        return np.array([used[0] << 4], np.uint16), 0
    if not len(used):
        raise ValueError("a prefix code without symbols")
    order = used[np.argsort(lens[used], kind="stable")]
    most = int(lens[order[-1]])
    out = np.repeat((order << 4 | lens[order]).astype(np.uint16), 1 << (most - lens[order]))
    if len(out) != 1 << most:
        raise ValueError("a prefix code is not complete")
    return out[_REVERSED[np.arange(1 << most)] >> (MAX_BITS - most)], most


@lru_cache(256)
def _length_code(count: int, sent: int) -> tuple[np.ndarray, int]:
    """The lookup table of a code length code, from its count of lengths and these as sent."""
    meta = np.zeros(19, np.int64)
    for k in range(count):
        meta[CODE_ORDER[k]] = sent >> 3 * k & 7
    return _direct(meta)


@dataclass
class Lengths:
    """Code lengths still to be read: where they begin, the code they are sent in, the size of the alphabet, how many are sent at most."""

    data: bytes
    at: int
    steps: np.ndarray
    bits: int
    size: int
    limit: int


@lru_cache(256)
def _single(symbol: int) -> tuple[np.ndarray, int]:
    return np.array([symbol << 4], np.uint16), 0


def read_code(r: Reader, size: int) -> Generator[Lengths, tuple, tuple[np.ndarray, int]]:
    """The lookup table of the prefix code that comes next, over an alphabet of `size` symbols.

    Lengths that are sent one by one are yielded, and what `read_lengths` makes of them awaited.
    """
    if r.take(1):
        two, wide = r.take(1), r.take(1)
        first = r.take(8 if wide else 1)
        second = r.take(8) if two else first
        if max(first, second) >= size:
            raise ValueError("a symbol past the alphabet")
        if first == second:
            return _single(first)
        lens = np.zeros(size, np.int64)
        lens[[first, second]] = 1
        return _direct(lens)
    count = r.take(4) + 4
    steps, bits = _length_code(count, r.take(3 * count))
    limit = size
    if r.take(1):
        limit = 2 + r.take(2 + 2 * r.take(3))
        if limit > size:
            raise ValueError("more code lengths than symbols")
    found, r.at = yield Lengths(r.data, r.at, steps, bits, size, limit)
    if found is None:
        raise ValueError("a prefix code is not complete, or has lengths past its alphabet")
    return found


def read_lengths(asked: list[Lengths]) -> tuple[list[tuple[np.ndarray, int] | None], list[int]]:
    """The lookup table of each code whose lengths come next (None for a wrong one), and the place in bits where they end.

    A run of zeros and one more length of each code are read at a time.
    """
    n = len(asked)
    parts = [c.data[c.at >> 3 : (c.at >> 3) + 2 * c.size + 8] for c in asked]  # a length takes at most 14 bits
    raw = np.frombuffer(b"".join(x.ljust(2 * c.size + 16, b"\0") for x, c in zip(parts, asked, strict=True)), np.uint8)
    window = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    size = np.array([c.size for c in asked])
    starts = 8 * (np.cumsum(2 * size + 16) - 2 * size - 16)
    pos = starts + np.array([c.at & 7 for c in asked])
    distinct = {id(c.steps): c for c in asked}
    tables, at = {}, 0
    for key, c in distinct.items():
        tables[key] = at
        at += len(c.steps)
    steps = np.concatenate([c.steps for c in distinct.values()]).astype(np.int64)
    base = np.array([tables[id(c.steps)] for c in asked])
    mask = np.array([(1 << c.bits) - 1 for c in asked], np.uint64)
    most_zeros = np.where(steps[base] == 1, 40, 0)  # where length 0 is sent as a single 0
    begin = np.cumsum(size) - size
    lens, to, end = np.zeros(int(size.sum()), np.uint8), begin.copy(), begin + size
    limit, last, lane = np.array([c.limit for c in asked]), np.full(n, 8), np.arange(n)
    ends, wrong = np.zeros(n, np.int64), np.zeros(n, bool)
    while len(lane):
        word = window[pos >> 3] >> (pos & 7).astype(np.uint64)
        run = np.minimum(np.minimum(np.bitwise_count((word & -word) - np.uint64(1)), most_zeros), np.minimum(end - to, limit))
        pos, to, limit = pos + run, to + run, limit - run
        done = (to >= end) | (limit <= 0)
        word >>= run.astype(np.uint64)
        e = steps[base + (word & mask).astype(np.int64)]
        e[done] = 0
        used, symbol = e & 15, e >> 4
        plain = ~done & (symbol < 16)
        pos += used
        lens[to[plain]] = symbol[plain]
        last = np.where(plain & (symbol > 0), symbol, last)
        limit -= ~done
        to += plain
        for k in np.nonzero(symbol > 15)[0].tolist():
            s = int(symbol[k])
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            count = least + (int(word[k]) >> int(used[k]) & ((1 << extra) - 1))
            pos[k] += extra
            if to[k] + count > end[k]:
                wrong[lane[k]] = True
                count = int(end[k] - to[k])
            if s == 16:
                lens[to[k] : to[k] + count] = last[k]
            to[k] += count
        done = (to >= end) | (limit <= 0)
        if done.any():
            ends[lane[done]] = pos[done]
            stay = ~done
            lane, pos, to, end, limit, last, base, mask, most_zeros = (x[stay] for x in (lane, pos, to, end, limit, last, base, mask, most_zeros))
    found = _tables(lens, size)
    return [None if w else f for f, w in zip(found, wrong.tolist(), strict=True)], (ends - starts + np.array([c.at & ~7 for c in asked])).tolist()


def _tables(lens: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, int] | None]:
    """The lookup tables (see `_direct`) of codes whose lengths stand one after the other; None for codes that are not complete."""
    n = len(size)
    at = np.nonzero(lens)[0]
    length = lens[at].astype(np.int64)
    own = np.repeat(np.arange(n), size)[at]
    symbol = at - (np.cumsum(size) - size)[own]
    used, most = np.bincount(own, minlength=n), np.zeros(n, np.int64)
    np.maximum.at(most, own, length)
    filled = np.bincount(own, weights=1 << (most[own] - length), minlength=n)
    complete = (used > 1) & (filled == 1 << most)
    out: list = [None] * n
    for k in np.nonzero(used[own] == 1)[0].tolist():
        out[own[k]] = _single(int(symbol[k]))
    by_most = np.lexsort((np.arange(n), most))
    rank = np.empty(n, np.int64)
    rank[by_most] = np.arange(n)
    order = np.nonzero(complete[own])[0]
    order = order[np.argsort(rank[own[order]] << 4 | length[order], kind="stable")]
    values = np.repeat((symbol[order] << 4 | length[order]).astype(np.uint16), 1 << (most[own[order]] - length[order]))
    begin = 0
    for bits in np.unique(most[complete]).tolist():
        codes = by_most[(most[by_most] == bits) & complete[by_most]].tolist()
        rows = values[begin : begin + (len(codes) << bits)].reshape(len(codes), -1)[:, _REVERSED[: 1 << bits] >> (MAX_BITS - bits)]
        begin += len(codes) << bits
        for k, row in zip(codes, rows, strict=True):
            out[k] = row, bits
    return out


@dataclass
class Coded:
    """An image whose tokens are still to be read: its codes by group, the group of each block, and where the tokens begin."""

    data: bytes
    at: int
    width: int
    height: int
    cache_bits: int
    groups: list
    meta: np.ndarray | None
    meta_bits: int


def read_head(r: Reader, width: int, height: int, main: bool) -> Generator[Coded | Lengths, tuple, Coded]:
    cache_bits = r.take(4) if r.take(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, meta_bits, count = None, 0, 1
    if main and r.take(1):
        meta_bits = r.take(3) + 2
        w, h = _blocks(width, height, meta_bits)
        meta = ((yield from read_inner(r, w, h)) >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
        count = int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups: list = [[] for _ in range(count)]
    for g in groups:
        for s in sizes:
            g.append((yield from read_code(r, s)))
    r.take(0)  # the codes end within the stream
    return Coded(r.data, r.at, width, height, cache_bits, groups, meta, meta_bits)


def read_inner(r: Reader, width: int, height: int) -> Generator[Coded | Lengths, tuple, np.ndarray]:
    """The pixels of an image inside the head; its coded form is yielded, and what `read_tokens` makes of it awaited."""
    pixels, r.at = yield (yield from read_head(r, width, height, False))
    if pixels is None:
        raise ValueError("the stream ends early, or a back-reference leaves the image")
    return pixels


_NEAR_X, _NEAR_Y = np.array(NEAR).T


def read_tokens(images: list[Coded], few: int = 16) -> tuple[list[np.ndarray | None], list[int]]:
    """The pixels of each image and the place in bits where its tokens end. One token of each image is read at a time, and when few are left, image by image.

    An image whose tokens go past its stream, or refer to what is not in it, has None for pixels; the others are not touched by it.
    """
    n, room = len(images), 64  # bytes after each stream, more than one token takes
    skipped = np.array([i.at >> 3 for i in images])
    parts = [i.data[i.at >> 3 : (i.at >> 3) + 8 * (i.width * i.height + 1)] for i in images]  # a token takes at most 60 bits
    starts = np.concatenate(([0], np.cumsum([len(x) + room for x in parts])))
    raw = np.frombuffer(b"".join(x + b"\0" * room for x in parts), np.uint8)
    stop = 8 * (starts[1:] - room)
    broken = np.zeros(n, bool)
    window = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()  # the 8 bytes from each byte on
    tables, base, limits, at = [], [], [], 0
    first_group = []
    for i in images:
        first_group.append(len(base))
        for g in i.groups:
            base.append([])
            limits.append([])
            for values, bits in g:
                tables.append(values)
                base[-1].append(at)
                limits[-1].append((1 << bits) - 1)
                at += len(values)
    table_ = np.concatenate(tables)
    base, mask = np.array(base, np.int64).T.copy(), np.array(limits, np.uint64).T.copy()
    short = bool((np.bitwise_count(mask[:4]).sum(axis=0) <= 57).all())  # a pixel's codes fit what is left of 8 bytes
    sizes = np.array([i.width * i.height for i in images])
    origin = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(origin[-1], np.uint32)
    pos = starts[:-1] * 8 + np.array([i.at & 7 for i in images])
    p, end, begin = origin[:-1].copy(), origin[1:].copy(), origin[:-1].copy()
    width = np.array([i.width for i in images])
    group = np.array(first_group)
    cache_bits = np.array([i.cache_bits for i in images])
    cache_at = np.concatenate(([0], np.cumsum(1 << cache_bits)))[:-1]
    cache = np.zeros(int((1 << cache_bits).sum()), np.uint32)
    cache_shift = (32 - cache_bits).astype(np.uint64)
    any_cache = bool(cache_bits.any())
    has_meta = any(i.meta is not None for i in images)
    metas = [i.meta if i.meta is not None else np.zeros(1, np.int64) for i in images]
    meta = np.concatenate(metas)
    meta_at = np.concatenate(([0], np.cumsum([len(m) for m in metas])))[:-1]
    meta_bits = np.array([i.meta_bits if i.meta is not None else 40 for i in images])
    meta_width = np.array([_blocks(i.width, i.height, i.meta_bits)[0] if i.meta is not None else 1 for i in images])
    lane, ends = np.arange(n), np.zeros(n, np.int64)

    def code(k, g, w):
        return table_[base[k][g] + (w & mask[k][g]).astype(np.int64)].astype(np.int64)

    def window_at(place):
        return window[place >> 3] >> (place & 7).astype(np.uint64)

    def remember(who, px):
        key = (px.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> cache_shift[who]
        cache[cache_at[who] + key.astype(np.int64)] = px

    def valued(symbol, place):
        extra = np.where(symbol < 4, 0, symbol - 2 >> 1)
        bits = (window_at(place) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(symbol < 4, symbol, 2 + (symbol & 1) << extra) + bits + 1, place + extra

    while len(lane) > few:
        g = group
        if has_meta:
            off = p - begin
            g = group + meta[meta_at + (off // width >> meta_bits) * meta_width + (off % width >> meta_bits)]
        w = window_at(pos)
        e = code(0, g, w)
        symbol, used = e >> 4, e & 15
        literal = symbol < 256
        whole = bool(literal.all())
        k = slice(None) if whole else np.nonzero(literal)[0]
        if whole or len(k):
            gk = g[k]
            wk = w[k] >> used[k].astype(np.uint64)
            red = code(1, gk, wk)
            wk = wk >> (red & 15).astype(np.uint64)
            blue = code(2, gk, wk)
            place = pos[k] + used[k] + (red & 15) + (blue & 15)
            alpha = code(3, gk, wk >> (blue & 15).astype(np.uint64) if short else window_at(place))
            px = (alpha >> 4 << 24 | red >> 4 << 16 | symbol[k] << 8 | blue >> 4).astype(np.uint32)
            out[p[k]] = px
            pos[k] = place + (alpha & 15)
            p[k] += 1
            if any_cache:
                remember(lane[k], px)
        if not whole:
            k = np.nonzero(symbol >= 280)[0]
            if len(k):
                who = lane[k]
                px = cache[cache_at[who] + symbol[k] - 280]
                out[p[k]] = px
                pos[k] += used[k]
                p[k] += 1
                remember(who, px)
            k = np.nonzero((symbol >= 256) & (symbol < 280))[0]
            if len(k):
                length, place = valued(symbol[k] - 256, pos[k] + used[k])
                e = code(4, g[k], window_at(place))
                back, place = valued(e >> 4, place + (e & 15))
                near = back <= len(NEAR)
                back = np.where(near, np.maximum(1, _NEAR_X[np.where(near, back, 1) - 1] + _NEAR_Y[np.where(near, back, 1) - 1] * width[k]), back - len(NEAR))
                bad = (back > p[k] - begin[k]) | (length > end[k] - p[k])
                if bad.any():
                    broken[lane[k[bad]]] = True
                    p[k[bad]] = end[k[bad]]
                    k, length, back, place = k[~bad], length[~bad], back[~bad], place[~bad]
                step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                to = np.repeat(p[k], length)
                px = out[to - np.repeat(back, length) + step % np.repeat(back, length)]
                out[to + step] = px
                if any_cache:
                    remember(np.repeat(lane[k], length), px)
                pos[k] = place
                p[k] += length
        past = pos > stop
        broken[lane[past]] = True
        done = (p >= end) | past
        if done.any():
            ends[lane[done]] = pos[done]
            stay = ~done
            lane, pos, p, end, begin, width, group, meta_at, meta_bits, meta_width, stop = (x[stay] for x in (lane, pos, p, end, begin, width, group, meta_at, meta_bits, meta_width, stop))
    for k, i in enumerate(lane.tolist()):
        own = cache[cache_at[i] : cache_at[i] + (1 << images[i].cache_bits)].tolist() if images[i].cache_bits else None
        px, ends[i], broken[i] = _read_on(images[i], parts[i], int(pos[k] - 8 * starts[i]), out[begin[k] : p[k]].tolist(), own)
        out[p[k] : begin[k] + len(px)] = px[p[k] - begin[k] :]
        ends[i] += 8 * starts[i]
    return [None if bad else out[a:b] for a, b, bad in zip(origin[:-1], origin[1:], broken.tolist(), strict=True)], (ends - starts[:-1] * 8 + skipped * 8).tolist()


def _read_on(image: Coded, data: bytes, pos: int, out: list[int], cache: list[int] | None) -> tuple[list[int], int, bool]:
    """The pixels of an image, the first of which are known, the place in bits where its tokens end, and whether they are broken."""
    size, stop, width, broken = image.width * image.height, 8 * len(data), image.width, False
    groups = [[(values.tolist(), (1 << bits) - 1) for values, bits in g] for g in image.groups]
    meta = image.meta.tolist() if image.meta is not None else None
    meta_width = _blocks(width, image.height, image.meta_bits)[0]
    shift = 32 - image.cache_bits
    ((green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (far, far_mask)) = groups[0]
    while len(out) < size:
        if meta:
            y, x = divmod(len(out), width)
            ((green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (far, far_mask)) = groups[meta[(y >> image.meta_bits) * meta_width + (x >> image.meta_bits)]]
        word = int.from_bytes(data[pos >> 3 : (pos >> 3) + 9], "little") >> (pos & 7)
        e = green[word & green_mask]
        symbol, n = e >> 4, e & 15
        word >>= n
        pos += n
        if symbol < 256:
            r = red[word & red_mask]
            word >>= r & 15
            b = blue[word & blue_mask]
            word >>= b & 15
            a = alpha[word & alpha_mask]
            pos += (r & 15) + (b & 15) + (a & 15)
            new = [a >> 4 << 24 | r >> 4 << 16 | symbol << 8 | b >> 4]
        elif symbol >= 280:
            new = [cache[symbol - 280]]
        else:
            extra = max(0, symbol - 258 >> 1)
            symbol -= 256
            length = (symbol if symbol < 4 else 2 + (symbol & 1) << extra) + (word & ((1 << extra) - 1)) + 1
            word >>= extra
            pos += extra
            e = far[word & far_mask]
            symbol, n = e >> 4, e & 15
            word >>= n
            extra = max(0, symbol - 2 >> 1)
            back = (symbol if symbol < 4 else 2 + (symbol & 1) << extra) + (word & ((1 << extra) - 1)) + 1
            pos += n + extra
            back = back - len(NEAR) if back > len(NEAR) else max(1, NEAR[back - 1][0] + NEAR[back - 1][1] * width)
            if back > len(out) or length > size - len(out):
                broken = True
                break
            new = out[-back : len(out) - back + length]
            if length > back:
                new = (new * (length // back + 1))[:length]
        out += new
        if cache is not None:
            for px in new:
                cache[(px * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = px
        if pos > stop:
            broken = True
            break
    return out, pos, broken


def _opening(file: bytes) -> Generator[Coded | Lengths, tuple, tuple[Coded, list[tuple], int, int]]:
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(file[16:20], "little")
    if len(file) < 20 + size:
        raise ValueError("the file is shorter than it says")
    r = Reader(file[20 : 20 + size])
    if r.take(8) != 0x2F:
        raise ValueError("the signature is missing")
    width, height = r.take(14) + 1, r.take(14) + 1
    r.take(1)
    if r.take(3):
        raise ValueError("an unknown version")
    undo, inner = [], width
    while r.take(1):
        kind = r.take(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.take(3) + 2
            w, h = _blocks(inner, height, bits)
            undo.append((kind, (yield from read_inner(r, w, h)).reshape(h, w), bits, inner))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0, inner))
        else:
            size = r.take(8) + 1
            colours = _joined(np.cumsum(_channels((yield from read_inner(r, size, 1))), axis=0))
            undo.append((kind, colours, 0, inner))
            share = palette_bits(size)
            inner = (inner + (1 << share) - 1) >> share
    return (yield from read_head(r, inner, height, True)), undo, width, height


def open_streams(files: list[bytes]) -> list[tuple[Coded, list[tuple], int, int] | Exception]:
    """Of each WebP file the coded image, the transforms to undo in the order read, and the size in pixels; or what is wrong with it.

    Codes and the images inside the heads are read in rounds, of each file the next.
    """
    out: list = [None] * len(files)
    heads = [_opening(f) for f in files]
    waiting: list[tuple[int, tuple | None]] = [(i, None) for i in range(len(files))]
    while waiting:
        images, codes = [], []
        for i, value in waiting:
            try:
                asked = heads[i].send(value)
                (images if isinstance(asked, Coded) else codes).append((i, asked))
            except StopIteration as e:
                out[i] = e.value
            except (ValueError, IndexError) as e:
                out[i] = e
        waiting = []
        for own, read in ((images, read_tokens), (codes, read_lengths)):
            if own:
                found = zip(*read([asked for _, asked in own]), strict=True)
                waiting += [(i, value) for (i, _), value in zip(own, found, strict=True)]
    return out


def open_stream(file: bytes) -> tuple[Coded, list[tuple], int, int]:
    (found,) = open_streams([file])
    if isinstance(found, Exception):
        raise found
    return found


def read_images(files: list[bytes], skip: bool = False) -> list[tuple[np.ndarray, int, int] | None]:
    """(pixels, width, height) of each WebP file.

    A damaged or truncated file raises ValueError or, with skip, is None among the others' images.
    """
    opened = open_streams(files)
    sound = [i for i, o in enumerate(opened) if not isinstance(o, Exception)]
    pixels: list = [None] * len(files)
    if sound:
        for i, found in zip(sound, read_tokens([opened[i][0] for i in sound])[0], strict=True):
            opened[i] = opened[i] if found is not None else ValueError("the stream ends early, or a back-reference leaves the image")
            pixels[i] = found
    wrong = [o for o in opened if isinstance(o, Exception)]
    if wrong and not skip:
        raise ValueError(f"a damaged file: {wrong[0]}") from wrong[0]
    sound = [i for i in sound if pixels[i] is not None]
    images = [Image(pixels[i], opened[i][0].width, opened[i][3]) for i in sound]
    undo(images, [opened[i][1] for i in sound])
    out: list = [None] * len(files)
    for i, image in zip(sound, images, strict=True):
        out[i] = (image.pixels, image.width, image.height)
    return out


def undo(images: list[Image], steps: list[list[tuple]]) -> None:
    """Undo each image's transforms, the last first; images of one width go through a kind of transform together."""
    for k in range(1, max(map(len, steps), default=0) + 1):
        kinds: dict[int, list[tuple[Image, tuple]]] = {}
        for image, own in zip(images, steps, strict=True):
            if k <= len(own):
                kinds.setdefault(own[-k][0], []).append((image, own[-k]))
        for kind, both in kinds.items():
            if kind == PALETTE:
                for image, (_, colours, _, before) in both:
                    image.pixels, image.width = unpack_palette(image.pixels, image.width, before, image.height, colours), before
                continue
            step_of = {id(i): step for i, step in both}
            for same in _by_width([i for i, _ in both]):
                rows, heights = _stacked(same)
                own = [step_of[id(i)] for i in same]
                if kind == SUBTRACT_GREEN:
                    rows = subtract_green(rows, 1)
                else:
                    values = _spread([s[1] for s in own], [s[2] for s in own], same[0].width, heights)
                    rows = inverse_predictors(rows, heights, values >> np.uint32(8) & np.uint32(15)) if kind == PREDICTOR else cross_colour(rows, values, 1)
                _unstacked(rows, same)


# ---------------------------------------------------------------- payloads


def shape_of(size: int) -> tuple[int, int]:
    """Width and height for a payload of a positive multiple of 64 bytes: 16 pixels a row, or the least multiple that fits."""
    rows = size // 64
    wide = -(-rows // MAX_SIDE)
    return ROW * wide, -(-rows // wide)


def chosen(payload: bytes, width: int, height: int) -> tuple:
    """The transforms that a payload is stored under: by its checksum, as none is always smaller for text.

    One payload in four each gets the predictor, cross-colour, subtract-green, and all three, with
    modes and factors that differ from block to block; those of few colours get a palette instead.
    """
    sum_ = zlib.crc32(payload)
    bits = 4 if width * height <= 1 << 14 else 7
    w, h = _blocks(width, height, bits)
    place = np.arange(w * h).reshape(h, w) + (sum_ >> 9) % 14
    predictor = ("predictor", place % 14, bits)
    cross = ("cross", np.stack([place * 7 % 256, place * 11 % 256, place * 13 % 256], axis=-1), bits)
    return ((predictor,), (cross,), (("green",),), (("green",), predictor, cross))[sum_ % 4]


def store(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload; which features it uses depends on the payload alone."""
    images, steps = [], []
    for payload in payloads:
        width, height = shape_of(len(payload))
        samples = np.frombuffer(payload.ljust(4 * width * height, b"\0"), ">u4").astype(np.uint32)
        pixels = samples >> np.uint32(8) | samples << np.uint32(24)  # the payload's bytes are red, green, blue and alpha samples
        few = len(pixels) <= 4096 and len(set(pixels[:64].tolist())) <= 16 and len(np.unique(pixels)) <= 16
        images.append(Image(pixels, width, height, [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]))
        steps.append((("palette",),) if few else chosen(payload, width, height))
    cached = [len(i.pixels) >= 512 for i in images]
    transform(images, steps)
    out: list[bytes] = [b""] * len(payloads)
    for bits in (0, 8):
        own = [k for k, c in enumerate(cached) if c == (bits > 0)]
        for k in own:
            images[k].head.append((0, 1))
        for k, (stream, n) in zip(own, write_entropy([images[k] for k in own], bits) if own else [], strict=True):
            out[k] = container(stream[: -(-n // 8)])
    return out


def load(files: list[bytes], sizes: list[int]) -> list[bytes]:
    """The payloads of files, given their sizes."""
    out = []
    for (pixels, _, _), size in zip(read_images(files), sizes, strict=True):
        out.append((pixels << np.uint32(8) | pixels >> np.uint32(24)).astype(">u4").tobytes()[:size])
    return out


def features(payload: bytes, width: int, height: int) -> str:
    """Size in pixels, and of the samples the mean, the variance and the number of distinct values."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values, n = np.arange(256), len(payload)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    return f"{width}x{height} mean={total / n:.4f} var={(squares * n - total * total) / (n * n):.4f} distinct={int((counts > 0).sum())}"


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, most_images: int = 1024, most_bytes: int = 6 << 20, files: bool = False) -> DataFrame:
    """doc_id and RESULT for each row of docs, and the WebP file as media where files is set.

    The text's UTF-8 bytes, padded with 0 to a positive multiple of 64, are the samples of an image.
    It is written, the file is read back, and all results but n_bytes and those named media are of
    what was read. A task handles images of like size together, at most most_images or most_bytes of
    payload (or a single larger one) at a time. Null and empty texts are 64 zero bytes; equal texts
    give equal files; an empty table gives an empty result; other columns are ignored.
    """
    schema = "doc_id long, " + RESULT + ", media binary" * files
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * files
    names = [x.split()[0] for x in schema.split(", ")]

    def settle(ids, raw):
        padded = [r + b"\0" * (max(64, -(-len(r) // 64) * 64) - len(r)) for r in raw]
        stored = store(padded)
        rows = []
        for id_, r, f, back in zip(ids, raw, stored, load(stored, [len(p) for p in padded]), strict=True):
            row = (id_, len(r), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(f), hashlib.sha256(f).hexdigest(), features(back, *shape_of(len(back))))
            rows.append(row + ((f,) if files else ()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            held, size = [], 0
            for i in sorted(range(len(raw)), key=lambda i: len(raw[i])):
                if held and (len(held) >= most_images or size + len(raw[i]) > most_bytes):
                    yield settle([ids[k] for k in held], [raw[k] for k in held])
                    held, size = [], 0
                held.append(i)
                size += len(raw[i])
            if held:
                yield settle([ids[k] for k in held], [raw[k] for k in held])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
