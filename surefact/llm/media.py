"""Lossless WebP (VP8L) columns: a reader of whole images into pixel arrays, and a writer of 8-bit samples.

The reader (`pixels`) decodes prefix codes, meta prefix images, back-references and the colour cache, and inverts predictor,
cross-colour, subtract-green and palette transforms. Images of one channel with at most a palette and back-references (what the
writer makes) are decoded side by side: each bit stream is cut into lanes, a lane's start is found by
decoding from shortly before it (prefix codes fall into step), and a lane whose start proves wrong is decoded again.

Samples are stored as the green channel, at most `ROWS` rows of 64 samples an image, longer payloads as several images one
after the other. Images of at most 16 different samples get a palette, which packs two to eight samples into one; passages that
stood before in an image are back-references. Colour cache, predictor and cross-colour are never smaller on one channel of text, so
only the reader knows them. Defined results: a null text is empty; an empty payload is 64 zeros; equal texts give equal files;
a null or damaged image has no pixels.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import raw_texts, slices, tidy

WIDTH, ROWS = 64, 16384
LIMIT, FAR_LIMIT = 12, 8  # longest codes of samples and of distances
LANE, RUN_UP = 4096, 384
GRAM, LONGEST = 16, 4096  # least and greatest length of a back-reference
PLACES = 120  # distance codes that name a place nearby
#: An odd multiplier for hashes of eight bytes.
ODD = 0x9E3779B97F4A7C15
#: Order in which the lengths of code length codes are stored (fixed values).
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Places (x to the left, y up) of the first 120 distance codes (fixed values).
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1),
    (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3),
    (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# -- prefix codes ---------------------------------------------------------------------------------


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of a complete prefix code for symbols with counts, none above the limit; 0: no symbol."""
    some = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(some) == 1:
        out[some[0]] = 1
        return out
    floor = 1
    while True:
        heap = [(max(counts[i], floor), i, None) for i in some]
        heapq.heapify(heap)
        fresh = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], fresh, (a, b)))
            fresh += 1
        stack, deepest = [(heap[0], 0)], 0
        while stack:
            (_, i, kids), depth = stack.pop()
            if kids is None:
                out[i], deepest = depth, max(deepest, depth)
            else:
                stack += [(kids[0], depth + 1), (kids[1], depth + 1)]
        if deepest <= limit:
            return out
        floor = max(2 * floor, sum(counts) >> (limit + 2))


def canonical(lengths: list[int]) -> list[int]:
    """The codes of those lengths, bits reversed as the stream holds them."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, i in sorted((n, i) for i, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[i] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


class Bits:
    """A bit sink: the first bit is the lowest."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def put_simple(out: Bits, symbol: int) -> None:
    out.put(1, 1)
    out.put(0, 1)
    out.put(int(symbol > 1), 1)
    out.put(symbol, 8 if symbol > 1 else 1)


def put_code(out: Bits, lengths: list[int]) -> None:
    """A prefix code by its lengths."""
    some = [i for i, n in enumerate(lengths) if n]
    if len(some) == 1 and some[0] < 256:
        put_simple(out, some[0])
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, its bits
    i, top = 0, some[-1] + 1
    while i < top:
        if lengths[i]:
            tokens.append((lengths[i], 0, 0))
            i += 1
            continue
        j = i
        while j < top and not lengths[j]:
            j += 1
        n = j - i
        while n >= 11:
            m = min(n, 138)
            tokens.append((18, m - 11, 7))
            n -= m
        if n >= 3:
            tokens.append((17, n - 3, 3))
            n = 0
        tokens += [(0, 0, 0)] * n
        i = j
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    inner = code_lengths(counts, 7)
    codes = canonical(inner)
    n = max(4, max(k for k, s in enumerate(ORDER) if inner[s]) + 1)
    out.put(0, 1)
    out.put(n - 4, 4)
    for s in ORDER[:n]:
        out.put(inner[s], 3)
    out.put(1, 1)  # the number of tokens follows
    size = max(2, (len(tokens) - 2).bit_length())
    half = (size - 1) // 2
    out.put(half, 3)
    out.put(len(tokens) - 2, 2 + 2 * half)
    single = sum(1 for x in inner if x) == 1
    for s, extra, m in tokens:
        if not single:
            out.put(codes[s], inner[s])
        out.put(extra, m)


# -- writing --------------------------------------------------------------------------------------


def common(raw: bytes, i: int, j: int, most: int) -> int:
    """How many bytes from i on equal those from j on."""
    n, step = 0, 64
    while n < most:
        m = min(step, most - n)
        x, y = raw[i + n : i + n + m], raw[j + n : j + n + m]
        if x != y:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + (((differ & -differ).bit_length() - 1) >> 3)
        n, step = n + m, min(2 * step, LONGEST)
    return n


def repeats(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references (start, length, distance), none over another, within images that stand from `begin` to `end`.

    Places whose hash of the `GRAM` bytes from there is least among the four before and after look for the last such place of
    the same hash before; what is equal there is widened to both sides."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < 2 * GRAM:
        return none, none, none
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    key = (eight[: len(raw) - GRAM + 1] * np.uint64(ODD)) ^ eight[8:]
    key *= np.uint64(ODD)
    beyond = np.iinfo(np.uint64).max  # of places from which an image has not enough bytes
    cross = (np.maximum(end - GRAM + 1, begin)[:, None] + np.arange(GRAM - 1)).ravel()
    key[cross[(cross < np.repeat(end, GRAM - 1)) & (cross < len(key))]] = beyond
    least = np.concatenate([np.full(4, beyond), key, np.full(4, beyond)])
    for step in (1, 2, 4, 1):
        least = np.minimum(least[:-step], least[step:])
    at = np.nonzero((key == least) & (key < beyond))[0]
    image, key = np.searchsorted(end, at, side="right"), key[at]
    order = np.argsort(key, kind="stable")
    again = np.nonzero((key[order][1:] == key[order][:-1]) & (image[order][1:] == image[order][:-1]))[0]
    here, before = at[order[again + 1]], at[order[again]]
    order = np.argsort(here)
    here, before = here[order].tolist(), before[order].tolist()
    first, last = begin.tolist(), end.tolist()
    out, k, done, where = [], 0, 0, np.searchsorted(end, here, side="right").tolist()
    while k < len(here):
        i, j, lo, hi = here[k], before[k], first[where[k]], last[where[k]]
        n = common(raw, i, j, hi - i)
        if n >= GRAM and i - j <= (1 << 20) - PLACES:
            lo = max(lo, done)
            back = i - j
            stop = i + n
            while i > lo and i - back > first[where[k]] and raw[i - 1] == raw[i - 1 - back]:
                i -= 1
            for a in range(i, stop, LONGEST):
                out.append((a, min(LONGEST, stop - a), back))
            done = stop
            k = bisect_left(here, done, k + 1)
        else:
            k += 1
    found = np.array(out, dtype=np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and how many they are, of lengths or distances from 1 on."""
    x = value - 1
    top = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    small = x < 4
    extra = np.where(small, 0, top - 1)
    return np.where(small, x, 2 * top + ((x >> np.maximum(top - 1, 0)) & 1)), x & ((1 << extra) - 1), extra


def put_palette(out: Bits, colours: list[int]) -> None:
    """The palette transform: opaque green colours in rising order, each by its step from the one before."""
    steps = [b - a for a, b in zip([0, *colours], colours, strict=False)]
    out.put(1, 1)
    out.put(3, 2)
    out.put(len(colours) - 1, 8)
    out.put(0, 1)  # no colour cache
    counts = [0] * 256
    for x in steps:
        counts[x] += 1
    lengths = code_lengths(counts, LIMIT)
    put_code(out, lengths + [0] * 24)
    put_simple(out, 0)
    put_simple(out, 0)
    if len(colours) == 1:
        put_simple(out, 255)
    else:  # two symbols, 0 and 255
        out.put(1, 1)
        out.put(1, 1)
        out.put(0, 1)
        out.put(0, 1)
        out.put(255, 8)
    put_simple(out, 0)
    codes, single = canonical(lengths), len(set(steps)) == 1
    for k, x in enumerate(steps):
        if not single:
            out.put(codes[x], lengths[x])
        if len(colours) > 1:
            out.put(int(k == 0), 1)


def packing_of(colours: int) -> int:
    """How many samples a palette of that size packs into one, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def write_samples(payloads: list[bytes]) -> list[bytes]:
    """A lossless WebP file (or several in a row) of each payload, whose length is a positive multiple of 64."""
    parts = [(k, p[a : a + WIDTH * ROWS]) for k, p in enumerate(payloads) for a in range(0, len(p), WIDTH * ROWS)]
    n = len(parts)
    rows = [len(p) // WIDTH for _, p in parts]
    raw = b"".join(p for _, p in parts)
    sizes = np.array([len(p) for _, p in parts], dtype=np.int64)
    seen = np.bincount(np.repeat(np.arange(n), sizes) * 256 + np.frombuffer(raw, dtype=np.uint8), minlength=256 * n).reshape(n, 256) > 0
    few = {}
    for k in np.nonzero(seen.sum(axis=1) <= 16)[0].tolist():
        colours = np.nonzero(seen[k])[0]
        pack = packing_of(len(colours))
        index = np.searchsorted(colours, np.frombuffer(parts[k][1], dtype=np.uint8)).reshape(-1, 1 << pack)
        packed = (index << (np.arange(1 << pack) * (8 >> pack))).sum(axis=1).astype(np.uint8).tobytes()
        parts[k], few[k], sizes[k] = (parts[k][0], packed), colours.tolist(), len(packed)
    if few:
        raw = b"".join(p for _, p in parts)
    data = np.frombuffer(raw, dtype=np.uint8)
    image = np.repeat(np.arange(n), sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place, length, back = repeats(raw, starts, ends)
    symbol = data.astype(np.int64)
    covered = np.zeros(len(data), dtype=bool)
    long_, long_bits, long_n = prefixed(length)
    far, far_bits, far_n = prefixed(back + PLACES)
    if len(place):
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        edge[place] += 1
        np.subtract.at(edge, place + length, 1)
        covered = np.cumsum(edge[:-1], dtype=np.int8) > 0
        symbol[place] = 256 + long_
        covered[place] = False
    told = np.nonzero(~covered)[0]
    counts = np.bincount(image[told] * 280 + symbol[told], minlength=280 * n).reshape(n, 280)
    of = image[place]
    far_counts = np.bincount(of * 40 + far, minlength=40 * n).reshape(n, 40)
    codes, widths = np.zeros((n, 280), dtype=np.uint64), np.zeros((n, 280), dtype=np.int64)
    far_codes, far_widths = np.zeros((n, 40), dtype=np.uint64), np.zeros((n, 40), dtype=np.int64)
    heads: list[Bits] = []
    for k in range(n):
        lengths = code_lengths(counts[k].tolist(), LIMIT)
        head = Bits()
        head.put(0x2F, 8)
        head.put(WIDTH - 1, 14)
        head.put(rows[k] - 1, 14)
        head.put(0, 1 + 3)  # no alpha, version 0
        if k in few:
            put_palette(head, few[k])
        head.put(0, 1 + 1 + 1)  # no more transforms, no colour cache, no meta prefix codes
        put_code(head, lengths)
        for x in (0, 0, 255):  # red, blue, alpha
            put_simple(head, x)
        if sum(1 for x in lengths if x) > 1:
            codes[k], widths[k] = canonical(lengths), lengths
        some = np.count_nonzero(far_counts[k])
        if some:
            lengths = code_lengths(far_counts[k].tolist(), FAR_LIMIT)
            put_code(head, lengths)
            if some > 1:
                far_codes[k], far_widths[k] = canonical(lengths), lengths
        else:
            put_simple(head, 0)
        heads.append(head)
    width, code = widths[image, symbol], codes[image, symbol]
    width[covered], code[covered] = 0, 0
    # A back-reference's code, extra bits, distance code and its extra bits make one number of at most 50 bits.
    for value, bits in ((long_bits, long_n), (far_codes[of, far], far_widths[of, far]), (far_bits, far_n)):
        code[place] |= value.astype(np.uint64) << width[place].astype(np.uint64)
        width[place] += bits
    total = np.add.reduceat(width, starts)
    head_bits = np.array([h.n for h in heads], dtype=np.int64)
    words = (head_bits + total + 63) // 64 + 1
    slot = np.cumsum(words) - words
    at = np.cumsum(width)
    at += np.repeat(slot * 64 + head_bits - (at[starts] - width[starts]), sizes) - width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()), dtype="<u8")
    first = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
    out[word[first]] = np.bitwise_or.reduceat(code << shift, first)
    over = np.nonzero((at & 63) + width > 64)[0]
    out[word[over] + 1] |= code[over] >> (np.uint64(64) - shift[over])
    files: list[list[bytes]] = [[] for _ in payloads]
    for k, head in enumerate(heads):
        a, b = int(slot[k]), int(slot[k] + words[k])
        m = (head.n + 63) // 64
        out[a : a + m] |= np.frombuffer(head.value.to_bytes(8 * m, "little"), dtype="<u8")
        stream = out[a:b].tobytes()[: (head.n + int(total[k]) + 7) // 8]
        body = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
        files[parts[k][0]].append(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body)
    return [b"".join(x) for x in files]


# -- reading --------------------------------------------------------------------------------------


def streams(file: bytes) -> Iterator[bytes]:
    """The VP8L streams of one or more RIFF containers."""
    at = 0
    while at < len(file):
        if file[at : at + 4] != b"RIFF" or file[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP container")
        end = at + 8 + struct.unpack_from("<I", file, at + 4)[0]
        chunk = at + 12
        while chunk < end:
            name, size = file[chunk : chunk + 4], struct.unpack_from("<I", file, chunk + 4)[0]
            if name == b"VP8L":
                yield file[chunk + 8 : chunk + 8 + size]
            elif name in (b"VP8 ", b"ANMF"):
                raise ValueError("only still lossless images are read")
            chunk += 8 + size + (size & 1)
        at = end + (end & 1)


class Reader:
    """Bits of one stream; read past its end, they are 0."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 16, 0

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 6], "little") >> (self.at & 7)

    def get(self, n: int) -> int:
        out = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        return out


class Code:
    """A prefix code read from a stream."""

    def __init__(self, r: Reader, alphabet: int):
        self.lengths = [0] * alphabet
        if r.get(1):
            two, wide = r.get(1), r.get(1)
            first = r.get(8 if wide else 1)
            self.lengths[first] = 1
            if two:
                self.lengths[r.get(8)] = 1
        else:
            inner = [0] * 19
            for k in range(4 + r.get(4)):
                inner[ORDER[k]] = r.get(3)
            left = alphabet if not r.get(1) else 2 + r.get(2 + 2 * r.get(3))
            meta, i, last = Table(inner), 0, 8
            while i < alphabet and left:
                left -= 1
                s = meta.read(r)
                if s < 16:
                    self.lengths[i] = s
                    last = s or last
                    i += 1
                else:
                    n, value = ((3 + r.get(2)), last) if s == 16 else ((3 + r.get(3)), 0) if s == 17 else ((11 + r.get(7)), 0)
                    self.lengths[i : i + n] = [value] * n
                    i += n
        self.table = Table(self.lengths)
        self.read = self.table.read


class Table:
    """Lookup of a prefix code by its next bits."""

    def __init__(self, lengths: list[int]):
        some = [i for i, n in enumerate(lengths) if n]
        self.only = some[0] if len(some) == 1 else None
        self.width = 0 if len(some) < 2 else max(lengths)
        self.symbols, self.sizes = np.zeros(1 << self.width, dtype=np.int32), np.zeros(1 << self.width, dtype=np.int32)
        if not some:
            self.only = 0
        if self.only is None:
            if sum(1 << (self.width - lengths[i]) for i in some) != 1 << self.width:
                raise ValueError("a prefix code is not complete")
            for i, code in enumerate(canonical(lengths)):
                if lengths[i]:
                    self.symbols[code :: 1 << lengths[i]], self.sizes[code :: 1 << lengths[i]] = i, lengths[i]
        else:
            self.symbols[:] = self.only

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        k = r.peek() & ((1 << self.width) - 1)
        r.at += int(self.sizes[k])
        return int(self.symbols[k])


def spread(r: Reader, symbol: int) -> int:
    """The value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.get(extra) + 1


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels (ARGB numbers) of one image, row by row."""
    cache_bits = r.get(4) if r.get(1) else 0
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    groups, tile, meta = 1, 0, None
    if main and r.get(1):
        tile = 2 + r.get(3)
        meta = (read_image(r, -(-width >> tile), -(-height >> tile), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    codes = [[Code(r, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    n, across = width * height, -(-width >> tile) if tile else 0
    out, i, waiting = [0] * n, 0, 0
    while i < n:
        own = codes[int(meta[((i // width) >> tile) * across + ((i % width) >> tile)])] if meta is not None else codes[0]
        s = own[0].read(r)
        if s < 256:
            red, blue, alpha = own[1].read(r), own[2].read(r), own[3].read(r)
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            length, place = spread(r, s - 256), spread(r, own[4].read(r))
            if place > 120:
                back = place - 120
            else:
                x, y = NEAR[place - 1]
                back = max(1, x + y * width)
            if back > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[i] = out[i - back]
                i += 1
        else:
            while waiting < i:
                cache[(0x1E35A7BD * out[waiting] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[waiting]
                waiting += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, dtype=np.uint32)


def average(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) // 2 for x, y in zip(a, b, strict=True))


def predict(mode: int, left: tuple, top: tuple, top_left: tuple, top_right: tuple) -> tuple:
    """The predicted channels of a pixel from its neighbours'."""
    clamp = lambda x: min(255, max(0, x))
    if mode == 0:
        return (255, 0, 0, 0)
    if mode == 11:
        near = [sum(abs(x + y - z - w) for x, y, z, w in zip(left, top, top_left, side, strict=True)) for side in (left, top)]
        return left if near[0] < near[1] else top
    if mode == 12:
        return tuple(clamp(x + y - z) for x, y, z in zip(left, top, top_left, strict=True))
    if mode == 13:
        return tuple(clamp(m + int((m - z) / 2)) for m, z in zip(average(left, top), top_left, strict=True))
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: average(average(left, top_right), top), 6: lambda: average(left, top_left), 7: lambda: average(left, top),
        8: lambda: average(top_left, top), 9: lambda: average(top, top_right), 10: lambda: average(average(left, top_left), average(top, top_right)),
    }[mode]()


def neighbours(rows: list[list[tuple]], x: int, y: int, width: int) -> tuple[int | None, tuple, tuple, tuple, tuple]:
    """A fixed mode on the edges (else None), and the left, top, top-left and top-right pixels."""
    none = (0, 0, 0, 0)
    left = rows[y][x - 1] if x else none
    if not y:
        return (1 if x else 0), left, none, none, none
    above = rows[y - 1]
    # To the right of the last column stands the current row's first pixel.
    return (None if x else 2), left, above[x], above[x - 1] if x else none, above[x + 1] if x + 1 < width else rows[y][0] if x else none


def channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([(pixels >> s) & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) - ((x.astype(np.int64) >> 7) << 8)


def read_general(stream: bytes) -> np.ndarray:
    """Pixels (rows, columns, ARGB) of any VP8L stream."""
    r = Reader(stream)
    if r.get(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    done, now = [], width
    while r.get(1):
        kind = r.get(2)
        if kind in (0, 1):
            tile = 2 + r.get(3)
            done.append((kind, tile, now, channels(read_image(r, -(-now >> tile), -(-height >> tile), False)).reshape(-(-height >> tile), -1, 4)))
        elif kind == 2:
            done.append((2, 0, now, None))
        else:
            size = r.get(8) + 1
            palette = np.cumsum(channels(read_image(r, size, 1, False)), axis=0) & 0xFF
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            done.append((3, pack, now, palette))
            now = -(-now >> pack)
    p = channels(read_image(r, now, height, True)).reshape(height, now, 4)
    for kind, tile, wide, own in reversed(done):
        if kind == 2:
            p[..., 1] = (p[..., 1] + p[..., 2]) & 0xFF
            p[..., 3] = (p[..., 3] + p[..., 2]) & 0xFF
        elif kind == 3:
            bits = 8 >> tile
            x = np.arange(wide)
            index = (p[:, x >> tile, 2] >> ((x & ((1 << tile) - 1)) * bits)) & ((1 << bits) - 1)
            p = np.where((index < len(own))[..., None], own[np.minimum(index, len(own) - 1)], 0)
        elif kind == 1:
            t = own[np.arange(height)[:, None] >> tile, np.arange(wide)[None, :] >> tile]
            green_red, green_blue, red_blue = signed(t[..., 3]), signed(t[..., 2]), signed(t[..., 1])
            green = signed(p[..., 2])
            p[..., 1] = (p[..., 1] + (green_red * green >> 5)) & 0xFF
            p[..., 3] = (p[..., 3] + (green_blue * green >> 5) + (red_blue * signed(p[..., 1]) >> 5)) & 0xFF
        else:
            rows: list[list[tuple]] = []
            for y in range(height):
                rows.append([])
                for x in range(wide):
                    mode, *near = neighbours(rows, x, y, wide)
                    mode = int(own[y >> tile, x >> tile, 2]) & 15 if mode is None else mode
                    guess = predict(min(mode, 13), *near)
                    rows[y].append(tuple((int(a) + b) & 0xFF for a, b in zip(p[y, x], guess, strict=True)))
            p = np.array(rows, dtype=np.int64)
    return p.astype(np.uint8)


class Plain(NamedTuple):
    """An image of one channel: where its pixels begin, how many a row and in all are stored, the codes and the palette, if it has one."""

    stream: bytes
    first: int
    width: int
    n: int
    green: Table
    far: Table
    palette: np.ndarray | None


def plain_samples(stream: bytes) -> Plain | None:
    """The image if its pixels are green samples or back-references, with a palette of at most 16 colours or none."""
    r = Reader(stream[:8192])
    if r.get(8) != 0x2F:
        return None
    width, height, palette = r.get(14) + 1, r.get(14) + 1, None
    if r.get(1 + 3) or width != WIDTH:
        return None
    if r.get(1):
        if r.get(2) != 3:
            return None
        size = r.get(8) + 1
        if size > 16:
            return None
        own = np.cumsum(channels(read_image(r, size, 1, False)), axis=0) & 0xFF
        palette, width = np.zeros(16, dtype=np.uint8), width >> packing_of(size)
        palette[:size] = own[:, 2]
        palette = palette[: 1 << (8 >> packing_of(size))]
        if r.get(1):
            return None
    if r.get(2):
        return None
    green, others = Code(r, 280), [Code(r, 256) for _ in range(3)]
    far = Code(r, 40)
    if green.table.width > LIMIT or far.table.width > FAR_LIMIT or [x.table.only for x in others] != [0, 0, 255]:
        return None
    return Plain(stream, r.at, width, width * height, green.table, far.table, palette)


def unpacked(image: Plain, stored: np.ndarray) -> np.ndarray:
    """The samples that a palette's indices stand for."""
    if image.palette is None:
        return stored
    bits = len(image.palette).bit_length() - 1
    shifts = np.arange(0, 8, bits, dtype=np.uint8)
    return image.palette[(stored[:, None] >> shifts) & np.uint8((1 << bits) - 1)].ravel()


def replayed(tokens: np.ndarray, at: np.ndarray, length: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
    """The n pixels of a sequence of literals in which the tokens `at` are back-references."""
    if not len(at) and len(tokens) >= n:
        return tokens[:n].astype(np.uint8)
    sizes = np.ones(len(tokens), dtype=np.int64)
    sizes[at] = length
    ends = np.cumsum(sizes)
    enough = int(np.searchsorted(ends, n))
    if enough == len(ends) or ends[enough] != n:
        raise ValueError("the stream ends too early, or a back-reference leaves the image")
    place = (ends - sizes)[: enough + 1]
    out = np.empty(n, dtype=np.uint8)
    literal = np.ones(enough + 1, dtype=bool)
    at = at[: np.searchsorted(at, enough, side="right")]
    literal[at] = False
    out[place[literal]] = tokens[: enough + 1][literal]
    for i, m, d in zip(place[at].tolist(), length.tolist(), back.tolist(), strict=False):
        if not 0 < d <= i:
            raise ValueError("a back-reference leaves the image")
        if d >= m:
            out[i : i + m] = out[i - d : i - d + m]
        else:
            out[i : i + m] = np.resize(out[i - d : i], m)
    return out


def read_lanes(images: list[Plain]) -> list[np.ndarray]:
    """Samples of several plain images, all lanes in step."""
    many = [k for k, x in enumerate(images) if x.green.width]
    out = [np.full(x.n, 0 if x.green.only is None else x.green.only, dtype=np.uint8) for x in images]
    if many:
        pad = b"\0" * 16
        data = np.frombuffer(b"".join(images[k].stream + pad for k in many), dtype=np.uint8).astype(np.uint32)
        four = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
        table, far_table = np.zeros((len(many), 1 << LIMIT), dtype=np.uint16), np.zeros((len(many), 1 << FAR_LIMIT), dtype=np.uint16)
        begin, end, base = [], [], 0
        for j, k in enumerate(many):
            x = images[k]
            table[j] = np.tile((x.green.symbols | x.green.sizes << 9).astype(np.uint16), 1 << (LIMIT - x.green.width))
            far_table[j] = np.tile((x.far.symbols | x.far.sizes << 9).astype(np.uint16), 1 << (FAR_LIMIT - x.far.width))
            begin.append(8 * base + x.first)
            end.append(8 * (base + len(x.stream)))
            base += len(x.stream) + len(pad)
        for j, (tokens, at, length, back) in enumerate(decoded(four, table.ravel(), far_table.ravel(), np.array(begin), np.array(end), [images[k].width for k in many])):
            out[many[j]] = replayed(tokens, at, length, back, images[many[j]].n)
    return [unpacked(x, own) for x, own in zip(images, out, strict=True)]


def decoded(four: np.ndarray, table: np.ndarray, far_table: np.ndarray, begin: np.ndarray, end: np.ndarray, widths: list[int]) -> list[tuple[np.ndarray, ...]]:
    """Of each image, whose bits stand from `begin` to `end`: tokens, which of them are back-references, lengths and distances.

    `four` has the 32 bits from each byte on, the tables of all images stand one after the other."""
    lanes = np.maximum(1, -(-(end - begin) // LANE))
    image = np.repeat(np.arange(len(begin)), lanes)
    no = np.arange(len(image)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    edge = begin[image] + no * LANE  # where a lane's bits begin
    stop = np.minimum(edge + LANE, end[image])

    def extra(at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of length or distance symbols whose extra bits begin at `at`, and where these end."""
        n = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        bits = (four[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64) & ((1 << n) - 1)
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << n) + bits + 1), at + n

    def run(who: np.ndarray, at: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Decode lanes from `at` until their stops: where they end, how many tokens, the tokens, and (token, length, distance) of back-references."""
        at, goal, offset = at.copy(), stop[who], image[who] << LIMIT
        count, live, steps, copies = np.zeros(len(who), dtype=np.int64), np.nonzero(at < goal)[0], [], []
        here, to, off = at[live], goal[live], offset[live]
        while len(live):
            got = table[off + ((four[here >> 3] >> (here & 7).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1))]
            here = here + (got >> 9)
            got &= 511
            if got.max() > 255:
                some = np.nonzero(got > 255)[0]
                length, now = extra(here[some], got[some].astype(np.int64) - 256)
                far = far_table[(off[some] >> (LIMIT - FAR_LIMIT)) + ((four[now >> 3] >> (now & 7).astype(np.uint32)) & np.uint32((1 << FAR_LIMIT) - 1))]
                place, here[some] = extra(now + (far >> 9), (far & 511).astype(np.int64))
                if keep:
                    copies.append((live[some], np.full(len(some), len(steps)), length, place))
            if keep:
                steps.append((live, got))
            on = here < to
            if not on.all():
                off_now = ~on
                at[live[off_now]] = here[off_now]
                count[live[off_now]] = len(steps)
                live, here, to, off = live[on], here[on], to[on], off[on]
        tokens, far_ = np.zeros(0, dtype=np.uint16), np.zeros((4, 0), dtype=np.int64)
        if keep and steps:
            ends = np.cumsum(count)
            tokens = np.empty(int(ends[-1]), dtype=np.uint16)
            head = ends - count
            for step, (lane, got) in enumerate(steps):
                tokens[head[lane] + step] = got
        if copies:
            far_ = np.stack([np.concatenate(x) for x in zip(*copies, strict=True)])
            far_ = far_[:, np.lexsort((far_[1], far_[0]))]
        return at, count, tokens, far_

    # Guess each lane's end, which is the next lane's start, by decoding its last bits only.
    every = np.arange(len(image))
    guess = run(every, np.maximum(edge, stop - RUN_UP), False)[0]
    start = edge.copy()
    inner = np.nonzero(no > 0)[0]
    start[inner] = guess[inner - 1]

    def split(who: np.ndarray, count: np.ndarray, tokens: np.ndarray, copies: np.ndarray) -> Iterator[tuple]:
        bounds = np.searchsorted(copies[0], np.arange(len(who) + 1))
        return zip(who.tolist(), np.split(tokens, np.cumsum(count)[:-1]), (copies[1:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)), strict=True)

    ended, *found = run(every, start, True)
    pieces = {k: (tokens, copies) for k, tokens, copies in split(every, *found)}
    while len(wrong := inner[start[inner] != ended[inner - 1]]):
        start[wrong] = ended[wrong - 1]
        ended[wrong], *found = run(wrong, start[wrong], True)
        pieces.update((k, (tokens, copies)) for k, tokens, copies in split(wrong, *found))
    out, k = [], 0
    for m, width in zip(lanes.tolist(), widths, strict=True):
        own = [pieces[x] for x in range(k, k + m)]
        k += m
        head = np.cumsum([0] + [len(tokens) for tokens, _ in own[:-1]])
        at, length, place = np.concatenate([copies + np.array([[h], [0], [0]]) for h, (_, copies) in zip(head, own, strict=True)], axis=1)
        back = place - PLACES
        for x in np.nonzero(place <= PLACES)[0].tolist():
            dx, dy = NEAR[place[x] - 1]
            back[x] = max(1, dx + dy * width)
        out.append((np.concatenate([tokens for tokens, _ in own]), at, length, back))
    return out


def read_samples(files: list[bytes]) -> list[bytes]:
    """The samples of each file, as the writer took them."""
    plain, where, out = [], [], [[] for _ in files]
    for k, file in enumerate(files):
        for stream in streams(file):
            found = plain_samples(stream)
            out[k].append(None)
            if found:
                plain.append(found)
                where.append((k, len(out[k]) - 1))
            else:
                out[k][-1] = read_general(stream)[..., 2].tobytes()
    for (k, j), samples in zip(where, read_lanes(plain), strict=True):
        out[k][j] = samples.tobytes()
    return [b"".join(x) for x in out]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy and mean step of the samples."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    mean = float((counts * np.arange(256)).sum()) / len(samples)
    sd = np.sqrt(max(0.0, float((counts * np.arange(256) ** 2).sum()) / len(samples) - mean * mean))
    step = float(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)) / len(samples)
    return f"{WIDTH}x{len(samples) // WIDTH};mean={mean:.4f};sd={sd:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


def padded(text: bytes) -> bytes:
    return text + b"\0" * (max(1, -(-len(text) // 64)) * 64 - len(text))


def store(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes long, media binary) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = raw_texts(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(write_samples([padded(x) for x in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of rows (doc_id, n_bytes, media), from the pixels read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                files = part.column(2).to_pylist()
                payloads = read_samples(files)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                        pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()), pa.array([len(f) for f in files], pa.int64()),
                        pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([feature(np.frombuffer(p, dtype=np.uint8)) for p in payloads]),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        tidy(run), f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def pixels(media: DataFrame) -> DataFrame:
    """(doc_id, image int, width int, height int, argb binary) of every lossless image in rows (doc_id, media): four bytes a pixel,
    alpha, red, green, blue, row by row. A media value may hold several files one after the other."""

    def read(file: bytes | None) -> list[np.ndarray]:
        try:
            return [read_general(x) for x in streams(file or b"")]
        except (ValueError, IndexError, struct.error):
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = [(k, j, x) for k, file in enumerate(part.column(1).to_pylist()) for j, x in enumerate(read(file))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([k for k, _, _ in rows], pa.int64())), pa.array([j for _, j, _ in rows], pa.int32()),
                     *(pa.array([x.shape[side] for _, _, x in rows], pa.int32()) for side in (1, 0)), pa.array([x.tobytes() for _, _, x in rows], pa.binary())],
                    ["doc_id", "image", "width", "height", "argb"],
                )

    return media.select("doc_id", "media").mapInArrow(tidy(run), f"doc_id {media.schema['doc_id'].dataType.simpleString()}, image int, width int, height int, argb binary")
