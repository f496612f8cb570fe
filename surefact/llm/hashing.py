"""Words of whole chunks as 64-bit numbers, and hash tables of them, all in numpy.

A span's hash is a polynomial over its characters, taken from one running sum for the chunk, then mixed.
Two distinct words of n agree with a chance of about n*n / 2**65.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 // 8 * 8 + 5  # odd, and 5 modulo 8: powers differ early
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS["up"]) < n:
        m = max(n, BLOCK + 4096)
        for k, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(m, b, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_WEIGHTS = mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each span codes[start:end]; spans stand in order and do not overlap. Never 0."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + BLOCK)))
        seg = codes[base : int(ends[j - 1])]
        up, down = powers(len(seg) + 1)
        if seg.dtype == np.uint8 or int(seg.max(initial=0)) < len(_WEIGHTS):
            weight = _WEIGHTS[seg]
        else:
            weight = mix((seg.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        total = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(weight * up[: len(seg)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    out[out == 0] = 1
    return out


class Table:
    """64-bit keys (not 0) to int32 values: open addressing, looked up and filled by whole arrays."""

    def __init__(self, room: int = 1 << 16):
        self.bits = max(8, int(room * 2 - 1).bit_length())
        self.keys, self.values, self.n = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32), 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values, -1 where unknown."""
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        live = np.nonzero((found != keys) & (found != 0))[0]
        mask = len(self.keys) - 1
        while len(live):
            at_live = (at[live] + 1) & mask
            at[live] = at_live
            found = self.keys[at_live]
            hit = found == keys[live]
            out[live[hit]] = self.values[at_live[hit]]
            live = live[~hit & (found != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in it yet."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            kept = self.keys != 0
            k, v = self.keys[kept], self.values[kept]
            self.__init__((self.n + len(keys)) * 2)  # type: ignore[misc]
            self.fill(k, v)
        self.fill(keys, values)

    def fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.n += len(keys)
        mask = len(self.keys) - 1
        at = self.slot(keys)
        live = np.arange(len(keys))
        while len(live):
            free = self.keys[at[live]] == 0
            self.keys[at[live[free]]] = keys[live[free]]  # one of those that meet in a slot stays
            won = self.keys[at[live]] == keys[live]
            self.values[at[live[won]]] = values[live[won]]
            live = live[~won]
            at[live] = (at[live] + 1) & mask


def byte_words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes marked in the 256-entry table."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    return np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]


class Chunk:
    """Texts of one chunk as bytes, lower-cased A-Z and joined by line feeds, with their words.

    word_doc: the text of each word; word_no: its place there, from 0; key: its hash.
    """

    def __init__(self, raw: list[bytes], is_word: np.ndarray, hashed: bool = True):
        self.n = len(raw)
        self.data = np.frombuffer(b"\n".join(raw).lower(), dtype=np.uint8)
        self.starts, self.ends = byte_words(self.data, is_word)
        stops = np.cumsum([len(x) + 1 for x in raw])
        upto = np.searchsorted(self.starts, stops)
        self.counts = np.diff(upto, prepend=0)
        self.first = upto - self.counts
        self.word_doc = np.repeat(np.arange(self.n), self.counts)
        self.key = span_hash(self.data, self.starts, self.ends) if hashed else np.zeros(0, dtype=np.uint64)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


#: Word bytes: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, and all but white space `[^\x20\x09-\x0D]`.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SOLID = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that Chunk gives these words."""
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    return span_hash(data, ends - sizes, ends)
