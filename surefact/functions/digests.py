"""md5 of many short texts at once, in numpy: each message is a prefix and one of the texts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

#: Messages hashed together: what a round touches stays in the cache.
TOGETHER = 16_384
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_AT = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def block(words: list[int | np.ndarray], n: int, first: bool = False) -> list[np.ndarray]:
    """The four words of the md5 of n messages of one block, given by its 16 words, a number where all have the same; with `first` only
    the first of the four."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61 if first else 64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        w = words[_AT[i]]
        if isinstance(w, int):
            f += np.uint32((_ADD[i] + w) % 2**32)
        else:
            f += w
            f += np.uint32(_ADD[i])
        np.left_shift(f, np.uint32(_TURN[i]), out=t)
        f >>= np.uint32(32 - _TURN[i])
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    # After 61 rounds the word that ends as the first one was set last.
    done = [b] if first else [a, b, c, d]
    for x, s in zip(done, _START, strict=False):
        x += np.uint32(s)
    return done


class Texts:
    """Texts whose md5 behind changing prefixes is wanted; those with which a message is longer than a block go to hashlib."""

    def __init__(self, texts: pa.Array) -> None:
        flat = texts.cast(pa.large_binary())
        flat = pa.concat_arrays([flat]) if flat.offset else flat
        ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)
        body = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
        sizes = np.diff(ends)
        self.n = len(flat)
        self.body, self.starts, self.sizes = body, ends[:-1], sizes
        self.order = np.argsort(sizes, kind="stable")
        self.width, self.parts = -1, []

    def _lay(self, width: int) -> None:
        """Lays the texts out behind `width` bytes, in words; by length, as texts of one length are copied at once."""
        self.width, self.parts = width, []
        fit = int(np.searchsorted(self.sizes[self.order], 55 - width, side="right"))
        self.long = self.order[fit:]
        for k in range(0, fit, TOGETHER):
            at = self.order[k : min(k + TOGETHER, fit)]
            size = self.sizes[at]
            raw = np.zeros((len(at), 64), np.uint8)
            cuts = np.flatnonzero(np.diff(size)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True):
                end = width + size[i]
                raw[i:j, width:end] = self.body[self.starts[at[i:j]][:, None] + np.arange(size[i])]
                raw[i:j, end] = 0x80
                raw[i:j, 56:58] = 8 * end % 256, 8 * end // 256
            words = np.ascontiguousarray(raw.view("<u4").T)
            same = (words == words[:, :1]).all(axis=1)
            self.parts.append((at, [int(w[0]) if s else w.copy() for w, s in zip(words, same, strict=True)]))

    def md5(self, prefix: bytes, first: bool = False) -> np.ndarray:
        """Of prefix + text for each text: the digest's first 64 and last 64 bits, as two rows, or only its first 32 with `first`."""
        if len(prefix) != self.width:
            self._lay(len(prefix))
        out = np.empty(self.n, np.uint32) if first else np.empty((2, self.n), np.uint64)
        front = np.frombuffer(prefix + b"\0" * (-len(prefix) % 4), "<u4")
        for at, held in self.parts:
            words: list[int | np.ndarray] = list(held)
            for k, w in enumerate(front):
                x = words[k]
                words[k] = (x | int(w)) if isinstance(x, int) else (x | w)
            self._put(out, at, block(words, len(at), first), first)
        if len(self.long):
            text = (self.body[i : i + k].tobytes() for i, k in zip(self.starts[self.long], self.sizes[self.long], strict=True))
            raw = b"".join(hashlib.md5(prefix + x).digest() for x in text)
            self._put(out, self.long, list(np.frombuffer(raw, "<u4").reshape(-1, 4).T), first)
        return out

    @staticmethod
    def _put(out: np.ndarray, at: np.ndarray, got: list[np.ndarray], first: bool) -> None:
        got = [x.byteswap() for x in got]
        if first:
            out[at] = got[0]
        else:
            out[0, at] = got[0].astype(np.uint64) << np.uint64(32) | got[1]
            out[1, at] = got[2].astype(np.uint64) << np.uint64(32) | got[3]
