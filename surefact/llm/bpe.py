"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into its longest vocabulary entries. Such a cut is the BPE result exactly
if every two neighbours are compatible, that is, if undoing their merges step by step never meets a
merge across the cut with a lower rank than those undone. All distinct neighbour pairs of a batch are
tested at once with numpy; only words with an incompatible pair are merged exactly, rank by rank.

Defined results: a null text is the empty text and gives no ids; ids and ties need no order; equal rows give
equal rows; extra columns are not read. A word of any length is encoded (heap merging beyond
`WIDE` symbols). Known words are kept in numpy tables by a 64-bit hash, emptied at `CACHE_WORDS` entries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts, tidy
from .hashing import Table, span_hash

#: Words that a Python worker remembers: some 25 MB.
CACHE_WORDS = 200_000
WIDE = 48
NONE = np.int64(1 << 40)
#: White space as the Unicode property has it (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
SIGN, LETTER, NUMBER = 3, 1, 2
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each character: 0 white space, letter, number or other sign."""
    if not _KINDS:
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
        out = np.full(0x110000, SIGN, dtype=np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (f"[{SPACE}]+", 0)):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _KINDS.append(out)
    return _KINDS[0]


def byte_symbols() -> dict[str, int]:
    """The usual printable character of each byte, reversed: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """A vocabulary file of the kind: lower case, words by pattern, byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.n
        for t, i in (vocab | self.special).items():
            self.names[i] = t
        self.name_bytes = [t.encode() for t in self.names]
        back = byte_symbols()
        self.left, self.right = np.arange(self.n, dtype=np.int64), np.arange(self.n, dtype=np.int64)
        symbols: dict[str, int] = {}
        for t, i in vocab.items():
            body = t[: -len(self.end)] if t.endswith(self.end) and t != self.end else t
            s = "".join(chr(back[c]) for c in body)
            symbols[s if body == t else s[:-1] + chr(256 + ord(s[-1]))] = i
        self.base = np.full(512, -1, dtype=np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.base[ord(s)] = i
        pairs = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            pairs[(x, y)] = z
            self.left[z], self.right[z] = x, y
        self.pairs = pairs
        self.joined = Table(len(pairs))
        self.joined.put(np.array([(x << 20 | y) + 1 for x, y in pairs], dtype=np.uint64), np.array(list(pairs.values()), dtype=np.int32))
        # Only entries that BPE itself arrives at may be proposed.
        lexicon: dict[str, int] = {}
        for width in range(1, max(map(len, symbols)) + 1):
            some = [x for x in symbols if len(x) == width]
            if some:
                ids, size = self.merge_rows(np.array([[ord(c) for c in x] for x in some], dtype=np.int64))
                lexicon |= {x: symbols[x] for x, i, m in zip(some, ids[:, 0].tolist(), size.tolist(), strict=True) if m == 1 and i == symbols[x]}
        self.build_trie(lexicon)
        self.forget()

    # -- verification ---------------------------------------------------------------------------

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that a and b merge into, or NONE."""
        made = self.joined.get(((np.maximum(a, 0) << 20 | np.maximum(b, 0)) + 1).astype(np.uint64).ravel()).reshape(a.shape)
        return np.where(made >= 0, made.astype(np.int64), NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of ids: does BPE of their joined text keep the cut between them?"""
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NONE)
        while len(live):
            crosses = self.merged(a, b) < limit
            good[live[crosses]] = False
            # Undo the later of the two merges; if that side is a single byte, the other.
            la, lb = self.left[b], self.right[a]
            atom_a, atom_b = lb == a, la == b
            undo_a = np.where(a > b, ~atom_a, atom_b & ~atom_a)
            done = (atom_a & atom_b) | crosses
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, lb, a), np.where(undo_a, b, la)
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return good

    # -- exact merging --------------------------------------------------------------------------

    def merge_rows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of equally long words (rows of symbols): the lowest rank first, the leftmost of equals."""
        n, width = symbols.shape
        ids = self.base[symbols]
        size = np.full(n, width)
        live, cols = np.arange(n), np.arange(width)
        while width > 1 and len(live):
            now = ids[live]
            rank = np.where(now[:, 1:] >= 0, self.merged(now[:, :-1], now[:, 1:]), NONE)
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), j]
            go = best < NONE
            live, now, j, best = live[go], now[go], j[go], best[go]
            moved = np.take_along_axis(now, np.minimum(cols + (cols > j[:, None]), width - 1), axis=1)
            moved[np.arange(len(live)), j] = best
            size[live] -= 1
            moved[cols[None, :] >= size[live][:, None]] = -1
            ids[live] = moved
        return ids, size

    def merge_heap(self, word: str) -> list[int]:
        ids = [int(self.base[ord(c)]) for c in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(z, i, ids[i], ids[i + 1]) for i in range(n - 1) if (z := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            z, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if 0 <= p and q < n and (m := self.pairs.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    # -- speculation ----------------------------------------------------------------------------

    def build_trie(self, lexicon: dict[str, int]) -> None:
        """Nodes of the entries' prefixes; edges by (node, symbol) in a hash table."""
        node = {"": 0}
        edges: list[tuple[int, int]] = []
        for s in lexicon:
            for k in range(1, len(s) + 1):
                if s[:k] not in node:
                    node[s[:k]] = len(node)
                    edges.append((node[s[: k - 1]] * 512 + ord(s[k - 1]) + 1, node[s[:k]]))
        self.edges = Table(len(edges))
        self.edges.put(np.array([k for k, _ in edges], dtype=np.uint64), np.array([v for _, v in edges], dtype=np.int32))
        self.entry = np.full(len(node), -1, dtype=np.int64)
        for s, i in lexicon.items():
            self.entry[node[s]] = i

    def propose(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of equally long words (rows of symbols): ids by row, padded with -1, and their numbers."""
        n, width = words.shape
        out, size = np.full((n, width), -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        live = np.arange(n)
        at, node = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        best, stop = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        while len(live):
            inside = at < width
            symbol = words[live, np.minimum(at, width - 1)]
            child = np.where(inside, self.edges.get((node * 512 + symbol + 1).astype(np.uint64)), -1)
            on = child >= 0
            entry = np.where(on, self.entry[child], -1)
            at = at + on
            hit = entry >= 0
            best, stop, node = np.where(hit, entry, best), np.where(hit, at, stop), np.where(on, child, node)
            off = np.nonzero(~on)[0]
            if len(off):
                rows = live[off]
                out[rows, size[rows]] = best[off]
                size[rows] += 1
                at[off], node[off] = stop[off], 0
                keep = np.ones(len(live), dtype=bool)
                keep[off[stop[off] >= width]] = False
                live, at, node, best, stop = live[keep], at[keep], node[keep], best[keep], stop[keep]
        return out, size

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """BPE of distinct words: all ids, one word after the other, and each word's number of ids."""
        raw = [w if w.isascii() else w.encode("utf-8", "replace").decode("latin-1") for w in words]
        forms = [s[:-1] + chr(256 + ord(s[-1])) for s in raw]
        widths = np.array([len(s) for s in forms], dtype=np.int64)
        sizes = np.zeros(len(forms), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(widths).tolist():
            rows = np.nonzero(widths == width)[0]
            if width > WIDE:
                for k in rows.tolist():
                    ids = self.merge_heap(forms[k])
                    sizes[k] = len(ids)
                    found.append((np.array([k]), np.array([ids], dtype=np.int64)))
                continue
            symbols = np.frombuffer("".join(forms[k] for k in rows.tolist()).encode("utf-16-le"), dtype=np.uint16).reshape(len(rows), width).astype(np.int64)
            ids, size = self.propose(symbols)
            if width > 1:
                inner = np.nonzero(ids[:, 1:].ravel() >= 0)[0]
                pairs, at = np.unique((ids[:, :-1].ravel()[inner] << 32) | ids[:, 1:].ravel()[inner], return_inverse=True)
                failed = np.unique(inner[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[at]] // (width - 1))
                if len(failed):
                    ids[failed], size[failed] = self.merge_rows(symbols[failed])
            sizes[rows] = size
            found.append((rows, ids))
        ends = np.cumsum(sizes)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u4")
        for rows, ids in found:
            place = (ends[rows] - sizes[rows])[:, None] + np.arange(ids.shape[1])
            real = ids >= 0
            flat[place[real]] = ids[real]
        return flat, sizes

    # -- whole texts ----------------------------------------------------------------------------

    def split(self, text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The normalised text, its characters' codes, and starts and ends of its words."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes by single characters: no final sigma
                text = text.replace("Σ", "σ")
        text = text.lower()
        codes = np.frombuffer(text.encode("latin-1"), dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = np.empty(len(codes) + 2, dtype=np.uint8)
        kind[0] = kind[-1] = 0
        kind[1:-1] = kinds()[codes]
        # A word goes on from the character before: letters, or signs.
        start = kind[1:] != kind[:-1]
        start |= kind[1:] == NUMBER
        quote = np.nonzero(codes == 39)[0]
        if len(quote):
            quote = quote[(kind[quote] != SIGN) & (kind[quote + 2] == LETTER)]
            one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
            two = np.where(quote + 2 < len(codes), two, 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for chosen, n in ((quote[short], 2), (quote[long], 3)):
                start[chosen + 1] = False
                start[chosen + n] = True
        starts = np.nonzero(start)[0]
        ends = np.append(starts[1:], len(codes))
        real = kind[starts + 1] != 0 if len(starts) else np.zeros(0, dtype=bool)
        return text, codes, starts[real], ends[real]

    def encode_joined(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without special entries, and where each text's ids end."""
        text, codes, starts, ends = self.split("\n".join(batch))
        if len(starts) == 0:
            return np.zeros(0, dtype="<u4"), np.zeros(len(batch), dtype=np.int64)
        key = span_hash(codes, starts, ends)
        word = self.known.get(key)
        new = np.nonzero(word < 0)[0]
        if len(new):
            if self.known.n > CACHE_WORDS:
                self.forget()
                new = np.arange(len(key))
            fresh, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            s, e = starts[new[first]].tolist(), ends[new[first]].tolist()
            ids, sizes = self.encode_words([text[a:b] for a, b in zip(s, e, strict=True)])
            n = self.known.n
            self.known.put(fresh, np.arange(n, n + len(fresh), dtype=np.int32))
            self.sizes = np.append(self.sizes, sizes)
            self.begins = np.append(self.begins, len(self.pool) + np.cumsum(sizes) - sizes)
            self.pool = np.append(self.pool, ids)
            word[new] = n + back
        sizes = self.sizes[word]
        stops = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.begins[word] - stops + sizes, sizes) + np.arange(int(stops[-1]))]
        # Words before each text's closing line feed.
        feeds = np.nonzero(codes == 10)[0]
        if len(feeds) != len(batch) - 1:
            inner = np.cumsum([x.count("\n") for x in batch] + np.ones(len(batch), dtype=np.int64)) - 1
            feeds = feeds[inner[:-1]]
        upto = np.append(np.searchsorted(starts, feeds), len(starts))
        return ids, np.append(0, stops)[upto]

    def forget(self) -> None:
        self.known = Table()
        self.sizes, self.begins, self.pool = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if any("<|" in x and self.special_re.search(x) for x in batch):
            parts = [[x for x in self.special_re.split(t) if x] if "<|" in t else [t] for t in batch]
            plain = [x for p in parts for x in p if x not in self.special]
            own = iter(self.encode_batch(plain) if plain else [])
            return [np.concatenate([np.array([self.special[x]], dtype="<u4") if x in self.special else next(own) for x in p] or [np.zeros(0, dtype="<u4")]) for p in parts]
        ids, ends = self.encode_joined(batch)
        return [ids[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The entries' names joined by spaces, in UTF-8 (the file names no decoder, so the library joins them so)."""
        return b" ".join(map(self.name_bytes.__getitem__, ids.tolist()))

    def plain(self, ids: np.ndarray) -> str:
        """The readable text: bytes of the names, word ends as spaces."""
        back, out = byte_symbols(), bytearray()
        for i in ids.tolist():
            t = self.names[i]
            if t in self.special:
                out += t.encode()
                continue
            ends = t.endswith(self.end) and t != self.end
            out += bytes(back[c] for c in (t[: -len(self.end)] if ends else t)) + b" " * ends
        return out.decode("utf-8", "replace").rstrip(" ")


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One tokenizer for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [x.astype(np.int32) for x in bpe.encode_batch(texts(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(tidy(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", plain: bool = False) -> DataFrame:
    """Adds the decoded text of an array of ids (null: empty)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def run(ids):  # type: ignore[no-untyped-def]
        bpe = load(path)
        raw = [np.asarray([] if x is None else x, dtype="<u4") for x in ids]
        import pandas as pd

        return pd.Series([bpe.plain(x) if plain else bpe.decode(x).decode() for x in raw])

    return df.withColumn(out_col, run(df[ids_col]))


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode each whole text in one pass: counts and digests, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = bpe.encode_batch(texts(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
