"""Lexical retrieval packing: documents that share rare tokens fill a window together.

Documents are dealt by content: each gets the three least hashes of its words, and rows are ranged and sorted by these (and
a hash of the id, so that a group of copies may be many tasks). Copies and documents that share such a word stand together, whatever
file they came from. A shard is a run of documents of `SHARD_TOKENS` tokens in that order; it gets a BM25 inverted index over token
ids. A window starts with a seed (what is left of the document cut last,
else the next unused one); all of its tokens query the index, and unused neighbours fill the window by falling score, as many as
it takes. The one that no longer fits is cut there and seeds the next window, so that only the last window of a task is not
full. No task holds more than one shard.

Defined results: a null or empty text is its end token alone; ties go to the document that stands first; equal rows are packed
each; documents longer than a window fill whole windows alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import raw_texts, slices, texts, tidy
from .hashing import SOLID, Chunk, mix

WINDOW = 2048
SHARD_TOKENS = 2_000_000
END = 1
K1, B = 1.2, 0.75
FIRST = 64  # neighbours that are sorted before the others; all can be had


class Index:
    """BM25 over token ids, of documents given by one array of ids and where each ends.

    A token of an eighth of the documents or more has a row of all impacts, any other a posting list. Both are made anew without
    the used documents whenever a quarter of those left have been used."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = len(ends)
        sizes = np.diff(ends, prepend=0)
        kind, bits = (np.uint32, 16) if n < 1 << 16 and int(ids.max(initial=0)) < 1 << 16 else (np.uint64, 32)
        cells = np.repeat(np.arange(n, dtype=kind) << kind(bits), sizes) | ids.astype(kind)
        cells.sort()
        at = np.nonzero(np.append(True, cells[1:] != cells[:-1]))[0] if len(cells) else np.zeros(0, dtype=np.int64)
        tf = np.diff(np.append(at, len(cells))).astype(np.float64)
        cells = cells[at]
        doc, token = (cells >> kind(bits)).astype(np.int64), (cells & kind((1 << bits) - 1)).astype(np.int64)
        names, term, df = np.unique(token, return_inverse=True, return_counts=True)
        # Tokens that stand in one document alone find nobody.
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        useful = df > 1
        mean = max(1.0, float(sizes.mean()) if n else 1.0)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        kept = useful[term]
        doc, term, impact = doc[kept], (np.cumsum(useful) - 1)[term[kept]], impact[kept]
        self.terms, self.doc_ends = term, np.searchsorted(doc, np.arange(n + 1))
        often = df[useful] * 8 >= n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        full = often[term]
        self.rows = np.zeros((int(often.sum()), n), dtype=np.float32)
        self.rows[self.row[term[full]], doc[full]] = impact[full]
        rest = np.nonzero(~full)[0]
        rest = rest[np.argsort(term[rest], kind="stable")]
        self.post_doc, self.impact = doc[rest], impact[rest]
        self.begin = np.searchsorted(term[rest], np.arange(len(often) + 1))
        self.alive = np.arange(n)

    def shrink(self, used: np.ndarray) -> None:
        keep = ~used[self.alive]
        if np.count_nonzero(keep) > 0.75 * len(keep):
            return
        number = np.cumsum(keep) - 1
        self.alive, self.rows = self.alive[keep], self.rows[:, keep]
        posts = keep[self.post_doc]
        self.begin = np.append(0, np.cumsum(posts))[self.begin]
        self.post_doc, self.impact = number[self.post_doc[posts]], self.impact[posts]

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """All unused documents that share a token with the seed, best first; the order among equals is that of the documents."""
        self.shrink(used)
        terms = self.terms[self.doc_ends[seed] : self.doc_ends[seed + 1]]
        if not len(terms) or not len(self.alive):
            return
        row = self.row[terms]
        asked = np.zeros(len(self.rows), dtype=np.float32)
        asked[row[row >= 0]] = 1
        terms = terms[row < 0]
        lo, hi = self.begin[terms], self.begin[terms + 1]
        at = np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange(int((hi - lo).sum()))
        score = np.bincount(self.post_doc[at], self.impact[at], len(self.alive)) + asked @ self.rows
        score[used[self.alive]] = 0
        some = np.nonzero(score > 0)[0]
        score = -score[some]
        floor = np.partition(score, FIRST)[FIRST] if len(some) > FIRST else np.inf
        for part in (np.nonzero(score <= floor)[0], np.nonzero(score > floor)[0]):
            yield from self.alive[some[part[np.argsort(score[part], kind="stable")]]].tolist()


class Packer:
    """The windows of one task: `room` is what the open window still takes."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.sequence, self.window, self.room = first_sequence, window, window

    def place(self, out: list, doc: int, start: int, end: int) -> int:
        """Put tokens of a document into the open window; returns where they are cut."""
        n = min(self.room, end - start)
        out.append((doc, start, n, self.sequence, self.window - self.room))
        self.room -= n
        if not self.room:
            self.sequence, self.room = self.sequence + 1, self.window
        return start + n

    def shard(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of every piece of the shard."""
        index = Index(ids, ends)
        n, sizes = len(ends), np.diff(ends, prepend=0).tolist()
        used, out, next_ = np.zeros(n, dtype=bool), [], 0
        seed, at = -1, 0
        while True:
            if seed < 0:
                while next_ < n and used[next_]:
                    next_ += 1
                if next_ == n:
                    return out
                seed, at = next_, 0
                used[seed] = True
            # What fills windows alone needs no neighbours.
            while at < sizes[seed] and (sizes[seed] - at >= self.room):
                at = self.place(out, seed, at, sizes[seed])
            if at < sizes[seed]:
                self.place(out, seed, at, sizes[seed])
                cut = -1
                for d in index.neighbours(seed, used):
                    used[d] = True
                    window = self.sequence
                    at = self.place(out, d, 0, sizes[d])
                    if self.sequence != window:
                        cut = d
                        break
                if cut >= 0 and at < sizes[cut]:
                    seed = cut
                    continue
            seed = -1


def dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text), dealt and sorted by the three least hashes of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                c = Chunk(raw_texts(part), SOLID)
                keys, own = np.zeros((3, c.n), dtype=np.int64), c.key >> np.uint64(1)
                some = np.nonzero(c.counts)[0]
                for k in range(3):
                    # A word that was least before counts no more; a text of fewer words repeats its last.
                    least = np.minimum.reduceat(own, c.first[some]) if len(some) else own
                    known = least < np.uint64(1 << 63)
                    keys[k, some] = np.where(known, mix(least).view(np.int64), keys[k - 1, some])  # least hashes of long texts are low, mixed ones anywhere
                    own = np.where(own == np.repeat(least, c.counts[some]), np.uint64(1 << 63), own)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(x) for x in keys)], ["doc_id", "text", "k1", "k2", "k3"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, text string, k1 long, k2 long, k3 long")
    order = ["k1", "k2", "k3", F.xxhash64("doc_id")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id").select("doc_id", "text")


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = bpe.load(path)
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def done() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in ids])
            flat, doc_ids = np.concatenate(ids), pa.chunked_array(names).combine_chunks()
            pieces = np.array(packer.shard(flat, ends), dtype=np.int64).reshape(-1, 5)
            sizes = np.diff(ends, prepend=0)
            begin = (ends - sizes)[pieces[:, 0]] + pieces[:, 1]
            view = memoryview(flat.astype("<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + pieces[:, 2]).tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(pieces[:, 0])), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array(sizes[pieces[:, 0]]), pa.array(pieces[:, 3]), pa.array(pieces[:, 4])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        end = np.array([END], dtype="<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                own = [np.append(x, end) for x in tokenizer.encode_batch(texts(part))]
                ids += own
                names.append(part.column(0))
                held += sum(map(len, own))
                if held >= SHARD_TOKENS:
                    yield done()
                    ids, names, held = [], [], 0
        if ids:
            yield done()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt(docs).mapInArrow(tidy(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
