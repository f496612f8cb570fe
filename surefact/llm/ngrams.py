"""Language-model scores from an Elias-Fano trie of unigrams and bigrams that is trained and queried in shards.

Every word of the training counts is a word of the model. The `NUMBERED` most frequent have 16-bit numbers that all tasks know;
the others ("rare" below) go by their 64-bit hash and live in the bucket of that hash. The numbers only make messages short:
scores do not depend on how many there are. All pairs are kept, those seen once too. Passes over the texts, counts merged before any shuffle:

1. unigram counts of all tokens, in buckets by hash.
2. counts of pairs (context, word). Pairs of numbers are in shards by context; a context that would overfill a shard is split
   by word. A rare word's pairs with numbers before and after it are in its own bucket. A pair of rare words is counted in
   the bucket of its word, where it gets that word's count, and stays in the bucket of its context.
3. every text's pairs and rare words travel to the buckets and shards that can answer them; there tries are
   built in memory-mapped levels (contexts, pointers, words, quantised log probabilities) and queried by
   successor search; only sums per text come back. A shard that many pairs ask is several slots, a task each
   with a copy of the shard; questions take a slot by their chunk of texts.

Merging and answering run over sorted rows, so a task holds one shard and one Arrow batch, however many rows there are.

P(w|v) = max(c(v,w) - D, 0) / c(v) + l(v) P(w), with l(v) what is left of 1; P(w) is the add-0.1 unigram; a
word that training never saw has c = 0. Tokens are words between white space, A-Z lower-cased, and one
end per text. Defined results: a null or empty text is its end token; repeated rows each get a row and each count in
training; an empty training set gives c = N = V = 0.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, raw_texts, slices, tidy
from .hashing import SOLID, Chunk, Table, mix

NUMBERED = 60_000
START = 65_535
DISCOUNT, ADD = 0.75, 0.1
END_KEY = np.uint64(0x9E3779B97F4A7C15)  # of the end token
STEP = 1 / 4096
PARTS = 4  # a context fills a PARTS-th of a shard's share at most, then it is split
SLOT = 4_000_000  # pairs that one slot is asked, or a quarter of a task's share if that is more
FLUSH = 2_000_000
TOGETHER = 1 << 18  # questions of several messages that are answered at once


# -- Elias-Fano -----------------------------------------------------------------------------------


def nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the n-th set bit, from 1, of each word."""
    place, left = np.zeros(len(words), dtype=np.int64), n
    for width in (32, 16, 8, 4, 2, 1):
        mask = np.uint64((1 << width) - 1)
        here = np.bitwise_count((words >> place.astype(np.uint64)) & mask).astype(np.int64)
        skip = here < left
        left = np.where(skip, left - here, left)
        place += np.where(skip, width, 0)
    return place


class Monotone:
    """A non-decreasing sequence below 2**48: low bits packed, high bits in unary, ranks of zeros by word."""

    def __init__(self, upper: np.ndarray, lower: np.ndarray, zeros: np.ndarray, n: int, low: int):
        self.upper, self.lower, self.zeros, self.n, self.low = upper, lower, zeros, n, low

    @classmethod
    def build(cls, values: np.ndarray) -> Monotone:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(low)).astype(np.int64)
        bits = np.zeros(-(-(n + (top >> low) + 2) // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        upper = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.append(0, np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))).astype(np.uint32)
        lower = np.zeros(n * low // 64 + 2, dtype="<u8")
        if low and n:
            at = np.arange(n, dtype=np.int64) * low
            word, shift, part = at >> 6, (at & 63).astype(np.uint64), values & np.uint64((1 << low) - 1)
            first = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
            lower[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.nonzero((at & 63) + low > 64)[0]
            lower[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        return cls(upper, lower, zeros, n, low)

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.lower[word] >> shift
        out |= np.where(shift > 0, self.lower[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.low) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at these indexes: the place of the i-th one, from 0, among the high bits, and the low bits."""
        ones = self.ones if hasattr(self, "ones") else np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        self.ones = ones
        word = np.searchsorted(ones, i, side="right") - 1
        place = nth_bit(self.upper[word], i - ones[word] + 1)
        return ((word * 64 + place - i).astype(np.uint64) << np.uint64(self.low)) | self.low_bits(i)

    def before(self, high: np.ndarray) -> np.ndarray:
        """How many values have smaller high bits: the place of the zero that closes them."""
        rank = np.minimum(high, int(self.zeros[-1]))  # beyond all: everything is before
        word = np.searchsorted(self.zeros, rank, side="left") - 1
        word = np.maximum(word, 0)
        rest = (rank - self.zeros[word].astype(np.int64)).astype(np.int64)  # the rest-th zero of the word, from 1
        place = nth_bit(~self.upper[word], rest)
        return np.where(high > 0, np.minimum(self.n, word * 64 + place + 1 - rank), 0)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value not below each one asked for, and whether it is equal."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        at, end = self.before(high), self.before(high + 1)
        want = values & np.uint64((1 << self.low) - 1)
        # By halves: a frequent context has many words under one value of the high bits.
        stop, live = end.copy(), np.nonzero(at < end)[0]
        while len(live):
            mid = (at[live] + stop[live]) >> 1
            less = self.low_bits(mid) < want[live]
            at[live[less]] = mid[less] + 1
            stop[live[~less]] = mid[~less]
            live = live[at[live] < stop[live]]
        equal = at < end
        equal[equal] = self.low_bits(at[equal]) == want[equal]
        return at, equal


class Trie:
    """Contexts, where their words begin, words and codes: levels of one shard, in a file mapped into memory.

    The words of a context follow on from the last word of the context before, so that the level is monotone; a word is sought
    from where its context's pointer says, relative to the value before. The file has no name: a task that is run again, here
    or elsewhere, builds its shard again."""

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray):
        """Pairs sorted by context, then word."""
        names, begin = np.unique(context, return_index=True)
        word = word.astype(np.int64)
        ends = np.append(begin[1:], len(word)).astype(np.int64)
        past = np.append(0, np.cumsum(word[ends - 1] + 1))[:-1] if len(names) else np.zeros(0, dtype=np.int64)
        levels = [Monotone.build(names), Monotone.build(np.append(begin, len(word))), Monotone.build(np.repeat(past, ends - begin) + word)]
        arrays = [x for m in levels for x in (m.upper, m.lower, m.zeros)] + [code.astype(np.uint16)]
        self.bytes = sum(x.nbytes for x in arrays)
        mapped = []
        with tempfile.TemporaryFile() as f:  # without a name: nothing stays behind
            places = []
            for x in arrays:
                places.append(f.tell())
                f.write(x.tobytes() + b"\0" * (-x.nbytes % 8))
            f.write(b"\0" * 8)
            f.flush()
            for x, place in zip(arrays, places, strict=True):
                mapped.append(np.memmap(f, dtype=x.dtype, mode="r", offset=place, shape=x.shape) if x.size else x)
        self.contexts, self.pointers, self.words = (Monotone(*mapped[3 * k : 3 * k + 3], m.n, m.low) for k, m in enumerate(levels))
        self.codes = mapped[-1]

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each context, from the pointers: where its words begin and end (both 0 if it was never seen) and what they count from."""
        rank, known = self.contexts.successor(context)
        rank = np.where(known, rank, 0)
        begin, end = (np.where(known, self.pointers.at(x).astype(np.int64), 0) for x in (rank, rank + 1))
        past = np.zeros(len(begin), dtype=np.int64)
        past[begin > 0] = self.words.at(begin[begin > 0] - 1).astype(np.int64) + 1
        return begin, end, past

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The codes of pairs, -1 where they were never seen: each distinct context's range once, then the word's successor in it."""
        out = np.full(len(context), -1, dtype=np.int64)
        if not len(self.codes) or not len(context):
            return out
        if int(context.max()) < 1 << 16:
            names = np.nonzero(np.bincount(context))[0]
            place = np.zeros(1 << 16, dtype=np.int64)
            place[names] = np.arange(len(names))
            which = place[context]
        else:
            names, which = np.unique(context, return_inverse=True)
        begin, end, past = self.ranges(names)
        at, equal = self.words.successor(past[which] + word.astype(np.int64))
        hit = equal & (at >= begin[which]) & (at < end[which])
        out[hit] = self.codes[at[hit]]
        return out


# -- messages -------------------------------------------------------------------------------------


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueeze(body: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays again, each a copy that may be written to, of one value too."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T.copy().view(k).ravel())
        at += n * size
    return out


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(keys)
    out, at = np.unique(flat, return_inverse=True)
    return out, np.bincount(at, weights=np.concatenate(counts), minlength=len(out)).astype(np.int64)


class Sums:
    """Counts of keys, merged whenever as many have come together as were left by the last merge, `FLUSH` at least."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n, self.room = 0, FLUSH

    def add(self, keys: np.ndarray) -> bool:
        """Counts keys; whether there are many by now."""
        k, c = np.unique(keys, return_counts=True)
        self.put(k, c)
        return self.n > FLUSH

    def put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.n += len(keys)

    def shrink(self) -> None:
        if self.n > self.room:
            k, c = self.take()
            self.put(k, c)
            self.room = max(FLUSH, 2 * len(k))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merged(self.keys, self.counts) if self.keys else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        self.__init__()  # type: ignore[misc]
        return out


def merge_buckets(rows: DataFrame, kind: str, finish: Callable[[int, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """finish(bucket, keys, counts) of each bucket of (bucket, body), counts summed as the rows pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, Sums()
        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and now >= 0:
                    yield finish(now, *sums.take())
                now = bucket
                sums.put(*unsqueeze(body, kind, "<u4"))
                sums.shrink()
        if now >= 0:
            yield finish(now, *sums.take())

    return rows.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(tidy(run), schema)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def by_bucket(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, n: int, kind: str) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    some = [b for b in range(n) if cuts[b + 1] > cuts[b]]
    bodies = [squeeze(keys[o].astype(kind), counts[o].astype("<u4")) for b in some for o in [order[cuts[b] : cuts[b + 1]]]]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])


class Model:
    """What every task needs, of fixed size: the numbered words' keys and counts, context rests, totals."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int, buckets: int):
        if END_KEY not in keys:  # nothing to train on
            keys, counts = np.append(keys, END_KEY), np.append(counts, 0)
        self.table = Table(max(1, len(keys)))
        if len(keys):
            self.table.put(keys, np.arange(1, len(keys) + 1, dtype=np.int32))
        self.total, self.distinct, self.buckets = total, distinct, buckets
        self.floor = total + ADD * (distinct + 1)
        self.counts = np.append(0, counts).astype(np.float64)
        self.base = np.log10((self.counts + ADD) / self.floor)
        self.unigram = (self.counts + ADD) / self.floor
        # A context that holds more than a shard's share of the tokens is split by word.
        self.split = np.ones(1 << 16, dtype=np.int64)
        share = np.append(0, counts) / max(1, total)
        self.split[: len(share)] = np.clip(np.ceil(share * buckets * PARTS), 1, buckets).astype(np.int64)
        self.split[START] = max(1, min(buckets, int(share.max(initial=0) * buckets * PARTS) + 1))
        self.rest, self.seen = np.ones(1 << 16), np.zeros(1 << 16)
        self.asked = np.zeros(buckets, dtype=np.int64)  # pairs of each shard in training, repeats included

    def shard(self, pairs: np.ndarray) -> np.ndarray:
        context, word = pairs >> 16, pairs & 0xFFFF
        part = mix(word.astype(np.uint64)) % self.split[context].astype(np.uint64)
        # Parts of one context follow one another, so that a split context reaches as many shards as it has parts.
        return ((mix(context.astype(np.uint64)) + part) % np.uint64(self.buckets)).astype(np.int64)

    def slots(self, tasks: int) -> tuple[np.ndarray, np.ndarray]:
        """The first slot of each bucket (and the end), and how many it has: as many as its pairs in training ask for."""
        most = max(SLOT, int(self.asked.sum()) // (4 * tasks))
        n = np.maximum(1, -(-self.asked // most))
        return np.append(0, np.cumsum(n)), n

    def ids(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words (0: rare), and pairs (context << 16 | word) text by text with the end: n + 1 for each."""
        ids = np.maximum(self.table.get(c.key), 0).astype(np.int64)
        end = int(self.table.get(np.array([END_KEY]))[0])
        stops = np.cumsum(c.counts + 1)
        place = np.arange(len(ids)) + c.word_doc
        word = np.full(int(stops[-1]), end, dtype=np.int64)
        word[place] = ids
        context = np.append(START, word[:-1])
        context[stops - c.counts - 1] = START
        return ids, context << 16 | word

    def rare(self, c: Chunk, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the rare words, (number before << 16 | number after) of each, 0 for a rare one; places of those that a rare one follows."""
        at = np.nonzero(ids == 0)[0]
        cell = at + c.word_doc[at]  # the pair that ends in the word; the next one begins with it
        around = (own[cell] >> 16 << 16 | own[cell + 1] & 0xFFFF).astype("<u4")
        return at, around, at[own[cell + 1] == 0]


def tally(keys: tuple[np.ndarray, ...], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns in order, the first column leading, and their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.zeros(len(order), dtype=bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    at = np.nonzero(first)[0]
    n = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else counts.astype(np.int64)
    return [k[at] for k in keys], n


def bodies_by(bucket: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, body) of rows that stand by bucket."""
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.nonzero(np.diff(cuts))[0].tolist():
        yield b, squeeze(*(x[cuts[b] : cuts[b + 1]] for x in columns))


WORDS, TRIE, NEAR, FAR, HEAD, RARE, RARE_PAIRS, PAIRS = range(8)  # rows of a slot come in this order
QUESTIONS = {RARE: ("<u4", "<u8", "<u4"), RARE_PAIRS: ("<u4", "<u8", "<u8"), PAIRS: ("<u4", "<u4")}  # the text, then what is asked


def learn(docs: DataFrame, trained: Column, buckets: int, numbered: int) -> tuple[Model, DataFrame, DataFrame]:
    """The model, unigram counts (bucket, body) and pair counts (bucket, kind, body) of the rows where `trained` holds."""
    src = docs.where(trained).select("text")

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for part in slices(batch, "text"):
                c = Chunk(raw_texts(part), SOLID)
                if sums.add(np.append(c.key, np.full(c.n, END_KEY))):
                    k, n = sums.take()
                    yield by_bucket(k, n, bucket_of(k, buckets), buckets, "<u8")
        if sums.n:
            k, n = sums.take()
            yield by_bucket(k, n, bucket_of(k, buckets), buckets, "<u8")

    def merge_words(bucket: int, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "body": pa.array([k.tobytes() + n.astype("<i8").tobytes()], pa.binary()), "n": [len(k)], "total": [int(n.sum())]})

    words = cut(merge_buckets(src.mapInArrow(tidy(unigrams), "bucket int, body binary"), "<u8", merge_words, "bucket int, body binary, n long, total long"))
    distinct, total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                k, n = halves(body)
                top = np.lexsort((k, -n, k != END_KEY))[:numbered]
                yield pa.RecordBatch.from_arrays([pa.array(k[top].view(np.int64)), pa.array(n[top])], ["k", "n"])

    # At most `numbered` rows of 16 bytes; the end always has a number.
    rows = words.select("body").mapInArrow(tidy(best), "k long, n long").orderBy(F.col("k") != int(END_KEY.view(np.int64)), F.desc("n"), "k").limit(numbered).toArrow()
    model = Model(rows.column("k").to_numpy().view(np.uint64), rows.column("n").to_numpy(), int(total), int(distinct), buckets)
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = kept.value, Sums()
        near: list[tuple[np.ndarray, ...]] = []
        far: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            rows: list[tuple[int, int, bytes]] = []
            k, n = sums.take()
            shard = m.shard(k)
            order = np.argsort(shard, kind="stable")
            rows += [(b, TRIE, body) for b, body in bodies_by(shard[order], buckets, k[order].astype("<u4"), n[order].astype("<u4"))]
            for kind, parts in ((NEAR, near), (FAR, far)):
                if parts:
                    columns = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                    (bucket, *columns), n = tally((bucket_of(columns[-1] if kind == FAR else columns[0], buckets).astype(np.uint16), *columns))
                    rows += [(b, kind, body) for b, body in bodies_by(bucket, buckets, *columns, n.astype("<u4"))]
                    parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "body"])

        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                c = Chunk(raw_texts(part), SOLID)
                ids, own = m.ids(c)
                at, around, first = m.rare(c, ids, own)
                near.append((c.key[at], around))
                far.append((c.key[first], c.key[first + 1]))
                held += len(at) + len(first)
                if sums.add(own[(own >> 16 > 0) & (own & 0xFFFF > 0)]) or held > FLUSH:
                    yield flush()
                    held = 0
        yield flush()

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, Sums()
        near: list[list[np.ndarray]] = []
        far: list[list[np.ndarray]] = []

        def finish() -> pa.RecordBatch:
            k, n = sums.take()
            rows, asked = [(now, TRIE, squeeze(k.astype("<u4"), n.astype("<u4")))] if len(k) else [], int(n.sum())
            contexts, seen = [k >> np.uint64(16)], [n]
            if near:
                key, around, n = (np.concatenate(x) for x in zip(*near, strict=True))
                (word,), c = tally((key,), n)
                asked += int(n.sum())
                place = np.searchsorted(word, key).astype("<u4")
                before, after = around >> 16, (around & 0xFFFF).astype("<u2")
                some = before > 0
                (v, w), n_before = tally((before[some].astype("<u2"), place[some]), n[some])
                contexts.append(v.astype(np.uint64))
                seen.append(n_before)
                some = after > 0
                (rare, x), n_after = tally((place[some], after[some]), n[some])
                # Hashes of the words, so that places follow from the bucket's words; A: numbers before them, B: after them.
                head = squeeze(word.astype("<u8"))
                parts = [squeeze(v, w, n_before.astype("<u4")), squeeze(rare, x, n_after.astype("<u4"))]
                sizes = np.array([len(head), len(parts[0])], dtype="<i8").tobytes()
                rows.append((now, NEAR, sizes + head + parts[0] + parts[1]))
                if far:
                    a, b, n = (np.concatenate(x) for x in zip(*far, strict=True))
                    (a, b), n = tally((a, b), n)
                    asked += int(n.sum())
                    bucket = bucket_of(a, buckets)
                    order = np.argsort(bucket, kind="stable")
                    own = c[np.searchsorted(word, b)]
                    rows += [(to, FAR, body) for to, body in bodies_by(bucket[order], buckets, a[order], b[order], n[order].astype("<u4"), own[order].astype("<u4"))]
            context, at = np.unique(np.concatenate(contexts), return_inverse=True)
            n = np.concatenate(seen)
            mass, whole = np.bincount(at, weights=n - DISCOUNT, minlength=len(context)), np.bincount(at, weights=n, minlength=len(context))
            none = [None] * max(0, len(rows) - 1)
            near.clear()
            far.clear()
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([now] * len(rows), pa.int32()), pa.array([asked, *none], pa.int64())]
            columns += [pa.array([x, *none], pa.list_(kind)) for x, kind in ((context.astype(np.int32), pa.int32()), (mass, pa.float64()), (whole, pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "body", "origin", "asked", "context", "mass", "whole"])

        for batch in batches:
            for bucket, kind, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now and now >= 0:
                    yield finish()
                now = bucket
                if kind == TRIE:
                    sums.put(*unsqueeze(body, "<u4", "<u4"))
                    sums.shrink()
                elif kind == NEAR:
                    near.append(unsqueeze(body, "<u8", "<u4", "<u4"))
                else:
                    far.append(unsqueeze(body, "<u8", "<u8", "<u4"))
        if now >= 0:
            yield finish()

    found = src.mapInArrow(tidy(pairs), "bucket int, kind int, body binary").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    counted = cut(found.mapInArrow(tidy(merge_pairs), "bucket int, kind int, body binary, origin int, asked long, context array<int>, mass array<double>, whole array<double>"))
    # One row for each bucket.
    for bucket, asked in counted.where("asked is not null").select("origin", "asked").collect():
        model.asked[bucket] = asked
    # One row for each context at most: a bound by the numbered words.
    sums = counted.select(F.explode(F.arrays_zip("context", "mass", "whole")).alias("x")).groupBy("x.context").agg(F.sum("x.mass").alias("mass"), F.sum("x.whole").alias("whole")).toArrow()
    c, mass, whole = (sums.column(k).to_numpy() for k in ("context", "mass", "whole"))
    model.rest[c], model.seen[c] = np.clip(1 - mass / whole, 1e-9, 1), whole
    kept.unpersist()
    return model, words.select("bucket", "body"), counted.select("bucket", "kind", "body")


def halves(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(body) // 16
    return np.frombuffer(body, dtype="<u8", count=n), np.frombuffer(body, dtype="<i8", offset=8 * n)


def coded(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(p) / STEP), 0, 65535)


class Bucket:
    """What a slot holds: word counts and tries of the pairs of numbers, of rare words with numbers, and of rare words."""

    def __init__(self, m: Model):
        self.m = m
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.lower, self.back = np.log10(m.unigram), np.log10(m.rest)
        self.trie: Trie | None = None
        self.near, self.far, self.built = b"", [], False

    def words(self, body: bytes) -> None:
        self.keys, self.counts = halves(body)

    def pairs(self, body: bytes) -> None:
        k, n = unsqueeze(body, "<u4", "<u4")
        context, word = (k >> 16).astype(np.int64), (k & 0xFFFF).astype(np.int64)
        self.trie = Trie(context, word, coded((n - DISCOUNT) / self.m.seen[context] + self.m.rest[context] * self.m.unigram[word]))

    def place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand among the bucket's, and their counts in training."""
        if not len(self.keys):
            return np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.counts[at], 0)

    def build(self) -> None:
        if self.built:
            return
        self.built, m, none = True, self.m, np.zeros(0, dtype=np.int64)
        v = w = n = rare = x = n_after = a = b = n_far = own = none
        if self.near:
            k, k2 = np.frombuffer(self.near, dtype="<i8", count=2).tolist()
            (word,) = unsqueeze(self.near[16 : 16 + k], "<u8")
            place = np.searchsorted(self.keys, word)
            v, w, n = unsqueeze(self.near[16 + k : 16 + k + k2], "<u2", "<u4", "<u4")
            rare, x, n_after = unsqueeze(self.near[16 + k + k2 :], "<u4", "<u2", "<u4")
            v, w, rare, x = v.astype(np.int64), place[w], place[rare], x.astype(np.int64)
        if self.far:
            a, b, n_far, own = (np.concatenate(y) for y in zip(*(unsqueeze(body, "<u8", "<u8", "<u4", "<u4") for body in self.far), strict=True))
            a = np.searchsorted(self.keys, a)
        self.names, b = np.unique(b.astype(np.uint64), return_inverse=True)
        mass = np.bincount(rare, weights=n_after - DISCOUNT, minlength=len(self.keys)) + np.bincount(a, weights=n_far - DISCOUNT, minlength=len(self.keys))
        self.rest = np.clip(1 - mass / np.maximum(1, self.counts), 1e-9, 1)
        unigram = lambda c: (c + ADD) / m.floor
        self.before = Trie(v, w, coded((n - DISCOUNT) / m.seen[v] + m.rest[v] * unigram(self.counts[w])))
        self.after = Trie(rare, x, coded((n_after - DISCOUNT) / self.counts[rare] + self.rest[rare] * m.unigram[x]))
        order = np.lexsort((b, a))
        a, b, n_far, own = a[order], b[order], n_far[order], own[order]
        self.among = Trie(a, b, coded((n_far - DISCOUNT) / self.counts[a] + self.rest[a] * unigram(own)))
        # In the order of the names: a word has one count.
        self.own = np.zeros(len(self.names))
        self.own[b] = np.log10(unigram(own))
        self.near, self.far = b"", []

    def fallback(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log l(v) of rare contexts; 0 where training never saw them."""
        out = np.zeros(len(at))
        out[c > 0] = np.log10(self.rest[at[c > 0]])
        return out

    def rare(self, key: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, log P(w), and log P(w|v) of the word and of the number after it. A rare word before gives log P(w) here, and
        rare_pairs what is above it; a rare word after is left to its own bucket."""
        self.build()
        at, c = self.place(key)
        own = np.log10((c + ADD) / self.m.floor)
        v, x = (around >> 16).astype(np.int64), (around & 0xFFFF).astype(np.int64)
        code = np.where(c > 0, self.before.find(v, at), -1)
        gain = np.where(v > 0, np.where(code >= 0, -STEP * code, np.log10(self.m.rest[v]) + own), own)
        code = np.where(c > 0, self.after.find(at, x), -1)
        gain += np.where(x > 0, np.where(code >= 0, -STEP * code, self.fallback(at, c) + np.log10(self.m.unigram[np.minimum(x, len(self.m.unigram) - 1)])), 0)
        return c, own, gain

    def rare_pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log P(w|v) - log P(w) of pairs of rare words."""
        self.build()
        at, c = self.place(context)
        out = self.fallback(at, c)
        if len(self.names):
            name = np.minimum(np.searchsorted(self.names, word), len(self.names) - 1)
            code = np.where((c > 0) & (self.names[name] == word), self.among.find(at, name), -1)
            out = np.where(code >= 0, -STEP * code - self.own[name], out)
        return out

    def numbered(self, pair: np.ndarray) -> np.ndarray:
        """log P(w|v) of pairs of numbers."""
        context, word = (pair >> 16).astype(np.int64), (pair & 0xFFFF).astype(np.int64)
        code = self.trie.find(context, word) if self.trie else np.full(len(pair), -1)
        return np.where(code >= 0, -STEP * code, self.back[context] + self.lower[word])

    def replies(self, kind: int, questions: list[list[np.ndarray]]) -> Iterator[bytes]:
        """The reply to each message of one kind. All are searched for at once: there are as many messages as chunks times
        buckets, and a search costs about the same for a hundred questions as for one."""
        doc, *asked = (np.concatenate(x) for x in zip(*questions, strict=True))
        cell = np.repeat(np.arange(len(questions), dtype=np.uint64) << np.uint64(32), [len(x[0]) for x in questions]) | doc
        if kind == PAIRS:  # they stand by text
            begin = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0]
            some, sums = cell[begin], [np.add.reduceat(self.numbered(*asked), begin)]
        else:
            some, at = np.unique(cell, return_inverse=True)
            if kind == RARE:
                c, own, gain = self.rare(*asked)
                sums = [np.bincount(at[c > 0], minlength=len(some)).astype("<u4"), *(np.bincount(at, weights=x, minlength=len(some)) for x in (own, gain))]
            else:
                sums = [np.bincount(at, weights=self.rare_pairs(*asked), minlength=len(some))]
        for _, body in bodies_by((some >> np.uint64(32)).astype(np.int64), len(questions), some.astype("<u4"), *sums):
            yield body


def score(docs: DataFrame, trained: Column, buckets: int | None = None, numbered: int = NUMBERED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows of (doc_id, text)."""
    spark = docs.sparkSession
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model, words, pairs = learn(docs, trained, buckets or min(4096, tasks), numbered)
    first, n_slots = model.slots(tasks)
    kept = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "slot", "kind", "body", "ids", "held"]
    message = f"chunk long, slot int, kind int, body binary, ids array<{kind}>, held array<boolean>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk of texts: what is known of them here, and a question to each bucket and shard."""
        from pyspark import TaskContext

        m, chunk = kept.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                c = Chunk(raw_texts(part), SOLID)
                ids, own = m.ids(c)
                end = int(m.table.get(np.array([END_KEY]))[0])
                base = np.bincount(c.word_doc, weights=np.where(ids > 0, m.base[ids], 0), minlength=c.n) + m.base[end]
                known = np.bincount(c.word_doc[ids > 0], minlength=c.n) + int(m.counts[end] > 0)
                lot = int(mix(np.array([chunk], dtype=np.uint64))[0] >> np.uint64(1))
                slot = (first[:-1] + lot % n_slots).tolist()
                rows: list[tuple[int, int, bytes]] = []
                rare, around, before = m.rare(c, ids, own)
                for kind, at in ((RARE, rare), (RARE_PAIRS, before)):
                    bucket = bucket_of(c.key[at], m.buckets)
                    order = np.argsort(bucket, kind="stable")
                    second = around[order] if kind == RARE else c.key[at[order] + 1]
                    rows += [(slot[b], kind, body) for b, body in bodies_by(bucket[order], m.buckets, c.word_doc[at[order]].astype("<u4"), c.key[at[order]], second)]
                doc = np.repeat(np.arange(c.n), c.counts + 1)
                both = (own >> 16 > 0) & (own & 0xFFFF > 0)
                doc, own = doc[both], own[both]
                cell = np.sort(m.shard(own).astype(np.uint64) << np.uint64(52) | doc.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64))
                cuts = np.searchsorted(cell >> np.uint64(52), np.arange(m.buckets + 1))
                for b in np.nonzero(np.diff(cuts))[0].tolist():
                    some = cell[cuts[b] : cuts[b + 1]]
                    which = (some >> np.uint64(32) & np.uint64(0xFFFFF)).astype("<u4")
                    rows.append((slot[b], PAIRS, squeeze(np.diff(which, prepend=which.dtype.type(0)).astype("<u4"), some.astype("<u4"))))
                rows.append((lot % int(first[-1]), HEAD, squeeze((c.counts + 1).astype("<i8"), known.astype("<i8"), base)))
                none = [None] * (len(rows) - 1)
                columns = [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
                columns += [pa.array([*none, part.column(k).to_pylist()], pa.list_(part.column(k).type)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names)
                chunk += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A reply to each question, by the counts and the trie that stand before it; heads pass through."""
        m, now = kept.value, -1
        here = Bucket(m)
        for batch in batches:
            slot, what, bodies = (batch.column(k).to_pylist() for k in (1, 2, 3))
            at: list[int] = []
            replies: list[bytes] = []
            open_: list[list[np.ndarray]] = []  # questions without a reply so far, of the slot and the kind of the last of `at`
            held = 0
            for row in range(batch.num_rows):
                if open_ and (slot[row] != now or what[row] != what[at[-1]] or held > TOGETHER):
                    replies += here.replies(what[at[-1]], open_)
                    open_, held = [], 0
                if slot[row] != now:
                    now, here = slot[row], Bucket(m)
                body = bodies[row]
                if what[row] == WORDS:
                    here.words(body)
                elif what[row] == TRIE:
                    here.pairs(body)
                elif what[row] == NEAR:
                    here.near = body
                elif what[row] == FAR:
                    here.far.append(body)
                elif what[row] == HEAD:
                    at.append(row)
                    replies.append(body)
                else:
                    doc, *asked = unsqueeze(body, *QUESTIONS[what[row]])
                    open_.append([np.cumsum(doc, dtype="<u4") if what[row] == PAIRS else doc, *asked])
                    held += len(doc)
                    at.append(row)
            if open_:
                replies += here.replies(what[at[-1]], open_)
            if at:
                out = batch.take(pa.array(at))
                yield out.set_column(3, "body", pa.array(replies, pa.binary()))

    def finish(t: pa.Table) -> pa.Table:
        kinds, bodies = t.column("kind").to_pylist(), t.column("body").to_pylist()
        head = kinds.index(HEAD)
        ids, held = (t.column(k).slice(head, 1).combine_chunks().flatten() for k in ("ids", "held"))
        tokens, known, base = unsqueeze(bodies[head], "<i8", "<i8", "<f8")
        total = np.zeros(len(ids))
        # In one order, so that sums are the same in every run.
        for what, body in sorted((k, b) for k, b in zip(kinds, bodies, strict=True) if k != HEAD):
            if what == RARE:
                doc, more, own, gain = unsqueeze(body, "<u4", "<u4", "<f8", "<f8")
                known[doc] += more
                base[doc] += own
            else:
                doc, gain = unsqueeze(body, "<u4", "<f8")
            total[doc] += gain
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": tokens, "n_known": known, "train_tokens": pa.array([kept.value.total] * len(ids), pa.int64()), "base_score": base, "score": total})

    # A row for each bucket at most; its shard is copied to each of its slots.
    places = spark.createDataFrame([(b, int(first[b]), int(n)) for b, n in enumerate(n_slots)], "bucket int, first int, n int")
    shards = words.withColumn("kind", F.lit(WORDS)).unionByName(pairs).join(F.broadcast(places), "bucket")
    shards = shards.select(F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"), "kind", "body")
    asked = docs.select("doc_id", (~trained).alias("held"), "text").mapInArrow(tidy(ask), message)
    rows = asked.unionByName(shards, allowMissingColumns=True).repartitionById(int(first[-1]), F.col("slot")).sortWithinPartitions("slot", "kind")
    replies = rows.mapInArrow(tidy(answer), message)
    return replies.groupBy("chunk").applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
