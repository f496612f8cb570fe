"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared tile against tile with exclusive-or and bit counts; tiles stand in order of their
population counts, and a pair of tiles whose counts differ by more than the radius is skipped. So that no
task sees all fingerprints, they are first dealt to buckets without losing a link: fingerprints within r bits
agree on at least one of r + 1 blocks of bits. Of a bucket beyond `TILE` rows, those near its smallest node are linked to
it first and are not compared among themselves; the rest is dealt on as pairs of sub-buckets, so a hot bucket is many
tasks. A task returns a spanning forest of the links it finds, which loses no component.

`near_duplicates` is the operator for a similarity bound: wide fingerprints of word shingles, buckets by
bands of min-hashes, a loose radius, then exact Jaccard of the shingle sets within each cluster.

Defined results: a null text is the empty text; a text of fewer words than a shingle is one shingle; a text
without words has fingerprint zero and is linked like any other (in `near_duplicates` such texts equal each other).
Rows with a null id get a class if another id is there, else null. Repeated rows fall into one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, raw_texts, slices, tidy
from .grouping import Forest, by_runs, components, runs
from .hashing import mix

TILE = 2048
SUB = 256
BANDS, ROWS = 16, 3


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, A-Z lower-cased, joined by spaces."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(split), 42)], dtype=np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    pieces = [joined[a:b] for a, b in zip(starts[: len(split) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.fromiter([digest(x, 42) for x in pieces], dtype=np.uint64, count=len(pieces))


def majority(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each run of hashes flat[begin:next begin], none empty: a bit is 1 if it is set in over half of them."""
    ends = np.append(begins[1:], len(flat))
    out = np.empty(len(begins), dtype=np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + 65_536)))
        if j == i + 1 and ends[i] - begins[i] > 65_536:
            total = np.zeros((1, 64), dtype=np.int64)
            for k in range(int(begins[i]), int(ends[i]), 65_536):
                total += bits_of(flat[k : min(k + 65_536, int(ends[i]))]).sum(axis=0, dtype=np.int64)
        else:
            total = np.add.reduceat(bits_of(flat[begins[i] : ends[j - 1]]), begins[i:j] - begins[i], axis=0, dtype=np.int32)
        more = 2 * total > (ends[i:j] - begins[i:j])[:, None]
        out[i:j] = np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]
        i = j
    return out


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-empty arrays one after another, where each begins, and which they are."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    some = np.nonzero(sizes)[0]
    flat = np.concatenate([sets[i] for i in some.tolist()]) if len(some) else np.zeros(0, dtype=np.uint64)
    return flat, np.cumsum(sizes[some]) - sizes[some], some


def fingerprints(df: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, begins, some = joined([shingle_hashes(x, words) for x in raw_texts(part)])
                fps = np.zeros(part.num_rows, dtype=np.uint64)
                fps[some] = majority(flat, begins)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return df.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


def compare(fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows (of one or more 64-bit words) within the radius, as row numbers.

    side: if given, only pairs of different sides count."""
    n = len(fps)
    count = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(count, kind="stable")
    fps, count = np.ascontiguousarray(fps[order].T), count[order]
    side = side[order] if side is not None else None
    forest = Forest(n)
    for i in range(0, n, SUB):
        for j in range(i, n, SUB):
            if count[j] - count[min(i + SUB, n) - 1] > radius:
                break  # so do all later tiles
            far = np.zeros((min(SUB, n - i), min(SUB, n - j)), dtype=np.uint16)
            for word in fps:
                far += np.bitwise_count(word[i : i + SUB, None] ^ word[None, j : j + SUB])
            a, b = np.nonzero(far <= radius)
            near = a + i < b + j
            a, b = a[near] + i, b[near] + j
            if side is not None:
                other = side[a] != side[b]
                a, b = a[other], b[other]
            if len(a):
                # A root for each row first: most links of a dense tile join nothing new.
                roots = np.array([forest.root(x) for x in range(i, min(i + SUB, n))] + [forest.root(x) for x in range(j, min(j + SUB, n))])
                new = roots[a - i] != roots[b - j + min(SUB, n - i)]
                forest.join(a[new], b[new])
    links = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
    return order[links[:, 0]], order[links[:, 1]]


def deal(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds `key` and `side` to rows of (bucket, node, done, ...): a bucket of one is dropped, one of up to `tile` rows is a
    group, a larger one is pairs of its sub-buckets. Rows that are done are linked to the bucket's hub already, so they
    meet only those that are not."""
    sizes = rows.groupBy("bucket").agg(F.count_if("done").alias("hubbed"), F.count_if(~F.col("done")).alias("open")).where("open > 0 and hubbed + open > 1")
    parts = lambda c: F.ceil(F.col(c) / tile).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(F.col(c), F.lit(1))).cast("int")
    return (
        rows.join(sizes, "bucket").withColumns({"h": parts("hubbed"), "m": parts("open")}).drop("hubbed", "open")
        .withColumn("side", F.when(F.col("done"), F.col("m") + own("h")).otherwise(own("m")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("done"), F.col("m") - 1).otherwise(F.col("m") + F.col("h") - 1))))
        .withColumn("key", F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")))
        .drop("m", "h", "other", "bucket", "done")
    )


def to_hubs(rows: DataFrame, sizes: DataFrame, radius: int, words: int, tile: int) -> DataFrame:
    """(bucket, node, fp, hub, done) of the buckets beyond a tile: whether a row lies within the radius of its bucket's smallest
    node. A bucket of many near copies is one star, which spares the pairs among its rows."""
    large = rows.join(counted(sizes.where(F.col("n") > tile).select("bucket")), "bucket")
    hubs = large.groupBy("bucket").agg(F.min("node").alias("hub"), F.min_by("fp", "node").alias("to"))
    far = sum((F.bit_count(F.col("fp")[k].bitwiseXOR(F.col("to")[k])) for k in range(words)), F.lit(0))
    return cut(large.join(hubs, "bucket").select("bucket", "node", "fp", "hub", (far <= radius).alias("done")))


def linked(rows: DataFrame, radius: int, words: int = 1, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span what lies within the radius in each bucket, of rows (bucket long, node long, fp array<long>)."""

    def find(t: pa.Table) -> pa.Table | None:
        node = t.column("node").to_numpy()
        fps = t.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
        side, out = t.column("side").to_numpy(), []
        for a, b in runs(t.column("key").to_numpy()):
            if b - a == 2:
                if int(np.bitwise_count(fps[a] ^ fps[a + 1]).sum()) <= radius:
                    out.append((node[a : a + 1], node[a + 1 : a + 2]))
            else:
                # A pair of sub-buckets compares across; each sub-bucket compares itself in its own group.
                s = side[a:b]
                x, y = compare(fps[a:b], radius, s if s.max() != s.min() else None)
                out.append((node[a:b][x], node[a:b][y]))
        if not out:
            return None
        return pa.table({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    sizes = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    starred = to_hubs(rows, sizes, radius, words, tile)
    small = rows.join(sizes.where(F.col("n") <= tile).select("bucket"), "bucket").select("node", "fp", F.lit(0).alias("side"), F.xxhash64("bucket").alias("key"))
    groups = small.unionByName(deal(starred.select("bucket", "node", "fp", "done"), tile).select("node", "fp", "side", "key"))
    star = starred.where("done and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return by_runs(groups, "key", find, "a long, b long").union(star).distinct()


def blocks(nodes: DataFrame, radius: int) -> DataFrame:
    """(bucket, node, fp) for each of radius + 1 blocks of a 64-bit fingerprint."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    keys = [F.xxhash64(F.lit(k), F.shiftrightunsigned(F.shiftleft("fp", 64 - edges[k + 1]), 64 - edges[k + 1] + edges[k])) for k in range(n)]
    return nodes.select(F.explode(F.array(*keys)).alias("bucket"), "node", F.array("fp").alias("fp"))


def classes(df: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id): the smallest doc_id reachable over links of at most `radius` bits."""
    docs = cut(fingerprints(df, words))
    nodes = cut(docs.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(linked(blocks(nodes, radius), radius))
    of = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return docs.join(of, "fp", "left").select("doc_id", "fp", "component_id")


# -- a bound on the similarity of shingle sets ----------------------------------------------------


def wide(flat: np.ndarray, begins: np.ndarray, lanes: int = 4) -> np.ndarray:
    """Fingerprints of 64 * lanes bits of sets of hashes, a row each."""
    return np.stack([majority(flat if k == 0 else mix(flat + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))), begins) for k in range(lanes)], axis=1)


_SEEDS = np.random.default_rng(5).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hashes of BANDS bands of ROWS min-hashes each, a row for each set."""
    rows = np.empty((len(_SEEDS), len(begins)), dtype=np.uint64)
    for k, seed in enumerate(_SEEDS):
        rows[k] = np.minimum.reduceat(mix_light(flat, seed), begins) if len(begins) else 0
    h = np.repeat((np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None], len(begins), axis=1)
    for k in range(ROWS):
        h = mix(h ^ rows[k::ROWS])
    return h.T


def mix_light(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = h * seed
    return h ^ (h >> np.uint64(32))


def sketches(df: DataFrame, words: int) -> DataFrame:
    """(doc_id, same long, n int, fp array<long>, bands array<long>) of each text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [np.unique(shingle_hashes(x, words)) for x in raw_texts(part)]
                flat, begins, some = joined(sets)
                fps, keys = np.zeros((len(sets), 4), dtype=np.uint64), np.zeros((len(sets), BANDS), dtype=np.uint64)
                fps[some], keys[some] = wide(flat, begins), bands(flat, begins)
                own = np.zeros(len(sets), dtype=np.int64)
                own[some] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([xxhash.xxh64_intdigest(h.tobytes(), len(h)) - (1 << 63) for h in sets], pa.int64()),
                        pa.array([len(h) for h in sets], pa.int32()),
                        pa.FixedSizeListArray.from_arrays(pa.array(fps.view(np.int64).ravel()), 4).cast(pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(own)), pa.int32()), pa.array(np.ascontiguousarray(keys[some]).view(np.int64).ravel())),
                    ],
                    ["doc_id", "same", "n", "fp", "bands"],
                )

    return df.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, same long, n int, fp array<long>, bands array<long>")


def jaccard_links(sets: list[np.ndarray], similarity: float, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets of at least that Jaccard similarity, by counting over an inverted index, or over bit
    rows of the shared items where that is cheaper."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only what two sets share counts.
    kept = times[item] > 1
    _, item = np.unique(item[kept], return_inverse=True)
    owner, times = owner[kept], times[times > 1]
    label, links = np.arange(n), []
    columns = -(-len(times) // 64)
    dense = n * n * columns < 20 * int((times * times).sum()) and n * columns < 1 << 24
    if dense:
        matrix = np.zeros((n, columns * 64), dtype=bool) if n * columns < 1 << 20 else None
        packed = np.zeros((n, columns * 8), dtype=np.uint8)
        if matrix is not None:
            matrix[owner, item] = True
            packed = np.packbits(matrix, axis=1, bitorder="little")
        else:
            np.bitwise_or.at(packed, (owner, item >> 3), (1 << (item & 7)).astype(np.uint8))
        packed = np.ascontiguousarray(packed).view(np.uint64)
    else:
        order = np.argsort(item, kind="stable")
        posting, first = owner[order], np.append(0, np.cumsum(times))
        begins = np.searchsorted(owner, np.arange(n + 1))
    for i in range(1, n):
        if dense:
            shared = np.bitwise_count(packed[:i] & packed[i]).sum(axis=1, dtype=np.int64)
        else:
            own = item[begins[i] : begins[i + 1]]
            lo, span = first[own], first[own + 1] - first[own]
            at = np.repeat(lo - np.cumsum(span) + span, span) + np.arange(int(span.sum()))
            shared = np.bincount(posting[at], minlength=n)[:i]
        near = np.nonzero((shared > 0) & (shared >= similarity * (sizes[i] + sizes[:i] - shared) - 1e-9))[0]
        if side is not None:
            near = near[side[near] != side[i]]
        near = near[label[near] != label[i]]
        while len(near):
            links.append((i, int(near[0])))
            label[label == label[near[0]]] = label[i]
            near = near[label[near] != label[i]]
    found = np.array(links, dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def text_hubs(df: DataFrame, loose: DataFrame, words: int, similarity: float, tile: int) -> DataFrame:
    """(bucket, node, hub, done) of the clusters (node, root) beyond a tile: whether a text's similarity to that of its cluster's
    smallest node is enough. A cluster is parts of a tile; each part's rows pass by a copy of the hub's set."""
    sizes = loose.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).withColumn("m", F.ceil(F.col("n") / tile).cast("int"))
    own = F.array(F.pmod(F.xxhash64("node", F.lit(11)), F.col("m")).cast("int"))
    parts = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(own)
    rows = cut(loose.join(sizes, "root").select("node", "root", F.explode(parts).alias("part"), (F.col("node") != F.col("root")).alias("late")))
    # One text for each node: repeated ids come with the least of their texts.
    rows = df.select(F.col("doc_id").alias("node"), "text").join(counted(rows), "node").groupBy("node", "root", "part", "late").agg(F.min("text").alias("text")).withColumn("key", F.xxhash64("root", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                done = []
                for late, text in zip(part.column(2).to_pylist(), raw_texts(part), strict=True):
                    own = np.unique(shingle_hashes(text, words))
                    if not late:
                        hub = own
                    shared = len(np.intersect1d(own, hub, assume_unique=True))
                    done.append(not late or (shared > 0 and shared >= similarity * (len(own) + len(hub) - shared) - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(done, pa.bool_())], ["root", "node", "late", "done"])

    rows = rows.repartition(F.col("key")).sortWithinPartitions("key", "late").select("root", "node", "late", "text")
    found = cut(rows.mapInArrow(tidy(run), "root long, node long, late boolean, done boolean"))
    return found.select(F.col("root").alias("bucket"), "node", F.col("root").alias("hub"), "done").dropDuplicates(["node"])


def near_duplicates(df: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = 1024) -> DataFrame:
    """(doc_id, component_id) over links of texts whose sets of word shingles have that Jaccard similarity or more.

    Candidates: equal bands (a pair at 0.8 is missed with chance 1e-5) and fingerprints of 256 bits within the
    bits expected at `similarity` plus six deviations (sets of few shingles differ in more bits, as ties of a bit count as 0). Every pair within a cluster of candidates is then decided exactly.
    """
    cosine = 2 * similarity / (1 + similarity)
    differ = float(np.arccos(cosine) / np.pi)
    radius = int(np.ceil(256 * differ + 6 * np.sqrt(256 * differ * (1 - differ))))
    docs = cut(sketches(df, words))
    nodes = cut(docs.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    loose = cut(components(linked(nodes.select(F.explode("bands").alias("bucket"), "node", "fp"), radius, words=4)))
    # The exact pass reads the whole texts of clustered nodes only, each cluster as groups of bounded size.
    starred = text_hubs(df, loose, words, similarity, tile)
    of_loose = loose.join(starred.select("node", "done"), "node", "left").select("node", F.col("root").alias("bucket"), F.coalesce("done", F.lit(False)).alias("done"))
    chosen = df.select(F.col("doc_id").alias("node"), "text").join(of_loose, "node").groupBy("node", "bucket", "done").agg(F.min("text").alias("text"))

    def decide(t: pa.Table) -> pa.Table | None:
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        texts, out = t.column("text").to_pylist(), []
        for a, b in runs(t.column("key").to_numpy()):
            if b - a > 1:
                s = side[a:b]
                x, y = jaccard_links([np.unique(shingle_hashes((t or "").encode(), words)) for t in texts[a:b]], similarity, s if s.max() != s.min() else None)
                out.append((node[a:b][x], node[a:b][y]))
        if not out:
            return None
        return pa.table({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    star = starred.where("done and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = components(by_runs(deal(chosen, tile), "key", decide, "a long, b long").union(star))
    of = nodes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component_id"))
    return docs.join(of, "same", "left").select("doc_id", "component_id")


def drop_near_duplicates(df: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of one document of each class, that of the smallest doc_id (of repeated ids, the row of the least text); rows with a null
    id stay. Texts without words equal each other: one of them stays."""
    keep = near_duplicates(df, words, similarity).where("doc_id = component_id").select("doc_id").distinct()
    whole = F.struct(*(F.col(c) for c in df.columns))
    kept = df.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
    return kept.unionByName(df.where("doc_id is null"))
