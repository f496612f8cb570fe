"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Every word of the examples is a term. A term's weight in a text is (1 + log tf) idf r: document frequencies count all documents,
and r, between a tenth and 1.1, grows with what the term's presence tells of the label in the examples (G-test). Without r a text is near
those that share its rare ordinary words, whatever their label. The examples are at most `max_examples` labelled rows, the smallest by a
hash of their id, with `max_entries` distinct words together; their vectors are taken whole and no term is dropped.

Examples stand in blocks of like ones; for each term and block that it stands in, a cell holds its largest weight and its
postings. Terms of an eighth of the examples or more have a full row of weights instead, multiplied for many texts at once. The largest
sum of these in a block and the cells of the other terms bound the block's cosines: the blocks of the highest bounds
give a floor for the k-th neighbour, and only blocks whose bound reaches it are read, so the neighbours are exact (cosines to 12 decimals). Votes are weighted by cosine, and a monotone fit on the examples' own leave-one-out votes
turns them into probabilities. Evidence is the neighbours and their cosines.

Defined results: a null or empty text, or one without a term, gets the share of label 1 among such examples; ties
go to the example that stands first; a document labelled both ways counts as 1; of rows with one id the least text is learnt from;
null labels and ids are not learnt from. Without examples of both labels every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, raw_texts, slices, tidy, trim
from .hashing import ALNUM, Chunk, Table

BLOCK = 256
#: Texts that are multiplied with the full rows at once.
GROUP = 256
FULL = 8
#: A term of G 30 has half the relevance of a sure one; the rest keep a tenth.
SURE, LEAST = 30.0, 0.1


def term_counts(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count) of each distinct word of each text."""
    order = np.lexsort((c.key, c.word_doc))
    d, k = c.word_doc[order], c.key[order]
    first = np.ones(len(d), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.nonzero(first)[0]
    return d[at], k[at], np.diff(np.append(at, len(d)))


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... of each run, one after another."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def relevance(n: np.ndarray, bad: np.ndarray, total: int, total_bad: int) -> np.ndarray:
    """LEAST plus a share that grows with the G statistic of a term's presence against the label."""
    xlogx = lambda x: x * np.log(np.where(x > 0, x, 1.0))
    good = n - bad
    g = 2 * (xlogx(bad) + xlogx(good) + xlogx(total_bad - bad) + xlogx(total - total_bad - good) - xlogx(n) - xlogx(total - n))
    g = np.maximum(g + 2 * (xlogx(np.float64(total)) - xlogx(np.float64(total_bad)) - xlogx(np.float64(total - total_bad))), 0)
    return LEAST + g * g / (g * g + SURE * SURE)


class Model:
    """Sparse unit vectors of the examples as cells and postings, and the fit of votes to probabilities."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, labels: np.ndarray, ids: pa.Array, doc: np.ndarray, term: np.ndarray, count: np.ndarray, k: int):
        """terms: sorted keys, with their weights; doc, term, count: the examples' entries, by example."""
        self.k, self.prior = k, float(labels.mean()) if len(labels) else 0.0
        self.known = Table(max(1, len(terms)))
        if len(terms):
            self.known.put(terms, np.arange(len(terms), dtype=np.int32))
        blank = np.bincount(doc, minlength=len(labels)) == 0
        self.empty = float((labels[blank].sum() + self.prior) / (blank.sum() + 1))
        self.weight, self.n_terms = weight, len(terms)
        w = (1 + np.log(count)) * weight[term]
        w /= np.sqrt(np.bincount(doc, weights=w * w, minlength=len(labels)))[doc]
        # Like examples side by side: by their heaviest terms.
        heavy = np.full((len(labels), 3), len(terms), dtype=np.int64)
        by = np.lexsort((term, -w, doc))
        begin = np.searchsorted(doc[by], np.arange(len(labels)))
        for j in range(3):
            some = np.nonzero(begin + j < np.searchsorted(doc[by], np.arange(len(labels)), side="right"))[0]
            heavy[some, j] = term[by[begin[some] + j]]
        order = np.lexsort((heavy[:, 2], heavy[:, 1], heavy[:, 0]))
        place = np.empty(len(labels), dtype=np.int64)
        place[order] = np.arange(len(labels))
        self.labels, self.ids, self.n = labels[order].astype(np.int64), ids.take(pa.array(order)), len(labels)
        self.blocks = max(1, -(-self.n // BLOCK))
        doc = place[doc]
        by = np.lexsort((doc, term))
        doc, term, w = doc[by], term[by], w[by]
        often = np.bincount(term, minlength=len(terms)) * FULL >= max(FULL, self.n)
        self.full = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.blocks * BLOCK))
        self.rows[self.full[term[often[term]]], doc[often[term]]] = w[often[term]]
        rest = ~often[term]
        doc, term, w = doc[rest], term[rest], w[rest]
        cell = term * self.blocks + doc // BLOCK
        first = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0] if len(cell) else np.zeros(0, dtype=np.int64)
        self.post_doc, self.post_weight = doc.astype(np.int32), w
        self.cell_begin = np.append(first, len(cell)).astype(np.int64)
        self.cell_block = (doc[first] // BLOCK).astype(np.int32)
        self.cell_most = np.maximum.reduceat(w, first) if len(first) else w
        self.term_begin = np.searchsorted(term[first], np.arange(len(terms) + 1))
        self.knots = self.levels = np.array([0.0, 1.0])

    def read(self, cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Parts of the cosines from the postings of these cells, each with the text's weight of its term."""
        begin = self.cell_begin[cells]
        size = self.cell_begin[cells + 1] - begin
        at = spread(begin, size)
        return np.bincount(self.post_doc[at], weights=self.post_weight[at] * np.repeat(weight, size), minlength=self.blocks * BLOCK)

    def nearest(self, term: np.ndarray, weight: np.ndarray, score: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a positive cosine, and the cosines. score: what the full rows give to each.

        The blocks of the highest bounds give a floor; every block whose bound reaches it is then read at once."""
        begin = self.term_begin[term]
        size = self.term_begin[term + 1] - begin
        cells, weight = spread(begin, size), np.repeat(weight, size)
        block = self.cell_block[cells]
        bound = score.reshape(self.blocks, BLOCK).max(axis=1) + np.bincount(block, weights=weight * self.cell_most[cells], minlength=self.blocks)
        chosen = np.zeros(self.blocks, dtype=bool)
        chosen[np.argsort(-bound, kind="stable")[:2]] = True
        some = chosen[block]
        score = score + self.read(cells[some], weight[some])
        if leave >= 0:
            score[leave] = 0
        sure = score.reshape(self.blocks, BLOCK)[chosen].ravel()
        floor = np.partition(sure, -self.k)[-self.k] if len(sure) > self.k else 0.0
        more = (bound * (1 + 1e-12) + 1e-12 >= floor) & (bound > 0) & ~chosen
        if more.any():
            some = more[block]
            score += self.read(cells[some], weight[some])
            if leave >= 0:
                score[leave] = 0
        score = np.where(np.repeat(chosen | more, BLOCK), np.round(score, 12), 0)
        if len(score) > self.k:
            floor = np.partition(score, -self.k)[-self.k]
        docs = np.nonzero((score > 0) & (score >= floor))[0]
        best = np.lexsort((docs, -score[docs]))[: self.k]
        return docs[best], score[docs[best]]

    def neighbours(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, leave: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each of n texts, given by their entries: the places of its neighbours and the cosines. leave: text i is example i."""
        ends = np.searchsorted(doc, np.arange(n + 1))
        for i in range(0, n, GROUP):
            j = min(n, i + GROUP)
            d, t, w = (x[ends[i] : ends[j]] for x in (doc, term, weight))
            full = self.full[t] >= 0
            texts = np.zeros((j - i, len(self.rows)))
            texts[d[full] - i, self.full[t[full]]] = w[full]
            scores = texts @ self.rows
            d, t, w = d[~full], t[~full], w[~full]
            cuts = np.searchsorted(d, np.arange(i, j + 1)).tolist()
            for k in range(j - i):
                a, b = cuts[k], cuts[k + 1]
                yield self.nearest(t[a:b], w[a:b], scores[k], i + k if leave else -1)

    def vote(self, docs: np.ndarray, scores: np.ndarray) -> float:
        return float(((scores * self.labels[docs]).sum() + self.prior) / (scores.sum() + 1)) if len(docs) else self.empty

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Example, term and weight of all entries, by example."""
        cell = np.repeat(np.arange(len(self.cell_block)), np.diff(self.cell_begin))
        row, place = np.nonzero(self.rows)
        doc = np.append(self.post_doc, place)
        term = np.append(np.repeat(np.arange(self.n_terms), np.diff(self.term_begin))[cell], np.nonzero(self.full >= 0)[0][row])
        order = np.lexsort((term, doc))
        return doc[order], term[order], np.append(self.post_weight, self.rows[row, place])[order]

    def calibrate(self) -> None:
        """Monotone fit (pool adjacent violators) of labels to the leave-one-out votes of the examples."""
        if len(set(self.labels.tolist())) < 2:
            self.knots, self.levels = np.array([0.0]), np.array([self.prior])
            return
        doc, term, weight = self.entries()
        some = np.unique(doc)
        votes = np.array([self.vote(d, s) for d, s in self.neighbours(doc, term, weight, self.n, leave=True)])[some]
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # sum of labels, number, sum of votes
        for v, y in zip(votes[order].tolist(), self.labels[some][order].tolist(), strict=True):
            pools.append([float(y), 1.0, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                y2, n2, v2 = pools.pop()
                pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2] + v2]
        self.knots = np.array([v / n for _, n, v in pools])
        self.levels = np.array([(y + 0.02) / (n + 0.04) for y, n, _ in pools])

    def score(self, raw: list[bytes]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text: probability, places of its neighbours, cosines."""
        c = Chunk(raw, ALNUM)
        slot = self.known.get(c.key)
        hit = slot >= 0
        cell, count = np.unique(c.word_doc[hit] * max(1, self.n_terms) + slot[hit], return_counts=True)
        doc, term = np.divmod(cell, max(1, self.n_terms))
        w = (1 + np.log(count)) * self.weight[term]
        w /= np.sqrt(np.bincount(doc, weights=w * w, minlength=c.n))[doc]
        blank = np.bincount(doc, minlength=c.n) == 0
        # Equal runs of words are equal texts to the model.
        size = np.bincount(doc, minlength=c.n)
        ends = np.cumsum(size).tolist()
        own: dict[tuple[bytes, bytes], int] = {}
        first = [own.setdefault((term[b - n : b].tobytes(), count[b - n : b].tobytes()), i) for i, (b, n) in enumerate(zip(ends, size.tolist(), strict=True))]
        asked = np.array(sorted(set(first)), dtype=np.int64)
        number = np.full(c.n, -1, dtype=np.int64)
        number[asked] = np.arange(len(asked))
        kept = number[doc] >= 0
        found = list(self.neighbours(number[doc[kept]], term[kept], w[kept], len(asked)))
        levels = [self.empty if blank[i] else float(np.clip(np.interp(self.vote(*x), self.knots, self.levels), 0, 1)) for i, x in zip(asked.tolist(), found, strict=True)]
        return [(levels[k], *found[k]) for k in number[first].tolist()]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 4000, max_entries: int = 4_000_000, k: int = 25) -> Model:
    """Learn from labels (doc_id, toxic); all of `docs` give document frequencies. The driver and every task get the examples'
    distinct words: `max_entries` rows of some 20 bytes at most."""
    model = learn(docs, labels, max_examples, max_entries, k)
    trim()  # what the driver held of the examples would stay in its allocators
    return model


def learn(docs: DataFrame, labels: DataFrame, max_examples: int, max_entries: int, k: int) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    # At most max_examples ids: a proven bound.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, key, count = term_counts(Chunk(raw_texts(part), ALNUM))
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (pa.array(key.view(np.int64)), pa.array(count.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(ends), pa.int64()), *lists], ["doc_id", "toxic", "n", "key", "count"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    vectors = cut(sample.select("doc_id", "toxic", "text").mapInArrow(tidy(entries), f"doc_id {kind}, toxic int, n long, key array<long>, count array<int>"))
    # The running sum is over max_examples numbers.
    upto = vectors.select("doc_id", F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto")).where(F.col("upto") <= max_entries)
    got = vectors.join(F.broadcast(upto.select("doc_id")), "doc_id").select("doc_id", "toxic", "n", "key", "count").toArrow().sort_by("doc_id")
    column = lambda c: got.column(c).combine_chunks()
    toxic, sizes = column("toxic").to_numpy(zero_copy_only=False).astype(np.int64), column("n").to_numpy(zero_copy_only=False)
    flat = lambda c: column(c).flatten().to_numpy(zero_copy_only=False)
    doc, count = np.repeat(np.arange(len(sizes)), sizes), flat("count").astype(np.float64)
    terms, term = np.unique(flat("key").view(np.uint64), return_inverse=True)
    keys = docs.sparkSession.sparkContext.broadcast(terms)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = Table(max(1, len(keys.value))), len(keys.value)
        if n:
            table.put(keys.value, np.arange(n, dtype=np.int32))
        total, rows = np.zeros(n, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                c = Chunk(raw_texts(part), ALNUM)
                slot = table.get(c.key)
                hit = slot >= 0
                total += np.bincount(np.unique(c.word_doc[hit] * max(1, n) + slot[hit]) % max(1, n), minlength=n)[:n]
                rows += c.n
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], rows), pa.int64())], ["slot", "n"])

    # One row for each term at most.
    seen = docs.select("text").mapInArrow(tidy(frequency), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = seen.column("slot").to_numpy(), seen.column("n").to_numpy()
    df = np.zeros(len(terms))
    df[slot[slot >= 0]] = n[slot >= 0]
    idf = np.log(1 + float(n[slot < 0].sum()) / (1 + df))
    keys.unpersist()
    present = np.bincount(term, minlength=len(terms)).astype(np.float64)
    r = relevance(present, np.bincount(term, weights=toxic[doc], minlength=len(terms)), len(toxic), int(toxic.sum()))
    model = Model(terms, idf * r, toxic, column("doc_id"), doc, term, count, k)
    model.calibrate()
    return model


def score(docs: DataFrame, model: Model, evidence: bool = True) -> DataFrame:
    """Per row of (doc_id, text): score double and, if asked for, the neighbours' ids and cosines, nearest first."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = kept.value.score(raw_texts(part))
                columns, names = [part.column(0), pa.array([p for p, _, _ in got], pa.float64())], ["doc_id", "score"]
                if evidence:
                    ends = pa.array(np.append(0, np.cumsum([len(d) for _, d, _ in got])), pa.int32())
                    columns += [pa.ListArray.from_arrays(ends, kept.value.ids.take(pa.array(np.concatenate([d for _, d, _ in got])))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([s for _, _, s in got])))]
                    names += ["neighbours", "cosines"]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = f", neighbours array<{kind}>, cosines array<double>" if evidence else ""
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double{more}")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows whose score is below the threshold, with the columns as they are."""
    kept, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array([p < threshold for p, _, _ in kept.value.score(raw_texts(part))]))

    return docs.mapInArrow(tidy(run), schema)
