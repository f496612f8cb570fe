"""Runs of equal keys through Arrow, and connected components, for operators on pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, tidy


def by_runs(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table | None], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Like groupBy(key).applyInArrow, without a call for each of many small groups: fn gets whole groups, as many as a batch holds.

    The rows come sorted by key (a long) and `order`. What each task keeps is one batch and the group at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            keys = now.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (kept and kept[0].column(key)[0].as_py() != keys[0]):
                done = pa.concat_tables([*kept, now.slice(0, last)])
                kept = []
                if (out := fn(done)) is not None:
                    yield from out.to_batches()
            kept.append(now.slice(last))
        if kept and (out := fn(pa.concat_tables(kept))) is not None:
            yield from out.to_batches()

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(tidy(run), schema)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal neighbours."""
    cuts = np.nonzero(keys[1:] != keys[:-1])[0] + 1
    return list(zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist(), strict=True)) if len(keys) else []


class Forest:
    """Union-find over 0..n-1; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of links (a, b), by alternating stars.

    Large star ties every larger neighbour of a node to its smallest, small star every smaller one. Each
    round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        n, digest = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if state == (n, digest) or not n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct()).distinct()
        state = (n, digest)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        next_ = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small)
        last, now = now, cut(next_.distinct())
        dropped(last)
