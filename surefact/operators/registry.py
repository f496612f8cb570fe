"""Names and their embeddings: nearest-name resolution in blocks, exact names first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of names and the least and most rows of terms that meet in one task, and those of a tile of their products.
NAMES, LEAST_TERMS, TERMS = 1 << 16, 1 << 12, 1 << 16
TILE_TERMS, TILE_NAMES = 512, 4096


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(x * (1 << 20) + 0.5)


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def rounding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of `a`, a bound of what single precision may add to or take from its dot products with rows of `b`."""
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    return norm(a) * norm(b).max(initial=0) * (a.shape[1] + 4) * 2.0**-23


def nearest(a: np.ndarray, b: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, dots) of the `top` rows of b nearest to each row of a by exact dot product, the earlier of equals first.

    Tiles are multiplied in single precision; only what may be among the best by the bound of its rounding is taken up in double
    precision, where 20-bit numbers stay exact. A tile with many such products is multiplied in double precision as a whole."""
    n, top = len(a), min(top, len(b))
    dots, places = np.full((n, top), -np.inf), np.full((n, top), len(b), np.int64)
    slack = rounding(a, b)
    single = bool(slack.max(initial=0) < 1e30)
    if not single:  # beyond single precision, or not numbers
        slack[:] = np.inf
    a4, b4 = (a.astype(np.float32), b.astype(np.float32)) if single else (a, b)
    for i in range(0, n, TILE_TERMS):
        own, best, at = slice(i, i + TILE_TERMS), dots[i : i + TILE_TERMS], places[i : i + TILE_TERMS]
        for j in range(0, len(b), TILE_NAMES):
            d = a4[own] @ b4[j : j + TILE_NAMES].T
            m = min(top, d.shape[1])
            if j == 0:
                least = np.partition(d, d.shape[1] - m, axis=1)[:, d.shape[1] - m].astype(np.float64) if m == top else np.full(len(d), -np.inf)
                least -= 2 * slack[own]
            else:
                least = best[:, -1] - slack[own]
            # In the products' own precision, rounded down.
            level = np.nextafter(least.astype(d.dtype), d.dtype.type(-np.inf))
            near = np.flatnonzero(~(d.max(axis=1) < level))
            if not len(near):
                continue
            few = d if len(near) == len(d) else d[near]
            r, c = np.divmod(np.flatnonzero(few >= level[near, None]), d.shape[1])
            if not single or len(r) > 8 * top * len(near):
                e = a[own][near] @ b[j : j + TILE_NAMES].T
                c = np.empty((len(near), m), np.int64)
                for k in range(m):
                    c[:, k] = e.argmax(axis=1)  # the first of equals
                    x = e[np.arange(len(near)), c[:, k]].copy()
                    e[np.arange(len(near)), c[:, k]] = -np.inf
                    c_dots = x[:, None] if k == 0 else np.column_stack([c_dots, x])
                r, c, found = np.repeat(np.arange(len(near)), m), c.ravel(), c_dots.ravel()
            else:
                found = np.einsum("ij,ij->i", a[i + near[r]], b[j + c])
            rows = np.concatenate([np.repeat(np.arange(len(near)), top), r])
            values, who = np.concatenate([best[near].ravel(), found]), np.concatenate([at[near].ravel(), j + c])
            order = np.lexsort((who, -values, rows))
            rows, values, who = rows[order], values[order], who[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = place < top
            best[near], at[near] = values[kept].reshape(-1, top), who[kept].reshape(-1, top)
    return places, dots


def resolve(terms: DataFrame, registry: DataFrame, top: int = 2, n_blocks: int | None = None) -> DataFrame:
    """(term, place, name, dot) of the `top` names nearest to each term by dot product of quantised unit vectors.

    terms (term, e) and registry (name, e) meet in pairs of blocks: each pair is one task's, which multiplies tile by tile and lets
    only `top` rows a term go. All terms meet all names, so the work grows with their product; a task's does not. Ties go to the
    smaller name. A term equal to a name is excluded where `term = name` if both are of one type and `leave` is wanted by the caller
    beforehand."""
    blocks = n_blocks or max(1, -(-registry.count() // NAMES))
    asked = terms.count()
    sides = max(1, -(-asked // min(TERMS, max(LEAST_TERMS, asked * blocks // 64))))
    t = terms.withColumn("bt", F.pmod(F.xxhash64("term"), F.lit(sides))).withColumn("br", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = registry.withColumn("br", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).withColumn("bt", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("name").to_numpy(zero_copy_only=False)
        if not len(names) or not left.num_rows:
            return pa.table({"term": left.column("term").slice(0, 0), "name": right.column("name").slice(0, 0), "dot": pa.array([], pa.float64())})
        by = np.argsort(names, kind="stable")
        best, dots = nearest(quantise(matrix(left.column("e"))), quantise(matrix(right.column("e")))[by], top)
        rows = np.repeat(np.arange(left.num_rows), best.shape[1])
        return pa.table({"term": left.column("term").take(pa.array(rows)), "name": right.column("name").take(pa.array(by[best.ravel()])), "dot": pa.array(dots.ravel())})

    kinds = f"term {terms.schema['term'].dataType.simpleString()}, name {registry.schema['name'].dataType.simpleString()}, dot double"
    # As many tasks as pairs of blocks: small shuffles of much work must not be put together.
    dealt = lambda x: x.repartition(sides * blocks, "bt", "br").groupBy("bt", "br")
    found = dealt(t.withColumn("bt", F.col("bt").cast("int"))).cogroup(dealt(r)).applyInArrow(meet, kinds)
    w = Window.partitionBy("term").orderBy(F.desc("dot"), "name")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def margin(resolved: DataFrame, scale: float = float(1 << 40)) -> DataFrame:
    """(term, name, c1, m_ref): the nearest name, its cosine and its lead over the second; lead 1 with one entry only."""
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    out = resolved.groupBy("term").agg(at(1, "name").alias("name"), (at(1, "dot") / scale).alias("c1"), (at(2, "dot") / scale).alias("c2"))
    return out.select("term", "name", "c1", F.coalesce(F.col("c1") - F.col("c2"), F.lit(1.0)).alias("m_ref"))


def canonicalise(resolved: DataFrame, threshold: float) -> DataFrame:
    """(term, canonical, matched): the nearest name if it is near enough, else the term itself."""
    m = margin(resolved)
    return m.select("term", F.when(F.col("c1") >= threshold, F.col("name").cast("string")).otherwise(F.col("term").cast("string")).alias("canonical"), (F.col("c1") >= threshold).alias("matched"))


def add(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with the names that it lacks."""
    return registry.unionByName(new.dropDuplicates(["name"]).join(registry.select("name"), "name", "left_anti"))


def leave_one_out(registry: DataFrame) -> DataFrame:
    """(name, best) the largest dot with another name."""
    found = resolve(registry.withColumnRenamed("name", "term"), registry, top=2)
    return found.where(F.col("term") != F.col("name")).groupBy(F.col("term").alias("name")).agg(F.max("dot").alias("best"))


def sign_projection(vectors: DataFrame, rows: np.ndarray) -> DataFrame:
    """(name, bits array<int>): signs of a fixed integer projection of the quantised vectors, 0 as +1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits = np.where(quantise(matrix(b.column(1))) @ rows.T >= 0, 1, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), bits.shape[1]).cast(pa.list_(pa.int32()))], ["name", "bits"])

    return vectors.select("name", "e").mapInArrow(run, f"name {vectors.schema['name'].dataType.simpleString()}, bits array<int>")
