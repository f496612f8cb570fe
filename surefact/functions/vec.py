"""Bipolar vectors as Spark columns: arrays of -1 and +1, exact in integers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 512


def atom(name: Column, dim: int = DIM) -> Column:
    """The item vector of a name: bits of md5(name#block), 128 a block, 0 as -1."""
    block = lambda b: F.split(F.md5(F.concat(name, F.lit(f"#{b}"))), "")
    digit = lambda d: F.transform(
        F.array(*(F.lit(k) for k in (8, 4, 2, 1))), lambda m: F.when(F.conv(d, 16, 10).cast("int").bitwiseAND(m) > 0, 1).otherwise(-1)
    )
    blocks = [F.flatten(F.transform(F.filter(block(b), lambda c: c != ""), digit)) for b in range(-(-dim // 128))]
    return F.slice(F.concat(*blocks), 1, dim)


def atoms(names: list[str], dim: int = DIM) -> np.ndarray:
    """The same vectors as rows of int8."""
    raw = b"".join(hashlib.md5(f"{n}#{b}".encode()).digest() for n in names for b in range(-(-dim // 128)))
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(len(names), -1)[:, :dim]
    return (bits.astype(np.int8) << 1) - 1


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def permute(v: Column, k: int, dim: int = DIM) -> Column:
    """Rotated right by k (left for k < 0)."""
    k %= dim
    return v if k == 0 else F.concat(F.slice(v, dim - k + 1, k), F.slice(v, 1, dim - k))


def record(subj: Column, rel: Column, obj: Column, dim: int = DIM) -> Column:
    return bind(bind(subj, permute(rel, 1, dim)), permute(obj, 2, dim))


def unbind_obj(bundle: Column, subj: Column, rel: Column, dim: int = DIM) -> Column:
    return permute(bind(bind(bundle, subj), permute(rel, 1, dim)), -2, dim)


def unbind_subj(bundle: Column, rel: Column, obj: Column, dim: int = DIM) -> Column:
    return bind(bind(bundle, permute(rel, 1, dim)), permute(obj, 2, dim))


def unbind_rel(bundle: Column, subj: Column, obj: Column, dim: int = DIM) -> Column:
    return permute(bind(bind(bundle, subj), permute(obj, 2, dim)), -1, dim)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def sign(v: Column) -> Column:
    """0 counts as +1."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1))


def quantised(v: Column, bits: int = 20) -> Column:
    """Fixed-point integers, so that sums do not depend on their order."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * (1 << bits) + 0.5))


def superpose(df: DataFrame, keys: list[str], v: str, weight: str | None = None) -> DataFrame:
    """(keys, bundle): elementwise sums per key, as partial and final aggregates by position; a weight of -1 retracts."""
    w = F.col(weight) if weight else F.lit(1)
    long = df.select(*keys, w.alias("w"), F.posexplode(v).alias("pos", "x"))
    sums = long.groupBy(*keys, "pos").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda z: z.s).alias("bundle"))


def validated(rows: DataFrame) -> DataFrame:
    """(n, distinct_names, wrong) of rows (name, v) that a caller brings: v has to hold -1 and 1 only, all of one length."""
    fine = F.forall("v", lambda x: (x == 1) | (x == -1))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == F.count_distinct("name")).alias("distinct_names"), (F.count_if(~F.coalesce(fine, F.lit(False))) + F.when(F.min(F.size("v")) != F.max(F.size("v")), 1).otherwise(0)).cast("int").alias("wrong"))
