"""Lossy recall: facts superposed page by page, unbound and cleaned up against a codebook."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gate
from ..functions.vec import DIM, atoms


def records(subj: np.ndarray, rel: np.ndarray, obj: np.ndarray) -> np.ndarray:
    return subj * np.roll(rel, 1, axis=1) * np.roll(obj, 2, axis=1)


def unbind(bundle: np.ndarray, subj: np.ndarray, rel: np.ndarray) -> np.ndarray:
    return np.roll(bundle * subj * np.roll(rel, 1, axis=1), -2, axis=1)


def recall(facts: DataFrame, asked: DataFrame, codebook: DataFrame, dim: int = DIM, limit: int = 1 << 16) -> DataFrame:
    """(page, subj, rel, top1, dot1, dot2, n): each asked key unbound from its page's bundle and cleaned up over the codebook.

    facts (page, subj, rel, obj) and asked (page, subj, rel) meet by page; a page is bounded by paging, so a task holds
    few records. The codebook (name) goes to every task; its size is checked first."""
    names = sorted(r.name for r in codebook.select("name").distinct().limit(limit + 1).collect())
    if len(names) > limit:
        raise ValueError(f"a codebook of over {limit} names needs registry.resolve in blocks")
    book = atoms(names, dim).astype(np.float32)
    kept = facts.sparkSession.sparkContext.broadcast((names, book))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, m = kept.value

        def column(t: pa.Table, c: str) -> np.ndarray:
            own = t.column(c).combine_chunks().fill_null("None").dictionary_encode()
            return atoms(own.dictionary.to_pylist(), dim)[own.indices.to_numpy()]

        total = records(*(column(left, c) for c in ("subj", "rel", "obj"))).sum(axis=0, dtype=np.int64) if left.num_rows else np.zeros(dim, dtype=np.int64)
        bundle = np.where(total >= 0, 1, -1).astype(np.int8)
        n = right.num_rows
        dots = unbind(bundle, column(right, "subj"), column(right, "rel")).astype(np.float32) @ m.T if n else np.zeros((0, len(words)), dtype=np.float32)
        order = np.argsort(-dots, axis=1, kind="stable")[:, :2]
        best = np.take_along_axis(dots, order, axis=1).astype(np.int64)
        return pa.table(
            {"page": right.column("page"), "subj": right.column("subj"), "rel": right.column("rel"), "top1": pa.array([words[i] for i in order[:, 0]], pa.string()), "dot1": pa.array(best[:, 0]),
             "dot2": pa.array(best[:, 1] if best.shape[1] > 1 else best[:, 0] * 0), "n": pa.array([left.num_rows] * n, pa.int64())}
        )

    schema = "page long, subj string, rel string, top1 string, dot1 long, dot2 long, n long"
    # Fresh names, so that both sides may come from one frame.
    asked = asked.select("page", "subj", "rel").toDF("page", "subj", "rel")
    # A number of tasks of its own: few bytes hold much work here, and small partitions would be put together by their bytes.
    n = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda x: x.repartition(n, "page").groupBy("page")
    return dealt(facts).cogroup(dealt(asked)).applyInArrow(run, schema)


def echo_check(facts: DataFrame, codebook: DataFrame, dim: int = DIM) -> DataFrame:
    """Distinct facts with `accepted`: their key reads back as their object, or as another object of the same key."""
    key = ["page", "subj", "rel"]
    own = facts.groupBy(*key).agg(F.collect_set("obj").alias("own"))
    back = recall(facts, own.select(*key), codebook, dim).select(F.struct(*key).alias("key"), "top1", "dot1")
    told = own.select(F.struct(*key).alias("key"), "own").join(back, "key")
    fine = F.array_contains("own", F.col("top1")) & (F.col("dot1") > 0)
    return told.select("key.*", F.explode("own").alias("obj"), fine.alias("accepted"))


def bundles(facts: DataFrame, dim: int = DIM) -> DataFrame:
    """(page, bundle array<long>): the sums of the records (page, subj, rel, obj) of each page."""

    def run(t: pa.Table) -> pa.Table:
        total = records(*(atoms(t.column(c).to_pylist(), dim) for c in ("subj", "rel", "obj"))).sum(axis=0, dtype=np.int64)
        return pa.table({"page": t.column("page").slice(0, 1), "bundle": pa.array([total], pa.list_(pa.int64()))})

    return facts.select("page", "subj", "rel", "obj").groupBy("page").applyInArrow(run, "page long, bundle array<long>")


#: Deviations of hits and nulls at 8192 dimensions (fixed values).
SD_HIT, SD_NULL, SD_DIM = 0.011, 0.004, 8192


def write_checked(facts: DataFrame, codebook: DataFrame, dim: int = DIM) -> DataFrame:
    """Distinct facts with `accepted`: read back through the gate, above the crossing of hits and nulls, as their object or as another
    object of the same key. What is not accepted is not written: bundles of the accepted facts are what stays."""
    names = codebook.select("name").distinct().count()
    key = ["page", "subj", "rel"]
    own = facts.groupBy(*key).agg(F.collect_set("obj").alias("own"))
    back = recall(facts, own.select(*key), codebook, dim).select(F.struct(*key).alias("key"), "top1", "dot1", "n")
    told = own.select(F.struct(*key).alias("key"), "own").join(back, "key")
    scale = (SD_DIM / dim) ** 0.5
    level = gate.crossing(gate.mu_hit(F.col("n")), F.lit(SD_HIT * scale), gate.mu_null(F.lit(float(max(names, 2))), F.lit(float(dim))), F.lit(SD_NULL * scale))
    fine = F.array_contains("own", F.col("top1")) & (F.col("dot1") / float(dim) > level)
    return told.select("key.*", F.explode("own").alias("obj"), fine.alias("accepted"))
