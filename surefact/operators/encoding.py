"""Strings to vectors without a model: sums of the item vectors of a string's trigrams, scaled to length 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import atoms
from .registry import margin, resolve, sign_projection

DIM = 256


def trigrams(name: str) -> list[str]:
    s = f"^{name.lower()}$"
    return [s[k : k + 3] for k in range(len(s) - 2)]


def unit_rows(names: list[str], dim: int = DIM) -> np.ndarray:
    """A row for each name; the empty string and null have the zero vector."""
    grams = [trigrams(x) if x else [] for x in names]
    own = sorted({g for x in grams for g in x})
    place = {g: k for k, g in enumerate(own)}
    rows = atoms(own, dim).astype(np.float64) if own else np.zeros((0, dim))
    out = np.stack([rows[[place[g] for g in x]].sum(axis=0) if x else np.zeros(dim) for x in grams]) if names else np.zeros((0, dim))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def encode(names: DataFrame, dim: int = DIM) -> DataFrame:
    """(name, e array<double>) of rows (name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = unit_rows(b.column(0).to_pylist(), dim)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), dim).cast(pa.list_(pa.float64()))], ["name", "e"])

    return names.select("name").mapInArrow(run, "name string, e array<double>")


def encode_bipolar(names: DataFrame, rows: np.ndarray) -> DataFrame:
    """(name, bits): signs of a fixed projection of the encoded names."""
    return sign_projection(encode(names, rows.shape[1]), rows)


def resolve_names(terms: DataFrame, names: DataFrame, margins: DataFrame | None = None) -> DataFrame:
    """(term, name, second, c1, m_ref) of each distinct term: its nearest name, the next one, the cosine and the lead.

    A term that is a name is found by an equi join and takes its lead from `margins`, what resolve_names gives for the names
    themselves, if the caller keeps such a table; only the others meet the names in blocks."""
    own, known = terms.select("term").distinct(), names.select("name").distinct()
    exact = None
    if margins is not None:
        exact = own.join(margins, "term").select("term", "name", "second", "c1", "m_ref")
        own = own.join(margins.select("term"), "term", "left_anti")
    found = resolve(encode(own.withColumnRenamed("term", "name")).withColumnRenamed("name", "term"), encode(known), top=2)
    second = found.where("place = 2").select("term", F.col("name").alias("second"))
    out = margin(found).join(second, "term", "left").select("term", "name", "second", "c1", "m_ref")
    return out if exact is None else exact.unionByName(out)
