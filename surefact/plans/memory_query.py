"""The read path as one lazy plan: exact key, recall, opinion, routing, answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gate
from ..functions.vec import DIM, atoms
from ..operators.encoding import resolve_names
from ..operators.recall import recall
from ..operators.registry import resolve

#: Moments of hits and nulls that the gate assumes where none were measured (fixed values at 8192 dimensions).
SD_HIT, SD_NULL, SD_MARGIN, MEASURED_DIM = 0.011, 0.004, 0.014, 8192


def query(facts: DataFrame, asked: DataFrame, codebook: DataFrame, dim: int = DIM) -> DataFrame:
    """Per asked key: a, m_l1, hit, objects, opinion, action, tag, and the stored answer where the action gives one.

    Exact keys are found by an equi join; only geometry goes through Arrow. An answer is always a stored triple."""
    names = codebook.select("name").distinct().count()
    told = recall(facts, asked, codebook, dim)
    exact = facts.groupBy("page", "subj", "rel").agg(F.count_distinct("obj").alias("objects"), F.min("obj").alias("obj"), F.array_sort(F.collect_set("obj")).alias("own"))
    x = told.join(exact, ["page", "subj", "rel"], "left").withColumn("hit", F.col("objects").isNotNull())
    scale = (MEASURED_DIM / dim) ** 0.5
    x = x.withColumn("a", F.col("dot1") / F.lit(float(dim))).withColumn("m_l1", (F.col("dot1") - F.col("dot2")) / F.lit(float(dim)))
    mu_h, mu_n = gate.mu_hit(F.greatest("n", F.lit(1))), gate.mu_null(F.lit(float(max(names, 2))), F.lit(float(dim)))
    sd_h, sd_n, sd_m = F.lit(SD_HIT * scale), F.lit(SD_NULL * scale), F.lit(SD_MARGIN * scale)
    x = x.withColumn("z", gate.z_resolution(F.col("a"), mu_h, sd_h, mu_n, sd_n)).withColumn("m_z", gate.z_margin(F.col("m_l1"), mu_h, mu_n, sd_m))
    # The lead of the best stored key: none between several objects of one key.
    x = x.withColumn("m_l2", F.when(F.col("objects") > 1, 0.0).otherwise(1.0))
    x = x.withColumn("o", gate.opinion_two_source(F.col("z"), F.lit(1.0), F.col("m_l2"), F.col("m_z"), F.col("hit")))
    x = x.withColumn("action", gate.route(F.col("o.b"), F.col("o.d"), F.col("o.u"), gate.saturated(mu_h, mu_n, sd_n), F.lit(True)))
    answer = F.when(F.col("action").isin("answer", "recollect"), F.when(F.col("objects") == 1, F.col("obj")))
    return x.select("page", "subj", "rel", "hit", "objects", "a", "m_l1", F.col("o.b").alias("b"), F.col("o.d").alias("d"), F.col("o.u").alias("u"), "action", gate.route_tag(F.col("action"), F.col("o.tag")).alias("tag"), answer.alias("answer"))


def key_vectors(keys: DataFrame, name: str, dim: int) -> DataFrame:
    """(name, e): the item vectors of subject and relation side by side, scaled to length 1."""

    def run(batches):  # type: ignore[no-untyped-def]
        for b in batches:
            if b.num_rows:
                rows = np.hstack([atoms(b.column(k).to_pylist(), dim) for k in (1, 2)]) / np.sqrt(2.0 * dim)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), 2 * dim).cast(pa.list_(pa.float64()))], [name, "e"])

    return keys.select(name, "subj", "rel").mapInArrow(run, f"{name} string, e array<double>")


def resolved(facts: DataFrame, terms: DataFrame, entities: DataFrame, dim: int, key_dim: int = 512) -> DataFrame:
    """The read path from terms: (subj_term, rel_term) to the opinion, the action, the stored triple or what to choose from.

    facts (page, subj, rel, obj, provenance), terms (page, subj_term, rel_term), entities (name). Terms become the nearest
    registered names, which gives the referential margin; the key is unbound from its page and cleaned up over all
    entities; the lead of the nearest stored key over the next one is the stored margin. An answer is always stored."""
    relations = facts.select(F.col("rel").alias("name")).distinct()
    subj = resolve_names(terms.select(F.col("subj_term").alias("term")), entities)
    rel = resolve_names(terms.select(F.col("rel_term").alias("term")), relations)
    x = terms.join(subj.select(F.col("term").alias("subj_term"), F.col("name").alias("subj"), "second", "m_ref"), "subj_term")
    x = x.join(rel.select(F.col("term").alias("rel_term"), F.col("name").alias("rel")), "rel_term")
    keys = x.select("page", "subj", "rel").distinct()
    told = recall(facts, keys, entities, dim)
    # The stored keys of a page by their vectors; the place of a record is its triple.
    key, own = F.concat_ws("\x1f", "page", "subj", "rel"), F.concat_ws("\x1f", "page", "subj", "rel", "obj")
    near = resolve(key_vectors(keys.withColumn("term", key), "term", key_dim), key_vectors(facts.withColumn("name", own), "name", key_dim), top=2)
    at = lambda k, c: F.max(F.when(F.col("place") == k, c))
    dot = F.col("dot") / float(1 << 40)
    obj = F.element_at(F.split("name", "\x1f"), -1)
    lead = near.groupBy("term").agg((at(1, dot) - F.coalesce(at(2, dot), F.lit(0.0))).alias("m_l2"), at(1, obj).alias("o1"), at(2, obj).alias("o2"))
    x = x.join(told, ["page", "subj", "rel"]).join(keys.withColumn("term", key).join(lead, "term").drop("term"), ["page", "subj", "rel"])
    names = entities.select("name").distinct().count()
    scale = (MEASURED_DIM / dim) ** 0.5
    mu_h, mu_n = gate.mu_hit(F.greatest("n", F.lit(1))), gate.mu_null(F.lit(float(max(names, 2))), F.lit(float(dim)))
    sd_h, sd_n, sd_m = F.lit(SD_HIT * scale), F.lit(SD_NULL * scale), F.lit(SD_MARGIN * scale)
    x = x.withColumn("a", F.col("dot1") / F.lit(float(dim))).withColumn("m_l1", (F.col("dot1") - F.col("dot2")) / F.lit(float(dim)))
    z, m_z = gate.z_resolution(F.col("a"), mu_h, sd_h, mu_n, sd_n), gate.z_margin(F.col("m_l1"), mu_h, mu_n, sd_m)
    x = x.withColumn("o", gate.opinion_two_source(z, F.col("m_ref"), F.col("m_l2"), m_z))
    x = x.withColumn("action", gate.route(F.col("o.b"), F.col("o.d"), F.col("o.u"), gate.saturated(mu_h, mu_n, sd_n), F.lit(True)))
    x = x.withColumn("tag", gate.route_tag(F.col("action"), F.col("o.tag")))
    stored = facts.select("page", "subj", "rel", F.col("obj").alias("top1"), F.lit(True).alias("stored"), "provenance")
    x = x.join(stored, ["page", "subj", "rel", "top1"], "left")
    said = (F.col("action") == "answer") & F.col("stored")
    choices = F.when(F.col("tag") == "referential", F.array("subj", "second")).when(F.col("tag") == "stored", F.array_sort(F.array("o1", "o2")))
    return x.select(
        "page", "subj_term", "rel_term", "subj", "rel", "a", "m_ref", "m_l2", F.col("o.b").alias("b"), F.col("o.d").alias("d"), F.col("o.u").alias("u"), "action", "tag",
        F.when(said, F.col("top1")).alias("answer"), F.when(said, F.col("provenance")).alias("provenance"), choices.alias("candidates"),
    )
