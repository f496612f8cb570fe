"""The exact store: an append-only log of writes and retractions, and what follows from it by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROLES = ("user-stated", "assistant-inferred", "tool-derived")


def state(log: DataFrame) -> DataFrame:
    """Active triples of a log (seq, op, subj, rel, obj, provenance): the last operation on a triple decides."""
    last = log.groupBy("subj", "rel", "obj").agg(F.max_by(F.struct("op", "provenance"), "seq").alias("x"), F.max("seq").alias("seq"))
    return last.where(F.col("x.op") == "write").select("subj", "rel", "obj", "x.provenance", "seq")


def supersede(log: DataFrame) -> DataFrame:
    """The latest write of each key replaces all older objects: (subj, rel, obj, provenance, seq). A key whose latest write was
    forgotten later has none."""
    wrote = F.when(F.col("op") == "write", F.col("seq"))
    each = log.groupBy("subj", "rel", "obj").agg(F.max(wrote).alias("seq"), F.max_by("provenance", wrote).alias("provenance"), F.max_by("op", "seq").alias("op"))
    last = each.where("seq is not null").groupBy("subj", "rel").agg(F.max_by(F.struct("obj", "provenance", "seq", "op"), "seq").alias("x"))
    return last.where(F.col("x.op") == "write").select("subj", "rel", "x.obj", "x.provenance", "x.seq")


def active_count(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, triples, active): how many triples were ever touched and how many are written now."""
    last = log.groupBy("subj", "rel", "obj").agg(F.max_by("op", "seq").alias("op"))
    return last.groupBy(*keys).agg(F.count(F.lit(1)).alias("triples"), F.count_if(F.col("op") == "write").alias("active"))


def valid_writes(log: DataFrame) -> DataFrame:
    return log.where(F.col("provenance").isin(*ROLES) & F.col("subj").isNotNull() & F.col("rel").isNotNull() & F.col("obj").isNotNull())


def stored(keys: DataFrame, facts: DataFrame) -> DataFrame:
    """The keys that have an active fact."""
    return keys.join(facts, ["subj", "rel"], "left_semi")


def membership(keys: DataFrame, facts: DataFrame) -> DataFrame:
    """Each key with `stored` (a score of 0 or 1 as a boolean)."""
    known = facts.select("subj", "rel").distinct().withColumn("stored", F.lit(True))
    return keys.join(known, ["subj", "rel"], "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def unwritten(keys: DataFrame, facts: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Keys without a fact; with synonyms (rel, other), also without one under the paired relation."""
    out = keys.join(facts, ["subj", "rel"], "left_anti")
    if synonyms is not None:
        near = facts.join(synonyms, "rel").select("subj", F.col("other").alias("rel"))
        out = out.join(near, ["subj", "rel"], "left_anti")
    return out


def collisions(facts: DataFrame) -> DataFrame:
    """Keys with more than one distinct object, and how many."""
    return facts.select("subj", "rel", "obj").distinct().groupBy("subj", "rel").agg(F.count("obj").alias("objects")).where("objects > 1")


def candidates(keys: DataFrame, facts: DataFrame, limit: int = 2) -> DataFrame:
    """The first `limit` objects (by name) of each key with their provenance: what a deliberation lists."""
    w = Window.partitionBy("subj", "rel").orderBy("obj")
    return keys.join(facts, ["subj", "rel"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def provenance(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """Triples with provenance, null and `supported` false where they are not stored."""
    return triples.join(facts.select("subj", "rel", "obj", "provenance"), ["subj", "rel", "obj"], "left").withColumn("supported", F.col("provenance").isNotNull())


def both_ways(facts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Per (subj, pair of synonymous relations): facts under both with different objects."""
    a, b = facts.alias("a"), facts.alias("b")
    pairs = a.join(synonyms.alias("s"), F.col("a.rel") == F.col("s.rel")).join(b, (F.col("a.subj") == F.col("b.subj")) & (F.col("b.rel") == F.col("s.other")))
    return pairs.groupBy(F.col("a.subj").alias("subj"), F.col("a.rel").alias("rel"), F.col("s.other").alias("other")).agg((F.count_if(F.col("a.obj") != F.col("b.obj")) > 0).alias("differs"))


def views(spark: SparkSession, **frames: DataFrame) -> None:
    """Frames as temporary views by their names, for SQL: facts, registry, items, opinions or others."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
