"""Moments of hits and misses measured on written pages, and what the gate takes from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gate


def sweep(reads: DataFrame) -> DataFrame:
    """A row per load of reads (k, written, right, a, m): accuracy, moments of hits and misses, Cohen's d between them."""
    hit, miss = F.col("written"), ~F.col("written")
    on = lambda c, x: F.when(c, F.col(x))
    n1, n2 = F.count(on(hit, "a")), F.count(on(miss, "a"))
    pooled = F.sqrt(((n1 - 1) * F.var_samp(on(hit, "a")) + (n2 - 1) * F.var_samp(on(miss, "a"))) / (n1 + n2 - 2))
    return reads.groupBy("k").agg(
        F.avg(F.when(hit, F.col("right").cast("double"))).alias("accuracy"),
        F.avg(on(hit, "a")).alias("a_hit_mean"), F.stddev_samp(on(hit, "a")).alias("a_hit_sd"), F.avg(on(miss, "a")).alias("a_miss_mean"), F.stddev_samp(on(miss, "a")).alias("a_miss_sd"),
        F.avg(on(hit, "m")).alias("m_hit_mean"), F.stddev_samp(on(hit, "m")).alias("m_hit_sd"),
        ((F.avg(on(hit, "a")) - F.avg(on(miss, "a"))) / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"),
    )


def null_calibration(reads: DataFrame) -> DataFrame:
    """(mu, sd) of the best cosine of keys that nobody wrote."""
    return reads.where(~F.col("written")).agg(F.avg("a").alias("mu"), F.stddev_samp("a").alias("sd"))


def hit_calibration(reads: DataFrame) -> DataFrame:
    """(k, mean, sd, scale): moments of hits by load, and the scale of the analytic mean that fits them best (least squares)."""
    return moments(reads).select("k", "mean", "sd", "scale")


def moments(reads: DataFrame) -> DataFrame:
    """(k, mean, sd, scale, null_mu, null_sd): hit_calibration, and null_calibration in each row, from one pass over the reads.

    The reads are summed up to a row a load; what spans the loads is taken over those rows, so nothing is read again for it."""
    miss = F.when(~F.col("written"), F.col("a"))
    hit = F.when(F.col("written"), F.col("a"))
    per = reads.where("written is not null").groupBy("k").agg(
        F.count_if("written").alias("_hits"), F.avg(hit).alias("mean"), F.stddev_samp(hit).alias("sd"), F.count(miss).alias("_n"), F.avg(miss).alias("_m"), F.var_pop(miss).alias("_v")
    )
    # A window over a row for each load.
    loads = Window.partitionBy(F.lit(0))
    over = lambda x: F.sum(x).over(loads)
    mu = gate.mu_hit(F.col("k"))
    n = over(F.col("_n"))
    fitted = F.when(F.col("_hits") > 0, mu * mu)
    per = per.withColumns({"scale": over(F.col("mean") * mu) / over(fitted), "null_mu": over(F.col("_n") * F.col("_m")) / F.nullif(n, F.lit(0))})
    apart = F.col("_n") * (F.col("_v") + (F.col("_m") - F.col("null_mu")) * (F.col("_m") - F.col("null_mu")))
    per = per.withColumn("null_sd", F.sqrt(over(apart) / F.when(n > 1, n - 1)))
    return per.where("_hits > 0").select("k", "mean", "sd", "scale", "null_mu", "null_sd")


def interpolated(df: DataFrame, x: str, knots: DataFrame, out: str, limit: int = 10_000) -> DataFrame:
    """Adds `out`: linear between knots (x, y), clamped at the ends. Knots are a small table, which is checked."""
    n = knots.limit(limit + 1).count()
    if not 0 < n <= limit:
        raise ValueError(f"between 1 and {limit} knots are wanted")
    w = Window.partitionBy(F.lit(0)).orderBy("x")
    pieces = knots.select(
        F.when(F.row_number().over(w) == 1, F.lit(-math.inf)).otherwise(F.col("x").cast("double")).alias("_from"),
        F.coalesce(F.lead("x").over(w).cast("double"), F.lit(math.inf)).alias("_to"),
        F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), F.lead("y").over(w).cast("double").alias("_y2"),
    )
    at = F.col(x).cast("double")
    share = F.greatest(F.lit(0.0), (at - F.col("_x")) / (F.col("_to") - F.col("_x")))
    level = F.when(F.col("_y2").isNull(), F.col("_y")).otherwise(F.col("_y") + (F.col("_y2") - F.col("_y")) * share)
    return df.join(F.broadcast(pieces), (at >= F.col("_from")) & (at < F.col("_to")), "left").withColumn(out, level).drop("_from", "_to", "_x", "_y", "_y2")


def rescaled(sd: Column, measured_dim: int, dim: int) -> Column:
    """An sd measured at one dimension, at another."""
    return sd * math.sqrt(measured_dim / dim)


def k_max_measured(scale: Column, mu: Column) -> Column:
    """The load at which the measured hit mean falls to the measured null floor."""
    return 2 * scale * scale / (math.pi * mu * mu)
