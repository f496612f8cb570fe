"""Capacity laws, opinions and routing as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of the gate (fixed values).
THETA, ALPHA, BETA, GAMMA = 0.0, 1.0, 1.0, 1.0
C_REF, S_REF, C_L2, S_L2 = 0.19, 0.08, 0.4528, 0.0342
U_IGNORANT, U_WEAK, SAFETY, SMALL = 0.85, 0.35, 0.5, 1e-12


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mu_hit(k: Column) -> Column:
    return F.sqrt(2 / (math.pi * k))


def mu_null(n: Column, dim: Column) -> Column:
    return F.sqrt(2 * F.log(n) / dim)


def k_max(n: Column, dim: Column) -> Column:
    return dim / (math.pi * F.log(n))


def paging_threshold(n: Column, dim: Column) -> Column:
    return SAFETY * k_max(n, dim)


def k_sat(scale: Column, mu: Column, sigma: Column, gamma: float = GAMMA) -> Column:
    level = mu + gamma * sigma
    return 2 * scale * scale / (math.pi * level * level)


def crossing(mu_h: Column, sd_h: Column, mu_n: Column, sd_n: Column) -> Column:
    return (mu_h * sd_n + mu_n * sd_h) / (sd_h + sd_n)


def z_resolution(a: Column, mu_h: Column, sd_h: Column, mu_n: Column, sd_n: Column) -> Column:
    return (a - crossing(mu_h, sd_h, mu_n, sd_n)) / (0.5 * (sd_h + sd_n))


def z_margin(m: Column, mu_h: Column, mu_n: Column, sd_m: Column) -> Column:
    return (m - 0.5 * (mu_h - mu_n)) / sd_m


def saturated(mu_h: Column, mu_n: Column, sd_n: Column, gamma: float = GAMMA) -> Column:
    return mu_h <= mu_n + gamma * sd_n


def opinion(z: Column, m_z: Column) -> Column:
    u, s = 1 - sigmoid(ALPHA * (z - THETA)), sigmoid(BETA * m_z)
    return F.struct(((1 - u) * s).alias("b"), ((1 - u) * (1 - s)).alias("d"), u.alias("u"))


def opinion_two_source(z: Column, m_ref: Column, m_l2: Column, m_z: Column, key_hit: Column | None = None) -> Column:
    """Ambiguity is the larger of the referential and the stored one (the margin of recall if neither is there);
    of equals the referential. With `key_hit`, a key that is not stored cannot be a stored collision."""
    ref = 1 - sigmoid((m_ref - C_REF) / S_REF)
    stored = 1 - sigmoid((m_l2 - C_L2) / S_L2)
    if key_hit is not None:
        stored = F.when(key_hit, stored)
    p = F.coalesce(F.greatest(ref, stored), 1 - sigmoid(BETA * m_z))
    tag = F.when(ref.isNull() & stored.isNull(), "l1-hint").when(stored.isNull() | (ref >= stored), "referential").otherwise("stored")
    u = 1 - sigmoid(ALPHA * (z - THETA))
    return F.struct(((1 - u) * (1 - p)).alias("b"), ((1 - u) * p).alias("d"), u.alias("u"), tag.alias("tag"))


def route(b: Column, d: Column, u: Column, is_saturated: Column, has_store: Column) -> Column:
    fallback = F.when(has_store, "recollect").otherwise("abstain")
    return F.when(is_saturated, fallback).when(u >= U_IGNORANT, "abstain").when(u >= U_WEAK, fallback).when(d > b, "deliberate").otherwise("answer")


def route_tag(action: Column, tag: Column) -> Column:
    return F.when(action == "deliberate", tag)


def scalars(b: Column, d: Column, u: Column) -> Column:
    return F.struct(b.alias("belief"), F.when(b + d <= SMALL, 0.5).otherwise(b / (b + d)).alias("share"), (1 - u).alias("certainty"))


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, clamped at the ends."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (a, p), (b, q) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= b, p + (x - a) * ((q - p) / (b - a)))
    return out.otherwise(F.lit(knots[-1][1]))


def norm_cdf_poly(x: Column) -> Column:
    """The normal distribution by the rational form of Abramowitz and Stegun 26.2.17 (7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def norm_quantile(p: Column) -> Column:
    """The inverse normal distribution: Abramowitz and Stegun 26.2.23, then two Newton steps on norm_cdf_poly."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    start = F.when(p < 0.5, -x).otherwise(x)
    # A fold binds each step's value to a name, so that the expression does not grow with the steps.
    return F.aggregate(F.array(F.lit(1), F.lit(2)), start, lambda y, _: y - (norm_cdf_poly(y) - p) * math.sqrt(2 * math.pi) * F.exp(y * y / 2))


def l2_opinion_parts(u: Column, m_l2: Column) -> Column:
    """(b, d) split by the stored margin alone."""
    s = sigmoid((m_l2 - C_L2) / S_L2)
    return F.struct(((1 - u) * s).alias("b"), ((1 - u) * (1 - s)).alias("d"))


def null_moments(mu: Column, sd: Column, measured_mu: Column, measured_sd: Column) -> Column:
    """Measured moments where there are any (the number of names then plays no part), else the analytic ones."""
    return F.struct(F.coalesce(measured_mu, mu).alias("mu"), F.coalesce(measured_sd, sd).alias("sd"))


def hit_moments(k: Column, scale: Column, sd: Column) -> Column:
    """The analytic mean scaled to fit, and an sd interpolated at the load."""
    return F.struct((scale * mu_hit(k)).alias("mu"), sd.alias("sd"))
