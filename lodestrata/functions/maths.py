"""Column expressions for scores and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = {"openalex": 0.95, "semantic_scholar": 0.9, "pubmed": 0.85, "arxiv": 0.8}  #: fixed values; others 0.4
SHIFT, EPS = 0.5, 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.greatest(norm, F.lit(1e-300))).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def caste_direction(caste: Column, ref: Column, cites: Column) -> Column:
    """struct(ref, cites), summing to 1: half the way to one direction for the two castes that prefer it."""
    r = F.when(caste == "fundaciones", ref + (1 - ref) * SHIFT).when(caste == "impacto", ref * (1 - SHIFT)).otherwise(ref)
    c = F.when(caste == "fundaciones", cites * (1 - SHIFT)).when(caste == "impacto", cites + (1 - cites) * SHIFT).otherwise(cites)
    share = lambda x: F.when(r + c <= EPS, F.lit(0.5)).otherwise(x / F.greatest(r + c, F.lit(EPS)))
    return F.struct(share(r).alias("ref"), share(c).alias("cites"))


def provider_confidence(provider: Column, doi: Column, arxiv: Column, abstract: Column, title: Column) -> Column:
    base = F.lit(0.4)
    for name, value in CONFIDENCE.items():
        base = F.when(provider == name, value).otherwise(base)
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return clamp01(base + F.when(has(doi) | has(arxiv), 0.05).otherwise(0.0) + F.when(has(abstract), 0.05).otherwise(0.0) - F.when(~has(title), 0.2).otherwise(0.0))


def eta_components(similarity: Column, citations: Column, year: Column, confidence: Column) -> Column:
    """struct(sim, citations, recency, confidence), each in [0, 1]; a null similarity is 0.5, no year 2000."""
    when = F.when(F.coalesce(year, F.lit(0)) == 0, 2000).otherwise(year)
    return F.struct(
        F.coalesce(clamp01((similarity + 1) / 2), F.lit(0.5)).alias("sim"),
        sigmoid(F.log1p(F.coalesce(citations, F.lit(0))) / 5).alias("citations"),
        clamp01((when - 1950) / 75).alias("recency"),
        confidence.alias("confidence"),
    )


def eta(parts: Column, weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * clamp01(parts[name])
    return sigmoid(total)


def transition_weight(tau: Column, alpha: float, eta_: Column, beta: float, direction: Column) -> Column:
    trail = F.pow(F.when(tau <= 0, EPS).otherwise(tau), F.lit(alpha))
    return F.greatest(F.lit(0.0), trail) * F.greatest(F.lit(0.0), F.pow(eta_, F.lit(beta))) * F.greatest(F.lit(0.0), direction)


def kernel_score(abstract: Column, citations: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.5 + F.when(F.coalesce(abstract, F.lit("")) != "", 0.3).otherwise(0.0) + F.least(F.lit(0.2), F.coalesce(citations, F.lit(0)) / 5000)), 6)


def agent_priority(q: Column, frontier: Column, budget: Column, gamma: float, delta: float) -> Column:
    return q + gamma * F.least(F.lit(1.0), frontier / 20) + delta * budget
