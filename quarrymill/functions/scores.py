"""Scores, rates and ordered rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and scores of the consensus of two producers.
CONSENSUS_WEIGHTS = {"evidence": 0.35, "agreement": 0.40, "support": 0.15, "kind": 0.10}
EVIDENCE_SCORES = {"exact": 1.0, "normalized": 0.9, "fuzzy": 0.5}
AGREEMENT_SCORES = {"lexical": 1.0, "semantic": 0.8, "boundary": 0.5, "validator_confirmed": 0.6, "single_model": 0.25}


def lookup(c: Column, table: dict, default: float) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def consensus_score(match_type: Column, agreement: Column, support: Column, kind_conflict: Column) -> Column:
    w = CONSENSUS_WEIGHTS
    return F.round(w["evidence"] * lookup(match_type, EVIDENCE_SCORES, 0.0) + w["agreement"] * lookup(agreement, AGREEMENT_SCORES, 0.25) + w["support"] * F.coalesce(support, F.lit(0.0)) + w["kind"] * F.when(kind_conflict, 0.0).otherwise(1.0), 3)


def consensus_tier(score: Column, agreement: Column) -> Column:
    return F.when((score >= 0.80) & agreement.isin("lexical", "semantic"), "high").when(score >= 0.55, "medium").otherwise("low")


def gate(match_type: Column, support: Column, repeated: Column) -> Column:
    """Why an extracted statement is rejected, or that it is accepted; the first reason counts."""
    return F.when(match_type == "none", "rejected_evidence_not_found").when(support < 0.34, "rejected_unsupported_statement").when(repeated, "rejected_duplicate_in_output").otherwise("accepted")


def decision(top: Column, margin: Column, accept: float, review: float, least_margin: float) -> Column:
    return F.when((top >= accept) & (margin >= least_margin), "accepted").when(top >= review, "review").otherwise("unmatched")


def precision(tp: Column, predicted: Column) -> Column:
    return F.try_divide(tp.cast("double"), predicted.cast("double"))


def f1(p: Column, r: Column) -> Column:
    """Null if either is null, 0 if both are 0."""
    return F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Bounds of the 95 % interval of a share, to 4 places; null for no cases."""
    p, n = hits / n, n.cast("double")
    mid, half, d = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.struct(F.round((mid - half) / d, 4).alias("low"), F.round((mid + half) / d, 4).alias("high")))


def above_chance(rate: Column, chance: Column) -> Column:
    """Kappa: agreement beyond chance, null where chance is total."""
    return F.when(chance < 1, (rate - chance) / (1 - chance))


def granularity(n_clusters: Column, median: Column, low: float, high: float, least: int) -> Column:
    """1 within the band of median sizes, falling with the logarithm to 0 at half or twice its bounds."""
    bound = F.when(median < low, low).otherwise(high)
    fall = F.greatest(F.lit(0.0), 1 - F.abs(F.ln(median / bound)) / F.ln(F.lit(2.0)))
    return F.when(n_clusters.isNull() | (n_clusters < least) | median.isNull(), 0.0).when(median.between(low, high), 1.0).otherwise(fall)


def flags(**rules: Column) -> Column:
    """Names of the rules that hold, in order, as one string."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])), ";")


def overlap_class(jaccard: Column) -> Column:
    return F.when(jaccard >= 0.7, "robust").when(jaccard >= 0.4, "partial").otherwise("sensitive")


def sum_of_rules(*rules: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for c, v in rules:
        out = out + F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return out


def span_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union of two half-open spans; 0 where an end is null."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(F.try_divide(inter.cast("double"), (F.greatest(a1, b1) - F.least(a0, b0)).cast("double")), F.lit(0.0))


def rerank_blend(similarity: Column, ranks: list[Column], weight: float = 0.6) -> Column:
    """Similarity blended with the mean place of reviewers' rankings of five."""
    places = [F.coalesce((6 - r) / 5, F.lit(0.0)) for r in ranks]
    return weight * similarity + (1 - weight) * sum(places[1:], places[0]) / len(places)
