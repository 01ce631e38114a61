"""Scores of claims."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beta priors (alpha; beta is 1) by source and kind.
PRIORS = {
    "agent_add": {"fact": 4, "preference": 5, "constraint": 4, "learned-pattern": 3},
    "user_correction": {"fact": 6, "preference": 6, "constraint": 6, "learned-pattern": 6},
    "outcome_trace": {"fact": 3, "preference": 3, "constraint": 3, "learned-pattern": 3},
    "document": {"fact": 2, "preference": 2, "constraint": 2, "learned-pattern": 2},
}
#: Strength of evidence.
STRENGTH = {"verbatim": 0.8, "paraphrase": 0.3, "inference": 0.0}
UNKNOWN_FACTOR = 0.4


def prior_alpha(source: Column, kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for s, kinds in PRIORS.items():
        for k, a in kinds.items():
            out = F.when((source == s) & (kind == k), float(a)).otherwise(out)
    return out


def prior_confidence(source: Column, kind: Column, extraction: Column) -> Column:
    a = prior_alpha(source, kind) * F.when(extraction == "inference", 0.7).otherwise(1.0)
    return F.round(a / (a + 1), 4)


def evidence_strength(source: Column, extraction: Column) -> Column:
    out = F.lit(0.6)
    for k, v in STRENGTH.items():
        out = F.when(extraction == k, v).otherwise(out)
    return F.when(source == "user_correction", 0.0).otherwise(out)


def reinforced(confidence: Column, weight: Column, discount: Column = None) -> Column:
    mass = weight * (F.lit(1.0) if discount is None else discount)
    first = F.round(F.least(mass, F.lit(1.0)), 4)
    return F.when(weight <= 0, confidence).when(confidence.isNull(), first).otherwise(F.round(confidence + (1 - confidence) * mass * 0.2, 4))


def final_score(relevance: Column, confidence: Column, reuse: Column = None) -> Column:
    return F.round(relevance * F.coalesce(confidence, F.lit(UNKNOWN_FACTOR)) * (F.lit(1.0) if reuse is None else reuse), 4)


def channel_priority(source: Column, low_confidence: Column, from_graph: Column) -> Column:
    base = F.when(source == "profile", 4.0).when(source == "projectMemory", 3.0).when(source == "userMemory", 2.0).otherwise(1.0)
    return base - F.when(low_confidence, 1.0).otherwise(0.0) + F.when(from_graph, 0.5).otherwise(0.0)
