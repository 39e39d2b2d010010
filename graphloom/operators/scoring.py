"""Weighted confidence scores over factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the factors.
WEIGHTS = {
    "type_inference": 0.25, "data_flow": 0.20, "pattern_match": 0.15, "annotation": 0.15, "dependency": 0.10,
    "consistency": 0.10, "evidence": 0.03, "usage": 0.02,
}


def weighted(factors: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Mean of the factors given (not null), clamped to [0, 1] and weighted; 0 if there is none."""
    # greatest and least pass nulls over, so a missing factor has to stay missing
    clamp = {k: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))) for k, c in factors.items()}
    total = sum((F.when(factors[k].isNotNull(), F.lit(weights[k])).otherwise(0.0) for k in factors), F.lit(0.0))
    score = sum((F.coalesce(clamp[k] * weights[k], F.lit(0.0)) for k in factors), F.lit(0.0))
    return F.when(total > 0, score / total).otherwise(0.0)


def score_long(factors: DataFrame) -> DataFrame:
    """(entity_id, score) from rows (entity_id, factor, score, weight)."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    used = factors.where((F.col("weight") > 0) & F.col("score").isNotNull())
    return used.groupBy("entity_id").agg((F.sum(s * F.col("weight")) / F.sum("weight")).alias("score"))


def score_files(factors: DataFrame) -> DataFrame:
    """(file, score) from rows (file, entity_id, factor, score): mean per factor, evidence by number of entities."""
    per = factors.groupBy("file", "factor").agg(F.avg("score").alias("score"))
    n = factors.groupBy("file").agg(F.countDistinct("entity_id").alias("n"))
    base = per.where(F.col("factor") != "evidence").unionByName(
        n.select("file", F.lit("evidence").alias("factor"), F.least(F.lit(1.0), 0.1 * F.col("n")).alias("score"))
    )
    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[F.col("factor")]
    return score_long(base.select(F.col("file").alias("entity_id"), "factor", "score", weight.alias("weight"))).withColumnRenamed("entity_id", "file")


def recommendations(overall: Column, factors: dict[str, Column]) -> Column:
    """The first five findings about a low score."""
    found = [F.when(overall < 0.5, "low overall confidence: review this entity")]
    found += [F.when(c < 0.5, f"improve {k}") for k, c in factors.items()]
    return F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, 5)


def merge_types(inferences: DataFrame) -> DataFrame:
    """The type with most confidence in sum per identifier: (identifier, name, confidence); ties to the first name."""
    per = inferences.groupBy("identifier", "name").agg(F.sum("confidence").alias("total"), F.avg("confidence").alias("mean"), F.count("*").alias("n"))
    best = per.groupBy("identifier").agg(F.min_by(F.struct("name", "mean", "n"), F.struct(-F.col("total"), "name")).alias("b"))
    confidence = F.least(F.lit(1.0), F.col("b.mean") + 0.05 * (F.col("b.n") - 1))
    return best.select("identifier", F.col("b.name").alias("name"), confidence.alias("confidence"))


def from_type_inference(confidence: Column, annotated: Column, n_sources: Column) -> dict[str, Column]:
    """Factors that type inference gives."""
    return {"type_inference": F.coalesce(confidence, F.lit(0.5)), "annotation": annotated.cast("double"), "evidence": F.least(F.lit(1.0), 0.3 * n_sources)}


def from_data_flow(n_in: Column, n_out: Column, consistent: Column) -> dict[str, Column]:
    n = n_in + n_out
    return {"data_flow": F.least(F.lit(1.0), 0.2 * n), "consistency": F.when(consistent, 1.0).otherwise(0.5), "evidence": F.least(F.lit(1.0), 0.25 * n)}


def from_hook(custom: Column, has_dependencies: Column, consistent: Column) -> dict[str, Column]:
    return {"pattern_match": F.when(custom, 0.7).otherwise(1.0), "dependency": F.when(has_dependencies, 1.0).otherwise(0.5), "consistency": F.when(consistent, 1.0).otherwise(0.6)}


def from_injection(n: Column, typed: Column, circular: Column) -> dict[str, Column]:
    return {"dependency": F.least(F.lit(1.0), 0.3 * n), "type_inference": F.when(typed, 1.0).otherwise(0.6), "consistency": F.when(circular, 0.8).otherwise(1.0), "evidence": F.least(F.lit(1.0), 0.25 * n)}


def from_component(type_confidence: Column, has_props: Column, n_hooks: Column, n_di: Column, n_uses: Column) -> dict[str, Column]:
    cap = lambda c: F.least(F.lit(1.0), c)
    return {
        "type_inference": cap(F.coalesce(type_confidence, F.lit(0.0)) + F.when(has_props, 0.2).otherwise(0.0)), "pattern_match": cap(0.25 * n_hooks), "dependency": cap(0.2 * n_di),
        "usage": cap(0.3 * n_uses), "evidence": cap(0.15 * (n_hooks + n_di)),
    }


def entity_confidence(has_flow: Column, has_di: Column, typed: Column, annotated: Column, n_relations: Column) -> Column:
    """Confidence of a merged entity: shares for flow, injection and type, and a little for relations."""
    raw = F.when(has_flow, 0.3).otherwise(0.0) + F.when(has_di, 0.3).otherwise(0.0) + F.when(annotated, 0.4).when(typed, 0.3).otherwise(0.0)
    full = raw + F.least(F.lit(0.1), 0.02 * n_relations)
    return F.least(F.lit(1.0), full / F.when(n_relations > 0, 1.1).otherwise(1.0))


def reason(score: Column, factor: str) -> Column:
    """A factor's score in words."""
    return F.concat(F.when(score >= 0.7, "high ").when(score >= 0.4, "medium ").otherwise("low "), F.lit(factor.replace("_", " ")))


def behaviour_confidence(scores: Column) -> Column:
    """Share of behaviours above one half, and a part of the best."""
    n = F.size(F.filter(scores, lambda x: x > 0.5)) / F.size(scores)
    return F.least(F.lit(1.0), n + 0.3 * F.array_max(scores))
