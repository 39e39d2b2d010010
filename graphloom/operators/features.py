"""Texts and feature vectors for models, and a classifier of types."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import naming


def cache_key(name: Column, context: Column, code: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(name, F.lit("")), F.coalesce(context, F.lit("")), F.coalesce(code, F.lit(""))))


def semantic_text(name: Column, kind: Column, context: Column, code: Column) -> Column:
    """What an embedder reads of an entity."""
    return F.concat_ws(" | ", F.concat(F.lit("name: "), name), F.concat(F.lit("type: "), kind), F.concat(F.lit("context: "), context), F.concat(F.lit("code: "), F.substring(code, 1, 200)))


def shortened(code: Column, max_tokens: int) -> Column:
    """Code of at most so many lines for a token budget: the first line and as many as fit."""
    lines = F.split(code, "\n")
    most = max(1, max_tokens // 10)
    return F.when(F.size(lines) <= most, code).otherwise(F.array_join(F.slice(lines, 1, most + 1), "\n"))


def code_features(text: Column) -> dict[str, Column]:
    """Counts and flags of a piece of code."""
    count = lambda rx: F.size(F.regexp_extract_all(text, F.lit(rx), F.lit(0))).cast("bigint")
    distinct = lambda rx: F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(rx), F.lit(1)))).cast("bigint")
    return {
        "n_functions": distinct(r"function ([A-Za-z_$][A-Za-z0-9_$]*)"), "n_imports": count(r"(?m)^import |require\("),
        "n_annotations": count(r": *(?:string|number|boolean|any|unknown|void)\b"), "n_calls": count(r"\.[A-Za-z_$][A-Za-z0-9_$]*\("),
        "n_assignments": count(r"[^=!<>]=[^=>]"), "has_default": F.contains(text, F.lit("??")), "n_chars": F.char_length(text).cast("bigint"),
    }


def feature_vector(name: Column, text: Column) -> Column:
    """Flags of the name and counts of the text as one vector."""
    return F.array(*(c.cast("double") for c in naming(name).values()), *(c.cast("double") for c in code_features(text).values()))


def _seeded(dims: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                seed = int(hashlib.md5((text or "").encode()).hexdigest(), 16) % (1 << 32)
                v = np.random.default_rng(seed).uniform(-1, 1, dims).astype(np.float32)
                rows.append(v / np.linalg.norm(v))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            offsets = np.arange(0, len(flat) + 1, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "embedding"])

    return run


def seeded_embeddings(df: DataFrame, key: str, text: Column, dims: int = 768) -> DataFrame:
    """(key, embedding): a reproducible unit vector per text, where no model is at hand."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text.alias("text")).mapInArrow(_seeded(dims), f"key {kind}, embedding array<float>")


def train_type_classifier(labelled: DataFrame, label: str, vector: str, trees: int = 20, seed: int = 42):
    """A random forest over feature vectors; returns a function that adds ``predicted`` to a frame."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    rows = labelled.withColumn("_v", array_to_vector(vector))
    indexer = StringIndexer(inputCol=label, outputCol="_l", stringOrderType="alphabetAsc").fit(rows)
    forest = RandomForestClassifier(featuresCol="_v", labelCol="_l", numTrees=trees, seed=seed)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    model = Pipeline(stages=[indexer, forest, back]).fit(rows)
    # a copy has no training summary, which holds the session and cannot be sent to executors
    forest_model, names = model.stages[1].copy(), model.stages[2]

    def predict(df: DataFrame) -> DataFrame:
        scored = names.transform(forest_model.transform(df.withColumn("_v", array_to_vector(vector))))
        return scored.drop("_v", "rawPrediction", "probability", "prediction")

    return predict
