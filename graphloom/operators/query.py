"""The fluent query API over entities; every step is a Column predicate, so Catalyst sees one filter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EntityQuery:
    """Chained filters over an entity table (name, kind, type_name, confidence, ...)."""

    def __init__(self, entities: DataFrame):
        self.entities = entities

    def _where(self, condition: Column) -> EntityQuery:
        return EntityQuery(self.entities.where(condition))

    def with_name(self, pattern: str, exact: bool = False) -> EntityQuery:
        if exact:
            return self._where(F.col("name") == pattern)
        re.compile(pattern)  # a bad pattern raises here
        return self._where(F.col("name").rlike(f"(?i){pattern}"))

    def with_type(self, type_name: str) -> EntityQuery:
        return self._where(F.col("type_name") == type_name)

    def with_kind(self, kind: str) -> EntityQuery:
        return self._where(F.col("kind") == kind)

    def with_min_confidence(self, least: float) -> EntityQuery:
        return self._where(F.col("confidence") >= least)

    def with_confidence(self, least: float = 0.0, most: float = 1.0) -> EntityQuery:
        return self._where(F.col("confidence").between(least, most))

    def calling(self, links: DataFrame, target: str) -> EntityQuery:
        """Entities with a link to a named target; the links are semi-joined, not collected."""
        ends = links.where(F.col("target") == target).select(F.col("source").alias("id"))
        return EntityQuery(self.entities.join(ends, "id", "left_semi"))

    def called_by(self, links: DataFrame, source: str) -> EntityQuery:
        ends = links.where(F.col("source") == source).select(F.col("target").alias("id"))
        return EntityQuery(self.entities.join(ends, "id", "left_semi"))

    def execute(self) -> DataFrame:
        return self.entities

    def count(self) -> DataFrame:
        return self.entities.agg(F.count("*").alias("total_count"))


def find_by_name(entities: DataFrame, pattern: str, exact: bool = False, case_sensitive: bool = False) -> DataFrame:
    """By name: equal, or containing a pattern; a bad pattern is taken as plain text."""
    name = F.col("name")
    if exact:
        return entities.where(name == pattern if case_sensitive else F.lower(name) == pattern.lower())
    try:
        re.compile(pattern)
    except re.error:
        return entities.where(F.contains(name, F.lit(pattern)) if case_sensitive else F.contains(F.lower(name), F.lit(pattern.lower())))
    return entities.where(name.rlike(pattern if case_sensitive else f"(?i){pattern}"))


def find_by_type(entities: DataFrame, type_name: str, exact: bool = True) -> DataFrame:
    low = F.lower("type_name")
    return entities.where(low == type_name.lower() if exact else F.contains(low, F.lit(type_name.lower())))
