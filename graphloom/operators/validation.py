"""Validation of edges against nodes: rows of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALLABLE = ("function", "component", "class", "api_endpoint")
CROSSING = ("calls", "uses", "renders")
IMPORTING = ("imports", "depends_on")


def located(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with type and file of both ends; null where an end is missing."""
    s = nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type"), F.col("file").alias("source_file"))
    t = nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type"), F.col("file").alias("target_file"))
    return links.join(s, "source", "left").join(t, "target", "left")


def edge_issues(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, issue_type, severity) of every finding.

    The located links are read once for the pairs of files with an import and once for the findings,
    which are one array per link.
    """
    e = located(links, nodes)
    files = ["source_file", "target_file"]
    imported = e.where(F.col("type").isin(*IMPORTING) & F.col("source_file").isNotNull() & F.col("target_file").isNotNull()).select(*files).distinct()
    known = e.join(imported.withColumn("imported", F.lit(True)), files, "left")
    render, call, own = F.col("type") == "renders", F.col("type").isin("calls", "async_calls"), F.col("source") == F.col("target")
    crossing = F.col("type").isin(*CROSSING) & (F.col("source_file") != F.col("target_file"))
    rules = (
        (F.col("source_type").isNull(), "missing_source_node", "error"),
        (F.col("target_type").isNull(), "missing_target_node", "error"),
        (crossing & F.col("imported").isNull(), "missing_import", "warning"),
        (render & own, "self_referencing_render", "error"),
        (render & ~own & (F.col("source_type") != "component"), "render_source_not_component", "warning"),
        (render & ~own & (F.col("target_type") != "component"), "render_target_not_component", "info"),
        (call & own, "self_call", "error"),
        (call & ~own & ~F.col("target_type").isin(*CALLABLE), "call_target_not_callable", "warning"),
    )
    each = F.array(*(F.when(c, F.struct(F.lit(k).alias("issue_type"), F.lit(s).alias("severity"))) for c, k, s in rules))
    return known.select("edge_id", F.inline(F.filter(each, lambda x: x.isNotNull())))


def orphaned_nodes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without any link, apart from modules and entries."""
    ends = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct()
    return nodes.where((F.col("type") != "module") & ~F.col("is_entry")).join(ends, "id", "left_anti")
