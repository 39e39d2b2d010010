"""Sinks: rows as JSON, and the whole analysis as tables in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import whole_json

#: Schema of node metadata as far as it is known; the open part stays text.
METADATA = (
    "c4_level string, is_entry boolean, location struct<file:string,line_start:int,line_end:int,column_start:int,column_end:int>,"
    " type_info struct<name:string,category:string,confidence:double,source:string,generic_params:array<string>>,"
    " hook_info struct<hook_name:string,hook_type:string,dependencies:array<string>>,"
    " confidence_score struct<overall_score:double,factors:map<string,double>>, dependencies array<string>"
)
C4 = ("system", "container", "component", "code")


def metadata(text: Column) -> Column:
    """Metadata with defaults; a level outside the vocabulary becomes code."""
    m = F.from_json(whole_json(text), METADATA)
    return F.struct(
        F.when(m["c4_level"].isin(*C4), m["c4_level"]).otherwise("code").alias("c4_level"), F.coalesce(m["is_entry"], F.lit(False)).alias("is_entry"),
        m["location"].alias("location"), m["type_info"].alias("type_info"), m["hook_info"].alias("hook_info"), m["confidence_score"].alias("confidence_score"),
        F.coalesce(m["dependencies"], F.array()).alias("dependencies"),
    )


def sparse_json(row: Column) -> Column:
    """A struct as JSON without the fields that are null."""
    return F.to_json(row, {"ignoreNullFields": "true"})


def node_documents(nodes: DataFrame) -> DataFrame:
    """(id, document) of nodes with structured metadata."""
    return nodes.select("id", sparse_json(F.struct("id", "type", "file", "name", metadata(F.col("metadata")).alias("metadata"))).alias("document"))


def edge_documents(edges: DataFrame) -> DataFrame:
    meta = F.coalesce(F.from_json(whole_json(F.col("metadata")), "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    both = F.map_concat(F.map_filter(meta, lambda k, v: k != "confidence"), F.create_map(F.lit("confidence"), F.coalesce(F.col("confidence").cast("string"), F.lit(""))))
    return edges.select("edge_id", sparse_json(F.struct("source", "target", "type", both.alias("metadata"))).alias("document"))


def insights(nodes: DataFrame, links: DataFrame, large: int = 50, many: int = 10) -> DataFrame:
    """(type, severity, title, subject, n) of what stands out: large files, unused nodes.

    Unused nodes are reported if there are more than ``many``, once, with their number and the first id.
    """
    files = nodes.where("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > large)
    big = files.select(F.lit("complexity").alias("type"), F.lit("medium").alias("severity"), F.lit("large file").alias("title"), F.col("file").alias("subject"), "n")
    targets = links.select(F.col("target").alias("id")).distinct()
    unused = nodes.where(~F.col("is_entry")).join(targets, "id", "left_anti").agg(F.count("*").alias("n"), F.min("id").alias("subject")).where(F.col("n") > many)
    return big.unionByName(unused.select(F.lit("dead_code").alias("type"), F.lit("low").alias("severity"), F.lit("unused nodes").alias("title"), "subject", "n"))


def write_response(folder: str, **tables: DataFrame) -> None:
    """Each table of the analysis as JSON lines below a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def call_key(method: str, arguments: Column) -> Column:
    """One key for a call, whatever the order of its arguments (a map)."""
    pairs = F.array_sort(F.transform(F.map_entries(arguments), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("None")))))
    return F.concat(F.lit(method + ":"), F.array_join(pairs, "|"))
