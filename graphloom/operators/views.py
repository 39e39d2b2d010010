"""Views of the graph for people: drill-down, lists, layers, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import spill_table

# What node types are shown as, and how edges are drawn (colour, dashed).
SHOWN_AS = {"module": "file", "template": "file", "class": "class", "component": "class", "function": "method"}
EDGE_STYLES = {"imports": ("blue", False), "calls": ("green", False), "renders": ("purple", False), "uses": ("orange", True), "depends_on": ("red", True)}


def shown_as(type_: Column) -> Column:
    out = None
    for k, v in SHOWN_AS.items():
        out = F.when(type_ == k, v) if out is None else out.when(type_ == k, v)
    return out.otherwise("file")


def edge_style(type_: Column) -> Column:
    out = None
    for k, (colour, dashed) in EDGE_STYLES.items():
        row = F.struct(F.lit(colour).alias("colour"), F.lit(dashed).alias("dashed"))
        out = F.when(type_ == k, row) if out is None else out.when(type_ == k, row)
    return out.otherwise(F.struct(F.lit("grey").alias("colour"), F.lit(False).alias("dashed")))


def view_nodes(nodes: DataFrame, level: str, file: str | None = None) -> DataFrame:
    """Nodes of one level: all files; the classes of a file, or all; the methods of a file, or all."""
    kind = {"repo": "file", "file": "class", "class": "method"}[level]
    found = nodes.where(shown_as(F.col("type")) == kind)
    return found.where(F.col("file") == file) if file and level != "repo" else found


def type_lists(nodes: DataFrame, most: int = 15) -> DataFrame:
    """(type, position, id, name, total): the first names of each type, and how many there are.

    Positions are taken within (type, initial) first, so that no task ranks a whole type.
    """
    low = F.lower("name")
    n = nodes.where("name IS NOT NULL").select("type", "id", "name", low.alias("low"), F.substring(low, 1, 2).alias("part"))
    near = Window.partitionBy("type", "part").orderBy("low", "id")
    few = n.withColumn("i", F.row_number().over(near)).where(F.col("i") <= most)
    final = few.withColumn("position", F.row_number().over(Window.partitionBy("type").orderBy("low", "id"))).where(F.col("position") <= most)
    totals = n.groupBy("type").agg(F.count("*").alias("total"))
    return final.join(totals, "type").select("type", "position", "id", "name", "total")


def layers(importance: DataFrame) -> DataFrame:
    """(id, layer, position): layers by importance; positions by falling importance."""
    i = F.col("importance")
    layer = F.when(i > 3, 0).when(i > 2, 1).when(i > 1, 2).otherwise(3)
    # sorted once over all tasks; each numbers its own range, behind the sizes of the ranges before it
    w = importance.withColumn("layer", layer).repartitionByRange("layer", F.desc("importance"), "id")
    ranged = spill_table(w.withColumn("part", F.spark_partition_id()), "layers")
    sizes = ranged.groupBy("layer", "part").agg(F.count("*").alias("n")).groupBy("layer").agg(F.collect_list(F.struct("part", "n")).alias("l"))
    inside = F.row_number().over(Window.partitionBy("layer", "part").orderBy(F.desc("importance"), "id"))
    before = F.aggregate(F.filter("l", lambda p: p["part"] < F.col("part")), F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    placed = ranged.withColumn("i", inside).join(F.broadcast(sizes), "layer")  # four rows, one entry per task of the sort
    return placed.select("id", "layer", (before + F.col("i")).cast("int").alias("position"))


def related(nodes: DataFrame, id_: str) -> DataFrame:
    """A node's relatives: of a file what it holds, of anything else its file and what shares it."""
    one = nodes.where(F.col("id") == id_).select(F.col("file").alias("f"))
    return nodes.join(one, nodes["file"] == one["f"], "left_semi").where(F.col("id") != id_)
