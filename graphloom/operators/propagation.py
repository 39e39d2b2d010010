"""Values carried along links until nothing changes, and the value that holds at a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import spill_counted, spill_table


def spread(typed: DataFrame, links: DataFrame, factor: float) -> DataFrame:
    """(node, type, distance, confidence): every node that a typed one reaches gets the type of the nearest,
    the first by name on ties; each step multiplies the confidence.

    typed: (node, type, confidence); links: (src, dst).  Each round carries on only what the round before
    reached for the first time, and the loop ends when that is nothing.
    """
    pick = F.min_by(F.struct("type", "confidence"), F.struct("type", -F.col("confidence")))
    start = typed.groupBy("node").agg(pick.alias("r")).select("node", "r.*", F.lit(0).alias("distance"))
    known = spill_table(start, "typed")
    step = spill_table(links.select("src", "dst").distinct(), "steps")
    distance, n = 0, None
    while n != 0:
        distance += 1
        front = known.where(F.col("distance") == distance - 1)
        reached = step.join(front, step["src"] == front["node"]).groupBy("dst").agg(pick.alias("r")).select(F.col("dst").alias("node"), "r.type", (F.col("r.confidence") * factor).alias("confidence"))
        fresh = reached.join(known.select("node"), "node", "left_anti").withColumn("distance", F.lit(distance))
        known, n = spill_counted(known.unionByName(fresh), "typed", F.col("distance") == distance)
    return known


def as_of(asked: DataFrame, said: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """asked with ``value`` and its place ``at`` of the last row of ``said`` with the same keys at or before it.

    Both sides run once through one window per key; equal places of ``said`` count before those asked.
    """
    a = asked.withColumns({"_v": F.lit(None).cast(said.schema[value].dataType), "_at": F.lit(None).cast(said.schema[order].dataType), "_asked": F.lit(True)})
    b = said.select(*keys, order, F.col(value).alias("_v"), F.col(order).alias("_at"), F.lit(False).alias("_asked"))
    w = Window.partitionBy(*keys).orderBy(order, "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.max(F.when(~F.col("_asked"), F.struct("_at", "_v"))).over(w)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_h", held)
    return both.where("_asked").select(*asked.columns, F.col("_h._v").alias(value), F.col("_h._at").alias("at"))
