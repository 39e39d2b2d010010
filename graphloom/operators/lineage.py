"""Origins, consumers, chains and trees of a data flow graph; pairs of start and end events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .traversal import paths, reachable


def _turned(flows: DataFrame) -> DataFrame:
    return flows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def origins(flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): where each seed's data comes from: what reaches it and is reached by nothing.

    A seed that nothing flows into is its own origin; one fed by cycles only has none.
    """
    up = reachable(_turned(flows), seeds).select("seed", "node")
    fed = flows.select(F.col("dst").alias("node")).distinct()
    own = seeds.select("seed", F.col("seed").alias("node")).distinct()
    return up.unionByName(own).distinct().join(fed, "node", "left_anti").select("seed", "node")


def consumers(flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth): all that data of each seed flows into."""
    return reachable(flows, seeds)


def chain(flows: DataFrame, source: str, target: str, max_length: int) -> DataFrame:
    return paths(flows, source, target, max_length)


def tree(flows: DataFrame, root: str, max_depth: int = 3) -> DataFrame:
    """(path, line): the dependency tree of one component as indented text, in the order of path; where the
    depth asked for cuts off further parts, the line ends with dots."""
    step = flows.select("src", "dst").distinct()
    level = flows.sparkSession.range(1).select(F.array(F.lit(root)).alias("path"))
    found = level
    for _ in range(max_depth):
        on = level.join(step, F.element_at("path", -1) == step["src"]).where(~F.array_contains("path", F.col("dst")))
        level = on.select(F.array_append("path", F.col("dst")).alias("path"))
        found = found.unionByName(level)
    after = step.groupBy(F.col("src").alias("last")).agg(F.collect_set("dst").alias("next"))
    rows = found.withColumn("last", F.element_at("path", -1)).join(after, "last", "left")
    more = (F.size("path") == max_depth + 1) & F.coalesce(F.exists("next", lambda x: ~F.array_contains("path", x)), F.lit(False))
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), "last", F.when(more, " [...]").otherwise(""))
    return rows.select("path", line.alias("line")).withColumn("path", F.array_join("path", ">"))


def elapsed(events: DataFrame) -> DataFrame:
    """(key, operation, started, micros) of each end event with the start before it.

    events: (key, operation, kind, ts), kind being start or end.  An end without a start, or after
    another end, has none.
    """
    w = Window.partitionBy("key", "operation").orderBy("ts", F.desc("kind"))
    before = F.lag(F.struct("kind", "ts")).over(w)
    rows = events.withColumn("b", before).where((F.col("kind") == "end") & (F.col("b.kind") == "start"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("b.ts").cast("timestamp"))
    return rows.select("key", "operation", F.col("b.ts").alias("started"), micros.alias("micros"))
