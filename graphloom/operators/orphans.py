"""References to records that do not exist (problem 2).

A *link* is one reference of one record: (tbl, record, endpoint, ref, at, own_id).  A *stay*
says that id existed from ``since`` up to, not including, ``until`` (null: still there).

Whether a stay covers a link is decided without an interval join: each stay turns into +1 at its
start and -1 at its end, and an id exists at time t if the deltas up to t sum to more than zero.
The sum has two parts.  Whole days before t come from one row per id with its net change per day:
stays are aggregated map-side before they are shuffled, and such a row grows with the days of the
data, not with stays.  A link meets that one row, however hot its id is, and AQE splits the hot side.
Links whose id changes on their very day are looked at closer in the same way by minutes of the day,
and only those whose id changes in their very minute by a running sum within (id, minute).  No task
ever holds all rows of an id or of its day, and copies of a stay or of a link add no pairs.

The cascade is a fixpoint: a record whose referenced record is an orphan is an orphan by
inheritance; each round semi-joins the links with the ids orphaned in the round before.

Cases: null and blank references, and those with a package prefix, refer to nothing and are no
links.  A link without a time is an orphan only if its id never had a stay.  A stay without a
start, or that ends before it starts, covers nothing.  White space around ids is ignored.  Empty
tables give empty results.  Extra columns of the inputs are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.exprs import whole_json
from ..session import spill_table

#: Fixed value: characters that count as white space around an id.
BLANKS = " \t\n\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u0085\ufeff"
EXTERNAL = "external:"


def bare(c: Column) -> Column:
    """The id without white space around it."""
    return F.btrim(c, F.lit(BLANKS))


def node_stays(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        bare(F.col("id")).alias("ref"), F.col("recorded_at").alias("since"), F.col("deleted_at").alias("until")
    )


def _link(tbl: str, record: str, endpoint: Column, ref: Column, at: str, own: Column) -> list[Column]:
    return [
        F.lit(tbl).alias("tbl"),
        F.col(record).cast("bigint").alias("record"),
        endpoint.alias("endpoint"),
        bare(ref).alias("ref"),
        F.col(at).alias("at"),
        own.cast("string").alias("own_id"),
    ]


def edge_links(edges: DataFrame) -> DataFrame:
    ends = F.explode(
        F.array(
            F.struct(F.lit("source").alias("endpoint"), F.col("source").alias("ref")),
            F.struct(F.lit("target").alias("endpoint"), F.col("target").alias("ref")),
        )
    )
    flat = edges.select("edge_id", "observed_at", ends.alias("e"))
    return referring(
        flat.select(*_link("edges", "edge_id", F.col("e.endpoint"), F.col("e.ref"), "observed_at", F.lit(None)))
    )


def node_links(nodes: DataFrame) -> DataFrame:
    """The ids that nodes.metadata names as dependencies."""
    deps = F.from_json(whole_json(F.col("metadata")), T.StructType([T.StructField("dependencies", T.ArrayType(T.StringType()))]))
    flat = nodes.select("ord", "id", "recorded_at", F.explode(deps["dependencies"]).alias("d"))
    return referring(
        flat.select(*_link("nodes", "ord", F.lit("dependency"), F.col("d"), "recorded_at", bare(F.col("id"))))
    )


def embedding_links(embeddings: DataFrame) -> DataFrame:
    return referring(
        embeddings.select(
            *_link("semantic_embeddings", "embedding_id", F.lit("entity"), F.col("entity_id"), "computed_at", F.lit(None))
        )
    )


def referring(links: DataFrame) -> DataFrame:
    """Links that refer to something inside the graph."""
    return links.where((F.col("ref") != "") & ~F.startswith(F.col("ref"), F.lit(EXTERNAL)))


def direct_orphans(links: DataFrame, stays: DataFrame) -> DataFrame:
    """The links whose id has no stay at their time; columns of ``links``."""
    held = stays.where(
        F.col("ref").isNotNull()
        & F.col("since").isNotNull()
        & (F.col("until").isNull() | (F.col("until") > F.col("since")))
    )
    starts = held.select("ref", F.col("since").alias("t"), F.lit(1).alias("delta"))
    ends = held.where(F.col("until").isNotNull()).select("ref", F.col("until").alias("t"), F.lit(-1).alias("delta"))
    deltas = starts.unionByName(ends).groupBy("ref", "t").agg(F.sum("delta").cast("int").alias("delta"))
    deltas = deltas.withColumn("day", F.to_date("t"))
    asked = links.withColumns({"day": F.to_date("at"), "before": F.lit(0).cast("bigint"), "ever": F.lit(False)})
    asked = _so_far(asked, deltas, [], "day")
    # most links see no change of their id on their own day
    gone = F.when(F.col("at").isNull(), ~F.col("ever")).otherwise(F.col("before") <= 0)
    plain = asked.where(~F.col("changes") & gone).select(*links.columns)
    close = asked.where("changes").drop("changes").withColumn("minute", F.date_trunc("minute", "at").cast("timestamp_ntz"))
    minutes = deltas.withColumn("minute", F.date_trunc("minute", "t").cast("timestamp_ntz"))
    close = _so_far(close, minutes, ["day"], "minute")
    settled = close.where(~F.col("changes") & (F.col("before") <= 0)).select(*links.columns)

    payload = F.struct(*[c for c in links.columns if c != "ref"])
    same = close.where("changes").select("ref", "minute", F.col("at").cast("timestamp_ntz").alias("t"), F.lit(0).alias("delta"), "before", payload.alias("link"))
    within = Window.partitionBy("ref", "minute").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = same.unionByName(
        minutes.select("ref", "minute", F.col("t").cast("timestamp_ntz").alias("t"), "delta", F.lit(None).cast("bigint").alias("before"), F.lit(None).cast(same.schema["link"].dataType).alias("link"))
    )
    counted = both.withColumn("so_far", F.sum("delta").over(within)).where(F.col("link").isNotNull() & (F.col("before") + F.col("so_far") <= 0))
    return plain.unionByName(settled).unionByName(counted.select("ref", "link.*").select(*links.columns))


def _so_far(asked: DataFrame, deltas: DataFrame, within: list[str], unit: str) -> DataFrame:
    """``before`` raised by the net change of each link's id in the units before its own, and whether its own unit ``changes`` it.

    A link meets one row per id (and coarser unit), whose array has one entry per unit with a change.
    """
    net = deltas.groupBy("ref", *within, unit).agg(F.sum("delta").alias("net"))
    per = net.groupBy("ref", *within).agg(F.collect_list(F.struct(F.col(unit).alias("u"), "net")).alias("units"))
    met = asked.join(per, ["ref", *within], "left")
    before = F.aggregate(F.filter("units", lambda x: x["u"] < F.col(unit)), F.lit(0).cast("bigint"), lambda s, x: s + x["net"])
    return met.withColumns({
        "before": F.col("before") + F.coalesce(before, F.lit(0)),
        "changes": F.coalesce(F.exists("units", lambda x: x["u"] == F.col(unit)), F.lit(False)),
        "ever": F.col("ever") | F.col("units").isNotNull(),
    }).drop("units")


def cascade(links: DataFrame, direct: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """All orphaned links with ``kind`` direct or inherited and the round that found them.

    Only records that others can refer to (those with an own_id) carry the cascade on, so the rounds
    run over their links alone; all other links are met once, by the ids that the fixpoint ends with.
    ``max_rounds`` only guards against endless loops; every round orphans at least one more id, and
    a loop that reached it raises instead of returning less.
    """
    found = spill_table(direct.distinct().withColumns({"kind": F.lit("direct"), "depth": F.lit(0)}), "orphans")
    inner = spill_table(links.where(F.col("own_id").isNotNull()).select("ref", "own_id").distinct(), "orphan-links")
    frontier = spill_table(found.where(F.col("own_id").isNotNull()).select(F.col("own_id").alias("ref")).distinct(), "orphan-ids")
    levels = [frontier.withColumn("depth", F.lit(0))]
    for depth in range(1, max_rounds + 1):
        if frontier.isEmpty():
            break
        fresh = inner.join(frontier, "ref", "left_semi").select(F.col("own_id").alias("ref")).distinct()
        known = reduce(DataFrame.unionByName, (level.select("ref") for level in levels))
        frontier = spill_table(fresh.join(known, "ref", "left_anti"), "orphan-ids")
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    else:
        raise RuntimeError(f"the cascade did not end within {max_rounds} rounds")
    reached = links.join(reduce(DataFrame.unionByName, levels), "ref").select(*direct.columns, F.lit("inherited").alias("kind"), (F.col("depth") + 1).alias("depth")).distinct()
    # a link may name an orphaned id and be a direct orphan itself: it stays direct
    reached = reached.join(found.select("tbl", "record", "endpoint", "ref"), ["tbl", "record", "endpoint", "ref"], "left_anti")
    return found.unionByName(reached.select(*found.columns))


def report(orphans: DataFrame) -> DataFrame:
    """Orphaned references per table, endpoint, month and kind."""
    return (
        orphans.select("tbl", "record", "endpoint", "ref", "kind", F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
        .groupBy("tbl", "endpoint", "period", "kind")
        .agg(F.count("*").alias("n_refs"))
    )
