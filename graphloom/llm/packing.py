"""Filling containers of fixed capacity (problem 9).

Hierarchical residual packing.  Each partition packs its items best-fit in decreasing order and
keeps its bins as final where they are nearly full.  The other bins become items of the next round,
which has fewer partitions and packs them again; so on until one round over the residue changes
nothing more or its partitions would outgrow ``ROWS`` rows each.  The residue of a partition is
small, since small items fill the gaps of large ones; where it is not (all items just over half the
capacity, say), the partitions of the last rounds stay bounded and nothing is collected.

Items larger than the capacity are divided into full containers and a rest; no other item is.
Items of size 0 (null and empty texts) are packed as any other, so that each text is assigned.
Repeated rows are items of their own; extra columns are not read; empty tables give no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import spill_table

#: Most rows of one partition in the rounds after the first, and how many partitions become one.
ROWS = 200_000
FAN_IN = 8
#: A bin with at most this share of its capacity free is final.
SLACK = 0.01


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, best-fit over decreasing sizes."""
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    place = [0] * len(sizes)
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, bin_ = free.pop(at)
        else:
            room, bin_ = capacity, n
            n += 1
        place[i] = bin_
        if room - sizes[i] > 0:
            insort(free, (room - sizes[i], bin_))
    return place


def _packer(capacity: int, level: int):
    def run(frames: Iterator):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        frames = list(frames)
        rows = pd.concat(frames) if frames else pd.DataFrame()
        if not len(rows):
            return
        part = TaskContext.get().partitionId()
        place = np.array(best_fit(rows["size"].tolist(), capacity), dtype=np.int64)
        load = np.bincount(place, weights=rows["size"].to_numpy()).astype(np.int64)
        # level, partition and bin make the id unique: 7, 24 and 32 bits
        rows["bin"] = (np.int64(level) << 56) | (np.int64(part) << 32) | place
        rows["load"] = load[place]
        yield rows

    return run


def split_sizes(items: DataFrame, capacity: int, key: str, size: str) -> DataFrame:
    """(key, piece, size): items above the capacity in full pieces and a rest."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(capacity))).cast("int")
    piece = F.explode(F.sequence(F.lit(0), n - 1))
    flat = items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).alias("_n"), piece.alias("piece"))
    return flat.select(key, "piece", F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, n_tokens, container_id) with every piece of every item exactly once."""
    spark = items.sparkSession
    pieces = split_sizes(items, capacity, key, size)
    kind = pieces.schema[key].dataType.simpleString()
    first = spill_table(
        pieces.mapInPandas(_packer(capacity, 0), f"{key} {kind}, piece int, size int, bin bigint, load bigint"), "packed"
    )
    nearly = int(capacity * (1 - SLACK))

    def underfull(packed: DataFrame) -> DataFrame:
        few = packed.where(F.col("load") < nearly).groupBy("bin").agg(F.first("load").cast("int").alias("size"))
        return spill_table(few, "residue")

    bins, links, level = underfull(first), None, 0
    n, parts = bins.agg(F.count("*"), F.max(F.shiftright("bin", 32).bitwiseAND(F.lit(0xFFFFFF)))).first()
    parts = (parts or 0) + 1
    while n:
        level += 1
        before, parts = parts, max(-(-parts // FAN_IN), -(-n // ROWS))
        step = bins.select(F.col("bin").alias("item"), "size").repartition(parts, "item")
        step = spill_table(step.mapInPandas(_packer(capacity, level), "item bigint, size int, bin bigint, load bigint"), "merged")
        hop = step.select(F.col("item").alias("bin"), F.col("bin").alias("next"))
        # a residue follows its bin from round to round: links lead to the bin it ended in
        if links is None:
            links = hop
        else:
            moved = links.join(hop.select(F.col("bin").alias("next"), F.col("next").alias("last")), "next", "left")
            links = spill_table(moved.select("bin", F.coalesce("last", "next").alias("next")), "links")
        if parts == 1 or parts >= before:
            break
        bins = underfull(step)
        n = bins.count()
    out = first if links is None else first.join(links, "bin", "left").withColumn("bin", F.coalesce("next", "bin"))
    return out.select(key, "piece", F.col("size").alias("n_tokens"), F.col("bin").alias("container_id"))
