"""Reachability, depths, paths, cycles and components by iterated joins.

Loops run over dense numbers instead of ids, and keep their state in tables of the shared folder, so
that a step neither recomputes nor re-reads earlier steps.  Reachability walks from 63 seeds at once:
a row holds a node and the set of seeds that reach it as bits of one number, so a step costs at most
one row per node and 63 seeds.  Strongly connected components come from trimming ends, one forward
and backward walk for the component that holds the most linked node, and colours for what is left.
Every loop ends by itself; none stops at a number of rounds.  Only simple paths and cycles are
bounded in length, by the caller, since their number isn't.

Cases: empty links give empty results; repeated links count once; a link of a node to itself is a
cycle of length one; null ends are no links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spill_counted, spill_table

#: Seeds that share one row.
BITS = 63
#: Steps between two tables that a loop writes.
HOPS = 4


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n) and (s, t): a number for each node, and the links as numbers."""
    pairs = spill_table(links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ids = spill_table(ends.withColumn("n", F.monotonically_increasing_id()), "ids")
    step = pairs.join(ids.select(F.col("node").alias("src"), F.col("n").alias("s")), "src").join(ids.select(F.col("node").alias("dst"), F.col("n").alias("t")), "dst")
    return ids, spill_table(step.select("s", "t"), "steps")


def _walk(step: DataFrame, start: DataFrame) -> DataFrame | None:
    """(g, n, mask, depth): bits that newly reach a node in each step, from depth 1; start: (g, n, mask).

    step: (s, t), or (g, s, t) where each g has links of its own.
    """
    near = step.withColumnRenamed("s", "n")
    keys = [c for c in near.columns if c != "t"]
    zero = F.lit(0).cast("bigint")
    news = [f"new{i}" for i in range(HOPS)]
    front, state, levels, depth = start, start.limit(0).select("g", "n", "mask"), [], 0
    while True:
        # a node reached before leads to nothing new, so steps between two tables need not leave it out
        parts = [state.select("g", "n", F.col("mask").alias("old"), *(zero.alias(c) for c in news))]
        for i in range(HOPS):
            front = front.join(near, keys).groupBy("g", F.col("t").alias("n")).agg(F.bit_or("mask").alias("mask"))
            parts.append(front.select("g", "n", zero.alias("old"), *((F.col("mask") if k == i else zero).alias(c) for k, c in enumerate(news))))
        both = reduce(DataFrame.unionByName, parts).groupBy("g", "n").agg(*(F.bit_or(c).alias(c) for c in ("old", *news)))
        seen, fresh = F.col("old"), []
        for i, c in enumerate(news):
            fresh.append(F.struct(F.lit(depth + i + 1).alias("depth"), F.col(c).bitwiseAND(F.bitwise_not(seen)).alias("mask")))
            seen = seen.bitwiseOR(F.col(c))
        both = both.select("g", "n", seen.alias("mask"), F.filter(F.array(*fresh), lambda x: x["mask"] != 0).alias("fresh"))
        state, n = spill_counted(both, "reached", F.size("fresh") > 0)
        if not n:
            break
        level = state.where(F.size("fresh") > 0).select("g", "n", F.inline("fresh")).select("g", "n", "mask", "depth")
        levels.append(level)
        depth += HOPS
        front = level.where(F.col("depth") == depth).select("g", "n", "mask")
    return reduce(DataFrame.unionByName, levels) if levels else None


def reachable(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth): all that each seed reaches, at its least depth; a seed only if it lies on a cycle.

    links: (src, dst); seeds: (seed).
    """
    ids, step = _numbered(links)
    asked = seeds.select("seed").distinct().join(ids.withColumnRenamed("node", "seed"), "seed").withColumn("i", F.monotonically_increasing_id())
    asked = spill_table(asked.select("seed", "n", F.floor(F.col("i") / BITS).cast("bigint").alias("g"), (F.col("i") % BITS).cast("int").alias("bit")), "seeds")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    found = _walk(step, asked.groupBy("g", "n").agg(F.bit_or(one).alias("mask")))
    if found is None:
        return asked.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).limit(0)
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1)
    flat = found.select("g", "n", "depth", F.explode(bits).alias("bit"))
    return flat.join(asked.select("g", "bit", "seed"), ["g", "bit"]).join(ids, "n").select("seed", "node", "depth")


def paths(links: DataFrame, source: str, target: str, max_length: int) -> DataFrame:
    """(path, length): simple paths from source to target of at most so many steps."""
    step = links.select("src", "dst").distinct()
    walk = step.where(F.col("src") == source).select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    found = None
    for length in range(1, max_length + 1):
        done = walk.where(F.col("end") == target).select("path", F.lit(length).alias("length"))
        found = done if found is None else found.unionByName(done)
        if length < max_length:
            on = walk.where(F.col("end") != target).join(step, F.col("end") == step["src"])
            walk = on.where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("end"))
    return found


def _trimmed(rest: DataFrame) -> DataFrame | None:
    """Links (s, t) of which either end has a link onwards, None without any: the others lie on no cycle."""
    n = None
    while n != 0:
        for _ in range(HOPS // 2):
            both = rest.select(F.explode(F.array(F.struct(F.col("s").alias("n"), F.lit(1).alias("o")), F.struct(F.col("t").alias("n"), F.lit(2).alias("o")))).alias("e"))
            inner = both.groupBy("e.n").agg(F.bit_or("e.o").alias("o")).where("o = 3")
            rest = rest.join(inner.select(F.col("n").alias("s")), "s", "left_semi").join(inner.select(F.col("n").alias("t")), "t", "left_semi").select("s", "t")
        (rest, left), before = spill_counted(rest, "trimmed", F.lit(True)), n
        if left == before:
            return rest
        n = left
    return None


def _both_ways(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(n) that reach the root and are reached by it; roots: (n, label), one row."""
    ways = links.select(F.lit(0).cast("bigint").alias("g"), "s", "t").unionByName(links.select(F.lit(1).cast("bigint").alias("g"), F.col("t").alias("s"), F.col("s").alias("t")))
    begin = roots.select(F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("g"), "n", F.lit(1).cast("bigint").alias("mask"))
    walked = _walk(ways, begin)
    every = begin.select("g", "n") if walked is None else begin.select("g", "n").unionByName(walked.select("g", "n")).distinct()
    return every.groupBy("n").agg(F.count("*").alias("k")).where("k = 2").select("n")


def _coloured(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, t) within colours, and (n, label) of what reaches the node that gave its colour, within it."""
    colour = spill_table(links.select(F.explode(F.array("s", "t")).alias("n")).distinct().withColumn("c", F.col("n")), "colours")
    changed = 1
    while changed:  # the smallest number runs along the links
        near = links.join(colour, links["s"] == colour["n"]).groupBy("t").agg(F.min("c").alias("m"))
        both = colour.join(near, colour["n"] == near["t"], "left").select("n", F.least("c", F.coalesce("m", "c")).alias("new"), "c")
        after, changed = spill_counted(both, "colours", F.col("new") != F.col("c"))
        colour = after.select("n", F.col("new").alias("c"))
    inside = links.join(colour.withColumnRenamed("n", "s"), "s").join(colour.select(F.col("n").alias("t"), F.col("c").alias("at")), "t").where("c = at")
    inside = spill_table(inside.select("s", "t"), "inside")
    begin = colour.where("n = c").select(F.lit(0).cast("bigint").alias("g"), "n", F.lit(1).cast("bigint").alias("mask"))
    back = _walk(inside.select(F.col("t").alias("s"), F.col("s").alias("t")), begin)
    part = begin.select("n") if back is None else begin.select("n").unionByName(back.select("n")).distinct()
    return inside, part.join(colour.withColumnRenamed("c", "label"), "n")


def _labels(step: DataFrame) -> DataFrame:
    """(n, label) of the nodes on cycles; label is a number of one node of the component."""
    looped = step.where("s = t").select(F.col("s").alias("n"), F.col("s").alias("label"))
    rest, found = step.where("s <> t"), []
    rest = None if rest.isEmpty() else rest
    while rest is not None:
        if not found:
            # the most linked node most likely lies in the largest component
            ends = rest.select(F.col("s").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(rest.select(F.col("t").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))
            much = ends.groupBy("n").agg((F.sum("o").cast("double") * F.sum("i")).alias("w"))
            root = spill_table(much.agg(F.max_by("n", F.struct("w", "n")).alias("n")), "root")
            part = _both_ways(rest, root).crossJoin(F.broadcast(root.select(F.col("n").alias("label"))))
        else:
            rest, part = _coloured(rest)
        part = spill_table(part.select("n", "label"), "components")
        found.append(part)
        done = part.select("n")
        rest = _trimmed(rest.join(done.withColumnRenamed("n", "s"), "s", "left_anti").join(done.withColumnRenamed("n", "t"), "t", "left_anti").select("s", "t"))
    if not found:
        return looped
    every = reduce(DataFrame.unionByName, found)
    # a root alone is its own component: it lies on a cycle only if a link leads to itself
    several = every.groupBy("label").agg(F.count("*").alias("k")).where("k > 1").select("label")
    ring = every.join(several, "label", "left_semi").select("n", "label")
    return ring.unionByName(looped.join(ring, "n", "left_anti").select("n", "label"))


def strong_components(links: DataFrame) -> DataFrame:
    """(node, label) of nodes that reach themselves; label is the smallest node of their strongly connected component."""
    ids, step = _numbered(links)
    return _named(ids, spill_table(_labels(step), "labels"))


def _named(ids: DataFrame, labels: DataFrame) -> DataFrame:
    member = labels.join(ids, "n").select("node", "label")
    least = member.groupBy("label").agg(F.min("node").alias("first"))
    return member.join(least, "label").select("node", F.col("first").alias("label"))


def on_cycles(links: DataFrame) -> DataFrame:
    """(node) of nodes that reach themselves."""
    return strong_components(links).select("node").distinct()


def cycles(links: DataFrame) -> DataFrame:
    """(label, n_nodes, length, severity) of each component of nodes that reach each other.

    All simple cycles of a component are too many to list; ``length`` is that of the shortest one
    through its smallest node.
    """
    ids, step = _numbered(links)
    labels = spill_table(_labels(step), "labels")
    inside = step.join(labels.withColumnsRenamed({"n": "s", "label": "a"}), "s").join(labels.withColumnsRenamed({"n": "t", "label": "b"}), "t").where("a = b")
    inside = spill_table(inside.select("s", "t"), "inside")
    named = spill_table(_named(ids, labels), "named")
    # components are apart, so one bit serves all of them
    roots = named.where("node = label").join(ids, "node").select(F.lit(0).cast("bigint").alias("g"), "n", F.lit(1).cast("bigint").alias("mask"))
    roots = spill_table(roots, "roots")
    sizes = named.groupBy("label").agg(F.count("*").alias("n_nodes"))
    walked = _walk(inside, roots)
    if walked is None:
        return sizes.select("label", "n_nodes", F.lit(0).alias("length"), F.lit("info").alias("severity")).limit(0)
    length = walked.join(roots.select("n"), "n", "left_semi").join(ids, "n").select(F.col("node").alias("label"), F.col("depth").alias("length"))
    severity = F.when(F.col("length") == 2, "critical").when(F.col("length") <= 4, "warning").otherwise("info")
    return sizes.join(length, "label").select("label", "n_nodes", "length", severity.alias("severity"))


def mutual(links: DataFrame) -> DataFrame:
    """(a, b): nodes that link to each other directly, the smaller first."""
    e = links.select("src", "dst").where("src <> dst").distinct()
    ways = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    return ways.where("n = 2").select("a", "b")


def depths(links: DataFrame) -> DataFrame:
    """(node, depth): steps of the longest path from each node to one without links onwards.

    Nodes that reach each other count as one, as the longest simple path among them is not computable
    in reasonable time: steps between them are not counted.  A node that reaches no end at all gets
    the number of other nodes that it reaches; an end itself has depth 0.
    """
    ids, step = _numbered(links)
    labels = spill_table(_labels(step), "labels")
    of = ids.select("n").join(labels, "n", "left").select("n", F.coalesce("label", "n").alias("c"))
    of = spill_table(of, "classes")
    dag = step.join(of.withColumnsRenamed({"n": "s", "c": "a"}), "s").join(of.withColumnsRenamed({"n": "t", "c": "b"}), "t").where("a <> b")
    dag = spill_table(dag.select(F.col("a").alias("s"), F.col("b").alias("t")).distinct(), "dag")
    ring = labels.select(F.col("label").alias("c")).distinct()
    ends = spill_table(of.select("c").distinct().join(dag.select(F.col("s").alias("c")).distinct(), "c", "left_anti").join(ring, "c", "left_anti"), "ends")
    # the classes from which a way of so many steps leads to an end; the longest counts
    levels, depth, n = [ends.select("c", F.lit(0).cast("bigint").alias("depth"))], 0, None
    front = ends
    while n != 0:
        parts = []
        for i in range(1, HOPS + 1):
            front = dag.join(front.withColumnRenamed("c", "t"), "t", "left_semi").select(F.col("s").alias("c")).distinct()
            parts.append(front.withColumn("depth", F.lit(depth + i).cast("bigint")))
        table, n = spill_counted(reduce(DataFrame.unionByName, parts), "levels", F.lit(True))
        levels.append(table)
        depth += HOPS
        front = table.where(F.col("depth") == depth).select("c")
    levels = [spill_table(reduce(DataFrame.unionByName, levels).groupBy("c").agg(F.max("depth").alias("depth")), "far")]
    # classes without an end: their number of other nodes
    endless = spill_table(of.select("c").distinct().join(levels[0], "c", "left_anti"), "endless")
    if not endless.isEmpty():
        sizes = of.join(endless, "c", "left_semi").groupBy("c").agg(F.count("*").alias("k"))
        below = reachable(dag.join(endless.withColumnRenamed("c", "s"), "s", "left_semi").select(F.col("s").alias("src"), F.col("t").alias("dst")), endless.select(F.col("c").alias("seed")))
        more = below.join(sizes.select(F.col("c").alias("node"), "k"), "node").groupBy("seed").agg(F.sum("k").alias("more"))
        counted = sizes.join(more.withColumnRenamed("seed", "c"), "c", "left").select("c", (F.col("k") - 1 + F.coalesce("more", F.lit(0))).cast("bigint").alias("depth"))
        levels.append(counted)
    return of.join(reduce(DataFrame.unionByName, levels), "c").join(ids, "n").select("node", "depth")


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component.

    Labels run along the pairs and then halve their way by pointing to their label's label, so that
    rounds grow with the logarithm of the diameter.  pairs: (a, b); nodes: (node).
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = cut(nodes.select("node", F.col("node").alias("label")).distinct())
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        jump = least.select(F.col("node").alias("new"), F.col("new").alias("next"))
        after = cut(least.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new")))
        if after.where("new <> label").isEmpty():
            return after.select("node", F.col("new").alias("label"))
        labels = after.select("node", F.col("new").alias("label"))


def degrees(links: DataFrame) -> DataFrame:
    """(node, n_in, n_out); links: (src, dst)."""
    ends = links.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        links.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
