"""Exact search and similarity joins over vectors.

Search compares a stated set of queries with all rows in a grid of blocks, each a matrix product, and
keeps the best of each block before anything is shuffled again.

The join by a least cosine is exact and compares no pair that can't match.  Pivots split the sphere
into cells; a row is kept in the cell of its nearest pivot and is looked up in each cell whose pivot
is no farther than its own pivot plus twice the angle of the threshold, which by the triangle
inequality of angles is every cell that can hold a match.  Crowded cells are cut into blocks; no row
is left out.  A block gives one row per class instead of its links.  Exact copies are one class, so copies are never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .traversal import components

BLOCK = 2048
PIVOTS = 64


def usable(df: DataFrame, key: str, vec: str, dims: int = 64, order: str | None = None) -> DataFrame:
    """(id, v): of each id the latest vector, by ``order`` and then by its numbers, if it is finite, of the right length and not all zero."""
    e = F.col("v")
    good = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    at = F.col(order) if order else F.lit(0)
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"), at.alias("at"))
    return rows.groupBy("id").agg(F.max_by("v", F.struct("at", "v")).alias("v")).where(good)


def unit(v):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def _stack(column):
    import numpy as np

    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit_rows(x):
    import numpy as np

    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _block_search(k: int, grouped: bool):
    def run(table):
        import numpy as np
        import pyarrow as pa

        asked = table.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = table.column("id").to_numpy(), _unit_rows(_stack(table.column("v")))
        q, c = np.flatnonzero(asked), np.flatnonzero(~asked)
        out = []
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            s = np.round(x[part] @ x[c].T, 10)
            s[ids[part][:, None] == ids[c][None, :]] = -3
            if grouped:
                g = table.column("g").to_numpy()
                s[g[part][:, None] == g[c][None, :]] = -3
            order = np.lexsort((np.broadcast_to(ids[c], s.shape), -s), axis=1)[:, :k]
            best = np.take_along_axis(s, order, 1)
            keep = best > -3
            out.append((np.repeat(ids[part], keep.sum(axis=1)), ids[c][order][keep], best[keep]))
        a, b, r = (np.concatenate(z) if out else np.zeros(0) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"query_id": pa.array(a, pa.int64()), "other_id": pa.array(b, pa.int64()), "similarity": pa.array(r, pa.float64())})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, other_group: str | None = None) -> DataFrame:
    """(query_id, other_id, similarity, rank): the k nearest others of each query, ties to the smaller id.

    With ``other_group``, a bigint column of both, only rows of other groups count.
    """
    n, nq = vectors.count(), queries.count()
    rows, cols = max(1, -(-nq // BLOCK)), max(1, -(-n // (4 * BLOCK)))
    h = F.xxhash64("id")
    group = [F.col(other_group).alias("g")] if other_group else []
    q = queries.select("id", "v", *group, F.lit(True).alias("asked"), F.pmod(h, F.lit(rows)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j"))
    c = vectors.select("id", "v", *group, F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), F.pmod(h, F.lit(cols)).cast("int").alias("j"))
    best = q.unionByName(c).groupBy("i", "j").applyInArrow(_block_search(k, bool(group)), "query_id bigint, other_id bigint, similarity double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "other_id")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _cells(pivots, theta: float):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit_rows(_stack(pa.chunked_array([batch.column(1)])))
            angle = np.arccos(np.clip(x @ pivots.T, -1, 1))
            home = angle.argmin(axis=1)
            near = angle <= angle.min(axis=1)[:, None] + 2 * theta + 1e-9
            near[np.arange(len(x)), home] = False
            row, cell = np.nonzero(near)
            take = np.concatenate([np.arange(len(x)), row])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)), pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.arange(len(take)) < len(x))],
                ["id", "v", "cell", "home"],
            )

    return run


def _roots_in_block(least: float, cells: bool = False):
    """(id, root, n): for each row with a link in the block, the smallest row it is connected with there, and its links.

    With cells, links count for the rows on the left only, each of which meets all others once.
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = table.column("id").to_numpy(), _unit_rows(_stack(table.column("v")))
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        own = not cells and table.column("i")[0] == table.column("j")[0]  # a block with itself
        b = a if own else b
        names, where = np.unique(ids, return_inverse=True)
        root, n = np.arange(len(names)), np.zeros(len(names), np.int64)
        for lo in range(0, len(a), 512):
            part = a[lo : lo + 512]
            s = x[part] @ x[b].T
            i, j = np.nonzero(s >= least - 1e-9)
            good = np.round(s[i, j], 10) >= least
            p, q = where[part[i[good]]], where[b[j[good]]]
            p, q = p[p != q], q[p != q]
            n += np.bincount(p, minlength=len(n))
            if not own and not cells:
                n += np.bincount(q, minlength=len(n))
            while True:
                m = np.minimum(root[p], root[q])
                new = root.copy()
                np.minimum.at(new, root[p], m)
                np.minimum.at(new, root[q], m)
                new = new[new]
                if (new == root).all():
                    break
                root = new
        while (root[root] != root).any():
            root = root[root]
        k = np.flatnonzero((n > 0) | (root != np.arange(len(names))))
        return pa.table({"id": pa.array(names[k], pa.int64()), "root": pa.array(names[root[k]], pa.int64()), "n": pa.array(n[k], pa.int64())})

    return run


def celled_classes(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As linked_classes, for thresholds at which cells rule out most pairs."""
    import numpy as np

    theta = math.acos(max(-1.0, min(1.0, least)))
    reps = cut(vectors.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    members = vectors.join(reps.withColumnRenamed("id", "rep"), "v").select("id", "rep")
    # a bounded sample only chooses the pivots; every row is placed and looked up
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").toPandas()["v"]
    if not len(sample):
        return reps.select(F.col("id").alias("a"), F.col("id").alias("b")), members, reps.select(F.col("id").alias("rep"), F.lit(0).cast("bigint").alias("n_links"))
    pivots = _unit_rows(np.array(sample.tolist(), dtype=np.float64))
    placed = cut(reps.mapInArrow(_cells(pivots, theta), "id bigint, v array<double>, cell int, home boolean"))
    n = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sized = placed.join(F.broadcast(n), "cell")  # as many rows as pivots
    block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = sized.where("home").select("cell", "id", "v", F.lit(True).alias("left"), block.alias("i"), every.alias("j"))
    right = sized.select("cell", "id", "v", F.lit(False).alias("left"), every.alias("i"), block.alias("j"))
    found = cut(left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(_roots_in_block(least, True), "id bigint, root bigint, n bigint"))
    return _joined(found, members)


def _joined(found: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = found.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()
    return pairs, members, found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n_links"))


def linked_classes(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) that connect the same classes as all links of at least so much do, members (id, rep)
    and links per class (rep, n_links).

    For thresholds at which cells rule nothing out: each pair is compared once, in a grid of blocks, and
    a block gives one row per class instead of its links.
    """
    reps = cut(vectors.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    members = vectors.join(reps.withColumnRenamed("id", "rep"), "v").select("id", "rep")
    parts = max(1, -(-reps.count() // (4 * BLOCK)))
    block = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("o")
    each = reps.select("id", "v", block.alias("p"), other)
    sides = each.select("id", "v", (F.col("p") <= F.col("o")).alias("left"), F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))
    found = cut(sides.groupBy("i", "j").applyInArrow(_roots_in_block(least), "id bigint, root bigint, n bigint"))
    return _joined(found, members)


def clusters(vectors: DataFrame, least: float) -> DataFrame:
    """(id, label, n_links) of each vector: density clusters with two points at least, label null if alone.

    With two points enough, each vector with a link is a core point, and clusters are the connected
    components of the links.  n_links counts links to other classes of copies.
    """
    wide = 2 * math.acos(max(-1.0, min(1.0, least))) > math.pi / 2
    pairs, members, ends = linked_classes(vectors, least) if wide else celled_classes(vectors, least)
    reps = members.select(F.col("rep").alias("node")).distinct()
    label = components(pairs, reps)
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    each = members.join(size, "rep").join(ends, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep")
    alone = F.col("n_links").isNull() & (F.col("copies") == 1)
    return each.select("id", F.when(~alone, F.col("label")).alias("label"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def centroids(vectors: DataFrame, clustered: DataFrame) -> DataFrame:
    """(label, n, centroid, confidence) of each cluster: its mean unit vector, and the mean cosine of members to it."""
    flat = clustered.where("label IS NOT NULL").select("id", "label").join(vectors, "id").select("label", F.posexplode(unit(F.col("v"))).alias("i", "x"))
    mean = flat.groupBy("label", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    whole = mean.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centroid"))
    # the mean cosine of unit vectors to the direction of their mean is the length of the mean
    return whole.withColumn("confidence", F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)))


def cohesion(vectors: DataFrame) -> DataFrame:
    """(file, n, mean_similarity): the mean cosine of all pairs in a file, itself included.

    It equals the squared length of the mean unit vector, so no pair is formed; vectors: (file, v).
    """
    flat = vectors.select("file", F.posexplode(unit(F.col("v"))).alias("i", "x"))
    mean = flat.groupBy("file", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return mean.groupBy("file").agg(F.max("n").alias("n"), F.round(F.sum(F.col("m") * F.col("m")), 6).alias("mean_similarity"))
