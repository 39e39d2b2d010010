"""Most similar vectors for every vector (problem 5).

NN-descent.  A graph with the K best neighbours known so far of each vector starts from blocks of
random hyperplane trees and is refined by joins of neighbours of neighbours: every vector is a
centre whose members are its neighbours and those that have it as a neighbour; members of a centre
are compared with each other, and each keeps what beats its worst neighbour.  Only pairs with an
edge that is new since the last round are compared.  Rounds end when few edges change.

The descent compares vectors scaled to 16-bit integers in double precision, in which their products
are exact: near copies that differ by a ten-thousandth of their length are still told apart.  The
lists it ends with are ranked by the cosine of the given numbers in double precision, rounded to ten
decimals, ties to the smaller id.

Exact copies form one class and take part once, so a vector with very many copies costs one; the
smallest ids of a class stand in the lists for all of it.  The trees' planes are fitted on a sample
of at most SAMPLE vectors, which grows with their number up to there; every vector is indexed.  Leaves that outgrow a block are cut into
blocks, centres with very many members into parts; no member is left out.

Cases: vectors that are null, of another length, all zero or not finite take no part.  Of records
with the same id the latest counts.  With fewer vectors than neighbours asked for, all others are
neighbours.  Empty tables give empty results.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import spill_table

K = 32
TREES = 8
SAMPLE = 200_000
#: Vectors of the sample that a leaf of a tree is fitted on.
FITTED = 16
BLOCK = 1024
PART = 96
#: Best candidates that each member of a centre keeps of it.
OFFERS = 12
MAX_ROUNDS = 6
#: The descent ends when among the first LOOKED of each list fewer edges than this share of the vectors are new.
FEW, LOOKED = 0.03, 12

#: Search: width of a beam, nodes expanded per round, nodes that walks start from, most rounds.
BEAM = 48
EXPANDED = 6
ENTRIES = 8192
MAX_STEPS = 40

NEIGHBOURS = "array<struct<s:double,b:bigint,f:boolean>>"


def usable(embeddings: DataFrame, dims: int = 64) -> DataFrame:
    """(id, raw): the latest usable vector of each id as bytes of 32-bit numbers."""
    e = F.col("embedding")
    good = (
        (F.size(e) == dims)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(e, lambda x: x != 0)
    )
    rows = embeddings.where(F.col("embedding_id").isNotNull() & e.isNotNull()).select(
        F.col("embedding_id").cast("bigint").alias("id"), "computed_at", e.cast("array<float>").alias("embedding")
    )
    latest = rows.groupBy("id").agg(F.max_by("embedding", F.struct("computed_at", "embedding")).alias("embedding"))
    return latest.where(good).mapInArrow(_pack, "id bigint, raw binary")


def _pack(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        if n:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1) + np.float32(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(flat)], ["id", "raw"])


def _binary(rows):
    """A column of binaries from the rows of a matrix."""
    import numpy as np
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column, dtype):
    """The rows of a column of binaries."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def _quantise(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1), np.float32).astype(np.float64)
            q = np.rint(x / np.abs(x).max(axis=1)[:, None] * 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(q)], ["id", "q"])


def _similarities(q):
    """Cosines of small integers: exact products, hence the same wherever two rows meet."""
    import numpy as np

    x = q.astype(np.float64)
    dots = x @ x.T
    lengths = np.sqrt(np.diag(dots).copy())
    sims = dots / (lengths[:, None] * lengths[None, :])
    np.fill_diagonal(sims, -2.0)
    return sims


# the first graph


def fit_trees(sample, leaves: int, trees: int = TREES, seed: int = 11) -> list:
    """Hyperplane trees over a sample: (planes, cuts, children) with children below 0 for leaves."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    out = []
    for _ in range(trees):
        planes, cuts, children, n_leaves = [], [], [], 0
        stack = [(np.arange(len(x)), 0, -1, 0)]
        while stack:
            rows, level, parent, side = stack.pop()
            split = None
            if level < depth and len(rows) >= 8:
                a, b = rng.choice(rows, 2, replace=False)
                plane = x[a] - x[b]
                p = x[rows] @ plane
                cut = np.float32(np.median(p))
                low, high = rows[p <= cut], rows[p > cut]
                if len(low) and len(high):
                    split = (plane, cut, low, high)
            if split is None:
                n_leaves += 1
                number = -n_leaves
            else:
                number = len(planes)
                planes.append(split[0])
                cuts.append(split[1])
                children.append([0, 0])
                stack += [(split[2], level + 1, number, 0), (split[3], level + 1, number, 1)]
            if parent >= 0:
                children[parent][side] = number
        out.append((np.array(planes, np.float32).reshape(len(planes), x.shape[1]), np.array(cuts, np.float32), np.array(children, np.int64).reshape(-1, 2)))
    return out


def _leaves(trees: list):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), np.int16).astype(np.float32)
            x /= np.linalg.norm(x, axis=1)[:, None]
            for t, (planes, cuts, children) in enumerate(trees):
                at = np.zeros(len(x), np.int64) if len(planes) else np.full(len(x), -1)
                while (live := np.flatnonzero(at >= 0)).size:
                    node = at[live]
                    high = np.einsum("ij,ij->i", x[live], planes[node]) > cuts[node]
                    at[live] = children[node, high.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(-at + (t << 32), pa.int64())], ["id", "q", "leaf"]
                )

    return run


def _groups(batches: Iterator, key_columns: int) -> Iterator:
    """Whole groups out of batches sorted by their first columns: (boundaries, batch) with only full groups."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        keys = np.stack([table.column(i).to_numpy() for i in range(key_columns)])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if not len(change):
            held = table
            continue
        last = int(change[-1])
        yield np.concatenate([[0], change]), table.slice(0, last)
        held = table.slice(last)
    if held is not None and held.num_rows:
        table = held.combine_chunks()
        keys = np.stack([table.column(i).to_numpy() for i in range(key_columns)])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        yield np.concatenate([[0], change, [table.num_rows]]), table


def _best(sims, k: int):
    import numpy as np

    k = min(k, sims.shape[1] - 1)
    if k < 1:
        return np.zeros((len(sims), 0), np.int64)
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _top(a, b, s, k: int):
    """Rows of the k best b of each a, without repeats."""
    import numpy as np

    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s = a[new], b[new], s[new]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    keep = np.arange(len(a)) - begin < k
    return a[keep], b[keep], s[keep]


def _edges(a, b, s):
    import numpy as np
    import pyarrow as pa

    if not a:
        return None
    a, b, s = _top(np.concatenate(a), np.concatenate(b), np.concatenate(s), K)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["a", "b", "s"])


def _in_blocks(batches: Iterator) -> Iterator:
    import numpy as np

    for bounds, table in _groups(batches, 2):
        ids = table.column(2).to_numpy()
        q = _matrix(table.column(3).combine_chunks(), np.int16)
        out_a, out_b, out_s = [], [], []
        for lo, hi in zip(bounds, [*bounds[1:], table.num_rows]):
            if hi - lo > 1:
                sims = _similarities(q[lo:hi])
                best = _best(sims, K)
                own = ids[lo:hi]
                out_a.append(np.repeat(own, best.shape[1]))
                out_b.append(own[best].ravel())
                out_s.append(np.take_along_axis(sims, best, 1).ravel())
        if (found := _edges(out_a, out_b, out_s)) is not None:
            yield found


def _merged(edges: DataFrame) -> DataFrame:
    """(a, nbrs): the K best distinct neighbours of each a; of equal ones the old."""
    kept = F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("s"), "b", "f")))
    g = edges.groupBy("a").agg(kept.alias("n"))
    once = F.filter("n", lambda x, i: (i == 0) | (F.element_at("n", F.greatest(i, F.lit(1)))["b"] != x["b"]))
    best = F.transform(F.slice(once, 1, K), lambda x: F.struct((-x["s"]).alias("s"), x["b"].alias("b"), x["f"].alias("f")))
    return g.select("a", best.alias("nbrs"))


def first_graph(vectors: DataFrame, n: int) -> DataFrame:
    """(a, nbrs) from the blocks of the trees; vectors: (id, q)."""
    import numpy as np

    size = min(SAMPLE, max(20_000, FITTED * -(-n // BLOCK)))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(size).select("q").toPandas()["q"]
    if not len(sample):
        return vectors.select(F.col("id").alias("a"), F.array().cast(NEIGHBOURS).alias("nbrs")).limit(0)
    matrix = np.frombuffer(b"".join(bytes(x) for x in sample), dtype=np.int16).reshape(len(sample), -1)
    trees = fit_trees(matrix, min(-(-n // BLOCK), max(1, len(matrix) // FITTED)))
    placed = vectors.mapInArrow(_leaves(trees), "id bigint, q binary, leaf bigint")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    over = sizes.where(F.col("n") > 2 * BLOCK).select("leaf", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("parts"))
    # as many leaves as the trees have, which the sample bounds
    cut = placed.join(F.broadcast(over), "leaf", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64("id", "leaf"), F.col("parts")))
    )
    blocks = cut.repartition("leaf", "part").sortWithinPartitions("leaf", "part").select("leaf", "part", "id", "q")
    return _merged(blocks.mapInArrow(_in_blocks, "a bigint, b bigint, s double").withColumn("f", F.lit(True)))


# rounds


def _local_join(batches: Iterator) -> Iterator:
    """Compares the members of each centre; columns: centre, part, member, fresh, floor, q."""
    import numpy as np

    for bounds, table in _groups(batches, 2):
        ids = table.column(2).to_numpy()
        fresh = table.column(3).to_numpy(zero_copy_only=False)
        floor = table.column(4).to_numpy()
        q = _matrix(table.column(5).combine_chunks(), np.int16)
        out_a, out_b, out_s = [], [], []
        for lo, hi in zip(bounds, [*bounds[1:], table.num_rows]):
            if hi - lo < 2 or not fresh[lo:hi].any():
                continue
            own, first = np.unique(ids[lo:hi], return_index=True)
            if len(own) < 2:
                continue
            new = np.zeros(len(own), bool)
            new[np.searchsorted(own, ids[lo:hi][fresh[lo:hi]])] = True
            rows = lo + first
            sims = _similarities(q[rows])
            least = floor[rows]
            sims[~(new[:, None] | new[None, :])] = -2.0
            sims[sims <= least[:, None]] = -2.0
            best = _best(sims, OFFERS)
            s = np.take_along_axis(sims, best, 1)
            i, j = np.nonzero(s > -2.0)
            out_a.append(own[i])
            out_b.append(own[best[i, j]])
            out_s.append(s[i, j])
        if (found := _edges(out_a, out_b, out_s)) is not None:
            yield found


def descend(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """One round: (a, nbrs) with new edges fresh; graph: (a, nbrs)."""
    state = graph.join(vectors.withColumnRenamed("id", "a"), "a")
    floor = F.when(F.size("nbrs") < K, F.lit(-2.0)).otherwise(F.element_at("nbrs", -1)["s"])
    state = state.select("a", "q", floor.alias("floor"), "nbrs")
    edge = state.select("a", "q", "floor", F.explode("nbrs").alias("e"))
    back = edge.select(F.col("e.b").alias("centre"), F.col("a").alias("member"), F.col("e.f").alias("fresh"), "floor", "q")
    self_ = state.select(F.col("a").alias("centre"), F.col("a").alias("member"), F.lit(False).alias("fresh"), "floor", "q")
    ahead = edge.select(F.col("a").alias("centre"), F.col("e.b").alias("member"), F.col("e.f").alias("fresh"))
    ahead = ahead.join(state.select(F.col("a").alias("member"), "floor", "q"), "member").select("centre", "member", "fresh", "floor", "q")
    crowded = (
        graph.select(F.explode("nbrs.b").alias("centre")).groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") > PART)
        .select("centre", F.ceil(F.col("n") / PART).cast("bigint").alias("parts"))
    )
    back = back.join(crowded, "centre", "left").select(
        "centre", F.coalesce(F.pmod(F.xxhash64("member"), F.col("parts")), F.lit(0).cast("bigint")).alias("part"), "member", "fresh", "floor", "q"
    )
    near = ahead.unionByName(self_).join(crowded, "centre", "left")
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1).cast("bigint")) - 1)))
    members = back.unionByName(near.select(*back.columns))
    offers = members.repartition("centre", "part").sortWithinPartitions("centre", "part").mapInArrow(_local_join, "a bigint, b bigint, s double")
    old = graph.select("a", F.explode("nbrs").alias("e")).select("a", "e.b", "e.s", F.lit(False).alias("f"))
    return _merged(old.unionByName(offers.withColumn("f", F.lit(True))))


def neighbour_graph(vectors: DataFrame) -> DataFrame:
    """(a, nbrs) of all vectors (id, q)."""
    n = vectors.count()
    graph = spill_table(first_graph(vectors, n), "graph")
    for _ in range(MAX_ROUNDS):
        graph = spill_table(descend(graph, vectors), "graph")
        fresh = graph.select(F.sum(F.size(F.filter(F.slice("nbrs", 1, LOOKED), lambda x: x["f"])))).first()[0] or 0
        if fresh <= FEW * n:
            break
    return graph


# search


def _against(entries: list[tuple[int, bytes]]):
    """Cosines of each query with a few fixed entries."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids = np.array([i for i, _ in entries], np.int64)
        y = np.frombuffer(b"".join(q for _, q in entries), np.int16).reshape(len(entries), -1).astype(np.float32)
        y /= np.linalg.norm(y, axis=1)[:, None]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), np.int16).astype(np.float32)
                x /= np.linalg.norm(x, axis=1)[:, None]
                for lo in range(0, len(x), 512):
                    s = x[lo : lo + 512] @ y.T
                    k = min(BEAM, len(ids))
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    row = pa.array(np.repeat(np.arange(lo, lo + len(s)), k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel().astype(np.float64))], ["query", "b", "s"]
                    )

    return run


def _cosines(batches: Iterator) -> Iterator:
    """query, b and the cosine of their integer vectors."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            x, y = (_matrix(batch.column(i), np.int16).astype(np.float64) for i in (2, 3))
            s = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["query", "b", "s"])


def _beam(offers: DataFrame) -> DataFrame:
    """(query, beam): the best distinct nodes of each query; a node once visited stays so."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "b", (~F.col("seen")).alias("fresh"))))
    g = offers.groupBy("query", "b").agg(F.max("s").alias("s"), F.max("seen").alias("seen")).groupBy("query").agg(best.alias("l"))
    return g.select("query", F.slice("l", 1, BEAM).alias("beam"))


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, b, s): the nodes that a greedy search of the graph ends with, for vectors that need not be in it.

    All queries walk at once: each round expands the best nodes of every query's beam that have not
    been expanded, by a join with the graph.  A beam that holds no such node has ended; the number
    of rounds is that of the longest walk.  queries and vectors: (id, q).
    """
    asked = queries.select(F.col("id").alias("query"), F.col("q").alias("qq"))
    entries = [(r.id, bytes(r.q)) for r in vectors.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()]
    if not entries:
        return asked.select("query", F.col("query").alias("b"), F.lit(0.0).alias("s")).limit(0)
    first = asked.mapInArrow(_against(entries), "query bigint, b bigint, s double").withColumn("seen", F.lit(False))
    beams = spill_table(_beam(first), "beams")
    for _ in range(MAX_STEPS):
        flat = beams.select("query", F.inline("beam"))
        rank = Window.partitionBy("query").orderBy("s", "b")
        front = flat.where("fresh").withColumn("i", F.row_number().over(rank)).where(F.col("i") <= EXPANDED).select("query", "b")
        front = spill_table(front, "front")
        if front.isEmpty():
            break
        near = front.join(graph.select(F.col("a").alias("b"), "nbrs"), "b").select("query", F.explode("nbrs.b").alias("b")).distinct()
        near = near.join(flat.select("query", "b"), ["query", "b"], "left_anti")
        both = near.join(vectors.select(F.col("id").alias("b"), "q"), "b").join(asked, "query").select("query", "b", "qq", "q")
        offers = both.mapInArrow(_cosines, "query bigint, b bigint, s double").withColumn("seen", F.lit(False))
        held = flat.join(front.withColumn("now", F.lit(True)), ["query", "b"], "left").select("query", "b", (-F.col("s")).alias("s"), (~F.col("fresh") | F.coalesce("now", F.lit(False))).alias("seen"))
        beams = spill_table(_beam(held.unionByName(offers)), "beams")
    return beams.select("query", F.inline("beam")).select("query", "b", (-F.col("s")).alias("s"))


def searched(embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, other_id, rank): the k nearest others of each query, found by walking the graph.

    embeddings and queries: (embedding_id, embedding, computed_at).
    """
    raw = spill_table(usable(embeddings), "vectors")
    asked = spill_table(usable(queries), "queries")
    # classes of equal vectors, named by their smallest id; the graph holds one node of each
    reps = spill_table(raw.groupBy("raw").agg(F.min("id").alias("id")).select("id", "raw"), "classes")
    members = raw.join(reps.withColumnRenamed("id", "rep"), "raw").select("rep", "id")
    salted = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    first = members.withColumn("i", F.row_number().over(salted)).where(F.col("i") <= k + 1)
    first = first.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("i") <= k + 1).select("rep", "id")
    first = spill_table(first, "first")
    vectors = spill_table(reps.mapInArrow(_quantise, "id bigint, q binary"), "quantised")
    hits = search(neighbour_graph(vectors), vectors, asked.mapInArrow(_quantise, "id bigint, q binary"))
    # the class of the query itself counts, whether the walk met it or not
    own = asked.join(reps.withColumnRenamed("id", "b"), "raw").select(F.col("id").alias("a"), "b")
    hits = hits.select(F.col("query").alias("a"), "b").unionByName(own).distinct()
    far = hits.join(reps.select(F.col("id").alias("b"), "raw"), "b")
    both = far.join(asked.select(F.col("id").alias("a"), F.col("raw").alias("own")), "a").select("a", "b", "raw", "own")
    best = both.repartition("a").sortWithinPartitions("a").mapInArrow(_ranks(k + 1), "a bigint, b bigint, r double")
    # a class brings its smallest ids
    each = best.join(first.select(F.col("rep").alias("b"), F.col("id").alias("other")), "b").where("other <> a")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("r"), "other"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a").alias("query_id"), F.col("other").alias("other_id"), "rank")


# exact ranks


def _ranks(k: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for bounds, table in _groups(batches, 1):
            a, b = table.column(0).to_numpy(), table.column(1).to_numpy()
            x = _matrix(table.column(2).combine_chunks(), np.float32).astype(np.float64)
            own = table.column(3).combine_chunks().take(pa.array(bounds[bounds < table.num_rows]))
            y = np.repeat(_matrix(own, np.float32).astype(np.float64), np.diff([*bounds[bounds < table.num_rows], table.num_rows]), axis=0)
            r = np.round((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), 10)
            a, b, r = _top(a, b, r, k)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(r)], ["a", "b", "r"])

    return run


def ranked(graph: DataFrame, raw: DataFrame, k: int) -> DataFrame:
    """(a, b, r): the k best of each list by rounded cosine, then id."""
    pairs = graph.select("a", F.explode("nbrs.b").alias("b"))
    far = pairs.join(raw.select(F.col("id").alias("b"), "raw"), "b").select("a", "b", "raw")
    both = far.join(raw.select(F.col("id").alias("a"), F.col("raw").alias("own")), "a").select("a", "b", "raw", "own")
    return both.repartition("a").sortWithinPartitions("a").mapInArrow(_ranks(k), "a bigint, b bigint, r double")


def nearest(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """(id, other, r): the k most similar other vectors of each vector."""
    raw = spill_table(usable(embeddings), "vectors")
    # classes of equal vectors, named by their smallest id
    classes = raw.groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = spill_table(classes.select(F.col("rep").alias("id"), "raw", "n"), "classes")
    several = reps.where("n > 1").select(F.col("id").alias("rep"), "raw")
    copies = spill_table(raw.join(several, "raw").select("rep", "id"), "copies")
    salted = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    first = copies.withColumn("i", F.row_number().over(salted)).where(F.col("i") <= k + 1)
    first = first.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("i") <= k + 1).select("rep", "id")
    vectors = spill_table(reps.select("id", "raw").mapInArrow(_quantise, "id bigint, q binary"), "quantised")
    best = spill_table(ranked(neighbour_graph(vectors), reps, k), "ranked")
    # a class brings its smallest ids into the lists of others and into its own
    stand = best.join(first.select(F.col("rep").alias("b"), F.col("id").alias("c")), "b", "left").select("a", F.coalesce("c", "b").alias("other"), "r")
    own = first.select(F.col("rep").alias("a"), F.col("id").alias("other"), F.lit(1.0).alias("r"))
    lists = stand.unionByName(own).groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "other"))).alias("l"))
    member = reps.where("n = 1").select(F.col("id").alias("a"), "id").unionByName(copies.select(F.col("rep").alias("a"), "id"))
    each = member.join(lists.select("a", F.slice("l", 1, k + 1).alias("l")), "a")
    kept = each.select("id", F.explode(F.slice(F.filter("l", lambda x: x["other"] != F.col("id")), 1, k)).alias("x"))
    return kept.select("id", F.col("x.other").alias("other"), (-F.col("x.r")).alias("r"))


def similar_pairs(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """(embedding_a, embedding_b): pairs in which one is among the k most similar of the other."""
    near = nearest(embeddings, k)
    return near.select(F.least("id", "other").alias("embedding_a"), F.greatest("id", "other").alias("embedding_b")).distinct()
