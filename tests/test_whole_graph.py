"""Traversal over all links: no partner, type or length is left out."""

import random

import pytest
from graphloom import queries_export, queries_graph
from graphloom.operators import traversal
from graphloom.plans.graph_tables import project_graph

Q = {**queries_graph.queries(), **queries_export.queries()}
NODES = "ord bigint, id string, type string, file string, name string, is_entry boolean, c4_level string, line_start int, line_end int, metadata string, recorded_at timestamp_ntz, deleted_at timestamp_ntz"
EDGES = "edge_id bigint, source string, target string, type string, confidence double, metadata string, project string, observed_at timestamp_ntz, ingested_at timestamp_ntz"
#: p0 refers to four projects, one by 'renders' only; p5 to p11 form one circle of seven.
LINKS = [("p0", "p1", 3, "calls"), ("p0", "p2", 2, "calls"), ("p0", "p3", 1, "uses"), ("p0", "p4", 1, "renders"), ("p4", "p5", 1, "imports")]
LINKS += [(f"p{i}", f"p{i + 1 if i < 11 else 5}", 1, "calls") for i in range(5, 12)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("graph"))
    nodes = [(i, f"p{i}", "function", f"p{i}/a.ts", "f", False, "code", 1, 2, None, None, None) for i in range(12)]
    edges = [(s, t, kind) for s, t, n, kind in LINKS for _ in range(n)]
    spark.createDataFrame(nodes, NODES).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([(k, s, t, kind, 1.0, None, s, None, None) for k, (s, t, kind) in enumerate(edges)], EDGES).write.parquet(f"{d}/edges.parquet")
    return d


def reach(pairs):
    out = {s: {t for a, t in pairs if a == s} for s, _ in pairs}
    while True:
        more = {s: r | {t for x in r for t in out.get(x, ())} for s, r in out.items()}
        if more == out:
            return out
        out = more


def test_all_links(spark, folder):
    wanted = reach({(s, t) for s, t, *_ in LINKS})
    heads = {f"p{i}" for i in range(12)}
    assert {(r.seed, r.node) for r in Q["transitive_dependencies"](spark, folder).collect()} == {(s, t) for s, ts in wanted.items() for t in ts}
    assert {(r.seed, r.node) for r in Q["transitive_users"](spark, folder).collect()} == {(t, s) for s, ts in wanted.items() for t in ts}
    assert {r.seed: r.n for r in Q["data_consumers"](spark, folder).collect()} == {s: len(t) for s, t in wanted.items()}
    assert {r.node: r.depth for r in Q["dependency_depth"](spark, folder).collect()} == {"p0": 1, "p4": 7} | {f"p{i}": 0 for i in (1, 2, 3)} | {f"p{i}": 6 for i in range(5, 12)}
    assert {(r.node, r.label) for r in Q["nodes_on_cycles"](spark, folder).collect()} == {(f"p{i}", "p10") for i in range(5, 12)}
    assert [tuple(r) for r in Q["circular_dependencies"](spark, folder).collect()] == [("p10", 7, 7, "info")]
    assert {(r.seed, r.node) for r in Q["data_origins"](spark, folder).collect()} == {(p, "p0") for p in heads - {"p0"}}


def test_all_partners(spark, folder):
    got = {(r.src, r.dst, r.n) for r in project_graph(spark, folder).collect()}
    assert got == {(s, t, n) for s, t, n, _ in LINKS}


def test_depths(spark):
    rng = random.Random(5)
    for n, k in ((60, 66),):
        pairs = {(rng.randint(0, n), rng.randint(0, n)) for _ in range(k)}
        out = reach(pairs)
        nodes = {x for p in pairs for x in p}
        ring = {v: min([w for w in out.get(v, ()) if v in out.get(w, ())], default=v) for v in nodes}
        dag = {c: {ring[t] for s, t in pairs if ring[s] == c and ring[t] != c} for c in set(ring.values())}
        ends = {c for c in dag if not dag[c] and c not in out.get(c, ())}

        def far(c):
            return 0 if c in ends else max((1 + far(t) for t in dag[c] if far(t) is not None), default=None)

        wanted = {v: far(ring[v]) if far(ring[v]) is not None else len(out.get(v, set()) - {v}) for v in nodes}
        got = traversal.depths(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")).collect()
        assert {r.node: r.depth for r in got} == wanted and len(got) == len(wanted)


def test_strong_components(spark):
    rng = random.Random(2)
    pairs = {(rng.randint(0, 59), rng.randint(0, 59)) for _ in range(75)} | {(70, 71), (71, 72), (72, 70), (72, 5)}
    out = reach(pairs)
    wanted = {(n, min(m for m in out[n] if n in out.get(m, ()))) for n in out if n in out[n]}
    got = traversal.strong_components(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")).collect()
    assert {(r.node, r.label) for r in got} == wanted and len(got) == len(wanted)
