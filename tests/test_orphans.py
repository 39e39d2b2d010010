import datetime as dt
import random

import pytest
from graphloom.operators import orphans

D = dt.datetime
NODES = "ord bigint, id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz, metadata string, edge_id string"
EDGES = "edge_id bigint, source string, target string, observed_at timestamp_ntz, id string, ref string, link string"


def found(spark, nodes, edges):
    n = spark.createDataFrame([(*r, None, "x") for r in nodes], NODES)
    e = spark.createDataFrame([(*r, "x", "y", "z") for r in edges], EDGES)
    rows = orphans.direct_orphans(orphans.edge_links(e), orphans.node_stays(n)).select("record", "endpoint").distinct().collect()
    return {tuple(r) for r in rows}


def test_stays_cover_half_open_spans(spark):
    nodes = [(0, " a ", D(2026, 1, 2), D(2026, 1, 5)), (1, "b", D(2026, 1, 1), None), (2, "c", None, None), (3, None, D(2026, 1, 1), None), (4, "e", D(2026, 1, 9), D(2026, 1, 3))]
    edges = [
        (1, "a", "b", D(2026, 1, 2)), (2, "a", "b", D(2026, 1, 5)), (3, "a\t", "external:x", D(2026, 1, 4, 23)), (4, None, " ", D(2026, 1, 4)),
        (5, "A", "b", D(2025, 12, 31)), (6, "c", "b", D(2026, 2, 1)), (7, "b", "zz", None), (7, "b", "zz", None), (8, "e", "b", D(2026, 1, 10)),
    ]
    assert found(spark, nodes, edges) == {(2, "source"), (5, "source"), (5, "target"), (6, "source"), (7, "target"), (8, "source")}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    when = lambda: D(2026, 1, rng.randint(1, 6), rng.randint(0, 23))
    nodes = []
    for i in range(60):
        a, b = sorted((when(), when()))
        nodes.append((i, rng.choice("abcd"), a, rng.choice([b, b, None])))
    nodes += nodes[:10]  # repeated rows
    edges = [(i, rng.choice("abcdx"), rng.choice("abcdx"), when()) for i in range(300)]
    edges += edges[:20]
    wanted = set()
    for k, s, t, at in edges:
        for end, ref in (("source", s), ("target", t)):
            if not any(n[1] == ref and n[2] <= at and (n[3] is None or n[3] > at) for n in nodes):
                wanted.add((k, end))
    assert found(spark, nodes, edges) == wanted


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [], [(1, "a", "b", D(2026, 1, 1))]) == {(1, "source"), (1, "target")}
    assert found(spark, [(0, "a", D(2026, 1, 1), None)], []) == set()


def test_cascade_follows_dependencies_and_cycles(spark):
    links = spark.createDataFrame(
        [("nodes", 1, "dependency", "gone", None, "a"), ("nodes", 2, "dependency", "a", None, "b"), ("nodes", 3, "dependency", "b", None, "c"),
         ("nodes", 4, "dependency", "c", None, "a"), ("edges", 9, "source", "c", None, None), ("edges", 10, "source", "free", None, None)],
        "tbl string, record bigint, endpoint string, ref string, at timestamp_ntz, own_id string",
    )
    direct = links.where("ref = 'gone'")
    rows = {(r.tbl, r.record): (r.kind, r.depth) for r in orphans.cascade(links, direct).collect()}
    assert rows == {("nodes", 1): ("direct", 0), ("nodes", 2): ("inherited", 1), ("nodes", 3): ("inherited", 2), ("nodes", 4): ("inherited", 3), ("edges", 9): ("inherited", 3)}


def test_broken_metadata_names_no_dependency(spark):
    n = spark.createDataFrame(
        [(1, "a", None, None, '{"dependencies": ["x", null, " y "]}', ""), (2, "b", None, None, '{"dependencies": ["x", "y"', ""), (3, "c", None, None, "[]", ""), (4, "d", None, None, None, "")], NODES
    )
    assert {(r.record, r.ref) for r in orphans.node_links(n).collect()} == {(1, "x"), (1, "y")}
