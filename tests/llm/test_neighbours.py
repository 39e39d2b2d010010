import numpy as np
import pytest
from graphloom.llm import neighbours


def brute(rows, k):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 10)
    np.fill_diagonal(s, -3)
    out = set()
    for p, i in enumerate(ids):
        for q in sorted(range(len(ids)), key=lambda q: (-s[p, q], ids[q]))[: min(k, len(ids) - 1)]:
            out.add((min(i, ids[q]), max(i, ids[q])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 1) for i, v in rows], "embedding_id bigint, embedding array<float>, computed_at timestamp_ntz, id string, raw int")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    rows = {i: np.float32(centres[i % 40] * (i < 1500) + rng.normal(size=64) * rng.choice([0.2, 0.6])) for i in range(2000)}
    got = {tuple(r) for r in neighbours.similar_pairs(frame(spark, [(i, [float(x) for x in v]) for i, v in rows.items()])).collect()}
    want = brute(rows, 10)
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = {i: np.float32(rng.normal(size=64)) for i in range(60)}
    rows |= {100 + i: rows[7] for i in range(200)}  # a hot class of copies
    data = [(i, [float(x) for x in v]) for i, v in rows.items()]
    bad = [(900, None), (901, [1.0] * 3), (902, [0.0] * 64), (903, [float("nan")] + [1.0] * 63), (904, [float("inf")] + [1.0] * 63), (905, [None] + [1.0] * 63)]
    got = {tuple(r) for r in neighbours.similar_pairs(frame(spark, data + bad + data[:5])).collect()}
    assert got == brute(rows, 10)


def test_few_or_none(spark):
    assert neighbours.similar_pairs(frame(spark, [])).count() == 0
    one = [(1, [1.0] + [0.0] * 63)]
    assert neighbours.similar_pairs(frame(spark, one)).count() == 0
    three = one + [(2, [0.0, 1.0] + [0.0] * 62), (3, [2.0] + [0.0] * 63)]
    assert {tuple(r) for r in neighbours.similar_pairs(frame(spark, three)).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_graph_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 64))
    rows = {i: np.float32(centres[i % 30] + rng.normal(size=64) * rng.choice([0.3, 0.8])) for i in range(1500)}
    e = frame(spark, [(i, [float(x) for x in v]) for i, v in rows.items()])
    got = {(r.query_id, r.other_id) for r in neighbours.searched(e, e.where("embedding_id % 20 = 0")).collect()}
    x = np.array([rows[i] for i in range(1500)], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in range(0, 1500, 20):
        s = np.round(u @ u[q], 10)
        s[q] = -3
        want |= {(q, j) for j in sorted(range(1500), key=lambda j: (-s[j], j))[:10]}
    assert len(got & want) / len(want) >= 0.9
    assert neighbours.searched(e.limit(0), e.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [1e-2, 1e-3])
def test_crowd_of_near_copies(spark, noise):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    x = np.concatenate([centre + noise * rng.normal(size=(400, 64)), rng.normal(size=(800, 64))]).astype(np.float32)
    got = {(r.embedding_a, r.embedding_b) for r in neighbours.similar_pairs(frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)])).collect()}
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = np.round(y @ y.T, 10)
    np.fill_diagonal(s, -2)
    best = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s), axis=1)[:, :10]
    wanted = {(min(i, j), max(i, j)) for i in range(len(x)) for j in best[i].tolist()}
    crowd = {p for p in wanted if p[1] < 400}
    assert len(crowd & got) >= 0.97 * len(crowd) and len(wanted & got) >= 0.95 * len(wanted)
