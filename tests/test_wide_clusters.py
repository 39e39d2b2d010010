"""Clusters at the reference's threshold against brute force."""

import numpy as np
import pytest
from graphloom import queries_code, queries_views
from graphloom.operators import vectors


def brute(x, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.round(u @ u.T, 10) >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return np.where(near.sum(axis=1) > 1, label, -1), near
        label = new


def test_wide_clusters(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 64)), 5, axis=0) + rng.normal(size=(200, 64)) * 0.62
    x[7] = x[6]
    label, near = brute(x, 0.7)
    assert 10 < len(set(label)) < 200 and (label == -1).any()
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "embedding_id bigint, embedding array<double>, computed_at timestamp_ntz").write.parquet(f"{tmp_path}/semantic_embeddings.parquet")
    d = str(tmp_path)
    monkeypatch.setattr(vectors, "BLOCK", 20)  # several blocks
    got = queries_code.queries()["similarity_clusters"](spark, d).collect()
    assert {r.id: r.label for r in got} == dict(enumerate(label.tolist()))
    sizes = {r.label: r.n for r in queries_views.queries()["cluster_centroids"](spark, d).collect()}
    assert sizes == {k: int((label == k).sum()) for k in set(label.tolist()) - {-1}}
    links = {r.rep: r.n_links for r in vectors.linked_classes(vectors.usable(spark.read.parquet(f"{d}/semantic_embeddings.parquet"), "embedding_id", "embedding"), 0.7)[2].collect()}
    keep = [i for i in range(200) if i != 7]
    assert links == {i: int(near[i][keep].sum()) - 1 for i in keep if near[i][keep].sum() > 1}
