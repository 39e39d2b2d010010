import numpy as np
from graphloom.llm import neighbours


def test_third_equal(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 64)).astype(np.float32)
    x[::3] = x[0]
    x[1:60:3] = x[0] + rng.normal(size=(20, 64)).astype(np.float32) * 0.2
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "embedding_id bigint, embedding array<float>, computed_at timestamp")
    got = {}
    for r in neighbours.searched(df, df.where("embedding_id < 30")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.other_id
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 10)
    for i in range(30):
        wanted = [j for j in np.lexsort((np.arange(240), -s[i])) if j != i][:10]
        assert [got[i][k] for k in range(1, 11)] == wanted
