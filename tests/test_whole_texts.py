from graphloom import queries_views


def test_whole_context(spark, tmp_path):
    rows = [(1, "f", "Function", "x" * 300 + "a"), (2, "f", "Function", "x" * 300 + "b"), (3, "f", "Function", None)]
    spark.createDataFrame(rows, "embedding_id bigint, entity_name string, entity_type string, context string").write.parquet(f"{tmp_path}/semantic_embeddings.parquet")
    got = {r.embedding_id: r.text for r in queries_views.queries()["semantic_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: f"name: f | type: function | context: {c}" for i, _, _, c in rows[:2]}
