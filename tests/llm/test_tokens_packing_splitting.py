import base64
import random

import pytest
from graphloom.llm import packing, splitting, tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(tokens.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.sentencepiece_model(tokens.vocabulary_path()))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_and_round_trip(text):
    e = test_same_ids_and_round_trip.enc
    ids = e.encode_batch([text])[0]
    assert ids == test_same_ids_and_round_trip.reference(text)
    assert e.decode(ids) == text


@pytest.fixture(autouse=True)
def _share(enc, reference):
    test_same_ids_and_round_trip.enc = enc
    test_same_ids_and_round_trip.reference = reference


def test_encode_cases(spark, reference):
    texts = [None, "", " ", "a" * 5000, "Don't  stop\n\n<|endoftext|>", "日本語のテキスト" * 300, "x", "x"]
    df = spark.createDataFrame([(i, t, "ids", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, key int")
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokens.encode(df, "doc_id", "text", counts_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def packed(spark, sizes, capacity, parts=4):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, n_tokens int, bin string").repartition(parts)
    return packing.pack(df, capacity).collect()


@pytest.mark.parametrize("seed", [0, 1])
def test_packing_keeps_every_item(spark, seed):
    rng = random.Random(seed)
    sizes = [min(2600, int(rng.paretovariate(0.9) * 20)) for _ in range(3000)] + [0, 0, 1024, 1025]
    rows = packed(spark, sizes, 1024, 8)
    load, per = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        per.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
    assert max(load.values()) <= 1024
    for i, s in enumerate(sizes):
        pieces = sorted(per[i])
        assert sum(n for _, n in pieces) == s
        assert len(pieces) == max(1, -(-s // 1024)) and [p for p, _ in pieces] == list(range(len(pieces)))
    assert len(load) <= 1.02 * sum(sizes) / 1024 + 2


def test_packing_edges(spark):
    assert packed(spark, [], 10) == []
    rows = packed(spark, [6] * 40, 10)
    assert len({r.container_id for r in rows}) == 40
    assert len({r.container_id for r in packed(spark, [5] * 40, 10)}) == 20
    assert sorted(r.n_tokens for r in packed(spark, [25], 10)) == [5, 10, 10]


LIMITS = [("f", "characters", 40, 8), ("f2", "characters", 10, 30), ("g", "tokens", 5, 1), (None, None, None, None)]


@pytest.mark.parametrize("field,size,overlap", [("f", 40, 8), ("f2", 10, 9)])
def test_splitting(spark, field, size, overlap):
    rng = random.Random(4)
    words = ["alpha", "be.", "gamma\n", "delta\n\n", "这是。", "x" * 70, "🎉", "e!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "a" * size, "a" * (size + 1), "🎉" * (2 * size)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "k bigint, t string, piece string, max_size int")
    df = df.unionAll(df.limit(5))
    limit = splitting.limits(spark.createDataFrame(LIMITS, "item_field string, unit string, max_size bigint, overlap bigint"), field)
    rows = splitting.pieces(splitting.items([("tab", df, "k", "t", limit)])).distinct().collect()
    per = {}
    for r in rows:
        per.setdefault(r.item_id, []).append(r)
    assert set(per) == {i for i, t in enumerate(texts) if t is not None and len(t) > size}
    for i, pieces in per.items():
        pieces.sort(key=lambda r: r.piece_no)
        text, done = texts[i], ""
        for before, r in zip([None, *pieces], pieces):
            assert len(r.piece) <= size and text[r.start_pos : r.end_pos] == r.piece
            shared = min(overlap, len(before.piece)) if before else 0
            assert not before or r.piece.startswith(before.piece[len(before.piece) - shared :])
            done += r.piece[shared:]
        assert done == text


def test_splitting_prefers_strong_boundaries(spark):
    df = spark.createDataFrame([(1, "one two three four.\n\nfive six seven eight nine ten eleven")], "k bigint, t string")
    limit = spark.createDataFrame([("f", 40, 0)], "item_field string, max_size bigint, overlap bigint")
    cut = splitting.items([("tab", df, "k", "t", limit)]).first().bodies
    assert cut == ["one two three four.\n\n", "five six seven eight nine ten eleven"]
    assert splitting.items([("tab", df.limit(0), "k", "t", limit)]).count() == 0
    assert splitting.items([("tab", df, "k", "t", limit.where(F.lit(False)))]).count() == 0
