import json
import random

import numpy as np
from graphloom.operators import json_buffers, nesting
from graphloom.operators.nesting import NESTS, SCALARS

SCHEMA = "file_id bigint, classes string, root_id string, child_id string"


def links(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    return {(r.root_id, r.parent_id, r.child_id) for r in nesting.class_links(df).collect()}


# a recursive version, object by object


def opened(value, depth: int = 0):
    """The value, with JSON text replaced by what it holds."""
    while isinstance(value, str) and depth < 16:
        text = value.strip()
        if not text or text[0] not in '[{"':
            return value
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return value
        depth += 1
    return value


def as_id(value) -> str | None:
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    text = str(value)
    return text if text.strip() else None


def kinded(value, key: str | None = None, kind: str = "classes") :
    """(id, object, the list it is of) of each object directly in ``value``."""
    value = opened(value)
    if isinstance(value, list):
        return [m for v in value for m in kinded(v, kind=kind)]
    if not isinstance(value, dict):
        return []
    if any(k in value and not isinstance(value[k], (dict, list)) for k in SCALARS):
        own = as_id(value.get("id"))
        return [(own if own is not None else key, value, kind)]
    if any(k in value for k in NESTS):  # a wrapper, or an object of which only its key is left
        if key is None:
            return [m for k in NESTS for m in kinded(value.get(k), kind=k)]
        return [(key, value, kind)]
    return [m for k, v in value.items() for m in kinded(v, k, kind)]


def members(value, key: str | None = None) :
    """(id, object) of each object directly in ``value``."""
    return [(own, obj) for own, obj, _ in kinded(value, key)]


def brute(i, value, parent):
    out = set()
    for own, obj in members(value):
        if own is not None:
            out.add((str(i), parent, own))
        for k in ("classes", "methods"):
            out |= brute(i, obj.get(k), own if own is not None else parent)
    return out


def test_shapes(spark):
    m = {"id": "m", "name": "f"}
    texts = [
        json.dumps([{"id": "c", "name": "C", "methods": [m, None]}]), json.dumps({"classes": [{"id": "c", "methods": m}]}),
        json.dumps({"id": "c", "methods": {"m1": {"name": "a"}, "m2": {"id": "own", "name": "b"}}}), json.dumps(json.dumps([{"id": "c", "methods": json.dumps([m])}])),
        json.dumps([{"id": None, "name": "C", "methods": [m], "classes": [{"id": "d", "name": "D", "classes": [{"name": "E", "methods": [{"id": "deep", "name": "g"}]}]}]}]),
        '[{"id": "cut", "name": "C", "meth', None, "", "null", "[]", "3", '"text"', '[{"id": 7, "name": "n"}]', '[{"id": "c", "name": 1}, {"id": "c", "name": 1}]',
    ]
    assert links(spark, texts) == {
        ("0", "0", "c"), ("0", "c", "m"), ("1", "1", "c"), ("1", "c", "m"), ("2", "2", "c"), ("2", "c", "m1"), ("2", "c", "own"), ("3", "3", "c"), ("3", "c", "m"),
        ("4", "4", "m"), ("4", "4", "d"), ("4", "d", "deep"), ("12", "12", "7"), ("13", "13", "c"),
    }


def test_against_recursion(spark):
    rng = random.Random(5)

    def make(depth):
        o = {"name": "n", "methods": [{"id": f"m{rng.randint(0, 9)}", "name": "f"} for _ in range(rng.randint(0, 3))]}
        if rng.random() < 0.8:
            o["id"] = f"c{rng.randint(0, 9)}"
        if depth and rng.random() < 0.7:
            o["classes"] = [make(depth - 1) for _ in range(rng.randint(1, 2))]
        return o

    values = [[make(4) for _ in range(rng.randint(0, 3))] for _ in range(80)]
    assert links(spark, [json.dumps(v) for v in values]) == set().union(*(brute(i, v, str(i)) for i, v in enumerate(values)))


def test_very_long_and_empty(spark):
    many = json.dumps([{"id": f"c{i}", "name": "n", "methods": [{"id": "m", "name": "f"}]} for i in range(5000)])
    assert len(links(spark, [many])) == 10_000
    assert links(spark, []) == set()


def test_locations(spark):
    loc = lambda a, b: {"file": "f", "line_start": a, "line_end": b}
    texts = [
        json.dumps({"location": loc(1, 2), "hook_info": {"location": loc(8, 9)}}), json.dumps({"location": [loc(1, 2), loc("3", "4"), loc(5, None)]}),
        json.dumps({"location": json.dumps(loc(1, 2))}), json.dumps(json.dumps({"location": loc(6, 7)})), json.dumps({"location": None}), '{"location": {"line_start": 1, "line_end": 2', None, "[]",
    ]
    df = spark.createDataFrame([(i, f"n{i}", t) for i, t in enumerate(texts)], "ord bigint, id string, metadata string")
    got = {(r.root_id, r.parent_id, r.child_id) for r in nesting.location_links(df).collect()}
    assert got == {("0", "n0", "1-2"), ("1", "n1", "1-2"), ("1", "n1", "3-4"), ("2", "n2", "1-2"), ("3", "n3", "6-7")}


def test_tables(spark):
    text = json.dumps([{"name": "C", "startLine": "3", "endLine": 9, "methods": {"m1": {"name": "f", "startLine": 4, "endLine": 5, "code": "f() {}", "description": None}}, "classes": [{"id": "d", "name": "D"}]}])
    files = spark.createDataFrame([(7, text), (7, text), (8, '{"methods": [{"id": "m", "name": ["g"]}]}')], "file_id bigint, classes string")
    cols = ("file_id", "object_key", "parent_key", "id", "parent_id", "name", "start_line", "end_line", "code", "description")
    rows = lambda df, c: sorted(tuple(r[k] for k in c) for r in df.collect())
    assert rows(nesting.classes(files), cols) == [(7, "7/0", None, None, "7", "C", "3", "9", None, None), (7, "7/0/0", "7/0", "d", "7", "D", None, None, None, None)]
    assert rows(nesting.methods(files), cols) == [
        (7, "7/0/1", "7/0", "m1", "7", "f", "4", "5", "f() {}", None), (8, "8/0", None, "m", "8", '["g"]', None, None, None, None),
    ]
    nodes = spark.createDataFrame([(1, "n", json.dumps({"location": [{"file": "a", "line_start": 1}, {"file": "a", "line_start": "2", "line_end": 3.0, "column_end": 4}]}))], "ord bigint, id string, metadata string")
    assert rows(nesting.locations(nodes), ("ord", "location_key", "node_id", *nesting.PLACE)) == [(1, "1/0", "n", "a", "1", None, None, None), (1, "1/1", "n", "a", "2", "3", None, "4")]


def built(v, i):
    kids = v.children[i].as_py()
    if v.kind[i] == json_buffers.OBJECT:
        return {v.keys[c].as_py(): built(v, c) for c in kids}
    if v.kind[i] == json_buffers.LIST:
        return [built(v, c) for c in kids]
    return v.text_of(np.array([i]))[0].as_py() if v.kind[i] == json_buffers.STRING else json.loads(v.source_of(i))


def test_values_against_the_json_module():
    rng = random.Random(1)

    def make(depth):
        r = rng.random()
        if depth and r < 0.35:
            return {rng.choice(["id", 'b"q', "é\\", "x:y", ""]) + str(rng.randint(0, 3)): make(depth - 1) for _ in range(rng.randint(0, 4))}
        if depth and r < 0.65:
            return [make(depth - 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([1, -2.5, True, None, "s", 'q"}]{[,:', "\\", '\\"', "日本\n\t", "", 1e10])

    texts = ["", "  ", "null", '"a"', '{"a":1,"a":2}', '{"a":{"b":1},"a":{"c":[2]}}', "[1,]", "[,1]", "{,}", '{"a"}', '{"a":}', "[] []", "[1 2]", "{]", "[}", "01", "nul", "1.", '"\t"', '"\\x"', '"\\u12"', "\ufeff[]", '["a\\\\"]']
    for _ in range(1500):
        t = json.dumps(make(5), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        r = rng.random()
        if r < 0.15:
            t = t[: rng.randint(0, len(t) - 1)]
        elif r < 0.4:
            i = rng.randint(0, len(t) - 1)
            t = t[:i] + rng.choice(list('{}[],:"\\ x0')) + t[i + rng.randint(0, 1) :]
        texts.append(t)
    v = json_buffers.Values([t.encode() for t in texts])
    for i, t in enumerate(texts):
        try:
            wanted = json.loads(t)
        except ValueError:
            assert v.roots[i] < 0, t
        else:
            assert v.roots[i] >= 0 and built(v, v.roots[i]) == wanted, t
    assert len(json_buffers.Values([])) == 0 and len(json_buffers.Values([b""])) == 0
