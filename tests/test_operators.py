import datetime as dt
import random

import numpy as np
import pytest
from graphloom.functions import exprs
from graphloom.operators import classify, imports, query, scoring, traversal, validation, vectors
from graphloom.sources import parsers, projects
from graphloom.streaming import progress
from pyspark.sql import functions as F

LINKS = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x"), ("y", "a")]


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(LINKS + LINKS[:2], "src string, dst string")


def reach(edges, seed):
    seen, todo = set(), [seed]
    while todo:
        for s, t in edges:
            if s == todo[0] and t not in seen:
                seen.add(t)
                todo.append(t)
        todo.pop(0)
    return seen


def test_reachable(spark, links):
    seeds = spark.createDataFrame([(s,) for s in "aexyz"], "seed string")
    got = traversal.reachable(links, seeds).collect()
    assert {(r.seed, r.node) for r in got} == {(s, t) for s in "aexyz" for t in reach(LINKS, s)}
    assert {r.node: r.depth for r in got if r.seed == "y"} == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5} | {}
    assert traversal.reachable(links, seeds.limit(0)).count() == 0


def test_paths_and_cycles(links):
    assert {tuple(r.path) for r in traversal.paths(links, "y", "e", 5).collect()} == {tuple("yabcde")}
    assert traversal.paths(links, "y", "e", 4).count() == 0
    assert {tuple(r) for r in traversal.cycles(links).collect()} == {("a", 3, 3, "warning"), ("x", 1, 1, "warning")}
    assert {r.node for r in traversal.on_cycles(links).collect()} == set("abcx")


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    nodes = list(range(100)) + list(range(200, 261))
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = traversal.components(spark.createDataFrame(pairs, "a bigint, b bigint"), spark.createDataFrame([(n,) for n in nodes], "node bigint"))
    assert {r.node: r.label for r in got.collect()} == label


def test_query_builder(spark):
    e = spark.createDataFrame([("1", "loadUser", "function", "User", 0.9), ("2", "LoadAll", "class", None, 0.4), ("3", "a(b", "function", "user", 0.8)], "id string, name string, kind string, type_name string, confidence double")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(query.EntityQuery(e).with_name("^load").execute()) == ["1", "2"]
    assert ids(query.EntityQuery(e).with_name("^load").with_kind("class").with_min_confidence(0.4).execute()) == ["2"]
    assert ids(query.find_by_name(e, "a(b")) == ["3"]  # no pattern: taken as text
    with pytest.raises(Exception):
        query.EntityQuery(e).with_name("a(b")
    assert ids(query.find_by_name(e, "LOADALL", exact=True)) == ["2"]
    assert ids(query.find_by_name(e, "LOADALL", exact=True, case_sensitive=True)) == []
    assert ids(query.find_by_type(e, "USER")) == ["1", "3"]
    assert ids(query.EntityQuery(e).with_type("User").execute()) == ["1"]
    l = spark.createDataFrame([("1", "3")], "source string, target string")
    assert ids(query.EntityQuery(e).calling(l, "3").execute()) == ["1"]
    assert ids(query.EntityQuery(e).called_by(l, "1").execute()) == ["3"]


def test_scoring(spark):
    row = spark.range(1).select(
        scoring.weighted({"type_inference": F.lit(2.0), "data_flow": F.lit(None).cast("double"), "annotation": F.lit(0.0)}).alias("s"),
        scoring.weighted({"usage": F.lit(None).cast("double")}).alias("none"),
    ).first()
    assert row.s == pytest.approx(0.25 / 0.40) and row.none == 0.0
    t = spark.createDataFrame([("v", "A", 0.9), ("v", "B", 0.5), ("v", "B", 0.6), ("w", "B", 0.5), ("w", "A", 0.5)], "identifier string, name string, confidence double")
    got = {r.identifier: (r.name, round(r.confidence, 6)) for r in scoring.merge_types(t).collect()}
    assert got == {"v": ("B", 0.6), "w": ("A", 0.5)}
    f = spark.createDataFrame([("f", "1", "type_inference", 1.0), ("f", "2", "type_inference", 0.0), ("f", "1", "evidence", 1.0)], "file string, entity_id string, factor string, score double")
    assert scoring.score_files(f).first().score == pytest.approx((0.25 * 0.5 + 0.03 * 0.2) / 0.28)


def test_expressions(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(exprs.identifier_words(F.lit("parseHTMLFile2"))) == ["parse", "html", "file", "2"]
    assert one(exprs.identifier_words(F.lit("__init__"))) == ["", "", "init", "", ""]
    assert one(exprs.sanitised(F.lit("a\\b.c d"))) == "a/b_c_d"
    assert one(exprs.relative(F.lit("/a/b/c.js"), F.lit("/a/b"))) == "c.js"
    assert [one(exprs.confidence_bucket(F.lit(x))) for x in (0.0, 0.19, 0.2, 0.99, 1.0)] == ["0.0-0.2", "0.0-0.2", "0.2-0.4", "0.8-1.0", "0.8-1.0"]
    assert one(exprs.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(exprs.c4_level(F.lit("module"), F.lit("a/services/x.ts"), F.lit("x.ts"), F.lit(False))) == "component"
    assert one(exprs.whole_json(F.lit('{"a": 1'))) is None
    v = exprs.with_fallback_embedding(spark.createDataFrame([("return (1);",), ("",)], "t string"), "t", "e").collect()
    assert np.linalg.norm(v[0].e) == pytest.approx(1) and v[1].e == [0.0] * 10


def test_validation(spark):
    nodes = spark.createDataFrame([("c", "component", "f1", False), ("m", "model", "f2", False), ("g", "function", "f2", False), ("lone", "class", "f3", False), ("mod", "module", "f4", False)], "id string, type string, file string, is_entry boolean")
    links = spark.createDataFrame([(1, "c", "m", "renders"), (2, "c", "gone", "calls"), (3, "m", "c", "calls"), (4, "c", "g", "imports"), (5, "g", "m", "calls")], "edge_id bigint, source string, target string, type string")
    got = {(r.edge_id, r.issue_type) for r in validation.edge_issues(links, nodes).collect()}
    assert got == {(1, "render_target_not_component"), (2, "missing_target_node"), (3, "missing_import"), (5, "call_target_not_callable")}
    assert [r.id for r in validation.orphaned_nodes(links, nodes).collect()] == ["lone"]


def test_imports(spark):
    text = "import React, { useState as s } from 'react';\nimport './side';\nimport type { A } from '../lib/x.js';\nconst y = 1;\n"
    files = spark.createDataFrame([(1, "p/src/a.ts", text), (2, "p/lib/x.ts", None), (3, "p/src/side/index.ts", "")], "file_id bigint, path string, content string")
    got = imports.resolve(imports.es6_imports(files), files).orderBy("n").collect()
    assert [(r.module, r.target) for r in got] == [("react", None), ("./side", "p/src/side/index.ts"), ("../lib/x.js", "p/lib/x.ts")]
    assert spark.range(1).select(imports.imported_names(F.lit("React, { useState as s, b }"))).first()[0] == ["React", "s", "b"]
    calls = spark.createDataFrame([(1, "const [a] = useState<any>(0); useX(); reuse(1);")], "file_id bigint, content string")
    assert [r.hook for r in imports.hook_calls(calls).orderBy("n").collect()] == ["useState", "useX"]


def test_projects(spark, tmp_path):
    tree = {
        "package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}', "tsconfig.json": '{ // note\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "u": ["http://x"]}},\n}',
        "index.html": '<script type="module" src="/src/main.tsx"></script>', "src/main.tsx": "import App from './App'", "node_modules/a/index.js": "skip", "pom.xml": "<x><mainClass>org.A</mainClass></x>",
    }
    for k, v in tree.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    files = projects.scan(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == set(tree) - {"node_modules/a/index.js"}
    assert {(r.name, r.dev) for r in projects.dependencies(files).collect()} == {("react", False), ("vite", True)}
    assert {(r.alias, r.target) for r in projects.path_aliases(files).collect()} == {("@", "src"), ("u", "http://x")}
    assert {(r.type, r.value) for r in projects.entry_points(files).collect()} == {("html_script", "src/main.tsx"), ("main_module", "src/main.tsx"), ("main_class", "org.A")}


def test_parsers(spark):
    files = spark.createDataFrame(
        [(1, "a/b.py", "class A:\n  def list_view(self): pass\nasync def f(): pass\n"), (2, "a/broken.py", "def ("), (3, "a/C.tsx", "export const Panel = (p) => null;\nfunction go() {}\nclass K {}\n"),
         (4, "a/D.java", 'public class D {\n @GetMapping("/x") void f() {}\n}'), (5, "a/e.js", None)],
        "file_id bigint, path string, content string",
    )
    got = {(r.file_id, r.type, r.name) for r in parsers.parsed(files).collect() if r.type != "module"}
    assert got == {(1, "class", "A"), (1, "view", "list_view"), (1, "function", "f"), (3, "component", "Panel"), (3, "function", "go"), (3, "class", "K"), (4, "class", "D"), (4, "api_endpoint", "/x")}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 64))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + 0.02 * rng.normal(size=64)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, [0.0] * 64), (303, [1.0]), (304, [float("nan")] * 64), (0, rows[0][1])]
    v = vectors.usable(spark.createDataFrame(rows, "k bigint, e array<float>"), "k", "e")
    ids = sorted(range(301))
    x = np.array([dict(rows[:301])[i] for i in ids])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 10)
    np.fill_diagonal(s, -3)
    got = {(r.query_id, r["rank"]): r.other_id for r in vectors.top_k(v, v.where("id % 20 = 0"), 5).collect()}
    for q in range(0, 301, 20):
        best = sorted(range(301), key=lambda j: (-s[q, j], j))[:5]
        assert [got[q, k] for k in range(1, 6)] == best
    label = {i: i for i in ids}
    for _ in range(30):
        for a, b in zip(*np.nonzero(s >= 0.95)):
            label[a] = label[b] = min(label[a], label[b])
    out = {r.id: r for r in vectors.clusters(v, 0.95).collect()}
    assert {i: r.label for i, r in out.items()} == label
    assert vectors.clusters(v.limit(0), 0.95).count() == 0


def test_classify(spark):
    df = spark.createDataFrame([("a.ts", "try { x } catch (e) { throw new Error() } finally {}"), ("b", ""), ("c", None)], "name string, text string")
    out = {r.name: (r.label, r.score) for r in classify.best(classify.scores(df, F.col("text"), F.col("name"), classify.INTENTS, classify.INTENT_WEIGHTS)).collect()}
    assert out["a.ts"][0] == "error_handling" and out["a.ts"][1] == 1.0 and out["b"] == (None, 0.0) and out["c"] == (None, 0.0)


def test_progress(spark):
    t = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([(1, "s", "scanning", 0.5, t), (2, "s", "parsing_files", 0.5, t + dt.timedelta(seconds=9)), (3, "f", "failed", 0.2, t)], "event_id bigint, sid string, phase string, done double, ts timestamp_ntz")
    last = progress.overall(progress.latest(e, "sid", "ts", "event_id"), "phase", "done", progress.PHASES)
    assert {r.sid: round(r.overall, 6) for r in last.collect()} == {"s": 0.5, "f": 0.0}
    assert spark.range(1).select(progress.remaining_seconds(F.lit(10.0), F.lit(0.25))).first()[0] == 30.0
