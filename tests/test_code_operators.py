import datetime as dt
import json
import random

import pytest
from graphloom.operators import features, flows, inference, lineage, modules, propagation, scoring, symbols, traversal, vectors, views
from graphloom.sources import exports, projects
from pyspark.sql import functions as F


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.fixture(scope="module")
def files(spark):
    a = "import { load } from './b';\nexport default function main() {\n  const x = load(1);\n  return new Store(await x.go());\n}\nclass Panel extends Base implements Thing {}\n"
    b = "export const load = (n) => n;\nfunction go() {\n  helper(load(2));\n  return <Panel a={1} />;\n}\n"
    return spark.createDataFrame([(1, "p/a.ts", a), (2, "p/b.ts", b), (3, "p/c.ts", None)], "file_id bigint, path string, content string")


def test_symbols_and_references(files):
    s = {(r.file_id, r.line, r.name): (r.symbol_type, r.is_exported, r.is_default) for r in symbols.symbols(files).collect()}
    assert s == {(1, 2, "main"): ("function", True, True), (1, 3, "x"): ("variable", False, False), (1, 6, "Panel"): ("class", False, False), (2, 1, "load"): ("variable", True, False), (2, 2, "go"): ("function", False, False)}
    r = {(x.file_id, x.line, x.name, x.context) for x in symbols.references(files).collect()}
    assert {(1, 3, "load", "call"), (1, 4, "Store", "instantiate"), (1, 4, "go", "async_call"), (1, 6, "Base", "extends"), (1, 6, "Thing", "implements"), (2, 4, "Panel", "jsx"), (2, 3, "helper", "call")} <= r
    assert not any(n in ("main", "go") and c == "call" and l == 2 for _, l, n, c in r)


def test_resolution_by_priority(files):
    got = {(r.file_id, r.line, r.name): (r.step, r.target_file) for r in symbols.resolved(symbols.references(files), symbols.symbols(files), files).collect()}
    assert got[1, 3, "load"] == ("imported", 2) and got[2, 3, "load"] == ("same_file", 2) and got[2, 4, "Panel"] == ("any_file", 1) and got[2, 3, "helper"] == (None, None)
    e = {(r.source_file, r.target, r.type) for r in symbols.edges(symbols.resolved(symbols.references(files), symbols.symbols(files), files)).collect()}
    assert (2, "1", "renders") in e and (2, "external:helper", "calls") in e and (1, "external:Base", "extends") in e


def test_inference(spark):
    values = {"true": "boolean", "-1.5": "number", "'a'": "string", "null": "null", "[1]": "array", "{ a }": "object", "(a) => a": "function", "/x/g": "regexp", "new Map()": "Map", "f(x)": "unknown"}
    assert {k: one(spark, inference.literal_type(F.lit(k))) for k in values} == values
    assert one(spark, inference.binary_type(F.lit("string"), F.lit("+"), F.lit("number"))) == "string"
    assert one(spark, inference.unary_type(F.lit("!"))) == "boolean"
    assert one(spark, inference.return_type(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == "a | b"
    assert one(spark, inference.return_type(F.array().cast("array<string>"))) == "undefined"
    p = F.array(F.struct(F.lit("a").alias("name"), F.lit("number").alias("type")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("type")))
    assert one(spark, inference.function_type(p, F.lit("void"), F.lit(True))) == "(a: number, b: any) => Promise<void>"
    assert one(spark, inference.usage_type(F.array(F.lit("property_access")))).type == "object"
    assert one(spark, inference.type_category(F.lit("string[]"))) == "array"
    assert one(spark, inference.adjusted_confidence(F.lit(0.6), F.lit(2), F.lit(True), F.lit("array"))) == 0.9
    ok = lambda a, b, n=False: one(spark, inference.compatible(F.lit(a), F.lit(b), F.lit(n)))
    assert ok("a", "a | b") and ok("any", "x") and ok("null", "x", True) and not ok("null", "x") and not ok("a", "b")
    text = "if (typeof x === 'string') {\nif (n > 3) {\nif (!ok) {\nconst [v, setV] = useState<any>('');\nconst [w, setW] = useState();\nthis.a = new Store(1);\nthis.b = b;\nconstructor(private readonly a: Store<X>, b) {\nlet z = 1;"
    lines = symbols.lines(spark.createDataFrame([(1, "a.ts", text)], "file_id bigint, path string, content string"))
    assert {(r.name, r.type) for r in inference.narrowed(lines).collect()} == {("x", "string"), ("n", "number"), ("ok", "truthy")}
    assert {(r.state, r.flow) for r in inference.state_flows(lines).collect()} == {("v", "state_init"), ("v", "state_update"), ("w", "state_update")}
    assert {(r.property, r.provider, r.created) for r in inference.property_injection(lines).collect()} == {("a", "Store", True), ("b", "b", False)}
    assert {(r.parameter, r.provider) for r in inference.constructor_injection(lines).collect()} == {("a", "Store"), ("b", "b")}
    assert {(r.name, r.type, r.confidence) for r in inference.declared_types(lines).collect()} == {("z", "number", 0.7)}


def test_modules(spark):
    text = "export const a = 1;\nexport default class B {}\nexport { c, d as e } from './x';\nexport * from 'y';\n"
    js = "const fs = require('fs');\nconst q = require('./q');\nmodule.exports = { a, b: 2 };\nexports.z = a;\n"
    f = spark.createDataFrame([(1, "p/a.ts", text), (2, "p/b.js", js), (3, "p/n.js", None)], "file_id bigint, path string, content string")
    assert {(r.kind, r.name, r.module, r.is_default) for r in modules.es6_exports(f).collect()} == {("const", "a", None, False), ("class", "B", None, True), ("re_export", "c", "./x", False), ("re_export", "e", "./x", False), ("re_export", "*", "y", False)}
    assert {(r.module, r.is_core) for r in modules.requires(f).collect()} == {("fs", True), ("./q", False)}
    assert {r.name for r in modules.commonjs_exports(f).collect()} == {"a", "b", "z"}
    tree = [("app/src/a.js", ""), ("app/node_modules/lib/package.json", '{"main": "./dist/m.js"}'), ("app/node_modules/lib/dist/m.js", ""), ("node_modules/lib/index.js", ""), ("node_modules/top.js", "")]
    t = spark.createDataFrame(tree, "path string, content string")
    bare = spark.createDataFrame([("app/src/a.js", "lib"), ("app/src/a.js", "top"), ("b.js", "lib"), ("b.js", "none")], "path string, module string")
    assert {(r.path, r.module): r.target for r in modules.in_node_modules(bare, t).collect()} == {("app/src/a.js", "lib"): "app/node_modules/lib/dist/m.js", ("app/src/a.js", "top"): "node_modules/top.js", ("b.js", "lib"): "node_modules/lib/index.js"}
    al = spark.createDataFrame([("@", "src"), ("@/deep", "lib")], "alias string, target string")
    m = spark.createDataFrame([(1, "@/x"), (2, "@/deep/y"), (3, "react")], "n int, module string")
    assert {r.n: r.module for r in modules.aliased(F.col("module"), al, m).collect()} == {1: "src/x", 2: "lib/y", 3: "react"}


def test_lineage(spark):
    flows = spark.createDataFrame([("a", "b"), ("b", "c"), ("z", "c"), ("x", "y"), ("y", "x"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("c",), ("x",), ("a",)], "seed string")
    assert {(r.seed, r.node) for r in lineage.origins(flows, seeds).collect()} == {("c", "a"), ("c", "z"), ("a", "a")}
    assert {r.node for r in lineage.consumers(flows, seeds.where("seed = 'a'")).collect()} == {"b", "c", "d"}
    assert {r.node: r.depth for r in traversal.depths(flows).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0, "z": 2, "x": 1, "y": 1}
    assert [r.path for r in lineage.chain(flows, "a", "d", 5).collect()] == [["a", "b", "c", "d"]]
    assert sorted(map(tuple, lineage.tree(flows, "a", 2).collect())) == [("a", "a"), ("a>b", "  b"), ("a>b>c", "    c [...]")]
    t = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([("k", "op", "start", t), ("k", "op", "end", t + dt.timedelta(seconds=2)), ("k", "op", "end", t + dt.timedelta(seconds=3)), ("q", "op", "end", t)], "key string, operation string, kind string, ts timestamp_ntz")
    assert [(r.key, r.micros) for r in lineage.elapsed(e).collect()] == [("k", 2_000_000)]


def test_exports(spark, tmp_path):
    n = spark.createDataFrame([("a", "class", "f", "A", False, '{"c4_level": "odd", "dependencies": ["b"]}'), ("b", "class", "f", None, True, "{broken")], "id string, type string, file string, name string, is_entry boolean, metadata string")
    docs = {r.id: json.loads(r.document) for r in exports.node_documents(n).collect()}
    assert docs["a"]["metadata"] == {"c4_level": "code", "is_entry": False, "dependencies": ["b"]} and "name" not in docs["b"]
    e = spark.createDataFrame([(1, "a", "b", "calls", 0.5, '{"x": 1}'), (2, "a", "b", "calls", None, None)], "edge_id bigint, source string, target string, type string, confidence double, metadata string")
    assert json.loads(exports.edge_documents(e).where("edge_id = 1").first().document)["metadata"] == {"x": "1", "confidence": "0.5"}
    exports.write_response(str(tmp_path / "out"), nodes=n)
    assert spark.read.json(str(tmp_path / "out" / "nodes")).count() == 2
    m = F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(None).cast("int"))
    assert one(spark, exports.call_key("find", m)) == "find:a=None|b=2"


def test_project_choice(spark):
    f = spark.createDataFrame([("package.json", '{"dependencies": {"react": "1"}}'), ("index.html", ""), ("pom.xml", "<x>spring-boot</x>"), ("a/b.txt", None)], "path string, content string")
    assert {r.project_type for r in projects.applicable(f).collect()} == {"react_vite", "maven_java", "spring_boot"}
    assert tuple(projects.chosen(projects.applicable(f)).first()) == ("spring_boot", "java", "spring_boot")
    assert projects.applicable(f.limit(0)).count() == 0


def test_more_entry_points(spark):
    manifest = '<activity android:name=".A"><intent-filter/></activity><activity android:name=".Main"><action android:name="android.intent.action.MAIN"/></activity>'
    f = spark.createDataFrame([("angular.json", '{"projects": {"p": {"architect": {"build": {"options": {"main": "src/main.ts"}}}}}}'), ("app/AndroidManifest.xml", manifest), ("x/settings.py", "")], "path string, content string")
    assert {(r.type, r.value) for r in projects.entry_points(f).collect()} == {("angular_main", "src/main.ts"), ("android_activity", ".Main"), ("django", "x/settings.py")}


def test_views(spark):
    n = spark.createDataFrame([("a", "class", "f", "B"), ("b", "function", "f", "a"), ("c", "module", "g", "z"), ("d", "class", "g", None), ("e", "class", "g", "A")], "id string, type string, file string, name string")
    assert {r.id for r in views.view_nodes(n, "file", "f").collect()} == {"a"} and {r.id for r in views.view_nodes(n, "repo").collect()} == {"c"}
    assert {(r.type, r.position, r.id, r.total) for r in views.type_lists(n, 1).collect()} == {("class", 1, "e", 2), ("function", 1, "b", 1), ("module", 1, "c", 1)}
    assert {r.id for r in views.related(n, "a").collect()} == {"b"}
    i = spark.createDataFrame([("a", 3.5), ("b", 2.5), ("c", 0.0), ("d", 4.0)], "id string, importance double")
    assert {r.id: (r.layer, r.position) for r in views.layers(i).collect()} == {"d": (0, 1), "a": (0, 2), "b": (1, 1), "c": (3, 1)}
    assert one(spark, views.edge_style(F.lit("uses"))).dashed and one(spark, views.edge_style(F.lit("?"))).colour == "grey"


def test_features(spark):
    c = features.code_features(F.lit("import x;\nfunction a() { b.c(); let d: string = e ?? 1; }\nfunction a() {}"))
    got = {k: one(spark, v) for k, v in c.items()}
    assert (got["n_functions"], got["n_imports"], got["n_annotations"], got["n_calls"], got["has_default"]) == (1, 1, 1, 1, True)
    assert one(spark, features.shortened(F.lit("a\nb\nc\nd"), 20)) == "a\nb\nc" and one(spark, features.shortened(F.lit("a\nb"), 20)) == "a\nb"
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, t string")
    e = {r.key: r.embedding for r in features.seeded_embeddings(df, "k", F.col("t"), 16).collect()}
    assert e[1] == e[2] != e[3] and sum(x * x for x in e[3]) == pytest.approx(1, abs=1e-5)
    rows = [(f"is{i}", "boolean") for i in range(20)] + [(f"item{i}List", "array") for i in range(20)]
    train = spark.createDataFrame(rows, "name string, label string").withColumn("v", features.feature_vector(F.col("name"), F.lit("")))
    out = features.train_type_classifier(train, "label", "v", trees=5)(train).collect()
    assert sum(r.label == r.predicted for r in out) >= 38


def test_score_sources(spark):
    w = lambda f: one(spark, F.round(scoring.weighted(f), 6))
    assert w(scoring.from_type_inference(F.lit(None).cast("double"), F.lit(True), F.lit(2))) == pytest.approx((0.25 * 0.5 + 0.15 + 0.03 * 0.6) / 0.43, abs=1e-5)
    assert w(scoring.from_data_flow(F.lit(3), F.lit(4), F.lit(True))) == 1.0
    assert w(scoring.from_hook(F.lit(True), F.lit(False), F.lit(False))) == pytest.approx((0.15 * 0.7 + 0.1 * 0.5 + 0.1 * 0.6) / 0.35, abs=1e-5)
    assert w(scoring.from_injection(F.lit(0), F.lit(False), F.lit(True))) == pytest.approx((0.25 * 0.6 + 0.1 * 0.8) / 0.48, abs=1e-5)
    assert w(scoring.from_component(F.lit(0.9), F.lit(True), F.lit(4), F.lit(5), F.lit(9))) == 1.0
    assert one(spark, scoring.entity_confidence(F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit(9))) == 1.0
    assert one(spark, scoring.reason(F.lit(0.5), "data_flow")) == "medium data flow"
    assert one(spark, scoring.behaviour_confidence(F.array(F.lit(0.6), F.lit(0.2)))) == pytest.approx(0.68)


def test_centroids_and_groups(spark):
    rows = [(1, [1.0] + [0.0] * 63, 7), (2, [1.0, 0.1] + [0.0] * 62, 7), (3, [0.0, 1.0] + [0.0] * 62, 8), (4, [1.0, 0.2] + [0.0] * 62, 8)]
    v = spark.createDataFrame(rows, "id bigint, v array<double>, g bigint")
    near = vectors.top_k(v, v.where("id = 1"), 1, other_group="g").first()
    assert near.other_id == 4
    c = vectors.centroids(v, vectors.clusters(v.select("id", "v"), 0.97)).first()
    assert (c.label, c.n) == (1, 3) and 0.98 < c.confidence < 1


def test_spread_and_as_of(spark):
    rng = random.Random(4)
    links = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(90)})
    typed = [(n, f"t{n % 3}", 0.5) for n in (1, 2, 3, 40)] + [(1, "t0", 0.9)]
    wanted = {n: (t, 0, c) for n, t, c in [(1, "t0", 0.9), (2, "t2", 0.5), (3, "t0", 0.5), (40, "t1", 0.5)]}
    for depth in range(1, 70):
        near = {}
        for s, t in links:
            if s in wanted and wanted[s][1] == depth - 1 and t not in wanted:
                near.setdefault(t, []).append((wanted[s][0], -wanted[s][2] * 0.5))
        wanted |= {t: (min(o)[0], depth, -min(o)[1]) for t, o in near.items()}
    got = propagation.spread(spark.createDataFrame(typed, "node int, type string, confidence double"), spark.createDataFrame(links, "src int, dst int"), 0.5).collect()
    assert {r.node: (r.type, r.distance, r.confidence) for r in got} == wanted and len(got) == len(wanted)
    said = spark.createDataFrame([("a", 3, "x"), ("a", 7, "y"), ("b", 1, "z")], "k string, line int, v string")
    asked = spark.createDataFrame([("a", 2), ("a", 3), ("a", 6), ("a", 9), ("b", 0), ("c", 5)], "k string, line int")
    assert {(r.k, r.line): (r.v, r.at) for r in propagation.as_of(asked, said, ["k"], "line", "v").collect()} == {
        ("a", 2): (None, None), ("a", 3): ("x", 3), ("a", 6): ("x", 3), ("a", 9): ("y", 7), ("b", 0): (None, None), ("c", 5): (None, None),
    }


def test_flows_hooks_and_python_imports(spark):
    text = "export function Panel() {\n  const [a, setA] = useState(0);\n  const b = a;\n  useEffect(() => {\n    setA(b);\n  }, [a, b]);\n  useMemo(() => {\n  }, []);\n  const { x, y: z } = b;\n  go(a, b.c);\n  return b;\n}"
    py = "from .near import one, two as three\nfrom ..far.off import (x)\nimport os.path as p\nfrom pkg import y\n"
    files = spark.createDataFrame([(1, "p/src/a.tsx", text), (2, "p/src/m/b.py", py), (3, "p/src/m/near.py", ""), (4, "p/src/far/off/__init__.py", None), (5, "p/pkg.py", "")], "file_id int, path string, content string")
    lines = symbols.lines(files)
    got = {(r.flow, r.source, r.target) for r in flows.flows(lines).collect()}
    assert got >= {("assignment", "a", "b"), ("destructuring", "b", "x"), ("destructuring", "b", "z"), ("argument", "a", "go"), ("argument", "b.c", "go"), ("return", "b", "return"), ("array_destructuring", "useState", "setA"), ("state_update", "b", "A")}
    assert {(r.line, r.hook, r.component, tuple(r.dependencies) if r.dependencies is not None else None) for r in flows.hooks(lines).collect()} == {
        (2, "useState", "Panel", None), (4, "useEffect", "Panel", ("a", "b")), (7, "useMemo", "Panel", ()),
    }
    i = flows.python_targets(flows.python_imports(lines), files.select("path"))
    assert {(r.line, r.level, r.module, r.names, r.target) for r in i.collect()} == {
        (1, 1, "near", "one,two", "p/src/m/near.py"), (2, 2, "far.off", "x", "p/src/far/off/__init__.py"), (3, 0, "os.path", "", None), (4, 0, "pkg", "y", "p/pkg.py"),
    }
    assert flows.flows(lines.limit(0)).count() == 0 and flows.hooks(lines.limit(0)).count() == 0
