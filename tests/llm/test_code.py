import pytest
from graphloom.llm import documented, origin, syntax
from pyspark.sql import functions as F

VALID = {
    "typescript": [
        "", "// only a comment", "const f = <T,>(x: T): T => x;", "let a = b as unknown as Map<string, number[]>;", "type A<T> = T extends (infer U)[] ? U : never;",
        "interface X { readonly a?: string; [k: string]: any; m<T>(x: T): void; new (a: number): X }", "abstract class A<T> extends B<T> implements C, D { private x = 1; constructor(public y?: number) { super(); } abstract m(): void; static { f(); } get v(): number { return 1 } }",
        "enum E { A = 1, B = 'x' }\ndeclare module 'm' { export const x: number; }", "export type { A } from './a';\nexport * as ns from 'b';\nimport type { T } from './t';\nimport D, { type X as Y } from 'd';",
        "function f(this: Window, a: number, ...r: string[]): asserts a is 3 {}", "const x = y! + z?.a?.[0]?.(1) ?? `a${`b${c}`}d`;", "for (const [k, v] of Object.entries(o)) if (k) continue; else break;",
        "let v = a < b && c > d;\nlet w = f<number>(1);\nlet s = a >> 2 >= 1;", "const g = async <T>(a: T) => { await a; };", "let t: [a: string, b?: number, ...c: any[]] = x!;", "label: while (true) { break label }",
        "type M = { readonly [K in keyof T as `get${K}`]-?: () => T[K] };", "function over(a: string): void\nfunction over(a: any) {}", "namespace N.M { export let a = 1 }", "let u = <any>x;",
    ],
    "javascript": [
        "a\nb\n++c", "const {a = 1, ...b} = c, [d, , e = 2] = f;", "({ a, b: c, ['d']: 1, get e() { return 1 }, async *f() {}, ...g });", "const r = /[/\\]]+/g.test(x) / 2;", "x = a ? (b, c) : d => e;",
        "class A extends (B, C) { #p = 1; static async *m() { yield* this.#p; } }", "export default function () {}\nexport { a as default2, b };", "do x++; while (x < 5) y();", "switch (a) { case 1: { } default: b() }",
        "try { a } catch { b } finally { c }", "const e = <div className=\"a\" {...p}>it's {b && <B.C x={`${1}`} />} <>f</></div>;", "new Foo;\nnew a.b.C(1)(2);\nimport('x').then(y => y);\nimport.meta.url;",
        "if (a) b\nelse c", "var f = function* g() {}, h = async x => x, i = async (y) => { for await (const z of y) ; };", "a ||= b; c **= 2; d >>>= 1; `x`", "`<<<<<<< ours`;\n/*\n>>>>>>> x\n*/", "#!/usr/bin/env node\nx", "return_ = 1;",
    ],
    "tsx": ["const A: React.FC<P> = ({ a }: P) => <B<number> />;".replace("<B<number> />", "<B x={a as any} />"), "const f = <T,>(x: T) => <p>Rows & columns</p>;", "function C() { return (<ul>{xs.map((x: any) => (<li key={x.id}>{x!.n}</li>))}</ul>); }"],
    "java": [
        "", "package a.b;\nimport static java.util.List.*;\n@A(x = {1, 2}, y = \"z\") public final class C<T extends D & E> extends F<T> implements G, H { }", "class A { int[] x = {1, 2,}, y[] = new int[3][]; A() { this(1); } <T> A(T t) throws E { super(); } static { } { } }",
        "class A { void m() { for (int i = 0, j = 1; i < 3; i++, j--) ; for (var x : xs) { } Runnable r = () -> { }; f((a, b) -> a + b, String::valueOf, int[]::new, List<String>::new); } }",
        "class A { int f(Object o) { return switch (o.hashCode()) { case 1, 2 -> 3; default -> { yield 4; } }; } }", "record P(int x, @N String y) { P { if (x < 0) throw new E(); } static int z = 1; }", "sealed interface S permits A, B { default void m() { } int C = 1; }\nnon-sealed class A implements S { }",
        "enum E { A(1) { void m() { } }, B; private final int x; E(int... x) { } }", "class A { String s = \"\"\"\n  a \"quoted\" {\n  \"\"\"; char c = '\\''; boolean b = o instanceof String t && t.isEmpty() ? (int) 1L > -2 : !x; }",
        "class A { void m() throws X { try (var r = open(); s) { a.<String>b().c[1]++; } catch (E | F e) { throw e; } finally { } l: while (true) { continue l; } synchronized (this) { } assert a : b; x >>= 2; } }", "@interface N { String value() default \"\"; int[] xs() default {}; }",
        "class A { Map<String, List<int[]>> m = new HashMap<>(); Object o = (Runnable & S) () -> { }; int h = a < b ? c > d ? 1 : 2 : (x) + 3; class I { } }",
    ],
    "python": ["", "match x:\n    case {'a': [1, *_]} if y: pass", "async def f[T](a, /, *, b: int = 1) -> T: return [x async for x in y]", "\ufeffx = 1\r\n"],
}
BROKEN = {
    "typescript": ["const x", "let = ;", "function f( { }", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "a b", "interface { }", "class A { m() ", "const a = <div/>;", "x = 'abc", "if (a) else b", "let a: = 1;", "export function", "`${a", "foo(a,,b)", "a\n=======\nb"],
    "javascript": ["let x: number = 1;", "interface A { }", "const a = b as c;", "a => {", "<p>text", "<a></b>", "class { }", "return 010", "x = {a = 1}", "1 = 2", "} ", "package a.b;", "def f():\n  pass", "# Title\n\nSome text here.", "const wordless", "f(a: b)", "<div>a > b</div>"],
    "java": ["class A {", "class A { void m() { a.b; } }", "class A { int x = ; }", "clas A { }", "class A { void m() { int 1x; } }", "import x", "class A { }\n<<<<<<< a\n", "void m() { }", "class A { String s = \"a; }", "const x = 1;", "class A { void m() { x = 1 } }", "class A { void m() { if a { } } }"],
    "python": ["def f(", "x = = 1", "if x:\nprint(1)", "\x00", "a b", "print 'x'"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    syntax.parsers().parse(language, text)


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken(language, text):
    assert not syntax.parsers().verdict(language, text)[0]


def test_verdicts(spark):
    rows = [
        (1, "p/a.py", "def f(): pass", 1), (2, "p/a.ts", "class A:\n    def f(self):\n        return None\n", 1), (3, "p/b.java", "class A { ", 1), (4, "p/c.js", None, 1), (5, "p/d.txt", "???", 1), (6, "p/e.js", "", 1),
        (7, None, "x", 1), (8, "p/f.js", "a b", 1), (8, "p/f.js", "a + b", 2), (9, "p/g.ts", "const x = [" + "1," * 30000 + "];" + "(" * 3000 + ")" * 2999, 1), (3, "p/b.java", "class A { ", 1),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, t int").withColumns({"ingested_at": F.timestamp_seconds("t").cast("timestamp_ntz"), "valid": F.lit(1), "language": F.lit("x")})
    got = {r.file_id: (r.valid, r.parses_as) for r in syntax.latest(syntax.verdicts(df)).collect()}
    assert got == {1: (True, None), 2: (False, "python"), 3: (False, None), 4: (None, None), 5: (None, None), 6: (True, None), 7: (None, None), 8: (True, None), 9: (False, None)}
    assert sorted(r.file_id for r in syntax.invalid_files(df).collect()) == [2, 3, 9]
    assert syntax.invalid_files(df.limit(0)).count() == 0


def test_rates(spark):
    files = spark.createDataFrame([(1, "P", "P/a.py", "x = 1"), (2, "P", "P/b.py", "x = "), (3, "Q", "Q/c.js", "x: y"), (4, None, "Q/d.py", "class A { }")], "file_id bigint, project string, path string, content string").withColumn("ingested_at", F.lit(None).cast("timestamp_ntz"))
    reports = spark.createDataFrame([("./P\\b.py", " ERROR "), ("P/a.py", "warning"), (None, None)], "file string, severity string")
    got = {(r.project, r.language): (r.n_files, r.n_invalid, r.n_wrong_extension, r.n_invalid_reported, r.n_valid_reported) for r in syntax.rates(files, reports).collect()}
    assert got == {("P", "python"): (2, 1, 0, 1, 0), ("Q", "javascript"): (1, 0, 0, 0, 0), (None, "python"): (1, 1, 1, 0, 0)}


TS = """
/** Reads the cache before it goes stale. */
@dec({ a: 1 })
export class K {
  /** Keeps order, as later stages rely on it. */
  private async load<T>(a: { x: number }, b = () => ({})): Promise<{ y: T }> { return null; }
  /** TODO */
  store() { }
  /** Store. */
  storeIt2() { }
  /** Only declared, no body here at all. */
  abstract gone(): void;
  /** Builds the thing that callers own afterwards. */
  constructor(x) { }
  /** Arrow kept on the instance for event handlers. */
  handler = (e: Event) => e.kind;
  /** Field that counts seconds since the start. */
  count: number = 3;
}
/** Far away from what follows below. */

function far() {}
/** Adds documentation in every language it knows. */
export const go: Fn<A, B> = async (a, b): Promise<void> => { a(); };
/** Falls back to the lock file when nothing else opens. */
export default function named() { return `/** no */`; }
/**
 * @param x
 */
function tagged(x) {}
// plain
/* Not a documentation comment, whatever it says. */
function plain() {}
"""
JAVA = """
class A {
    /** Weights are halved at each hop of the walk. */
    @Timed(name = "x(") public <T extends B> Map<String, int[]> walk(int[] a) throws E { return null; }
    @Deprecated
    /** Callers pass seconds, not milliseconds, to it. */
    A(int x) { }
    /** Number of walks so far in this session. */
    int walks = 0;
    /** {@inheritDoc} */
    public String toString() { return ""; }
    /** Never called twice by the same thread. */
    abstract void none();
}
"""
PY = '''
def a():
    """Gives up after three attempts, then reports."""
class C:
    @dec
    def __init__(self):
        """Init."""
    async def b(self, x):
        r"""Caches by content.

        Args:
            x: more
        """
    def c(self):
        """Args:
            x: only tags
        """
    def d(self):
        x = 1
        """Not a docstring, only a string."""
'''


def test_pairs():
    names = lambda p, t: [(n, x) for n, x, _, _ in documented.pairs_of(p, t)]
    assert names("a.ts", TS) == [(6, "load"), (14, "constructor"), (16, "handler"), (24, "go"), (26, "named")]
    assert names("A.java", JAVA) == [(4, "walk"), (7, "A")]
    assert names("a.py", PY) == [(2, "a"), (8, "b")]
    code = {n: c for _, n, _, c in documented.pairs_of("a.ts", TS)}
    assert code["handler"] == "handler = (e: Event) => e.kind" and code["named"].endswith("`; }")
    assert names("a.ts", TS + "}") == [] and names("a.ts", None) == [] and names("a.ts", "") == [] and names(None, TS) == []


@pytest.mark.parametrize("text,name,trivial", [
    ("", "f", True), ("N/A", "f", True), ("-", "f", True), ("TODO: document this.", "f", True), ("TODO numbers in the scope count too.", "f", False), ("Documentation to follow.", "f", True),
    ("See above.", "f", True), ("This function sorts the orphan suffix.", "sortOrphanSuffix", True), ("Init the value.", "Panel", True), ("Rank scope. It never blocks.", "rankScope", False),
    ("Возвращает пустой список.", "f", False), ("Helper function.", "f", True), ("sort_suffix", "sort_suffix", True), ("Auto-generated stub.", "f", True), ("缓存。", "f", False),
])
def test_trivial(text, name, trivial):
    assert documented.trivial(text, name) is trivial


def test_pairs_frame(spark):
    df = spark.createDataFrame([(1, "a.ts", TS, 1), (1, "a.ts", TS, 1), (2, "b.py", PY, 1), (3, "c.py", None, 1), (4, None, "x", 1)], "file_id bigint, path string, content string, code int").withColumn("ingested_at", F.lit(None).cast("timestamp_ntz"))
    assert documented.documented_functions(df).count() == 7
    later = df.where("file_id = 2").select("file_id", "path", F.lit("x = 1").alias("content"), "code", F.lit("2026-01-01").cast("timestamp_ntz").alias("ingested_at"))
    assert {r.file_id for r in documented.documented_functions(df.unionByName(later)).collect()} == {1}
    assert documented.documented_functions(df, with_text=False).columns == ["file_id", "decl_line", "func_name"]
    assert documented.documented_functions(df.limit(0)).count() == 0


def test_attributes():
    match = lambda g, p: __import__("re").search(origin.glob_pattern(g)[0], p) is not None
    assert match("*.min.js", "a/b/x.min.js") and match("gen/**", "gen/a/b.ts") and not match("gen/*", "gen/a/b.ts") and match("/top.js", "top.js") and not match("/top.js", "a/top.js")
    assert match("**/v/*.js", "a/v/x.js") and match("a[0-9].ts", "q/a1.ts") and not match("a?.ts", "a12.ts") and origin.glob_pattern("# c") is None
    rules = origin.attribute_rules("p/.gitattributes", "*.ts linguist-generated=true text\nkeep.ts -linguist-generated\nold/** linguist-vendored\nx.js linguist-generated=false\n*.md text")
    assert [(f, m) for f, _, _, _, m in rules] == [("p", True), ("p", False), ("p", True), ("p", False)]


def hand(i):
    return f"import {{ x{i} }} from './a{i}';\n\n" + "\n".join(f"export function f{i}_{k}(a, b) {{\n  if (a > {k}) return b;\n  return a + {i * k};\n}}" for k in range(6))


def made(i):
    return "\n".join(f"export class Msg{i}X{k} {{\n  static encode(m, w) {{\n    w.uint32(10).string(m.name{k});\n  }}\n}}" for k in range(6))


def lib(i, patch=""):
    return "\n".join(f"function lib_{i}_{k}(alpha, beta) {{ return alpha.part{k}(beta, {i}); }} // part {k} of {i} {patch if k == 3 else ''}" for k in range(40))


def test_origins(spark):
    rows = [(i, f"p{i % 7}", f"p{i % 7}/src/a{i}.js", hand(i)) for i in range(40)]
    rows += [(100 + i, f"p{i % 7}", f"p{i % 7}/src/g{i}.js", ("// Code generated by tool. DO NOT EDIT.\n" if i % 2 else "") + made(i)) for i in range(12)]
    rows += [(200 + i, f"p{i % 7}", f"p{i % 7}/vendor/lib{i}/x.js", ("/*!\n * lib v1.2.3\n * (c) 2020 lib authors\n * Released under the MIT licence.\n */\n" if i % 2 else "") + lib(i)) for i in range(10)]
    rows += [(300, "p9", "p9/src/copy.js", lib(3)), (301, "p9", "p9/src/patched.js", lib(5, "patched here")), (302, "p9", "p9/src/n.min.js", "function a(b){return b.c(b)}" * 30)]
    rows += [(303, "p9", "p9/src/d.js", "export default [" + "12.5,7,0x1f,\n" * 60 + "];"), (304, "p9", "p9/.gitattributes", "decl/** linguist-generated\ndecl/keep.js -linguist-generated"), (305, "p9", "p9/decl/x.js", hand(99)), (306, "p9", "p9/decl/keep.js", hand(98))]
    rows += [(307, "p9", "p9/vendors/x.js", "// Do not edit the generated files by hand; run make.\n" + hand(97)), (308, "p9", "p9/src/e.js", ""), (309, None, None, None), (310, "p9", "p9/src/l.js", "const icon = '" + "M1 2 L3 4 " * 60 + "';\n" + hand(96))]
    rows += [(311, "p9", "p9/decl/in/.gitattributes", "*.js -linguist-generated\n/b.js linguist-generated"), (312, "p9", "p9/decl/in/a.js", hand(95)), (313, "p9", "p9/decl/in/b.js", hand(94)), (314, "p9", "p9/decl/in/c/b.js", hand(93))]
    rows += [(320 + i, f"s{i}", f"s{i}/.gitattributes", "stubs/*.js linguist-vendored\nmine/** linguist-generated") for i in range(3)] + [(323, "s2", "s2/x/.gitattributes", "mine/** -linguist-generated")]
    rows += [(330 + i, f"p{i}", f"p{i}/stubs/h.js", hand(80 + i)) for i in range(2)] + [(332, "s0", "s0/stubs/h.js", hand(82)), (333, "p1", "p1/mine/h.js", hand(83)), (334, "s0", "s0/vendor/h.js", hand(84)), (335, "p1", "p1/deep/stubs/h.js", hand(85))]
    rows += [rows[-1], rows[0]]
    df = spark.createDataFrame(rows, "file_id bigint, project string, path string, content string").withColumns({"ingested_at": F.lit(None).cast("timestamp_ntz"), "sig": F.lit(1), "class": F.lit(2)})
    got = {}
    for r in origin.origins(df).collect():
        got.setdefault(r.file_id, set()).add(r.reason)
    assert set(got) == {*range(100, 112), *range(200, 210), 300, 301, 302, 303, 305, 311, 313, 330, 331, 332}
    assert {(r.glob, r.source) for r in origin.rules_of(df).collect()} >= {("**/vendor/**", "mined"), ("stubs/*.js", "declared"), ("decl/**", "declared")}
    assert got[305] == {"declared"} and got[300] == {"copy"} and got[301] == {"copy"} and "minified" in got[302] and "data" in got[303] and "tool_shape" in got[100] and "path" in got[200]
    assert origin.not_by_hand(df.limit(0)).count() == 0
