"""Queries of data flows, hooks, injected dependencies, Python imports, types and the documents made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs
from .operators import flows, imports, inference, propagation, symbols
from .plans.graph_tables import all_links, entities, links_now, nodes_now, sql
from .queries_code import _FILES, _files
from .queries_symbols import _LINES, _q

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *names) if names else oracle
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return symbols.lines(_files(spark, d, "content"))


# data flows


def _flows_sql() -> str:
    end = lambda rx, i: f"regexp_extract(text, '{_q(rx)}', {i})" if isinstance(i, int) else f"'{i}'"
    parts = [f"SELECT file_id, line, '{k}' AS flow, {end(rx, s)} AS source, {end(rx, t)} AS target, {c}::DOUBLE AS confidence FROM lines WHERE regexp_matches(text, '{_q(rx)}')" for k, (rx, s, t, c) in flows.FLOWS.items()]
    for k, rx in (("destructuring", flows.OBJECT), ("array_destructuring", flows.ARRAY)):
        inner = f"SELECT file_id, line, {end(rx, 2)} AS s, unnest(list_filter(list_transform(string_split({end(rx, 1)}, ','), lambda x: trim(regexp_replace(regexp_replace(x, '^.*: *', ''), ' *=.*$', ''))), lambda x: x <> '')) AS t FROM lines WHERE regexp_matches(text, '{_q(rx)}')"
        parts.append(f"SELECT file_id, line, '{k}', s, t, 0.95 FROM ({inner})")
    call = _q(flows.CALL)
    hits = f"SELECT file_id, line, unnest(regexp_extract_all(text, '{call}', 0)) AS h FROM lines"
    args = f"SELECT file_id, line, regexp_extract(h, '{call}', 1) AS f, unnest(string_split(regexp_extract(h, '{call}', 2), ', ')) AS a FROM ({hits})"
    parts.append(f"SELECT file_id, line, 'argument', a, f, 0.9 FROM ({args}) WHERE f NOT IN ({', '.join(repr(w) for w in flows.NO_CALLS)})")
    return f"{_LINES}, flows AS ({' UNION ALL '.join(parts)})"


_FLOWS = _flows_sql()


@query(f"WITH {_FLOWS} SELECT file_id, line, flow, source, target, confidence FROM flows")
def code_flows(spark: SparkSession, d: str) -> DataFrame:
    """Where values go, line by line."""
    return flows.flows(_lines(spark, d))


@query(f"WITH {_FLOWS} SELECT flow, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets, count(DISTINCT file_id) AS n_files FROM flows GROUP BY 1")
def code_flow_statistics(spark: SparkSession, d: str) -> DataFrame:
    return flows.flows(_lines(spark, d)).groupBy("flow").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"), F.countDistinct("file_id").alias("n_files"))


@query(f"WITH {_FLOWS}, e AS (SELECT file_id, source AS name, 1 AS o, 0 AS i FROM flows UNION ALL SELECT file_id, target, 0, 1 FROM flows) SELECT file_id, name, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM e GROUP BY 1, 2")
def flow_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The names of each file as nodes of its flow graph."""
    e = flows.flows(_lines(spark, d)).select("file_id", F.inline(F.array(F.struct(F.col("source").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return e.groupBy("file_id", "name").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


_STATE = _q(inference.STATE)


@query(
    f"""WITH {_LINES}, s AS (SELECT file_id, line AS at, regexp_extract(text, '{_STATE}', 1) AS state FROM lines WHERE regexp_matches(text, '{_STATE}')),
w AS (SELECT file_id, line, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*', 0))) AS name FROM lines)
SELECT s.file_id, state, count(*) AS n_reads, min(w.line) AS first_line FROM s JOIN w ON w.file_id = s.file_id AND w.name = s.state AND w.line > s.at GROUP BY 1, 2"""
)
def state_reads(spark: SparkSession, d: str) -> DataFrame:
    """Lines below its declaration that read a state."""
    text = _lines(spark, d)
    s = text.where(F.col("text").rlike(inference.STATE)).select("file_id", F.col("line").alias("at"), F.regexp_extract("text", inference.STATE, 1).alias("name"))
    w = text.join(s.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("name"))
    return s.join(w, ["file_id", "name"]).where("line > at").groupBy("file_id", F.col("name").alias("state")).agg(F.count("*").alias("n_reads"), F.min("line").alias("first_line"))


# hooks

_HOOK, _CLOSES = _q(imports.HOOK_CALL), _q(flows.CLOSES)
_CAPITAL = r"^[ \t]*(?:export )?(?:default )?(?:async )?(?:function|class|const) ([A-Z][A-Za-z0-9_$]*)"
_HOOKS = f"""{_LINES}, told AS (SELECT file_id, line, regexp_matches(text, '{_HOOK}') AS called, regexp_matches(text, '{_CLOSES}') AS closes, regexp_extract(text, '{_HOOK}', 1) AS hook, regexp_extract(text, '{_CLOSES}', 1) AS list,
  last_value(CASE WHEN regexp_matches(text, '{_CAPITAL}') THEN regexp_extract(text, '{_CAPITAL}', 1) END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line) AS component FROM lines),
marks AS (SELECT *, lead(closes) OVER w AS after, lead(list) OVER w AS next_list FROM told WHERE called OR closes WINDOW w AS (PARTITION BY file_id ORDER BY line)),
hooks AS (SELECT file_id, line, hook, component, CASE WHEN after THEN list_filter(regexp_split_to_array(next_list, ', *'), lambda x: x <> '') END AS deps FROM marks WHERE called)"""
_CATEGORY = exprs.sql_case("hook", imports.HOOKS, "custom")


def _hooks(spark: SparkSession, d: str) -> DataFrame:
    return flows.hooks(_lines(spark, d)).withColumn("category", exprs.mapped(F.col("hook"), imports.HOOKS, "custom"))


@query(f"""WITH {_HOOKS} SELECT file_id, line, hook, component, {_CATEGORY} AS category, deps IS NOT NULL AS has_list, CAST(coalesce(len(deps), 0) AS INT) AS n_dependencies,
CASE WHEN {_CATEGORY} <> 'effect' THEN NULL WHEN deps IS NULL THEN 'always' WHEN len(deps) = 0 THEN 'mount' ELSE 'update' END AS runs FROM hooks""")
def hook_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every call of a hook with its component, category and dependencies."""
    h = _hooks(spark, d)
    runs = F.when(F.col("category") == "effect", imports.effect_type(F.col("dependencies")))
    return h.select("file_id", "line", "hook", "component", "category", F.col("dependencies").isNotNull().alias("has_list"), F.coalesce(F.size("dependencies"), F.lit(0)).alias("n_dependencies"), runs.alias("runs"))


@query(f"WITH {_HOOKS} SELECT file_id, component, count(*) AS n_hooks, count(DISTINCT hook) AS n_kinds, CAST(count_if({_CATEGORY} = 'state') AS BIGINT) AS n_state, CAST(count_if({_CATEGORY} = 'effect') AS BIGINT) AS n_effect FROM hooks GROUP BY 1, 2")
def hooks_of_components(spark: SparkSession, d: str) -> DataFrame:
    h = _hooks(spark, d)
    return h.groupBy("file_id", "component").agg(F.count("*").alias("n_hooks"), F.countDistinct("hook").alias("n_kinds"), F.count_if(F.col("category") == "state").alias("n_state"), F.count_if(F.col("category") == "effect").alias("n_effect"))


@query(
    f"""WITH {_HOOKS}, x AS (SELECT file_id, line, hook, unnest(deps) AS dependency FROM hooks)
SELECT file_id, line, hook, dependency, CASE WHEN contains(dependency, '.') THEN 'property' WHEN regexp_matches(dependency, '^(set|on|handle)[A-Z]') THEN 'function' ELSE 'variable' END AS type, regexp_matches(dependency, '^(set[A-Z]|dispatch$)') AS is_stable FROM x"""
)
def hook_dependency_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the lists of hooks name; setters of states never change."""
    x = _hooks(spark, d).select("file_id", "line", "hook", F.explode("dependencies").alias("dependency"))
    kind = F.when(F.contains("dependency", F.lit(".")), "property").when(F.col("dependency").rlike("^(set|on|handle)[A-Z]"), "function").otherwise("variable")
    return x.withColumns({"type": kind, "is_stable": F.col("dependency").rlike("^(set[A-Z]|dispatch$)")})


# injected dependencies

_CTOR = _q(inference.CONSTRUCTOR)
_TS = r"^(?:(?:public|private|protected|readonly) )*([A-Za-z_$][A-Za-z0-9_$]*)\??(?: *: *([A-Za-z_$][A-Za-z0-9_$.]*))?"
_JAVA = r"^(?:final )?([A-Z][A-Za-z0-9_.]*)(?:\[\])* ([A-Za-z_][A-Za-z0-9_]*)$"
_INJECTED = f"""{_LINES}, cp AS (SELECT file_id, line, unnest(regexp_split_to_array(regexp_replace(regexp_extract(text, '{_CTOR}', 1), '<[^<>]*(<[^<>]*>)?[^<>]*>', '', 'g'), ' *, *')) AS p FROM lines WHERE regexp_matches(text, '{_CTOR}')),
cn AS (SELECT file_id, line, CASE WHEN regexp_matches(p, '{_JAVA}') THEN regexp_extract(p, '{_JAVA}', 2) ELSE regexp_extract(p, '{_TS}', 1) END AS parameter,
  CASE WHEN regexp_matches(p, '{_JAVA}') THEN regexp_extract(p, '{_JAVA}', 1) ELSE regexp_extract(p, '{_TS}', 2) END AS kind FROM cp WHERE trim(p) <> ''),
ctor AS (SELECT file_id, line, parameter, CASE WHEN kind <> '' THEN kind ELSE parameter END AS provider FROM cn)"""


@query(f"WITH {_INJECTED} SELECT provider, count(*) AS n, count(DISTINCT file_id) AS n_files FROM ctor GROUP BY 1")
def constructor_injection(spark: SparkSession, d: str) -> DataFrame:
    """Providers by how many constructors take them."""
    c = inference.constructor_injection(_lines(spark, d))
    return c.groupBy("provider").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


_PROP = r"^[ \t]*this\.([A-Za-z_$][A-Za-z0-9_$]*) = (new )?([A-Za-z_$][A-Za-z0-9_$]*)(?:\([^\n]*\))?;?[ \t\r]*$"
_DEPS = f"""{_INJECTED}, dd AS (SELECT file_id, line, text, CASE WHEN regexp_matches(text, '{_q(flows.DECLARES)}') THEN regexp_extract(text, '{_q(flows.DECLARES)}', 1) END AS d FROM lines),
scope AS (SELECT file_id, line, last_value(d IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line) AS entity FROM dd),
deps AS (SELECT x.file_id, x.line, s.entity, kind, provider FROM (SELECT file_id, line, 'constructor' AS kind, provider FROM ctor
  UNION ALL SELECT file_id, line, CASE WHEN regexp_extract(text, '{_PROP}', 2) <> '' THEN 'created' ELSE 'property' END, regexp_extract(text, '{_PROP}', 3) FROM lines WHERE regexp_matches(text, '{_PROP}')
  UNION ALL SELECT file_id, line, 'hook', regexp_extract(text, '{_HOOK}', 1) FROM lines WHERE regexp_matches(text, '{_HOOK}')) x JOIN scope s ON s.file_id = x.file_id AND s.line = x.line)"""


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    text = _lines(spark, d)
    ctor = inference.constructor_injection(text).select("file_id", "line", F.lit("constructor").alias("kind"), "provider")
    prop = inference.property_injection(text).select("file_id", "line", F.when(F.col("created"), "created").otherwise("property").alias("kind"), "provider")
    called = F.col("text").rlike(imports.HOOK_CALL)
    hook = text.where(called).select("file_id", "line", F.lit("hook").alias("kind"), F.regexp_extract("text", imports.HOOK_CALL, 1).alias("provider"))
    keep = called | F.col("text").rlike(inference.CONSTRUCTOR) | F.col("text").rlike(_PROP)
    scope = flows.scoped(text, keep).select("file_id", "line", F.col("scope").alias("entity"))
    return ctor.unionByName(prop).unionByName(hook).join(scope, ["file_id", "line"])


@query(f"WITH {_DEPS} SELECT file_id, entity, kind, count(*) AS n FROM deps GROUP BY 1, 2, 3")
def injected_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities and how many dependencies of each kind they have."""
    return flows.entities(_dependencies(spark, d))


@query(f"WITH {_DEPS} SELECT provider, kind, count(DISTINCT entity) AS n_consumers, count(DISTINCT file_id) AS n_files FROM deps GROUP BY 1, 2")
def dependency_consumers(spark: SparkSession, d: str) -> DataFrame:
    """Who takes each provider, by the way it is handed over."""
    return _dependencies(spark, d).groupBy("provider", "kind").agg(F.countDistinct("entity").alias("n_consumers"), F.countDistinct("file_id").alias("n_files"))


@query(f"WITH {_DEPS} SELECT file_id, line, entity, kind, provider, CASE WHEN kind = 'hook' THEN 'component' WHEN regexp_matches(provider, '(Service|API)$') THEN 'service' WHEN regexp_matches(provider, 'Config$') THEN 'configuration' ELSE 'service' END AS category FROM deps")
def dependency_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every dependency that is handed to an entity, with its category."""
    module = F.when(F.col("kind") == "hook", "react").otherwise("")
    return _dependencies(spark, d).withColumn("category", imports.di_category(F.col("provider"), module)).select("file_id", "line", "entity", "kind", "provider", "category")


# imports

_FROM, _IMP = _q(flows.FROM), _q(flows.IMPORT)
_PY = f"""{_LINES}, py AS (SELECT file_id, path, line, CAST(length(regexp_extract(text, '{_FROM}', 1)) AS INT) AS level, CASE WHEN regexp_matches(text, '{_IMP}') THEN regexp_extract(text, '{_IMP}', 1) ELSE regexp_extract(text, '{_FROM}', 2) END AS module,
CASE WHEN regexp_matches(text, '{_IMP}') THEN '' ELSE array_to_string(list_transform(string_split(regexp_replace(regexp_extract(text, '{_FROM}', 3), '[()]', '', 'g'), ','), lambda x: trim(regexp_replace(x, ' as .*$', ''))), ',') END AS names
FROM lines WHERE path LIKE '%.py' AND (regexp_matches(text, '{_FROM}') OR regexp_matches(text, '{_IMP}')))"""


@query(f"WITH {_PY} SELECT file_id, line, level, module, names FROM py")
def python_imports(spark: SparkSession, d: str) -> DataFrame:
    return flows.python_imports(_lines(spark, d)).drop("path")


@query(
    f"""WITH {_PY}, b AS (SELECT file_id, line, module, level, array_to_string(string_split(path, '/')[1:CASE WHEN level = 0 THEN 1 ELSE len(string_split(path, '/')) - level END], '/') || CASE WHEN module <> '' THEN '/' || replace(module, '.', '/') ELSE '' END AS p FROM py),
t AS (SELECT file_id, line, arg_min(f, o) AS target FROM (SELECT file_id, line, 0 AS o, p || '.py' AS f FROM b UNION ALL SELECT file_id, line, 1, p || '/__init__.py' FROM b) WHERE f IN (SELECT path FROM files) GROUP BY 1, 2)
SELECT b.file_id, coalesce(t.target, CASE WHEN level > 0 THEN 'missing:' ELSE 'external:' END || module) AS target, count(*) AS n FROM b LEFT JOIN t ON t.file_id = b.file_id AND t.line = b.line GROUP BY 1, 2"""
)
def python_import_edges(spark: SparkSession, d: str) -> DataFrame:
    """What Python files import: stored files, modules outside, or relative modules that are missing."""
    f = _files(spark, d, "content")
    i = flows.python_targets(flows.python_imports(symbols.lines(f)), f.select("path"))
    away = F.concat(F.when(F.col("level") > 0, "missing:").otherwise("external:"), "module")
    return i.groupBy("file_id", F.coalesce("target", away).alias("target")).agg(F.count("*").alias("n"))


_ES6 = _q(imports.ES6)


@query(
    f"""WITH {_FILES}, i AS (SELECT file_id, path, unnest(regexp_extract_all(content, '{_ES6}', 2)) AS module FROM files WHERE content IS NOT NULL),
b AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || module AS p0 FROM i), c AS (SELECT *, regexp_replace(regexp_replace(p0, '/(\\./)+', '/', 'g'), '/[^/.]+/\\.\\./', '/') AS p FROM b),
k AS (SELECT DISTINCT file_id, module, p FROM c WHERE starts_with(module, '.')),
t AS (SELECT file_id, module, arg_min(f, o) AS target FROM (SELECT file_id, module, o, CASE WHEN o < 10 THEN p ELSE regexp_replace(p, '\\.(js|jsx|mjs)$', '') END || ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.json', '/index.ts', '/index.tsx', '/index.js'][o % 10 + 1] AS f FROM k, (SELECT unnest(range(20)) AS o)) WHERE f IN (SELECT path FROM files) GROUP BY 1, 2)
SELECT i.file_id, coalesce(t.target, CASE WHEN starts_with(i.module, '.') THEN 'missing:' ELSE 'external:' END || i.module) AS target, count(*) AS n FROM i LEFT JOIN t ON t.file_id = i.file_id AND t.module = i.module GROUP BY 1, 2"""
)
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """What script files import: stored files, packages outside, or relative modules that are missing."""
    f = _files(spark, d, "content")
    i = imports.resolve(imports.es6_imports(f), f.select("path"))
    away = F.concat(F.when(F.startswith("module", F.lit(".")), "missing:").otherwise("external:"), "module")
    return i.groupBy("file_id", F.coalesce("target", away).alias("target")).agg(F.count("*").alias("n"))


# types


@query(
    f"""WITH {_LINES}, v AS (SELECT file_id, line, regexp_extract(text, '^[ \\t]*(?:const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS name, regexp_extract(text, ': ([A-Za-z]+)(?:<[^=]*>)? =', 1) AS type FROM lines WHERE regexp_matches(text, '^[ \\t]*(?:const|let|var) [A-Za-z_$][A-Za-z0-9_$]*: [A-Za-z]+')),
r AS (SELECT file_id, line, regexp_extract(text, '^[ \\t]*([A-Za-z_$][A-Za-z0-9_$]*)\\.[a-z]', 1) AS name FROM lines WHERE regexp_matches(text, '^[ \\t]*([A-Za-z_$][A-Za-z0-9_$]*)\\.[a-z]'))
SELECT r.file_id, r.line, r.name, v.line AS declared, v.type FROM r ASOF JOIN (SELECT * FROM v WHERE type <> '') v ON v.file_id = r.file_id AND v.name = r.name AND r.line >= v.line"""
)
def types_at_uses(spark: SparkSession, d: str) -> DataFrame:
    """The type that a variable has where a line calls a method of it: that of its last declaration before."""
    text = _lines(spark, d)
    var, ret = r"^[ \t]*(?:const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*)", r"^[ \t]*([A-Za-z_$][A-Za-z0-9_$]*)\.[a-z]"
    v = text.where(F.col("text").rlike(var + ": [A-Za-z]+")).select("file_id", "line", F.regexp_extract("text", var, 1).alias("name"), F.regexp_extract("text", ": ([A-Za-z]+)(?:<[^=]*>)? =", 1).alias("type")).where("type <> ''")
    r = text.where(F.col("text").rlike(ret)).select("file_id", "line", F.regexp_extract("text", ret, 1).alias("name"))
    return propagation.as_of(r, v, ["file_id", "name"], "line", "type").where("type IS NOT NULL").select("file_id", "line", "name", F.col("at").alias("declared"), "type")


@query()
def propagated_everywhere(spark: SparkSession, d: str) -> DataFrame:
    """Types carried along links until nothing changes."""
    typed = entities(spark, d).where("type_name IS NOT NULL").select(F.col("id").alias("node"), F.col("type_name").alias("type"), "confidence")
    e = links_now(spark, d).where(F.col("type").isin("uses", "references", "returns")).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return propagation.spread(typed, e, 0.95).select("node", "type", "distance", F.round("confidence", 6).alias("confidence"))


# enrichment of nodes by what their files say

_TYPED = r"^[ \t]*(?:const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*)(?:: ([A-Za-z]+))?"


@query(
    f"""WITH {_FLOWS}, n AS (SELECT n.id, n.name, n.type, f.file_id FROM nodes_now n JOIN files f ON f.path = n.file), deg AS (SELECT file_id, source AS name, count(*) AS n_flows FROM flows GROUP BY 1, 2),
hk AS (SELECT file_id, count(*) AS n_hooks FROM lines WHERE regexp_matches(text, '{_HOOK}') GROUP BY 1)
SELECT n.id, n.type, coalesce(n_flows, 0) AS n_flows, CASE WHEN n.type = 'component' THEN coalesce(n_hooks, 0) ELSE 0 END AS n_hooks FROM n LEFT JOIN deg ON deg.file_id = n.file_id AND deg.name = n.name LEFT JOIN hk ON hk.file_id = n.file_id""",
    "nodes_now",
)
def enriched_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of stored files with the flows that start from their names and, for components, the hooks of their file."""
    f = _files(spark, d, "content")
    text = symbols.lines(f)
    n = nodes_now(spark, d).select("id", "name", "type", F.col("file").alias("path")).join(f.select("file_id", "path"), "path")
    deg = flows.flows(text).groupBy("file_id", F.col("source").alias("name")).agg(F.count("*").alias("n_flows"))
    hk = text.where(F.col("text").rlike(imports.HOOK_CALL)).groupBy("file_id").agg(F.count("*").alias("n_hooks"))
    both = n.join(deg, ["file_id", "name"], "left").join(hk, "file_id", "left").na.fill(0, ["n_flows", "n_hooks"])
    return both.select("id", "type", "n_flows", F.when(F.col("type") == "component", F.col("n_hooks")).otherwise(0).alias("n_hooks"))


# documents


@query(f"WITH {_FLOWS} SELECT file_id, line, CAST(to_json({{'flow': flow, 'source': source, 'target': target}}) AS VARCHAR) AS document FROM flows")
def flow_documents(spark: SparkSession, d: str) -> DataFrame:
    return flows.flows(_lines(spark, d)).select("file_id", "line", F.to_json(F.struct("flow", "source", "target")).alias("document"))


@query(f"WITH {_HOOKS} SELECT file_id, line, CAST(to_json({{'hook': hook, 'component': coalesce(component, ''), 'dependencies': coalesce(deps, [])}}) AS VARCHAR) AS document FROM hooks")
def hook_documents(spark: SparkSession, d: str) -> DataFrame:
    h = _hooks(spark, d)
    doc = F.to_json(F.struct("hook", F.coalesce("component", F.lit("")).alias("component"), F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies")))
    return h.select("file_id", "line", doc.alias("document"))


@query(f"WITH {_DEPS} SELECT file_id, line, CAST(to_json({{'entity': coalesce(entity, ''), 'kind': kind, 'provider': provider}}) AS VARCHAR) AS document FROM deps")
def injection_documents(spark: SparkSession, d: str) -> DataFrame:
    return _dependencies(spark, d).select("file_id", "line", F.to_json(F.struct(F.coalesce("entity", F.lit("")).alias("entity"), "kind", "provider")).alias("document"))


@query("SELECT src AS node, CAST(to_json({'node': src, 'providers': list_sort(list(dst))}) AS VARCHAR) AS document FROM all_links GROUP BY src", "all_links")
def dependency_documents(spark: SparkSession, d: str) -> DataFrame:
    e = all_links(spark, d).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("providers"))
    return e.select("node", F.to_json(F.struct("node", "providers")).alias("document"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
