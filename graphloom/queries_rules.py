"""Queries of the rules for types and confidence, applied to what the files and links show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import flows, inference, scoring, symbols, traversal
from .plans.graph_tables import entities, links_now, sql
from .queries_code import _files
from .queries_flows import _DEPS, _HOOKS, _dependencies, _hooks
from .queries_symbols import _LINES, _REFS, _q

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


def _score(factors: dict[str, Column]) -> Column:
    return F.round(scoring.weighted(factors), 6)


# confidence


@query(f"WITH {_HOOKS} SELECT file_id, line, hook, round((0.15 * CASE WHEN regexp_matches(hook, '^use(State|Reducer|Effect|LayoutEffect|InsertionEffect|Context|Ref|ImperativeHandle|Memo|Callback|Transition|DeferredValue)$') THEN 1.0 ELSE 0.7 END + 0.1 * CASE WHEN len(deps) > 0 THEN 1.0 ELSE 0.5 END + 0.1) / 0.35, 6) AS score FROM hooks")
def hook_scores(spark: SparkSession, d: str) -> DataFrame:
    """How sure the calls of hooks are."""
    some = F.coalesce(F.size("dependencies") > 0, F.lit(False))
    return _hooks(spark, d).select("file_id", "line", "hook", _score(scoring.from_hook(F.col("category") == "custom", some, F.lit(True))).alias("score"))


_DEG = "deg AS (SELECT id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT target AS id, 1 AS i, 0 AS o FROM links_now UNION ALL SELECT source, 0, 1 FROM links_now) GROUP BY 1)"


@query(f"WITH {_DEG} SELECT id, round((0.2 * least(1.0, 0.2 * (n_in + n_out)) + 0.1 * CASE WHEN n_in > 0 THEN 1.0 ELSE 0.5 END + 0.03 * least(1.0, 0.25 * (n_in + n_out))) / 0.33, 6) AS score FROM deg", "links_now")
def flow_scores(spark: SparkSession, d: str) -> DataFrame:
    """How sure the flows of each end of links are; an end that nothing flows into is less consistent."""
    deg = traversal.degrees(links_now(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return deg.select(F.col("node").alias("id"), _score(scoring.from_data_flow(F.col("n_in"), F.col("n_out"), F.col("n_in") > 0)).alias("score"))


@query(f"WITH {_DEPS}, e AS (SELECT file_id, entity, count(*) AS n, count_if(regexp_matches(provider, '^[A-Z]')) = count(*) AS typed FROM deps GROUP BY 1, 2) SELECT file_id, entity, round((0.1 * least(1.0, 0.3 * n) + 0.25 * CASE WHEN typed THEN 1.0 ELSE 0.6 END + 0.1 + 0.03 * least(1.0, 0.25 * n)) / 0.48, 6) AS score FROM e")
def injection_scores(spark: SparkSession, d: str) -> DataFrame:
    """How sure the injected dependencies of each entity are; providers named like types are typed."""
    e = _dependencies(spark, d).groupBy("file_id", "entity").agg(F.count("*").alias("n"), F.bool_and(F.col("provider").rlike("^[A-Z]")).alias("typed"))
    return e.select("file_id", "entity", _score(scoring.from_injection(F.col("n"), F.col("typed"), F.lit(False))).alias("score"))


@query(
    f"""WITH {_DEG}, o AS (SELECT source AS id, count_if(type = 'depends_on') AS di, count_if(type = 'uses') AS uses FROM links_now GROUP BY 1), {_HOOKS},
hk AS (SELECT f.path, count(*) AS n FROM hooks h JOIN files f ON f.file_id = h.file_id GROUP BY 1)
SELECT e.id, round((0.25 * least(1.0, coalesce(e.confidence, 0)) + 0.15 * least(1.0, 0.25 * coalesce(hk.n, 0)) + 0.1 * least(1.0, 0.2 * coalesce(o.di, 0)) + 0.02 * least(1.0, 0.3 * coalesce(o.uses, 0)) + 0.03 * least(1.0, 0.15 * (coalesce(hk.n, 0) + coalesce(o.di, 0)))) / 0.55, 6) AS score
FROM entities e LEFT JOIN o ON o.id = e.id LEFT JOIN hk ON hk.path = e.file WHERE e.kind = 'component'""",
    "entities", "links_now",
)
def component_scores(spark: SparkSession, d: str) -> DataFrame:
    """How sure components are: their type, the hooks of their file, what they depend on and use."""
    o = links_now(spark, d).groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("type") == "depends_on").alias("di"), F.count_if(F.col("type") == "uses").alias("uses"))
    hk = _hooks(spark, d).groupBy("file_id").agg(F.count("*").alias("n")).join(_files(spark, d).select("file_id", F.col("path").alias("file")), "file_id").select("file", "n")
    e = entities(spark, d).where("kind = 'component'").join(o, "id", "left").join(hk, "file", "left").na.fill(0, ["di", "uses", "n"])
    return e.select("id", _score(scoring.from_component(F.col("confidence"), F.lit(False), F.col("n"), F.col("di"), F.col("uses"))).alias("score"))


@query(
    f"WITH {_DEG}, s AS (SELECT e.id, round((0.25 * least(1.0, e.confidence) + 0.15 * CASE WHEN type_name IS NULL THEN 0.0 ELSE 1.0 END + 0.03 * least(1.0, 0.3 * coalesce(n_out, 0))) / 0.43, 6) AS score FROM entities e LEFT JOIN deg ON deg.id = e.id) "
    "SELECT id, score, CASE WHEN score >= 0.7 THEN 'high ' WHEN score >= 0.4 THEN 'medium ' ELSE 'low ' END || 'type inference' AS reason FROM s",
    "entities", "links_now",
)
def type_scores(spark: SparkSession, d: str) -> DataFrame:
    """How sure types are, and that in words."""
    deg = traversal.degrees(links_now(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst"))).withColumnRenamed("node", "id")
    e = entities(spark, d).join(deg, "id", "left").na.fill(0, ["n_out"])
    s = e.select("id", _score(scoring.from_type_inference(F.col("confidence"), F.col("type_name").isNotNull(), F.col("n_out"))).alias("score"))
    return s.withColumn("reason", scoring.reason(F.col("score"), "type_inference"))


# types

_LIT = r"(?:true|false|-?[0-9]+(?:\.[0-9]+)?|\"[^\"\n]*\"|'[^'\n]*')"
_BINARY = rf"([A-Za-z0-9_$.'\")\]]+) (\+|-|\*|/|%|===|!==|<=|>=|<|>|&&|\|\|) ({_LIT})"


def _literal_sql(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '^(true|false)$') THEN 'boolean' WHEN regexp_matches({v}, '^-?[0-9]+(\\.[0-9]+)?$') THEN 'number' WHEN regexp_matches({v}, '^[\"'']') THEN 'string' ELSE 'unknown' END"


@query(
    f"""WITH {_LINES}, x AS (SELECT file_id, line, unnest(regexp_extract_all(text, '{_q(_BINARY)}', 0)) AS h FROM lines),
y AS (SELECT file_id, line, regexp_extract(h, '{_q(_BINARY)}', 1) AS l, regexp_extract(h, '{_q(_BINARY)}', 2) AS op, regexp_extract(h, '{_q(_BINARY)}', 3) AS r FROM x),
z AS (SELECT file_id, line, op, {_literal_sql('l')} AS lt, {_literal_sql('r')} AS rt FROM y)
SELECT file_id, line, op, lt AS left_type, rt AS right_type, CASE WHEN op = '+' AND (lt = 'string' OR rt = 'string') THEN 'string' WHEN op IN ('+', '-', '*', '/', '%') THEN 'number' ELSE 'boolean' END AS type FROM z"""
)
def expression_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of expressions with a literal on the right."""
    rows = _lines(spark, d).select("file_id", "line", F.explode(F.regexp_extract_all("text", F.lit(_BINARY), F.lit(0))).alias("h"))
    part = lambda i: F.regexp_extract("h", _BINARY, i)
    each = rows.select("file_id", "line", part(2).alias("op"), inference.literal_type(part(1)).alias("left_type"), inference.literal_type(part(3)).alias("right_type"))
    return each.withColumn("type", inference.binary_type(F.col("left_type"), F.col("op"), F.col("right_type")))


_RET = rf"^[ \t]*return ({_LIT}|null|undefined|\[[^\n]*\]|\{{[^\n]*\}});?[ \t]*$"


@query(
    f"""WITH {_LINES}, dd AS (SELECT *, CASE WHEN regexp_matches(text, '{_q(flows.DECLARES)}') THEN regexp_extract(text, '{_q(flows.DECLARES)}', 1) END AS d FROM lines),
s AS (SELECT file_id, line, text, last_value(d IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line) AS scope FROM dd),
v AS (SELECT file_id, scope, regexp_extract(text, '{_q(_RET)}', 1) AS v FROM s WHERE regexp_matches(text, '{_q(_RET)}')),
t AS (SELECT file_id, scope, CASE WHEN v = 'null' THEN 'null' WHEN v = 'undefined' THEN 'undefined' WHEN starts_with(v, '[') THEN 'array' WHEN starts_with(v, '{{') THEN 'object' ELSE {_literal_sql('v')} END AS type FROM v)
SELECT file_id, scope, array_to_string(list_sort(list(DISTINCT type)), ' | ') AS type, count(*) AS n FROM t GROUP BY 1, 2"""
)
def return_types(spark: SparkSession, d: str) -> DataFrame:
    """What functions return, from the literals they return: one type, or a union."""
    rows = flows.scoped(_lines(spark, d), F.col("text").rlike(_RET))
    t = rows.select("file_id", "scope", inference.literal_type(F.regexp_extract("text", _RET, 1)).alias("type"))
    return t.groupBy("file_id", "scope").agg(F.collect_list("type").alias("l"), F.count("*").alias("n")).select("file_id", "scope", inference.return_type(F.col("l")).alias("type"), "n")


@query(f"""WITH {_REFS}, u AS (SELECT file_id, name, count_if(contains(context, 'call')) > 0 AS c, count_if(contains(context, 'property_access')) > 0 AS p, count_if(contains(context, 'index')) > 0 AS i FROM refs GROUP BY 1, 2)
SELECT file_id, name, CASE WHEN c THEN 'function' WHEN p THEN 'object' WHEN i THEN 'array' ELSE 'unknown' END AS type, CASE WHEN c THEN 0.75::DOUBLE WHEN p OR i THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM u""")
def usage_types(spark: SparkSession, d: str) -> DataFrame:
    """What the uses of a name in a file say about its type."""
    r = symbols.references(_files(spark, d, "content")).groupBy("file_id", "name").agg(F.collect_set("context").alias("contexts"))
    return r.select("file_id", "name", F.inline(F.array(inference.usage_type(F.col("contexts")))))


@query(
    f"""WITH {_DEG}, c AS (SELECT e.id, type_name, confidence, coalesce(n_in, 0) AS n, CASE WHEN lower(type_name) IN ('string', 'number', 'boolean', 'null', 'undefined', 'symbol', 'bigint') THEN 'primitive'
WHEN contains(lower(type_name), 'array') OR contains(type_name, '[]') THEN 'array' WHEN contains(lower(type_name), 'function') OR contains(type_name, '=>') THEN 'function'
WHEN contains(lower(type_name), 'jsx') OR contains(lower(type_name), 'element') THEN 'jsx' WHEN regexp_matches(type_name, '^use[A-Z]') THEN 'hook' WHEN contains(lower(type_name), 'object') THEN 'object' ELSE 'unknown' END AS category
FROM entities e LEFT JOIN deg ON deg.id = e.id WHERE type_name IS NOT NULL)
SELECT id, category, round(least(1.0, (confidence + least(0.15, 0.05 * n)) * CASE WHEN category = 'unknown' THEN 0.5 ELSE 1 END), 6) AS confidence FROM c""",
    "entities", "links_now",
)
def type_categories(spark: SparkSession, d: str) -> DataFrame:
    """The category of each type, and its confidence raised by the links that lead to it."""
    deg = traversal.degrees(links_now(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst"))).withColumnRenamed("node", "id")
    e = entities(spark, d).where("type_name IS NOT NULL").join(deg, "id", "left").na.fill(0, ["n_in"])
    e = e.withColumn("category", inference.type_category(F.col("type_name")))
    return e.select("id", "category", inference.adjusted_confidence(F.col("confidence"), F.col("n_in"), F.lit(False), F.col("category"), 6).alias("confidence"))


@query(
    """SELECT l.edge_id, s.type_name IN ('any', 'unknown') OR t.type_name IN ('any', 'unknown') OR s.type_name = t.type_name OR list_contains(string_split(t.type_name, ' | '), s.type_name) AS compatible
FROM links_now l JOIN entities s ON s.id = l.source JOIN entities t ON t.id = l.target WHERE s.type_name IS NOT NULL AND t.type_name IS NOT NULL""",
    "entities", "links_now",
)
def compatible_links(spark: SparkSession, d: str) -> DataFrame:
    """May the source of a link stand for its target, by their types?"""
    e = entities(spark, d).where("type_name IS NOT NULL").select("id", "type_name")
    both = links_now(spark, d).select("edge_id", "source", "target").join(e.select(F.col("id").alias("source"), F.col("type_name").alias("a")), "source").join(e.select(F.col("id").alias("target"), F.col("type_name").alias("b")), "target")
    return both.select("edge_id", inference.compatible(F.col("a"), F.col("b"), F.lit(False)).alias("compatible"))


_ATTR = r"([A-Za-z][A-Za-z0-9]*)=\{([^\n{}]*)\}"


@query(
    f"""WITH {_LINES}, x AS (SELECT file_id, line, unnest(regexp_extract_all(text, '{_ATTR}', 0)) AS h FROM lines WHERE regexp_matches(path, '\\.(tsx|jsx|js)$')),
p AS (SELECT file_id, line, regexp_extract(h, '{_ATTR}', 1) AS name, CASE WHEN contains(regexp_extract(h, '{_ATTR}', 2), '=>') THEN 'function' ELSE '' END AS kind FROM x)
SELECT file_id, line, name, CASE WHEN kind = 'function' OR regexp_matches(name, '^(on|handle)') THEN 'function' WHEN regexp_matches(name, '(Context|Provider)') THEN 'context' ELSE 'data' END AS category FROM p"""
)
def prop_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """The properties that elements are given, and what kind of dependency each is."""
    rows = _lines(spark, d).where(F.col("path").rlike(r"\.(tsx|jsx|js)$")).select("file_id", "line", F.explode(F.regexp_extract_all("text", F.lit(_ATTR), F.lit(0))).alias("h"))
    kind = F.when(F.contains(F.regexp_extract("h", _ATTR, 2), F.lit("=>")), "function").otherwise("")
    named = rows.select("file_id", "line", F.regexp_extract("h", _ATTR, 1).alias("name"), kind.alias("kind"))
    return named.select("file_id", "line", "name", inference.prop_category(F.col("name"), F.col("kind")).alias("category"))


# links

_KIND = "CASE WHEN type IN ('imports', 're_exports', 'exports') THEN 'module' WHEN type IN ('calls', 'async_calls', 'invokes', 'returns') THEN 'function' WHEN type IN ('extends', 'implements', 'inherits', 'instantiates', 'has_method') THEN 'class' ELSE 'type' END"


@query(f"SELECT {_KIND} AS kind, type, count(*) AS n FROM links_now GROUP BY 1, 2", "links_now")
def relationship_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Whether links are about modules, functions, classes or types."""
    t = F.col("type")
    kind = F.when(t.isin("imports", "re_exports", "exports"), "module").when(t.isin("calls", "async_calls", "invokes", "returns"), "function").when(t.isin("extends", "implements", "inherits", "instantiates", "has_method"), "class").otherwise("type")
    return links_now(spark, d).groupBy(kind.alias("kind"), "type").agg(F.count("*").alias("n"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
