"""Queries over symbols, references, inferred types, flows and injected dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs
from .operators import inference, symbols
from .queries_code import _FILES, _files

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _q(rx: str) -> str:
    return rx.replace("'", "''")


_LINES = f"""{_FILES}, lines AS (SELECT file_id, path, CAST(unnest(generate_series(1, len(t))) AS INT) AS line, unnest(t) AS text FROM (
SELECT file_id, path, string_split(replace(content, chr(13), ''), chr(10)) AS t FROM files WHERE content IS NOT NULL))"""
_D = _q(symbols.DECLARED)
_SYMBOLS = f"""{_LINES}, syms AS (SELECT file_id, path, line, regexp_extract(text, '{_D}', 4) AS name, {exprs.sql_case(f"regexp_extract(text, '{_D}', 3)", symbols.KINDS, "x")} AS symbol_type,
regexp_extract(text, '{_D}', 1) <> '' AS is_exported, regexp_extract(text, '{_D}', 2) <> '' AS is_default FROM lines WHERE regexp_matches(text, '{_D}'))"""
_HITS = " UNION ALL ".join(f"SELECT file_id, path, line, text, unnest(regexp_extract_all(text, '{_q(rx)}', 1)) AS name, '{k}' AS context FROM lines" for k, rx in symbols.CONTEXTS.items())
_REFS = f"""{_SYMBOLS}, refs AS (SELECT file_id, path, line, name, context FROM ({_HITS}) WHERE name NOT IN ({", ".join(repr(k) for k in symbols.KEYWORDS)})
AND NOT (context = 'call' AND regexp_matches(text, '{_D}') AND regexp_extract(text, '{_D}', 4) = name))"""


@query(f"WITH {_SYMBOLS} SELECT file_id, line, name, symbol_type, is_exported, is_default FROM syms")
def declared_symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbols.symbols(_files(spark, d, "content")).drop("path")


@query(f"WITH {_SYMBOLS} SELECT file_id, name FROM syms WHERE is_exported AND is_default")
def default_exports(spark: SparkSession, d: str) -> DataFrame:
    return symbols.symbols(_files(spark, d, "content")).where("is_exported AND is_default").select("file_id", "name")


@query(f"WITH {_REFS} SELECT context, count(*) AS n, count(DISTINCT name) AS n_names, count(DISTINCT file_id) AS n_files FROM refs GROUP BY 1")
def references_by_context(spark: SparkSession, d: str) -> DataFrame:
    r = symbols.references(_files(spark, d, "content"))
    return r.groupBy("context").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"), F.countDistinct("file_id").alias("n_files"))


@query(
    f"""WITH {_REFS} SELECT n_symbols, n_names, n_files, n_exported, n_references FROM (SELECT count(*) AS n_symbols, count(DISTINCT name) AS n_names, count(DISTINCT file_id) AS n_files,
CAST(count_if(is_exported) AS BIGINT) AS n_exported FROM syms), (SELECT count(*) AS n_references FROM refs)"""
)
def symbol_statistics(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d, "content")
    return symbols.statistics(symbols.symbols(f), symbols.references(f))


_RESOLVED = f"""{_REFS}, own AS (SELECT file_id, name, min(line) AS l FROM syms GROUP BY 1, 2),
best AS (SELECT name, file_id AS f, line AS l FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_exported DESC, file_id, line) AS rn FROM syms) WHERE rn = 1),
res AS (SELECT r.*, coalesce(own.file_id, best.f) AS target_file, CASE WHEN own.file_id IS NOT NULL THEN own.l ELSE best.l END AS target_line,
  CASE WHEN own.file_id IS NOT NULL THEN 'same_file' WHEN best.f IS NOT NULL THEN 'any_file' END AS step
  FROM refs r LEFT JOIN own ON own.file_id = r.file_id AND own.name = r.name LEFT JOIN best ON best.name = r.name)"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d, "content")
    return symbols.resolved(symbols.references(f), symbols.symbols(f), f)


@query(f"WITH {_RESOLVED} SELECT coalesce(step, 'none') AS step, context, count(*) AS n, CAST(sum(coalesce(target_line, 0)) AS BIGINT) AS lines FROM res GROUP BY 1, 2")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """References by the step that resolved them (in these tables no import leads to a stored file)."""
    r = _resolved(spark, d)
    return r.groupBy(F.coalesce("step", F.lit("none")).alias("step"), "context").agg(F.count("*").alias("n"), F.sum(F.coalesce("target_line", F.lit(0))).alias("lines"))


@query(f"WITH {_RESOLVED} SELECT file_id AS source_file, coalesce(CAST(target_file AS VARCHAR), 'external:' || name) AS target, {exprs.sql_case('context', symbols.EDGE_OF_CONTEXT, 'calls')} AS type, count(*) AS n FROM res GROUP BY 1, 2, 3")
def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return symbols.edges(_resolved(spark, d))


@query(f"WITH {_REFS} SELECT name, name IN ({', '.join(repr(b) for b in symbols.BUILTINS)}) AS is_builtin, count(*) AS n FROM refs WHERE context = 'call' AND name NOT IN (SELECT name FROM syms) GROUP BY 1")
def external_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of names that no file declares."""
    f = _files(spark, d, "content")
    r = symbols.references(f).where("context = 'call'").join(symbols.symbols(f).select("name").distinct(), "name", "left_anti")
    return r.groupBy("name").agg(F.count("*").alias("n")).select("name", symbols.is_builtin(F.col("name")).alias("is_builtin"), "n")


@query(
    f"""WITH {_REFS}, c AS (SELECT name, arg_min(file_id, (file_id, line)) AS f FROM syms WHERE symbol_type IN ('function', 'class', 'variable') GROUP BY 1)
SELECT DISTINCT r.file_id AS source_file, c.f AS target_file, r.name FROM refs r JOIN c ON c.name = r.name WHERE r.context = 'jsx' AND c.f <> r.file_id"""
)
def render_edges(spark: SparkSession, d: str) -> DataFrame:
    """Elements rendered from components that other files declare; the first declaration counts."""
    f = _files(spark, d, "content")
    s = symbols.symbols(f).where(F.col("symbol_type").isin("function", "class", "variable"))
    c = s.groupBy("name").agg(F.min_by("file_id", F.struct("file_id", "line")).alias("target_file"))
    r = symbols.references(f).where("context = 'jsx'").join(c, "name").where("target_file <> file_id")
    return r.select(F.col("file_id").alias("source_file"), "target_file", "name").distinct()


_L = _q(inference.LITERAL)
_V = f"regexp_extract(text, '{_L}', 3)"


@query(
    f"""WITH {_LINES} SELECT file_id, line, regexp_extract(text, '{_L}', 2) AS name, CASE WHEN regexp_matches(v, '^(true|false)$') THEN 'boolean' WHEN regexp_matches(v, '^-?(0x[0-9a-fA-F]+|[0-9][0-9_]*(\\.[0-9]+)?)$') THEN 'number'
WHEN regexp_matches(v, '^[''"`]') THEN 'string' WHEN v = 'null' THEN 'null' WHEN v = 'undefined' THEN 'undefined' WHEN regexp_matches(v, '^\\[') THEN 'array' WHEN regexp_matches(v, '^\\{{') THEN 'object'
WHEN regexp_matches(v, '^(async )?(function\\b|\\([^()]*\\)[^=]*=>|[A-Za-z_$][A-Za-z0-9_$]* =>)') THEN 'function' WHEN regexp_matches(v, '^/[^/*]') THEN 'regexp'
WHEN regexp_matches(v, '^new [A-Z]') THEN regexp_extract(v, '^new ([A-Za-z0-9_$]+)', 1) ELSE 'unknown' END AS type,
CASE WHEN regexp_extract(text, '{_L}', 1) = 'const' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM (SELECT *, {_V} AS v FROM lines WHERE regexp_matches(text, '{_L}'))"""
)
def inferred_types(spark: SparkSession, d: str) -> DataFrame:
    return inference.declared_types(symbols.lines(_files(spark, d, "content")))


@query(
    f"""WITH {_LINES} SELECT file_id, line, regexp_extract(text, 'if \\(!?([A-Za-z_$][A-Za-z0-9_$]*)\\)', 1) AS name, 'truthy' AS type, 0.7::DOUBLE AS confidence FROM lines WHERE regexp_matches(text, 'if \\(!?([A-Za-z_$][A-Za-z0-9_$]*)\\)')
UNION ALL SELECT file_id, line, regexp_extract(text, '\\(([A-Za-z_$][A-Za-z0-9_$]*) *[<>]=? *[0-9]', 1), 'number', 0.9 FROM lines WHERE regexp_matches(text, '\\(([A-Za-z_$][A-Za-z0-9_$]*) *[<>]=? *[0-9]')
UNION ALL SELECT file_id, line, regexp_extract(text, 'typeof ([A-Za-z_$][A-Za-z0-9_$]*) *===? *[''"]([a-z]+)[''"]', 1), regexp_extract(text, 'typeof ([A-Za-z_$][A-Za-z0-9_$]*) *===? *[''"]([a-z]+)[''"]', 2), 0.95 FROM lines WHERE regexp_matches(text, 'typeof ([A-Za-z_$][A-Za-z0-9_$]*) *===? *[''"]([a-z]+)[''"]')"""
)
def narrowed_types(spark: SparkSession, d: str) -> DataFrame:
    return inference.narrowed(symbols.lines(_files(spark, d, "content")))


_S = _q(inference.STATE)


@query(
    f"""WITH {_LINES}, s AS (SELECT file_id, line, regexp_extract(text, '{_S}', 1) AS state, regexp_extract(text, '{_S}', 2) AS setter, regexp_extract(text, '{_S}', 3) AS v FROM lines WHERE regexp_matches(text, '{_S}'))
SELECT file_id, line, state, setter, 'state_init' AS flow, v AS source, 0.95::DOUBLE AS confidence FROM s WHERE v <> '' UNION ALL SELECT file_id, line, state, setter, 'state_update', setter, 1.0 FROM s"""
)
def state_flows(spark: SparkSession, d: str) -> DataFrame:
    return inference.state_flows(symbols.lines(_files(spark, d, "content")))


_M = "([A-Za-z_$][A-Za-z0-9_$]*)\\.([A-Za-z_$][A-Za-z0-9_$]*)"


@query(
    f"""WITH {_LINES}, m AS (SELECT text, unnest(regexp_extract_all(text, '{_M}', 0)) AS hit FROM lines)
SELECT CASE WHEN regexp_extract(text, '^[ \\t]*({_M}) = ', 1) = hit THEN 'bidirectional' ELSE 'forward' END AS direction, count(*) AS n, count(DISTINCT hit) AS n_members FROM m GROUP BY 1"""
)
def member_flow_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = inference.member_flows(symbols.lines(_files(spark, d, "content")))
    return m.groupBy("direction").agg(F.count("*").alias("n"), F.countDistinct("object", "property").alias("n_members"))


@query(
    f"""WITH {_LINES} SELECT file_id, line, regexp_extract(text, rx, 1) AS property, regexp_extract(text, rx, 3) AS provider, regexp_extract(text, rx, 2) <> '' AS created
FROM (SELECT *, '^[ \\t]*this\\.([A-Za-z_$][A-Za-z0-9_$]*) = (new )?([A-Za-z_$][A-Za-z0-9_$]*)(?:\\([^\\n]*\\))?;?[ \\t\\r]*$' AS rx FROM lines) WHERE regexp_matches(text, rx)""".replace("regexp_extract(text, rx,", "regexp_extract(text, '^[ \\t]*this\\.([A-Za-z_$][A-Za-z0-9_$]*) = (new )?([A-Za-z_$][A-Za-z0-9_$]*)(?:\\([^\\n]*\\))?;?[ \\t\\r]*$',")
)
def property_injection(spark: SparkSession, d: str) -> DataFrame:
    return inference.property_injection(symbols.lines(_files(spark, d, "content")))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
