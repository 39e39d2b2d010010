"""Queries of module systems, lineage and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lineage, modules
from .plans.graph_tables import all_links, links_now, nodes_now, project_graph, project_heads, sql
from .queries_code import _FILES, _files
from .sources import exports
from .tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *names) if names else oracle
        return f

    return add


_E = modules.EXPORTED.replace("'", "''")


def _part(i: int) -> str:
    return f"regexp_extract(s, '{_E}', {i})"


@query(
    f"""WITH {_FILES}, e AS (SELECT file_id, unnest(regexp_extract_all(content, '{_E}', 0)) AS s FROM files WHERE content IS NOT NULL),
p AS (SELECT file_id, {_part(1)} AS d, {_part(2)} AS k, {_part(3)} AS n, {_part(4)} AS l, {_part(5)} AS m, {_part(6)} AS st FROM e),
x AS (SELECT file_id, CASE WHEN k <> '' THEN k WHEN m <> '' OR st <> '' THEN 're_export' ELSE 'list' END AS kind, d <> '' AS is_default,
unnest(CASE WHEN n <> '' THEN [n] WHEN st <> '' THEN ['*'] ELSE list_filter(list_transform(string_split(l, ','), lambda x: trim(regexp_replace(x, '^.* as ', ''))), lambda x: x <> '') END) AS name FROM p)
SELECT file_id, kind, name, is_default FROM x"""
)
def es6_exports(spark: SparkSession, d: str) -> DataFrame:
    return modules.es6_exports(_files(spark, d, "content")).select("file_id", "kind", "name", "is_default")


@query(f"""WITH {_FILES} SELECT file_id, unnest(regexp_extract_all(content, 'require\\(\\s*[''"]([^''"\n]+)[''"]\\s*\\)', 1)) AS module FROM files WHERE content IS NOT NULL""")
def commonjs_requires(spark: SparkSession, d: str) -> DataFrame:
    return modules.requires(_files(spark, d, "content")).select("file_id", "module")


@query(
    """WITH RECURSIVE u AS (SELECT seed, seed AS node FROM targets_of_projects UNION SELECT u.seed, p.src FROM u JOIN all_links p ON p.dst = u.node)
SELECT seed, node FROM u WHERE node NOT IN (SELECT dst FROM all_links)""",
    "targets_of_projects",
)
def data_origins(spark: SparkSession, d: str) -> DataFrame:
    """Where the data of the most used node of each project comes from."""
    return lineage.origins(all_links(spark, d), project_heads(spark, d, "dst"))


@query(
    """WITH RECURSIVE u AS (SELECT seed, dst AS node FROM sources_of_projects JOIN all_links ON src = seed UNION SELECT u.seed, p.dst FROM u JOIN all_links p ON p.src = u.node)
SELECT seed, count(*) AS n FROM u GROUP BY 1""",
    "sources_of_projects",
)
def data_consumers(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes the data of the node with most links of each project flows into."""
    return lineage.consumers(all_links(spark, d), project_heads(spark, d, "src")).groupBy("seed").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE w AS (SELECT 'lumen-weave' AS path, 'lumen-weave' AS last, ['lumen-weave'] AS seen UNION ALL
SELECT w.path || '>' || p.dst, p.dst, list_append(seen, p.dst) FROM w JOIN project_graph p ON p.src = w.last WHERE len(seen) <= 2 AND NOT list_contains(seen, p.dst))
SELECT path, repeat('  ', CAST(len(seen) - 1 AS INT)) || last || CASE WHEN len(seen) = 3 AND EXISTS (SELECT 1 FROM project_graph p WHERE p.src = w.last AND NOT list_contains(w.seen, p.dst)) THEN ' [...]' ELSE '' END AS line FROM w""",
    "project_graph",
)
def dependency_tree(spark: SparkSession, d: str) -> DataFrame:
    """The dependency tree of one project, two levels deep, as indented lines."""
    return lineage.tree(project_graph(spark, d), "lumen-weave", 2)


@query(
    """SELECT id, CASE WHEN lvl IN ('system', 'container', 'component', 'code') THEN lvl ELSE 'code' END AS c4_level, type_name, n_dependencies FROM (
SELECT id, json_extract_string(js, '$.c4_level') AS lvl, json_extract_string(js, '$.type_info.name') AS type_name,
CASE WHEN json_type(js, '$.dependencies') = 'ARRAY' THEN CAST(json_array_length(js, '$.dependencies') AS BIGINT) ELSE 0 END AS n_dependencies
FROM (SELECT id, CASE WHEN json_valid(metadata) THEN metadata ELSE '{}' END AS js FROM nodes_now))""",
    "nodes_now",
)
def structured_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata read with a schema and defaults."""
    m = nodes_now(spark, d).select("id", exports.metadata(F.col("metadata")).alias("m"))
    return m.select("id", "m.c4_level", F.col("m.type_info.name").alias("type_name"), F.size("m.dependencies").cast("bigint").alias("n_dependencies"))


@query()
def node_documents(spark: SparkSession, d: str) -> DataFrame:
    return exports.node_documents(nodes_now(spark, d))


@query()
def edge_documents(spark: SparkSession, d: str) -> DataFrame:
    return exports.edge_documents(links_now(spark, d))


@query(
    """SELECT 'complexity' AS type, 'medium' AS severity, 'large file' AS title, file AS subject, count(*) AS n FROM nodes_now WHERE file IS NOT NULL GROUP BY file HAVING count(*) > 15
UNION ALL SELECT 'dead_code', 'low', 'unused nodes', min(id), count(*) FROM nodes_now n WHERE NOT is_entry AND NOT EXISTS (SELECT 1 FROM links_now l WHERE l.target = n.id) HAVING count(*) > 10""",
    "nodes_now", "links_now",
)
def insights(spark: SparkSession, d: str) -> DataFrame:
    return exports.insights(nodes_now(spark, d), links_now(spark, d), large=15)


@query(
    """WITH e AS (SELECT user_id AS key, 'visit' AS operation, CASE WHEN event_type = 'view' THEN 'start' WHEN event_type = 'purchase' THEN 'end' END AS kind, ts FROM events),
w AS (SELECT *, lag(kind) OVER v AS bk, lag(ts) OVER v AS bt FROM e WHERE kind IS NOT NULL WINDOW v AS (PARTITION BY key, operation ORDER BY ts, kind DESC))
SELECT key, bt AS started, epoch_us(ts) - epoch_us(bt) AS micros FROM w WHERE kind = 'end' AND bk = 'start'"""
)
def operation_times(spark: SparkSession, d: str) -> DataFrame:
    """From a view to the purchase that follows it."""
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "end")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.lit("visit").alias("operation"), kind.alias("kind"), "ts").where("kind IS NOT NULL")
    return lineage.elapsed(e).select("key", "started", "micros")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
