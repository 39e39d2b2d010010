"""Queries of the graph operators: statistics, filters, joins, set operations, scoring, ranking, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import exprs
from .operators import query as api
from .operators import scoring, traversal, validation
from .plans.graph_tables import C4_LEVELS, EDGE_TYPES, NODE_TYPES, all_links, edges_now, entities, links_now, nodes_now, project_graph, project_heads, sql
from .session import spill_table
from .tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, *names: str):
    """Registers a query, with its SQL over the named tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *names) if names else oracle
        return f

    return add


def _dim(spark: SparkSession, name: str, values: tuple) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(v) for v in values))).alias(name))


def _values(name: str, values: tuple) -> str:
    return f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {name})"


# statistics


@query(
    """SELECT (SELECT count(*) FROM nodes_now) AS n_nodes, (SELECT count(*) FROM links_now) AS n_links, (SELECT count(DISTINCT file) FROM nodes_now) AS n_files,
(SELECT count(*) FROM nodes_now WHERE type = 'function') AS n_functions, (SELECT count(*) FROM nodes_now WHERE type = 'class') AS n_classes,
(SELECT count(*) FROM nodes_now WHERE type = 'component') AS n_components, (SELECT count(*) FROM nodes_now WHERE is_entry) AS n_entries""",
    "nodes_now", "links_now",
)
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    n = nodes_now(spark, d).agg(
        F.count("*").alias("n_nodes"), F.countDistinct("file").alias("n_files"), F.count_if(F.col("type") == "function").alias("n_functions"),
        F.count_if(F.col("type") == "class").alias("n_classes"), F.count_if(F.col("type") == "component").alias("n_components"), F.count_if("is_entry").alias("n_entries"),
    )
    return n.crossJoin(links_now(spark, d).agg(F.count("*").alias("n_links")))  # one row by one row


@query(f"SELECT v.type, count(n.id) AS n FROM {_values('type', NODE_TYPES)} v LEFT JOIN nodes_now n ON n.type = v.type GROUP BY 1", "nodes_now")
def count_by_node_type(spark: SparkSession, d: str) -> DataFrame:
    """Every known type, also with no node."""
    counted = nodes_now(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return _dim(spark, "type", NODE_TYPES).join(counted, "type", "left").select("type", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query(f"SELECT v.type, count(n.source) AS n FROM {_values('type', EDGE_TYPES)} v LEFT JOIN links_now n ON n.type = v.type GROUP BY 1", "links_now")
def count_by_edge_type(spark: SparkSession, d: str) -> DataFrame:
    counted = links_now(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return _dim(spark, "type", EDGE_TYPES).join(counted, "type", "left").select("type", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query(
    """WITH k AS (SELECT id, CASE WHEN c4_level IN ('system','container','component','code') THEN c4_level END AS lvl FROM nodes_now)
SELECT a.lvl AS c4_level, n_nodes, coalesce(n_links, 0) AS n_links FROM (SELECT lvl, count(*) AS n_nodes FROM k WHERE lvl IS NOT NULL GROUP BY 1) a
LEFT JOIN (SELECT s.lvl, count(*) AS n_links FROM links_now l JOIN k s ON s.id = l.source JOIN k t ON t.id = l.target AND t.lvl = s.lvl GROUP BY 1) b ON a.lvl = b.lvl""",
    "nodes_now", "links_now",
)
def c4_levels(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per level, and links with both ends in it."""
    k = nodes_now(spark, d).where(F.col("c4_level").isin(*C4_LEVELS)).select("id", "c4_level")
    s, t = k.select(F.col("id").alias("source"), "c4_level"), k.select(F.col("id").alias("target"), "c4_level")
    inside = links_now(spark, d).select("source", "target").join(s, "source").join(t, ["target", "c4_level"]).groupBy("c4_level").agg(F.count("*").alias("n_links"))
    return k.groupBy("c4_level").agg(F.count("*").alias("n_nodes")).join(inside, "c4_level", "left").na.fill(0, ["n_links"])


@query("SELECT file, count(*) AS n FROM nodes_now WHERE file IS NOT NULL GROUP BY 1 HAVING count(*) > 10", "nodes_now")
def large_files(spark: SparkSession, d: str) -> DataFrame:
    return nodes_now(spark, d).where("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n")).where("n > 10")


@query("SELECT id FROM nodes_now n WHERE NOT is_entry AND NOT EXISTS (SELECT 1 FROM links_now l WHERE l.target = n.id)", "nodes_now", "links_now")
def unused_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that nothing refers to, entries aside."""
    targets = links_now(spark, d).select(F.col("target").alias("id")).distinct()
    return nodes_now(spark, d).where(~F.col("is_entry")).join(targets, "id", "left_anti").select("id")


@query(
    """SELECT id FROM nodes_now n WHERE type <> 'module' AND NOT is_entry AND NOT EXISTS (SELECT 1 FROM links_now l WHERE l.target = n.id)
AND NOT EXISTS (SELECT 1 FROM links_now l WHERE l.source = n.id)""",
    "nodes_now", "links_now",
)
def orphaned_nodes(spark: SparkSession, d: str) -> DataFrame:
    return validation.orphaned_nodes(links_now(spark, d), nodes_now(spark, d)).select("id")


@query("SELECT CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE 'root' END AS folder, count(*) AS n FROM nodes_now WHERE file IS NOT NULL GROUP BY 1", "nodes_now")
def folder_groups(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.contains("file", F.lit("/")), F.regexp_extract("file", "^(.*)/[^/]*$", 1)).otherwise("root")
    return nodes_now(spark, d).where("file IS NOT NULL").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))


@query(
    """SELECT (SELECT count(*) FROM nodes_now WHERE contains(id, '\\')) AS n_backslashes, CAST(count_if(source = target) AS BIGINT) AS n_self,
count(*) - count(DISTINCT (source, target, type)) AS n_repeated FROM edges_now""",
    "nodes_now", "edges_now",
)
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    e = edges_now(spark, d).agg(
        F.count_if(F.col("source") == F.col("target")).alias("n_self"), (F.count("*") - F.countDistinct("source", "target", "type")).alias("n_repeated")
    )
    return e.crossJoin(nodes_now(spark, d).agg(F.count_if(F.contains("id", F.lit("\\"))).alias("n_backslashes")))  # one row by one row


@query(
    """SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS quality, count(*) AS n
FROM links_now GROUP BY 1""",
    "links_now",
)
def edge_quality(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    q = F.when(c.isNull(), "none").when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")
    return links_now(spark, d).groupBy(q.alias("quality")).agg(F.count("*").alias("n"))


# the query API


@query("SELECT id FROM entities WHERE regexp_matches(name, '(?i)^(load|fetch).*policy')", "entities")
def find_by_name_regex(spark: SparkSession, d: str) -> DataFrame:
    return api.find_by_name(entities(spark, d), "^(load|fetch).*policy").select("id")


@query("SELECT id FROM entities WHERE lower(name) = 'constructor'", "entities")
def find_by_name_exact(spark: SparkSession, d: str) -> DataFrame:
    return api.find_by_name(entities(spark, d), "Constructor", exact=True).select("id")


@query("SELECT id, type_name FROM entities WHERE contains(lower(type_name), 'react')", "entities")
def find_by_type(spark: SparkSession, d: str) -> DataFrame:
    return api.find_by_type(entities(spark, d), "React", exact=False).select("id", "type_name")


@query("SELECT id FROM entities WHERE kind = 'service'", "entities")
def find_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return api.EntityQuery(entities(spark, d)).with_kind("service").execute().select("id")


@query("SELECT id, round(confidence, 6) AS confidence FROM entities WHERE confidence BETWEEN 0.2 AND 0.4", "entities")
def confidence_range(spark: SparkSession, d: str) -> DataFrame:
    return api.EntityQuery(entities(spark, d)).with_confidence(0.2, 0.4).execute().select("id", F.round("confidence", 6).alias("confidence"))


@query("SELECT id FROM entities WHERE kind = 'function' AND regexp_matches(name, '(?i)^scan') AND confidence >= 0.3", "entities")
def builder_chain(spark: SparkSession, d: str) -> DataFrame:
    return api.EntityQuery(entities(spark, d)).with_kind("function").with_name("^scan").with_min_confidence(0.3).execute().select("id")


@query("SELECT count(*) AS total_count FROM entities e WHERE EXISTS (SELECT 1 FROM links_now l WHERE l.source = e.id AND l.target = 'external:react')", "entities", "links_now")
def callers_of(spark: SparkSession, d: str) -> DataFrame:
    return api.EntityQuery(entities(spark, d)).calling(links_now(spark, d), "external:react").count()


@query(
    """SELECT CASE WHEN b = 8 THEN '0.8-1.0' ELSE '0.' || b || '-0.' || (b + 2) END AS bucket, count(*) AS n
FROM (SELECT CAST(least(floor(confidence * 5) * 2, 8) AS INT) AS b FROM entities) GROUP BY 1""",
    "entities",
)
def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).groupBy(exprs.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT id, NOT (contains(lower(coalesce(name, '')), 'policy') OR contains(lower(coalesce(file, '')), 'policy')) AS dimmed FROM nodes_now WHERE type IN ('class', 'component')", "nodes_now")
def search_dim(spark: SparkSession, d: str) -> DataFrame:
    """The search of a view marks what it doesn't match instead of removing it."""
    match = F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("policy")) | F.contains(F.lower(F.coalesce("file", F.lit(""))), F.lit("policy"))
    return nodes_now(spark, d).where(F.col("type").isin("class", "component")).select("id", (~match).alias("dimmed"))


_HUB = "lumen-atlas_src_core_logging_channel_ts_LogChannel_05866282"


@query(f"SELECT DISTINCT CASE WHEN source = '{_HUB}' THEN target ELSE source END AS id FROM links_now WHERE source = '{_HUB}' OR target = '{_HUB}'", "links_now")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """What a selected node is linked with, either way."""
    e = links_now(spark, d).where((F.col("source") == _HUB) | (F.col("target") == _HUB))
    return e.select(F.when(F.col("source") == _HUB, F.col("target")).otherwise(F.col("source")).alias("id")).distinct()


@query(
    """WITH v AS (SELECT id FROM nodes_now WHERE type IN ('class', 'component'))
SELECT source, target, type FROM links_now WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)""",
    "nodes_now", "links_now",
)
def edges_for_view(spark: SparkSession, d: str) -> DataFrame:
    """Links with both ends in the view of classes."""
    v = nodes_now(spark, d).where(F.col("type").isin("class", "component")).select("id")
    e = links_now(spark, d).select("source", "target", "type")
    return e.join(v.withColumnRenamed("id", "source"), "source", "left_semi").join(v.withColumnRenamed("id", "target"), "target", "left_semi")


# joins


@query(
    """WITH refs AS (SELECT e.edge_id, n.file, CAST(json_extract(e.metadata, '$.source_line') AS INT) AS line FROM edges_now e JOIN nodes_now n ON n.id = e.source
  WHERE json_valid(e.metadata) AND json_type(e.metadata) = 'OBJECT'),
spans AS (SELECT id, ord, file, line_start, line_end FROM nodes_now WHERE line_start <= line_end)
SELECT edge_id, id FROM (SELECT r.edge_id, s.id, row_number() OVER (PARTITION BY r.edge_id ORDER BY s.line_end - s.line_start, s.ord) AS rn
FROM refs r JOIN spans s ON s.file = r.file AND r.line BETWEEN s.line_start AND s.line_end) WHERE rn = 1""",
    "nodes_now", "edges_now",
)
def enclosing_node(spark: SparkSession, d: str) -> DataFrame:
    """The smallest node whose lines hold the line that an edge was seen in."""
    n = nodes_now(spark, d)
    line = F.get_json_object("metadata", "$.source_line").cast("int")
    refs = edges_now(spark, d).select("edge_id", "source", line.alias("line")).where("line IS NOT NULL")
    refs = refs.join(n.select(F.col("id").alias("source"), "file"), "source").select("edge_id", "file", "line")
    # by pages of lines, so that a use meets only what lies on its page, however much its file holds
    page = lambda c: F.floor(F.col(c) / 64)
    spans = n.where("line_start <= line_end").select("id", "ord", "file", "line_start", "line_end", F.explode(F.sequence(page("line_start"), page("line_end"))).alias("page"))
    hits = refs.withColumn("page", page("line")).join(spans, ["file", "page"]).where("line BETWEEN line_start AND line_end")
    best = F.min_by("id", F.struct(F.col("line_end") - F.col("line_start"), "ord"))
    return hits.groupBy("edge_id").agg(best.alias("id"))


@query(
    """SELECT edge_id, issue_type, severity FROM (
WITH e AS (SELECT l.*, s.type AS st, s.file AS sf, t.type AS tt, t.file AS tf FROM links_now l LEFT JOIN nodes_now s ON s.id = l.source LEFT JOIN nodes_now t ON t.id = l.target)
SELECT edge_id, 'missing_source_node' AS issue_type, 'error' AS severity FROM e WHERE st IS NULL
UNION ALL SELECT edge_id, 'missing_target_node', 'error' FROM e WHERE tt IS NULL
UNION ALL SELECT edge_id, 'missing_import', 'warning' FROM e WHERE type IN ('calls', 'uses', 'renders') AND sf <> tf AND NOT EXISTS (
  SELECT 1 FROM e i WHERE i.type IN ('imports', 'depends_on') AND i.sf = e.sf AND i.tf = e.tf)
UNION ALL SELECT edge_id, 'render_source_not_component', 'warning' FROM e WHERE type = 'renders' AND st <> 'component'
UNION ALL SELECT edge_id, 'render_target_not_component', 'info' FROM e WHERE type = 'renders' AND tt <> 'component'
UNION ALL SELECT edge_id, 'call_target_not_callable', 'warning' FROM e WHERE type IN ('calls', 'async_calls') AND tt NOT IN ('function', 'component', 'class', 'api_endpoint'))""",
    "nodes_now", "links_now",
)
def edge_issues(spark: SparkSession, d: str) -> DataFrame:
    return validation.edge_issues(links_now(spark, d), nodes_now(spark, d))


@query(ORACLES["edge_issues"].replace("SELECT edge_id, issue_type, severity FROM (", "SELECT issue_type, severity, count(*) AS n FROM (", 1) + " GROUP BY 1, 2")
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    return edge_issues(spark, d).groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


@query(
    f"""SELECT edge_id, {exprs.sql_case('l.type', exprs.FLOW_OF_EDGE, 'generic_relationship')} AS flow_type,
round(0.3 * coalesce(s.confidence, 0.5) + 0.3 * coalesce(t.confidence, 0.5) + 0.4 * {exprs.sql_case('l.type', exprs.CONFIDENCE_OF_EDGE, 0.7)}, 6) AS score
FROM links_now l LEFT JOIN entities s ON s.id = l.source LEFT JOIN entities t ON t.id = l.target""",
    "entities", "links_now",
)
def edge_enrichment(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select("id", "confidence")
    s, t = e.select(F.col("id").alias("source"), F.col("confidence").alias("sc")), e.select(F.col("id").alias("target"), F.col("confidence").alias("tc"))
    both = links_now(spark, d).select("edge_id", "source", "target", "type").join(s, "source", "left").join(t, "target", "left")
    half = F.lit(0.5)
    score = 0.3 * F.coalesce("sc", half) + 0.3 * F.coalesce("tc", half) + 0.4 * exprs.mapped(F.col("type"), exprs.CONFIDENCE_OF_EDGE, 0.7)
    return both.select("edge_id", exprs.mapped(F.col("type"), exprs.FLOW_OF_EDGE, "generic_relationship").alias("flow_type"), F.round(score, 6).alias("score"))


@query(
    """SELECT source, target, type FROM (SELECT l.*, row_number() OVER (PARTITION BY source, target ORDER BY edge_id) AS rn FROM links_now l
WHERE source IN (SELECT id FROM nodes_now) AND target IN (SELECT id FROM nodes_now)) WHERE rn = 1""",
    "nodes_now", "links_now",
)
def shown_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links for display: no loose ends, one per pair whatever its type."""
    n = nodes_now(spark, d).select("id")
    e = links_now(spark, d).join(n.withColumnRenamed("id", "source"), "source", "left_semi").join(n.withColumnRenamed("id", "target"), "target", "left_semi")
    return e.groupBy("source", "target").agg(F.min_by("type", "edge_id").alias("type"))


@query(
    """WITH m AS (SELECT file, arg_min(id, ord) AS module_id FROM nodes_now WHERE type = 'module' GROUP BY 1),
c AS (SELECT file, arg_min(id, ord) AS class_id FROM nodes_now WHERE type IN ('class', 'component') GROUP BY 1)
SELECT n.id, m.module_id, CASE WHEN n.type = 'function' THEN c.class_id END AS class_id FROM nodes_now n LEFT JOIN m ON m.file = n.file LEFT JOIN c ON c.file = n.file""",
    "nodes_now",
)
def parents(spark: SparkSession, d: str) -> DataFrame:
    """The module of each node's file, and of functions its first class."""
    n = nodes_now(spark, d)
    of = F.col("type").isin("class", "component")
    per = n.groupBy("file").agg(F.min_by(F.when(F.col("type") == "module", F.col("id")), F.when(F.col("type") == "module", F.col("ord"))).alias("module_id"), F.min_by(F.when(of, F.col("id")), F.when(of, F.col("ord"))).alias("first_class"))
    return n.join(per, "file", "left").select("id", "module_id", F.when(F.col("type") == "function", F.col("first_class")).alias("class_id"))


@query(
    """SELECT l.edge_id, s.type_name AS source_type, t.type_name AS target_type FROM links_now l LEFT JOIN entities s ON s.id = l.source LEFT JOIN entities t ON t.id = l.target
WHERE s.type_name IS NOT NULL OR t.type_name IS NOT NULL""",
    "entities", "links_now",
)
def typed_dependencies(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).where("type_name IS NOT NULL").select("id", "type_name")
    s = e.select(F.col("id").alias("source"), F.col("type_name").alias("source_type"))
    t = e.select(F.col("id").alias("target"), F.col("type_name").alias("target_type"))
    both = links_now(spark, d).select("edge_id", "source", "target").join(s, "source", "left").join(t, "target", "left")
    return both.where("source_type IS NOT NULL OR target_type IS NOT NULL").select("edge_id", "source_type", "target_type")


@query("SELECT type_name, count(*) AS n, min(id) AS first_id FROM entities WHERE type_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "entities")
def same_type_peers(spark: SparkSession, d: str) -> DataFrame:
    """Groups of entities of one type, as groups rather than all their pairs."""
    return entities(spark, d).where("type_name IS NOT NULL").groupBy("type_name").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query("SELECT DISTINCT source AS consumer, target AS provider FROM links_now WHERE type IN ('imports', 'depends_on') AND target NOT IN (SELECT id FROM nodes_now) AND NOT starts_with(target, 'external:')", "nodes_now", "links_now")
def missing_dependencies(spark: SparkSession, d: str) -> DataFrame:
    e = links_now(spark, d).where(F.col("type").isin("imports", "depends_on") & ~F.startswith("target", F.lit("external:")))
    lost = e.join(nodes_now(spark, d).select(F.col("id").alias("target")), "target", "left_anti")
    return lost.select(F.col("source").alias("consumer"), F.col("target").alias("provider")).distinct()


@query("SELECT target AS id, substr(target, 10) AS name, count(*) AS n_links FROM links_now WHERE starts_with(target, 'external:') GROUP BY 1", "links_now")
def external_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that stand for packages outside the graph."""
    e = links_now(spark, d).where(F.startswith("target", F.lit("external:")))
    return e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_links")).select("id", F.substr("id", F.lit(10)).alias("name"), "n_links")


@query(
    """SELECT coalesce(a.key, b.key) AS key, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_embedded, 0) AS n_embedded FROM (SELECT name || '|' || kind AS key, count(*) AS n_nodes FROM entities WHERE name IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT entity_name || '|' || lower(entity_type) AS key, count(DISTINCT embedding_id) AS n_embedded FROM semantic_embeddings GROUP BY 1) b ON a.key = b.key
WHERE coalesce(a.key, b.key) IS NOT NULL""",
    "entities",
)
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Full outer merge of nodes and embeddings by name and kind."""
    a = entities(spark, d).where("name IS NOT NULL").groupBy(F.concat("name", F.lit("|"), "kind").alias("key")).agg(F.count("*").alias("n_nodes"))
    s = table(spark, d, "semantic_embeddings").select("embedding_id", F.concat("entity_name", F.lit("|"), F.lower("entity_type")).alias("key"))
    b = s.where("key IS NOT NULL").groupBy("key").agg(F.countDistinct("embedding_id").alias("n_embedded"))
    return a.join(b, "key", "full_outer").na.fill(0, ["n_nodes", "n_embedded"])


# set operations


@query("SELECT edge_id, source, target, type FROM links_now", "links_now")
def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """First record wins per source, target and type; no self edges."""
    return links_now(spark, d).select("edge_id", "source", "target", "type")


@query(
    """SELECT source, target, type, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY edge_id) AS rn FROM edges_now
WHERE coalesce(confidence, 1.0) >= 0.5) WHERE rn = 1""",
    "edges_now",
)
def merged_confident_edges(spark: SparkSession, d: str) -> DataFrame:
    """As merged_edges, but a record of low confidence doesn't hold the place of a later one."""
    e = edges_now(spark, d).where(F.coalesce("confidence", F.lit(1.0)) >= 0.5)
    return e.groupBy("source", "target", "type").agg(F.min("edge_id").alias("edge_id"))


@query("SELECT DISTINCT source, target FROM edges_now WHERE type = 'calls' EXCEPT SELECT DISTINCT source, target FROM edges_now WHERE type = 'imports'", "edges_now")
def unique_links(spark: SparkSession, d: str) -> DataFrame:
    e = edges_now(spark, d)
    return e.where("type = 'calls'").select("source", "target").distinct().join(e.where("type = 'imports'").select("source", "target"), ["source", "target"], "left_anti")


# scoring


@query(
    """WITH deg AS (SELECT id, CAST(count_if(k = 'i') AS BIGINT) AS n_in, CAST(count_if(k = 'o') AS BIGINT) AS n_out FROM (SELECT target AS id, 'i' AS k FROM links_now UNION ALL SELECT source, 'o' FROM links_now) GROUP BY 1)
SELECT n.id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, round(2 * ln(coalesce(n_in, 0) + 1) + ln(coalesce(n_out, 0) + 1), 6) AS importance
FROM nodes_now n LEFT JOIN deg ON deg.id = n.id""",
    "nodes_now", "links_now",
)
def node_importance(spark: SparkSession, d: str) -> DataFrame:
    deg = traversal.degrees(links_now(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst")))
    n = nodes_now(spark, d).select("id").join(deg.withColumnRenamed("node", "id"), "id", "left").na.fill(0, ["n_in", "n_out"])
    return n.withColumn("importance", F.round(exprs.importance(F.col("n_in"), F.col("n_out")), 6))


_FACTORS = """f AS (SELECT e.id, e.file, e.kind, e.confidence AS type_inference, CASE WHEN type_name IS NULL THEN 0.0 ELSE 1.0 END AS annotation,
least(1.0, 0.2 * coalesce(n, 0)) AS data_flow, least(1.0, 0.25 * coalesce(n, 0)) AS evidence FROM entities e
LEFT JOIN (SELECT source AS id, count(*) AS n FROM links_now GROUP BY 1) o ON o.id = e.id)"""
_SCORE = "(0.25 * type_inference + 0.15 * annotation + 0.2 * data_flow + 0.03 * evidence) / 0.63"


def _factors(spark: SparkSession, d: str) -> DataFrame:
    out = links_now(spark, d).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    e = entities(spark, d).join(out, "id", "left").na.fill(0, ["n"])
    return e.select(
        "id", "file", "kind", F.col("confidence").alias("type_inference"), F.when(F.col("type_name").isNull(), 0.0).otherwise(1.0).alias("annotation"),
        F.least(F.lit(1.0), 0.2 * F.col("n")).alias("data_flow"), F.least(F.lit(1.0), 0.25 * F.col("n")).alias("evidence"),
    )


_USED = ("type_inference", "annotation", "data_flow", "evidence")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _factors(spark, d).withColumn("score", F.round(scoring.weighted({k: F.col(k) for k in _USED}), 6))


@query(f"WITH {_FACTORS} SELECT id, round({_SCORE}, 6) AS score FROM f", "entities", "links_now")
def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id", "score")


@query(
    f"""WITH {_FACTORS}, s AS (SELECT kind, round({_SCORE}, 6) AS score FROM f)
SELECT kind, CASE WHEN score >= 0.8 THEN 'very_high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'very_low' END AS level,
count(*) AS n, round(avg(score), 4) AS mean FROM s GROUP BY 1, 2""",
    "entities", "links_now",
)
def score_levels(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.groupBy("kind", exprs.confidence_level(F.col("score")).alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query(
    f"""WITH {_FACTORS} SELECT file, round((0.25 * avg(type_inference) + 0.15 * avg(annotation) + 0.2 * avg(data_flow) + 0.03 * least(1.0, 0.1 * count(DISTINCT id))) / 0.63, 6) AS score
FROM f WHERE file IS NOT NULL GROUP BY 1""",
    "entities", "links_now",
)
def file_scores(spark: SparkSession, d: str) -> DataFrame:
    f = _factors(spark, d).where("file IS NOT NULL")
    long = f.select("file", F.col("id").alias("entity_id"), F.inline(F.array(*(F.struct(F.lit(k).alias("factor"), F.col(k).alias("score")) for k in _USED))))
    return scoring.score_files(long).select("file", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_FACTORS}, s AS (SELECT *, round({_SCORE}, 6) AS score FROM f)
SELECT id, array_to_string(list_filter([CASE WHEN score < 0.5 THEN 'low overall confidence: review this entity' END, CASE WHEN type_inference < 0.5 THEN 'improve type_inference' END,
CASE WHEN annotation < 0.5 THEN 'improve annotation' END, CASE WHEN data_flow < 0.5 THEN 'improve data_flow' END, CASE WHEN evidence < 0.5 THEN 'improve evidence' END], lambda x: x IS NOT NULL)[1:5], '; ') AS advice FROM s WHERE score < 0.2""",
    "entities", "links_now",
)
def low_score_advice(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).where("score < 0.2")
    return s.select("id", F.array_join(scoring.recommendations(F.col("score"), {k: F.col(k) for k in _USED}), "; ").alias("advice"))


@query(
    """WITH t AS (SELECT entity_name AS identifier, lower(entity_type) AS name, confidence FROM (SELECT DISTINCT embedding_id, entity_name, entity_type, confidence FROM semantic_embeddings) WHERE confidence IS NOT NULL AND entity_name IS NOT NULL AND entity_type IS NOT NULL),
g AS (SELECT identifier, name, sum(confidence) AS total, avg(confidence) AS mean, count(*) AS n FROM t GROUP BY 1, 2)
SELECT identifier, name, round(least(1.0, mean + 0.05 * (n - 1)), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY total DESC, name) AS rn FROM g) WHERE rn = 1"""
)
def merged_types(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "semantic_embeddings").select("embedding_id", "entity_name", "entity_type", "confidence").distinct()
    e = e.where("confidence IS NOT NULL AND entity_name IS NOT NULL AND entity_type IS NOT NULL")
    return scoring.merge_types(e.select(F.col("entity_name").alias("identifier"), F.lower("entity_type").alias("name"), "confidence")).withColumn("confidence", F.round("confidence", 6))


# ranking


@query(
    """SELECT file, id, rn FROM (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY CASE type WHEN 'component' THEN 3 WHEN 'function' THEN 2 WHEN 'class' THEN 1 ELSE 0 END DESC, ord) AS rn
FROM nodes_now WHERE file IS NOT NULL) WHERE rn <= 3""",
    "nodes_now",
)
def representatives(spark: SparkSession, d: str) -> DataFrame:
    """The three nodes that stand for a file."""
    rank = exprs.mapped(F.col("type"), {"component": 3, "function": 2, "class": 1}, 0)
    n = nodes_now(spark, d).where("file IS NOT NULL").select("file", "id", "ord", rank.alias("p"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("p"), "ord")).cast("bigint")).where("rn <= 3").select("file", "id", "rn")


@query(
    """WITH f AS (SELECT id, ord, regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder, CASE type WHEN 'module' THEN 0 WHEN 'class' THEN 1 WHEN 'component' THEN 1 ELSE 2 END AS k FROM nodes_now WHERE contains(file, '/')),
p AS (SELECT id, folder, row_number() OVER (PARTITION BY folder ORDER BY k, ord) - 1 AS i FROM f),
w AS (SELECT folder, greatest(280, (max(i) // 6 + 1) * 220) AS width FROM p GROUP BY 1),
x AS (SELECT folder, coalesce(sum(width + 60) OVER (ORDER BY folder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM w)
SELECT p.id, CAST(x0 + (i // 6) * 220 AS BIGINT) AS x, CAST((i % 6) * 65 AS BIGINT) AS y FROM p JOIN x ON x.folder = p.folder""",
    "nodes_now",
)
def folder_layout(spark: SparkSession, d: str) -> DataFrame:
    """Grid places per folder, folders side by side.

    The offsets of the folders need one running sum over all of them: it is taken over one row per
    folder, in ranges whose totals are added up first, so that no task sees all folders.
    """
    k = exprs.mapped(F.col("type"), {"module": 0, "class": 1, "component": 1}, 2)
    f = nodes_now(spark, d).where(F.contains("file", F.lit("/"))).select("id", "ord", F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder"), k.alias("k"))
    p = f.withColumn("i", F.row_number().over(Window.partitionBy("folder").orderBy("k", "ord")) - 1).select("id", "folder", "i")
    w = p.groupBy("folder").agg(F.greatest(F.lit(280), (F.floor(F.max("i") / 6) + 1) * 220).alias("width"))
    # sorted once over all tasks; each then sums its own range, behind the totals of the ranges before it
    ranged = spill_table(w.repartitionByRange("folder").sortWithinPartitions("folder").withColumn("part", F.spark_partition_id()), "folders")
    parts = ranged.groupBy("part").agg(F.sum(F.col("width") + 60).alias("total"))
    earlier = parts.select(F.array_agg(F.struct("part", "total")).alias("l"))  # one entry per task of the sort
    inside = Window.partitionBy("part").orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    start = F.aggregate(F.filter("l", lambda p: p["part"] < F.col("part")), F.lit(0).cast("bigint"), lambda a, p: a + p["total"])
    x = ranged.crossJoin(F.broadcast(earlier)).select("folder", (start + F.coalesce(F.sum(F.col("width") + 60).over(inside), F.lit(0))).alias("x0"))
    return p.join(x, "folder").select("id", (F.col("x0") + F.floor(F.col("i") / 6) * 220).cast("bigint").alias("x"), ((F.col("i") % 6) * 65).cast("bigint").alias("y"))


# traversal, over all links


@query(
    """WITH RECURSIVE r AS (SELECT seed, dst AS node FROM sources_of_projects JOIN all_links ON src = seed UNION SELECT r.seed, p.dst FROM r JOIN all_links p ON p.src = r.node)
SELECT seed, node FROM r""",
    "sources_of_projects",
)
def transitive_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """All that the node with most links of each project depends on, directly or through others."""
    return traversal.reachable(all_links(spark, d), project_heads(spark, d, "src")).select("seed", "node")


@query(
    """WITH RECURSIVE r AS (SELECT seed, src AS node FROM targets_of_projects JOIN all_links ON dst = seed UNION SELECT r.seed, p.src FROM r JOIN all_links p ON p.dst = r.node)
SELECT seed, node FROM r""",
    "targets_of_projects",
)
def transitive_users(spark: SparkSession, d: str) -> DataFrame:
    """All that depends on the most used node of each project."""
    e = all_links(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traversal.reachable(e, project_heads(spark, d, "dst")).select("seed", "node")


@query(
    """WITH RECURSIVE e AS (SELECT source AS src, target AS dst FROM links_now WHERE type = 'imports'), r AS (SELECT src AS node FROM e WHERE dst = 'external:react' UNION SELECT e.src FROM r JOIN e ON e.dst = r.node)
SELECT DISTINCT node FROM r""",
    "links_now",
)
def transitive_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Everything that imports a package, directly or through others."""
    e = links_now(spark, d).where("type = 'imports'").select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return traversal.reachable(e, spark.range(1).select(F.lit("external:react").alias("seed"))).select("node")


@query(
    """WITH RECURSIVE w AS (SELECT src, dst, [src, dst] AS path FROM project_graph WHERE src = 'lumen-weave' UNION ALL SELECT w.src, p.dst, list_append(path, p.dst) FROM w JOIN project_graph p ON p.src = w.dst
WHERE w.dst <> 'lumen-ledger' AND NOT list_contains(path, p.dst) AND len(path) <= 4)
SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM w WHERE dst = 'lumen-ledger'""",
    "project_graph",
)
def dependency_paths(spark: SparkSession, d: str) -> DataFrame:
    """The simple paths of at most four steps from one project to another."""
    found = traversal.paths(project_graph(spark, d), "lumen-weave", "lumen-ledger", 4)
    return found.select(F.array_join("path", ">").alias("path"), F.col("length").cast("bigint").alias("length"))


@query(
    """WITH RECURSIVE b AS (SELECT label AS seed, label AS node, 0 AS depth FROM rings WHERE node = label
  UNION SELECT b.seed, p.dst, depth + 1 FROM b JOIN all_links p ON p.src = b.node JOIN rings g ON g.node = p.dst AND g.label = b.seed WHERE depth < 12),
s AS (SELECT seed AS label, min(depth) AS length FROM b WHERE node = seed AND depth > 0 GROUP BY 1)
SELECT label, count(*) AS n_nodes, CAST(any_value(length) AS INT) AS length, CASE WHEN any_value(length) = 2 THEN 'critical' WHEN any_value(length) <= 4 THEN 'warning' ELSE 'info' END AS severity
FROM rings JOIN s USING (label) GROUP BY 1""",
    "rings",
)
def circular_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """The groups of nodes that depend on each other in a circle, and the shortest circle through the smallest of each."""
    return traversal.cycles(all_links(spark, d))


@query("SELECT a.src AS a, a.dst AS b FROM all_links a JOIN all_links b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst", "all_links")
def mutual_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that depend on each other directly."""
    return traversal.mutual(all_links(spark, d))


@query("SELECT node, label FROM rings", "rings")
def nodes_on_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on cycles of whatever length, with the smallest node of those that reach each other."""
    return traversal.strong_components(all_links(spark, d))


@query(
    """WITH RECURSIVE v AS (SELECT src AS node FROM all_links UNION SELECT dst FROM all_links),
c AS MATERIALIZED (SELECT v.node, coalesce(g.label, v.node) AS c FROM v LEFT JOIN rings g USING (node)),
dag AS MATERIALIZED (SELECT DISTINCT a.c AS s, b.c AS t FROM all_links l JOIN c a ON a.node = l.src JOIN c b ON b.node = l.dst WHERE a.c <> b.c),
up AS (SELECT node AS c, 0 AS depth FROM v WHERE node NOT IN (SELECT src FROM all_links) UNION SELECT dag.s, depth + 1 FROM up JOIN dag ON dag.t = up.c),
far AS (SELECT c, max(depth) AS depth FROM up GROUP BY 1),
n AS (SELECT seed AS node, count(*) AS k FROM reach WHERE seed <> node GROUP BY 1)
SELECT c.node, CAST(coalesce(far.depth, n.k, 0) AS BIGINT) AS depth FROM c LEFT JOIN far ON far.c = c.c LEFT JOIN n ON n.node = c.node""",
    "rings",
)
def dependency_depth(spark: SparkSession, d: str) -> DataFrame:
    """The longest way from each node to one that depends on nothing."""
    return traversal.depths(all_links(spark, d))


@query("SELECT source AS node, CAST(count(DISTINCT target) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT target)), ',') AS providers FROM links_now WHERE type = 'depends_on' GROUP BY 1", "links_now")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = links_now(spark, d).where("type = 'depends_on'").groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("t"))
    return e.select("node", F.size("t").cast("bigint").alias("n"), F.array_join("t", ",").alias("providers"))


@query(
    """SELECT 'fan_out' AS rule, source AS node, count(DISTINCT target) AS n FROM links_now WHERE type IN ('imports', 'depends_on') GROUP BY 2 HAVING count(DISTINCT target) > 10
UNION ALL SELECT 'fan_in', target, count(DISTINCT source) FROM links_now WHERE type IN ('imports', 'depends_on') GROUP BY 2 HAVING count(DISTINCT source) > 100""",
    "links_now",
)
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    e = links_now(spark, d).where(F.col("type").isin("imports", "depends_on")).select("source", "target").distinct()
    out = e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n")).where("n > 10").select(F.lit("fan_out").alias("rule"), "node", "n")
    return out.unionByName(e.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n")).where("n > 100").select(F.lit("fan_in").alias("rule"), "node", "n"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
