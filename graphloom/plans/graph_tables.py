"""The graph as the operators see it: cleaned nodes, edges and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import whole_json
from ..operators.orphans import bare
from ..tables import table

#: Vocabularies, so that counts of zero can be produced.
NODE_TYPES = ("module", "component", "function", "class", "api_endpoint", "model", "service", "controller", "view", "template", "hook")
EDGE_TYPES = (
    "imports", "exports", "re_exports", "calls", "async_calls", "invokes", "returns", "extends", "implements", "instantiates",
    "inherits", "renders", "uses", "depends_on", "references", "has_type", "data_flow",
)
C4_LEVELS = ("system", "container", "component", "code")


def slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def nodes_now(spark: SparkSession, d: str) -> DataFrame:
    """One row per id that is still in the graph: of its stays without an end the last one, with paths and types in one form."""
    n = table(spark, d, "nodes").where(F.col("id").isNotNull() & F.col("deleted_at").isNull()).select(
        "ord", bare(F.col("id")).alias("id"),
        F.coalesce(F.lower(F.trim("type")), F.lit("unknown")).alias("type"),
        slashes(F.col("file")).alias("file"), "name", "is_entry",
        F.coalesce(F.lower(F.trim("c4_level")), F.lit("code")).alias("c4_level"),
        F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), "metadata", "recorded_at",
    )
    rest = [c for c in n.columns if c not in ("id", "recorded_at")]
    last = n.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("recorded_at", "ord")).alias("r"))
    return last.select("id", "r.*")


def edges_now(spark: SparkSession, d: str) -> DataFrame:
    """Each edge record once, as it first arrived, with trimmed ids and types in one form; edges without an end are left out."""
    e = table(spark, d, "edges").select(
        "edge_id", bare(F.col("source")).alias("source"), bare(F.col("target")).alias("target"),
        F.coalesce(F.lower(F.trim("type")), F.lit("unknown")).alias("type"), "confidence", "metadata", "project", "observed_at", "ingested_at",
    )
    rest = [c for c in e.columns if c not in ("edge_id", "ingested_at")]
    whole = F.to_json(F.struct(*rest))
    first = e.groupBy("edge_id").agg(F.min_by(F.struct(*rest), F.struct(F.coalesce("ingested_at", F.lit("9999-01-01").cast("timestamp_ntz")), whole)).alias("r"))
    return first.select("edge_id", "r.*").where((F.col("source") != "") & (F.col("target") != ""))


def links_now(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the multigraph: the first record of each (source, target, type), without self edges."""
    e = edges_now(spark, d).where(F.col("source") != F.col("target"))
    first = e.groupBy("source", "target", "type").agg(F.min_by(F.struct("edge_id", "confidence", "metadata", "project"), "edge_id").alias("r"))
    return first.select("source", "target", "type", "r.*")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the query API: nodes with the type and confidence that their metadata tell."""
    meta = F.from_json(whole_json(F.col("metadata")), "type_info struct<name:string,category:string,confidence:double>, confidence_score struct<overall_score:double>")
    n = nodes_now(spark, d).withColumn("m", meta)
    return n.select(
        "ord", "id", "name", F.col("type").alias("kind"), "file", F.col("m.type_info.name").alias("type_name"),
        F.coalesce("m.confidence_score.overall_score", "m.type_info.confidence", F.lit(0.5)).alias("confidence"),
    )


def all_links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): every link between nodes, of whatever type."""
    return links_now(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def project_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, n): projects that refer to each other, by edges of every type."""
    n = nodes_now(spark, d).select("id", F.element_at(F.split("file", "/"), 1).alias("p")).where(F.col("p").isNotNull())
    e = edges_now(spark, d).select("source", "target")
    pairs = e.join(n.select(F.col("id").alias("source"), F.col("p").alias("src")), "source").join(
        n.select(F.col("id").alias("target"), F.col("p").alias("dst")), "target"
    )
    return pairs.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def project_heads(spark: SparkSession, d: str, end: str) -> DataFrame:
    """(seed): of each project the node that most links lead from (end: src) or to (end: dst); projects are few."""
    n = nodes_now(spark, d).select(F.col("id").alias(end), F.element_at(F.split("file", "/"), 1).alias("p")).where(F.col("p").isNotNull())
    many = all_links(spark, d).groupBy(end).agg(F.count("*").alias("n"))
    return many.join(n, end).groupBy("p").agg(F.min_by(end, F.struct(-F.col("n"), end)).alias("seed")).select("seed")


_TRIM = "trim({}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)||chr(12288))"
#: The same tables for the SQL side.
SQL = {
    "nodes_now": f"""nodes_now AS (SELECT ord, id, type, file, name, is_entry, c4_level, line_start, line_end, metadata FROM (
  SELECT ord, {_TRIM.format('id')} AS id, coalesce(lower(trim(type)), 'unknown') AS type, replace(file, '\\', '/') AS file, name, is_entry,
  coalesce(lower(trim(c4_level)), 'code') AS c4_level, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end, metadata,
  rank() OVER (PARTITION BY {_TRIM.format('id')} ORDER BY recorded_at DESC NULLS LAST, ord DESC) AS rn
  FROM nodes n WHERE id IS NOT NULL AND deleted_at IS NULL) WHERE rn = 1)""",
    "edges_now": f"""edges_now AS (SELECT * EXCLUDE rn FROM (SELECT edge_id, {_TRIM.format('source')} AS source, {_TRIM.format('target')} AS target,
  coalesce(lower(trim(type)), 'unknown') AS type, confidence, metadata, project, observed_at,
  row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at) AS rn FROM edges) WHERE rn = 1 AND source <> '' AND target <> '')""",
    "links_now": """links_now AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY edge_id) AS rn
  FROM edges_now WHERE source <> target) WHERE rn = 1)""",
    "entities": """entities AS (SELECT ord, id, name, type AS kind, file, json_extract_string(js, '$.type_info.name') AS type_name,
  coalesce(CAST(json_extract(js, '$.confidence_score.overall_score') AS DOUBLE), CAST(json_extract(js, '$.type_info.confidence') AS DOUBLE), 0.5) AS confidence
  FROM (SELECT *, CASE WHEN json_valid(metadata) THEN metadata ELSE '{}' END AS js FROM nodes_now))""",
    "all_links": "all_links AS MATERIALIZED (SELECT DISTINCT source AS src, target AS dst FROM links_now)",
    "project_graph": """project_graph AS (SELECT split_part(a.file, '/', 1) AS src, split_part(b.file, '/', 1) AS dst, count(*) AS n
  FROM edges_now e JOIN nodes_now a ON a.id = e.source JOIN nodes_now b ON b.id = e.target WHERE split_part(a.file, '/', 1) <> split_part(b.file, '/', 1) GROUP BY 1, 2)""",
    "sources_of_projects": """sources_of_projects AS (SELECT arg_min(id, (-k, id)) AS seed FROM (SELECT n.id, split_part(n.file, '/', 1) AS p, count(*) AS k
  FROM all_links l JOIN nodes_now n ON n.id = l.src WHERE n.file IS NOT NULL GROUP BY 1, 2) GROUP BY p)""",
    "targets_of_projects": """targets_of_projects AS (SELECT arg_min(id, (-k, id)) AS seed FROM (SELECT n.id, split_part(n.file, '/', 1) AS p, count(*) AS k
  FROM all_links l JOIN nodes_now n ON n.id = l.dst WHERE n.file IS NOT NULL GROUP BY 1, 2) GROUP BY p)""",
    # what every node reaches, and the smallest node of those that reach each other
    "reach": "reach AS (SELECT src AS seed, dst AS node FROM all_links UNION SELECT r.seed, p.dst FROM reach r JOIN all_links p ON p.src = r.node)",
    "rings": "rings AS MATERIALIZED (SELECT a.seed AS node, min(b.seed) AS label FROM reach a JOIN reach b ON a.seed = b.node AND a.node = b.seed GROUP BY 1)",
}


def sql(body: str, *names: str) -> str:
    """A query over some of these tables."""
    needs = {"links_now": ("edges_now",), "entities": ("nodes_now",), "project_graph": ("nodes_now", "edges_now"), "all_links": ("edges_now", "links_now"),
             "sources_of_projects": ("nodes_now", "edges_now", "links_now", "all_links"), "targets_of_projects": ("nodes_now", "edges_now", "links_now", "all_links"),
             "reach": ("edges_now", "links_now", "all_links"), "rings": ("edges_now", "links_now", "all_links", "reach")}
    order: list[str] = []
    for n in names:
        for k in (*needs.get(n, ()), n):
            if k not in order:
                order.append(k)
    recursive = "RECURSIVE " if "RECURSIVE" in body or "reach" in order else ""
    body = body.replace("RECURSIVE ", "", 1) if recursive else body
    more = body.lstrip()
    joined = ",\n".join(SQL[k] for k in order)
    return f"WITH {recursive}{joined}" + (",\n" + more[len("WITH "):] if more.startswith("WITH ") else "\n" + more)
