"""Queries of the general problems (2 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import nesting, orphans
from .tables import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return (
        orphans.edge_links(table(spark, d, "edges"))
        .unionByName(orphans.node_links(table(spark, d, "nodes")))
        .unionByName(orphans.embedding_links(table(spark, d, "semantic_embeddings")))
    )


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """All orphaned references, direct and inherited."""
    links = _links(spark, d)
    return orphans.cascade(links, orphans.direct_orphans(links, orphans.node_stays(table(spark, d, "nodes"))))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the edges."""
    found = _orphans(spark, d).where("kind = 'direct' AND tbl = 'edges'")
    return found.select(F.col("record").alias("edge_id"), "endpoint").distinct()


def p2_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table, endpoint and month."""
    return orphans.report(_orphans(spark, d))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes in hier_files.classes, with all their fields."""
    return nesting.classes(table(spark, d, "hier_files"))


def p6_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods in hier_files.classes, with all their fields."""
    return nesting.methods(table(spark, d, "hier_files"))


def p6_locations(spark: SparkSession, d: str) -> DataFrame:
    """Locations in nodes.metadata, also those with one line or none."""
    return nesting.locations(table(spark, d, "nodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = nesting.flat_links(table(spark, d, "hier_files"), table(spark, d, "nodes"))
    return out.withColumn("root_id", F.col("root_id").cast("bigint"))


def queries():
    return {"p2_found": p2_found, "p2_orphan_report": p2_orphan_report, "p6_found": p6_found, "p6_classes": p6_classes, "p6_methods": p6_methods, "p6_locations": p6_locations}


_TRIM = "trim({}, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)||chr(12288))"
_STAY = "EXISTS (SELECT 1 FROM nodes n WHERE {n} = r.ref AND n.recorded_at <= r.t_at AND (n.deleted_at IS NULL OR n.deleted_at > r.t_at))".replace("{n}", _TRIM.format("n.id"))
_EDGE_REFS = f"""
  SELECT DISTINCT 'edges' AS tbl, edge_id AS record, 'source' AS endpoint, {_TRIM.format('source')} AS ref, observed_at AS t_at, CAST(NULL AS VARCHAR) AS own_id FROM edges
  UNION ALL
  SELECT DISTINCT 'edges', edge_id, 'target', {_TRIM.format('target')}, observed_at, CAST(NULL AS VARCHAR) FROM edges"""


def oracle_sql():
    return {
        "p2_found": f"""
WITH r AS (SELECT * FROM ({_EDGE_REFS}) WHERE ref <> '' AND NOT starts_with(ref, 'external:'))
SELECT DISTINCT record AS edge_id, endpoint FROM r WHERE NOT {_STAY}""",
        "p2_orphan_report": f"""
WITH RECURSIVE r0 AS ({_EDGE_REFS}
  UNION ALL
  SELECT DISTINCT 'nodes', ord, 'dependency', {_TRIM.format('d')}, recorded_at, {_TRIM.format('id')}
  FROM (SELECT ord, id, recorded_at, unnest(CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' AND json_type(metadata, '$.dependencies') = 'ARRAY'
        THEN CAST(json_extract(metadata, '$.dependencies') AS VARCHAR[]) ELSE [] END) AS d FROM nodes)
  UNION ALL
  SELECT DISTINCT 'semantic_embeddings', embedding_id, 'entity', {_TRIM.format('entity_id')}, computed_at, CAST(NULL AS VARCHAR) FROM semantic_embeddings),
r AS (SELECT * FROM r0 WHERE ref <> '' AND NOT starts_with(ref, 'external:')),
direct AS (SELECT * FROM r WHERE NOT {_STAY}),
bad(id) AS (SELECT DISTINCT own_id FROM direct WHERE own_id IS NOT NULL
  UNION SELECT r.own_id FROM r JOIN bad ON r.ref = bad.id WHERE r.own_id IS NOT NULL),
everything AS (SELECT *, 'direct' AS kind FROM direct
  UNION ALL
  SELECT r.*, 'inherited' FROM r WHERE ref IN (SELECT id FROM bad)
    AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.tbl = r.tbl AND x.record = r.record AND x.endpoint = r.endpoint AND x.ref = r.ref))
SELECT tbl, endpoint, period, kind, count(*) AS n_refs
FROM (SELECT DISTINCT tbl, record, endpoint, ref, kind, strftime(t_at, '%Y-%m') AS period FROM everything)
GROUP BY ALL""",
    }
