"""Queries of views, reports, features and vector links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs
from .operators import features, imports, scoring, vectors, views
from .plans.graph_tables import entities, links_now, nodes_now, sql
from .queries_code import _CLUSTERS, _FILES, _embeddings, _files
from .queries_graph import node_importance
from .queries_graph import oracle_sql as graph_sql
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


@query(f"SELECT {exprs.sql_case('type', views.SHOWN_AS, 'file')} AS shown_as, count(*) AS n FROM nodes_now GROUP BY 1", "nodes_now")
def shown_counts(spark: SparkSession, d: str) -> DataFrame:
    return nodes_now(spark, d).groupBy(views.shown_as(F.col("type")).alias("shown_as")).agg(F.count("*").alias("n"))


@query("SELECT id FROM nodes_now WHERE type IN ('class', 'component')", "nodes_now")
def class_view(spark: SparkSession, d: str) -> DataFrame:
    return views.view_nodes(nodes_now(spark, d), "file").select("id")


@query(
    """SELECT type, position, id, name, total FROM (SELECT type, id, name, row_number() OVER (PARTITION BY type ORDER BY lower(name), id) AS position, count(*) OVER (PARTITION BY type) AS total
FROM nodes_now WHERE name IS NOT NULL) WHERE position <= 15""",
    "nodes_now",
)
def type_lists(spark: SparkSession, d: str) -> DataFrame:
    return views.type_lists(nodes_now(spark, d)).withColumn("position", F.col("position").cast("bigint"))


@query(
    f"""SELECT layer, count(*) AS n, round(max(importance), 6) AS most FROM (SELECT *, CASE WHEN importance > 3 THEN 0 WHEN importance > 2 THEN 1 WHEN importance > 1 THEN 2 ELSE 3 END AS layer
FROM ({graph_sql()["node_importance"]})) GROUP BY 1"""
)
def dependency_layers(spark: SparkSession, d: str) -> DataFrame:
    i = node_importance(spark, d)
    return views.layers(i).join(i.select("id", "importance"), "id").groupBy("layer").agg(F.count("*").alias("n"), F.round(F.max("importance"), 6).alias("most"))


@query(
    """WITH h AS (SELECT id, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata ELSE '{}' END, '$.hook_info.hook_name') AS hook, type FROM nodes_now)
SELECT hook, count(*) AS n_nodes, CAST(count_if(type = 'component') AS BIGINT) AS n_components FROM h WHERE hook IS NOT NULL GROUP BY 1""",
    "nodes_now",
)
def hook_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Hooks that nodes depend on, by the metadata."""
    h = F.from_json(exprs.whole_json(F.col("metadata")), "hook_info struct<hook_name:string>")["hook_info"]["hook_name"]
    n = nodes_now(spark, d).select(h.alias("hook"), "type").where("hook IS NOT NULL")
    return n.groupBy("hook").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("type") == "component").alias("n_components"))


@query(
    """SELECT e.kind, count(*) AS n, round(avg(e.confidence), 4) AS mean, CAST(count_if(e.confidence < 0.5) AS BIGINT) AS n_low, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS n_links FROM entities e
LEFT JOIN (SELECT source AS id, count(*) AS n FROM links_now GROUP BY 1) o ON o.id = e.id GROUP BY 1""",
    "entities", "links_now",
)
def analysis_report(spark: SparkSession, d: str) -> DataFrame:
    out = links_now(spark, d).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    e = entities(spark, d).join(out, "id", "left")
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean"), F.count_if(F.col("confidence") < 0.5).alias("n_low"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_links"))


@query(
    """WITH r AS (SELECT id, count(*) AS n, count_if(flow) > 0 AS has_flow, count_if(di) > 0 AS has_di FROM (SELECT source AS id, type IN ('calls', 'uses', 'references', 'returns') AS flow, type IN ('imports', 'depends_on') AS di FROM links_now
UNION ALL SELECT target, type IN ('calls', 'uses', 'references', 'returns'), type IN ('imports', 'depends_on') FROM links_now) GROUP BY 1)
SELECT e.id, round(least(1.0, (CASE WHEN coalesce(has_flow, false) THEN 0.3 ELSE 0 END + CASE WHEN coalesce(has_di, false) THEN 0.3 ELSE 0 END + CASE WHEN type_name IS NOT NULL THEN 0.3 ELSE 0 END + least(0.1, 0.02 * coalesce(n, 0))) / CASE WHEN coalesce(n, 0) > 0 THEN 1.1 ELSE 1.0 END), 6) AS confidence
FROM entities e LEFT JOIN r ON r.id = e.id""",
    "entities", "links_now",
)
def entity_confidence(spark: SparkSession, d: str) -> DataFrame:
    ends = links_now(spark, d).select(F.explode(F.array("source", "target")).alias("id"), F.col("type").isin("calls", "uses", "references", "returns").alias("flow"), F.col("type").isin("imports", "depends_on").alias("di"))
    r = ends.groupBy("id").agg(F.count("*").alias("n"), F.bool_or("flow").alias("has_flow"), F.bool_or("di").alias("has_di"))
    e = entities(spark, d).join(r, "id", "left").na.fill(0, ["n"]).na.fill(False, ["has_flow", "has_di"])
    c = scoring.entity_confidence(F.col("has_flow"), F.col("has_di"), F.col("type_name").isNotNull(), F.lit(False), F.col("n"))
    return e.select("id", F.round(c, 6).alias("confidence"))


@query(
    f"""WITH {_FILES} SELECT file_id, CAST(len(list_distinct(regexp_extract_all(content, 'function ([A-Za-z_$][A-Za-z0-9_$]*)', 1))) AS BIGINT) AS n_functions, CAST(len(regexp_extract_all(content, '(?m)^import |require\\(')) AS BIGINT) AS n_imports,
CAST(len(regexp_extract_all(content, ': *(?:string|number|boolean|any|unknown|void)\\b')) AS BIGINT) AS n_annotations, CAST(len(regexp_extract_all(content, '\\.[A-Za-z_$][A-Za-z0-9_$]*\\(')) AS BIGINT) AS n_calls,
CAST(len(regexp_extract_all(content, '[^=!<>]=[^=>]')) AS BIGINT) AS n_assignments, contains(content, '??') AS has_default, length(content) AS n_chars FROM files WHERE content IS NOT NULL"""
)
def code_features(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d, "content").where("content IS NOT NULL")
    return f.select("file_id", *(c.alias(k) for k, c in features.code_features(F.col("content")).items()))


@query(
    """SELECT DISTINCT embedding_id, 'name: ' || entity_name || ' | type: ' || lower(entity_type) || ' | context: ' || context AS text, md5(coalesce(entity_name, '') || '|' || coalesce(context, '') || '|') AS key
FROM semantic_embeddings WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL AND context IS NOT NULL"""
)
def semantic_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that an entity is embedded by, with its whole context."""
    e = table(spark, d, "semantic_embeddings").where("entity_name IS NOT NULL AND entity_type IS NOT NULL AND context IS NOT NULL")
    text = features.semantic_text(F.col("entity_name"), F.lower("entity_type"), F.col("context"), F.lit(None).cast("string"))
    return e.select("embedding_id", text.alias("text"), features.cache_key(F.col("entity_name"), F.col("context"), F.lit("")).alias("key")).distinct()


@query(
    f"""WITH {_FILES}, t AS (SELECT file_id, unnest(regexp_extract_all(content, 'useContext\\(([A-Za-z_$][A-Za-z0-9_$]*)\\)', 1)) AS context, 'consumer' AS role FROM files WHERE content IS NOT NULL
UNION ALL SELECT file_id, unnest(regexp_extract_all(content, '<([A-Za-z_$][A-Za-z0-9_$]*)\\.Provider', 1)), 'provider' FROM files WHERE content IS NOT NULL)
SELECT context, role, count(DISTINCT file_id) AS n_files FROM t GROUP BY 1, 2"""
)
def context_flows(spark: SparkSession, d: str) -> DataFrame:
    """Contexts with the files that provide and those that consume them."""
    f = _files(spark, d, "content").where("content IS NOT NULL")
    one = lambda rx, role: f.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(rx), F.lit(1))).alias("context"), F.lit(role).alias("role"))
    both = one(r"useContext\(([A-Za-z_$][A-Za-z0-9_$]*)\)", "consumer").unionByName(one(r"<([A-Za-z_$][A-Za-z0-9_$]*)\.Provider", "provider"))
    return both.groupBy("context", "role").agg(F.countDistinct("file_id").alias("n_files"))


@query(
    """WITH v AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM (SELECT embedding_id AS id, CAST(min(embedding) AS DOUBLE[]) AS v FROM semantic_embeddings
WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY 1)),
m AS (SELECT embedding_id AS id, min(file_path) AS f, min(lower(entity_type)) AS t FROM semantic_embeddings GROUP BY 1),
c AS (SELECT v.*, m.f FROM v JOIN m ON m.id = v.id WHERE m.f IS NOT NULL AND m.t IN ('function', 'class', 'component')),
s AS (SELECT a.id AS p, b.id AS q, round(list_dot_product(a.v, b.v) / (a.l * b.l), 10) AS r FROM c a JOIN c b ON a.f <> b.f WHERE a.id % 20 = 0)
SELECT p AS source, q AS target FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY r DESC, q) AS rn FROM s) WHERE rn <= 10 AND r >= 0.75"""
)
def semantic_calls(spark: SparkSession, d: str) -> DataFrame:
    """Similar callables in other files, for each whose id is divisible by 20."""
    meta = table(spark, d, "semantic_embeddings").groupBy(F.col("embedding_id").alias("id")).agg(F.min("file_path").alias("f"), F.min(F.lower("entity_type")).alias("t"))
    meta = meta.where(F.col("f").isNotNull() & F.col("t").isin("function", "class", "component")).select("id", F.xxhash64("f").alias("g"))
    v = _embeddings(spark, d).join(meta, "id")
    near = vectors.top_k(v, v.where("id % 20 = 0"), 10, other_group="g")
    return near.where("similarity >= 0.75").select(F.col("query_id").alias("source"), F.col("other_id").alias("target"))


@query(
    f"""WITH RECURSIVE {_CLUSTERS}, u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / l AS x FROM cl JOIN v USING (id) WHERE label <> -1)
SELECT label, max(n) AS n, round(sqrt(sum(m * m)), 6) AS confidence FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1"""
)
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of vectors within a cosine of 0.7 with their size and how close members are to the centroid."""
    v = _embeddings(spark, d)
    return vectors.centroids(v, vectors.clusters(v, 0.7)).select("label", "n", F.round("confidence", 6).alias("confidence"))


@query("SELECT type, count(*) AS n, CASE type WHEN 'imports' THEN 'blue' WHEN 'calls' THEN 'green' WHEN 'renders' THEN 'purple' WHEN 'uses' THEN 'orange' WHEN 'depends_on' THEN 'red' ELSE 'grey' END AS colour FROM links_now GROUP BY 1", "links_now")
def edge_legend(spark: SparkSession, d: str) -> DataFrame:
    e = links_now(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return e.select("type", "n", views.edge_style(F.col("type"))["colour"].alias("colour"))


@query(f"WITH {_FILES} SELECT hook, count(DISTINCT file_id) AS n_files FROM (SELECT file_id, unnest(regexp_extract_all(content, '{imports.HOOK_CALL}', 1)) AS hook FROM files WHERE content IS NOT NULL) WHERE hook NOT IN ({', '.join(repr(h) for h in imports.HOOKS)}) GROUP BY 1")
def custom_hooks(spark: SparkSession, d: str) -> DataFrame:
    c = imports.hook_calls(_files(spark, d, "content")).where(~F.col("hook").isin(*imports.HOOKS))
    return c.groupBy("hook").agg(F.countDistinct("file_id").alias("n_files"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
