"""Queries over source text, vectors and progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions import exprs
from .operators import classify, imports, vectors
from .plans.graph_tables import links_now, nodes_now, sql
from .sources import parsers, projects
from .streaming import progress
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


_FILES = "files AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, path) AS rn FROM hier_files) WHERE rn = 1)"


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest record of each file, with these columns.

    Records that a later one replaced are found by their keys alone and anti-joined.  They are few,
    so that the optimizer, which knows their size by then, need not shuffle the texts.
    """
    h = table(spark, d, "hier_files")
    keys = h.select("file_id", F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"))
    newest = keys.groupBy("file_id").agg(F.max("at").alias("newest"), F.min("at").alias("oldest")).where("newest > oldest")
    old = keys.join(newest, "file_id").where("at < newest").select("file_id", "at").distinct()
    every = h.select("file_id", "path", *columns, F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"))
    return every.join(old, ["file_id", "at"], "left_anti").select("file_id", "path", *columns)


# classification


def _rules_sql(rules: dict, weights: tuple) -> str:
    each = ", ".join(f"{{'score': {classify.sql_score('t', 'n', r, k, weights)}, 'ord': {-i}, 'label': '{k}'}}" for i, (k, r) in enumerate(rules.items()))
    return f"""WITH {_FILES}, s AS (SELECT file_id, list_max([{each}]) AS b FROM (
SELECT file_id, lower(coalesce(content, '')) AS t, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM files))
SELECT file_id, CASE WHEN b.score > 0 THEN b.label END AS label, round(b.score, 6) AS score FROM s"""


def _classified(spark: SparkSession, d: str, rules: dict, weights: tuple) -> DataFrame:
    f = _files(spark, d, "content")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return classify.best(classify.scores(f, F.col("content"), name, rules, weights)).select("file_id", "label", "score")


@query(_rules_sql(classify.INTENTS, classify.INTENT_WEIGHTS))
def intents(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, classify.INTENTS, classify.INTENT_WEIGHTS)


_STATS = "SELECT label, count(*) AS n, round(avg(score), 3) AS mean, CAST(count_if(score > 0.7) AS BIGINT) AS n_high, CAST(count_if(score < 0.3) AS BIGINT) AS n_low FROM ({}) GROUP BY 1"


@query(_STATS.format(ORACLES["intents"]))
def intent_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return intents(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"), F.count_if(s > 0.7).alias("n_high"), F.count_if(s < 0.3).alias("n_low"))


@query(_rules_sql(classify.BEHAVIOURS, classify.BEHAVIOUR_WEIGHTS))
def behaviours(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, classify.BEHAVIOURS, classify.BEHAVIOUR_WEIGHTS)


@query(_STATS.format(ORACLES["behaviours"]))
def behaviour_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return behaviours(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"), F.count_if(s > 0.7).alias("n_high"), F.count_if(s < 0.3).alias("n_low"))


def _listed_sql(rules: dict, part: int, most: int) -> str:
    q = lambda x: x.replace("'", "''")
    test = lambda x: f"regexp_matches(t, '{q(x)}')" if part == 1 else f"contains(t, '{q(x)}')"
    each = " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"CASE WHEN {test(x)} THEN '{q(x)}' END" for x in r[part]) + "]" for k, r in rules.items())
    return f"array_to_string(list_filter(CASE label {each} END, lambda x: x IS NOT NULL)[1:{most}], ', ')"


def _evidence_sql(of: str, rules: dict) -> str:
    parts = ", ".join(f"{_listed_sql(rules, i, n)} AS {name}" for i, n, name in ((0, 3, "words"), (1, 2, "patterns"), (2, 2, "contexts")))
    return f"""WITH {_FILES} SELECT c.file_id, label, {parts} FROM ({ORACLES[of]}) c JOIN (SELECT file_id, lower(coalesce(content, '')) AS t FROM files) f ON f.file_id = c.file_id WHERE label IS NOT NULL"""


def _evidence(spark: SparkSession, d: str, rules: dict, weights: tuple) -> DataFrame:
    f = _files(spark, d, "content")
    rows = classify.best(classify.scores(f, F.col("content"), F.regexp_extract("path", "([^/]*)$", 1), rules, weights)).where("label IS NOT NULL")
    return classify.evidence(rows, F.col("content"), F.col("label"), rules).select("file_id", "label", "words", "patterns", "contexts")


@query(_evidence_sql("intents", classify.INTENTS))
def intent_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for the intent of each file."""
    return _evidence(spark, d, classify.INTENTS, classify.INTENT_WEIGHTS)


@query(_evidence_sql("behaviours", classify.BEHAVIOURS))
def behaviour_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d, classify.BEHAVIOURS, classify.BEHAVIOUR_WEIGHTS)


def _all_scores_sql(rules: dict, weights: tuple) -> str:
    each = ", ".join(f"{classify.sql_score('t', 'n', r, k, weights)} AS s_{k}" for k, r in rules.items())
    return f"""{_FILES}, s AS (SELECT file_id, {each} FROM (SELECT file_id, lower(coalesce(content, '')) AS t, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM files))"""


@query(
    "WITH " + _all_scores_sql(classify.BEHAVIOURS, classify.BEHAVIOUR_WEIGHTS) + ", r AS (SELECT file_id, list_filter(["
    + ", ".join(f"CASE WHEN s_{k} > {bound} THEN '{text}' END" for k, bound, text in classify.RISKS) + "], lambda x: x IS NOT NULL) AS risks, list_filter(["
    + ", ".join(f"CASE WHEN s_{k} > {bound} THEN '{text}' END" for k, bound, text in classify.ADVICE) + "], lambda x: x IS NOT NULL) AS advice, "
    + "list_filter([" + ", ".join(f"CASE WHEN s_{k} > 0.5 THEN s_{k} END" for k in classify.BEHAVIOURS) + "], lambda x: x IS NOT NULL) AS high, greatest(" + ", ".join(f"s_{k}" for k in classify.BEHAVIOURS) + ") AS top FROM s) "
    + f"SELECT file_id, array_to_string(risks, '; ') AS risks, array_to_string(CASE WHEN len(risks) > 3 THEN list_append(advice, '{classify.MANY_RISKS}') ELSE advice END, '; ') AS advice, "
    + f"round(least(1.0, len(high) / {len(classify.BEHAVIOURS)} + 0.3 * top), 6) AS confidence FROM r"
)
def behaviour_risks(spark: SparkSession, d: str) -> DataFrame:
    """Risks and advice of each file, and how sure its behaviours are."""
    f = _files(spark, d, "content")
    s = classify.scores(f, F.col("content"), F.regexp_extract("path", "([^/]*)$", 1), classify.BEHAVIOURS, classify.BEHAVIOUR_WEIGHTS)
    rows = s.select("file_id", "scores", classify.said_of(F.col("scores"), classify.RISKS).alias("r"), classify.said_of(F.col("scores"), classify.ADVICE).alias("a"))
    advice = F.when(F.size("r") > 3, F.array_append("a", F.lit(classify.MANY_RISKS))).otherwise(F.col("a"))
    high = F.size(F.filter("scores", lambda x: x["score"] > 0.5)) / F.lit(len(classify.BEHAVIOURS))
    sure = F.round(F.least(F.lit(1.0), high + 0.3 * F.array_max("scores")["score"]), 6)
    return rows.select("file_id", F.array_join("r", "; ").alias("risks"), F.array_join(advice, "; ").alias("advice"), sure.alias("confidence"))


def _roles_sql() -> str:
    roles = " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, '{r}' AS role, id, regexp_matches(lower(name), '({ends})$') AS named FROM nodes_now WHERE regexp_matches(lower(name), '{rx}')" for p, (rs, _, ends) in classify.PATTERNS.items() for r, rx in rs.items()
    )
    wanted = ", ".join(f"('{p}', '{s}', '{t}')" for p, (_, ls, _) in classify.PATTERNS.items() for s, t in ls)
    return f"""r AS ({roles}), w(p, s, t) AS (VALUES {wanted}),
met AS (SELECT a.pattern, a.role AS s, b.role AS t, count(*) AS n FROM links_now l JOIN r a ON a.id = l.source JOIN r b ON b.id = l.target AND b.pattern = a.pattern
  JOIN w ON w.p = a.pattern AND w.s = a.role AND w.t = b.role GROUP BY ALL)"""


@query(
    "WITH " + _roles_sql() + ", z(p, roles, links) AS (VALUES " + ", ".join(f"('{p}', {len(rs)}, {len(ls)})" for p, (rs, ls, _) in classify.PATTERNS.items()) + """),
per AS (SELECT pattern, count(*) AS present, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS n_members, sum(k) AS n_named FROM (SELECT pattern, role, count(*) AS n, count_if(named) AS k FROM r GROUP BY 1, 2) GROUP BY 1),
hits AS (SELECT pattern, CAST(sum(n) AS BIGINT) AS n_links, count(*) AS kinds FROM met GROUP BY 1)
SELECT per.pattern, n_members, coalesce(n_links, 0) AS n_links,
round(least(1.0, 0.4 * present / z.roles + CASE WHEN z.links > 0 THEN 0.3 * coalesce(kinds, 0) / z.links ELSE 0 END + 0.2 * least / most + 0.1 * n_named / n_members), 6) AS confidence
FROM per JOIN z ON z.p = per.pattern LEFT JOIN hits ON hits.pattern = per.pattern""",
    "nodes_now", "links_now",
)
def architectural_patterns(spark: SparkSession, d: str) -> DataFrame:
    return classify.patterns(nodes_now(spark, d), links_now(spark, d))


@query(
    "WITH " + _roles_sql() + ", e(p, r) AS (VALUES " + ", ".join(f"('{p}', '{r}')" for p, (rs, _, _) in classify.PATTERNS.items() for r in rs) + """)
SELECT p AS pattern, 'Missing ' || e.r || ' components' AS missing, 'Add missing components to complete ' || p || ' pattern' AS advice FROM e
WHERE p IN (SELECT pattern FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.pattern = e.p AND r.role = e.r)
UNION ALL SELECT p, 'Missing ' || s || ' -> ' || t || ' relationships', 'Establish missing relationships for ' || p || ' pattern' FROM w
WHERE EXISTS (SELECT 1 FROM r WHERE r.pattern = w.p AND r.role = w.s) AND EXISTS (SELECT 1 FROM r WHERE r.pattern = w.p AND r.role = w.t) AND NOT EXISTS (SELECT 1 FROM met WHERE met.pattern = w.p AND met.s = w.s AND met.t = w.t)""",
    "nodes_now", "links_now",
)
def pattern_violations(spark: SparkSession, d: str) -> DataFrame:
    return classify.violations(nodes_now(spark, d), links_now(spark, d))


@query("WITH " + _roles_sql() + " SELECT pattern, role, count(*) AS n, min(id) AS first_id, CAST(count_if(named) AS BIGINT) AS n_named FROM r GROUP BY 1, 2", "nodes_now", "links_now")
def pattern_components(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that play each role of a pattern."""
    return classify.roles(nodes_now(spark, d)).groupBy("pattern", "role").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.count_if("named").alias("n_named"))


# names and scalar functions


@query(
    r"""SELECT id, array_to_string(CASE WHEN contains(name, '_') THEN string_split(name, '_') ELSE list_transform(regexp_extract_all(
regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\d+'), lambda x: lower(x)) END, '|') AS words FROM nodes_now WHERE name IS NOT NULL""",
    "nodes_now",
)
def identifier_words(spark: SparkSession, d: str) -> DataFrame:
    return nodes_now(spark, d).where("name IS NOT NULL").select("id", F.array_join(exprs.identifier_words(F.col("name")), "|").alias("words"))


@query("SELECT id, replace(replace(file, '/', '_'), '.', '_') || '_' || name || '_' || substr(md5(file || ':' || name), 1, 8) AS made FROM nodes_now WHERE file IS NOT NULL AND name IS NOT NULL", "nodes_now")
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids as the parser makes them."""
    n = nodes_now(spark, d).where("file IS NOT NULL AND name IS NOT NULL")
    return n.select("id", exprs.node_id(F.col("file"), F.col("name")).alias("made"))


@query("SELECT edge_id, regexp_replace(source, '[^A-Za-z0-9/_-]', '_', 'g') AS source, regexp_replace(target, '[^A-Za-z0-9/_-]', '_', 'g') AS target FROM links_now", "links_now")
def sanitised_ids(spark: SparkSession, d: str) -> DataFrame:
    return links_now(spark, d).select("edge_id", exprs.sanitised(F.col("source")).alias("source"), exprs.sanitised(F.col("target")).alias("target"))


@query(
    """SELECT id, regexp_matches(name, '^(is|has|can|should|will)') AS is_boolean_name, regexp_matches(name, '(s|List|Array|Items)$') AS is_array_name,
regexp_matches(name, '^(on|handle|process|execute)') AS is_handler_name, upper(name) = name AND regexp_matches(name, '[A-Za-z]') AS is_constant_name, contains(name, '_') AS has_underscore,
regexp_matches(name, '^[a-z]+([A-Z][a-z0-9]*)+$') AS is_camel, regexp_matches(name, '^([A-Z][a-z0-9]*)+$') AS is_pascal,
regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') AS is_snake, regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)+$') AS is_kebab FROM nodes_now WHERE name IS NOT NULL""",
    "nodes_now",
)
def naming_conventions(spark: SparkSession, d: str) -> DataFrame:
    n = nodes_now(spark, d).where("name IS NOT NULL")
    return n.select("id", *(c.alias(k) for k, c in exprs.naming(F.col("name")).items()))


_COUNTS = ", ".join(f"CAST((length(t) - length(replace(t, '{w}', ''))) / {len(w)} AS DOUBLE)" for w in exprs.EMBEDDING_WORDS)


@query(
    f"""WITH {_FILES}, v AS (SELECT file_id, [CAST(length(t) AS DOUBLE), {_COUNTS}] AS x FROM (SELECT file_id, lower(content) AS t FROM files WHERE content IS NOT NULL))
SELECT file_id, array_to_string(list_transform(x, lambda a: CAST(CAST(round(a / CASE WHEN n > 0 THEN n ELSE 1 END * 100000) AS BIGINT) AS VARCHAR)), ',') AS embedding
FROM (SELECT *, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM v)"""
)
def fallback_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Features of a text that stand in for a model's embedding, in hundred-thousandths."""
    f = _files(spark, d, "content").where("content IS NOT NULL")
    f = exprs.with_fallback_embedding(f, "content", "e")
    return f.select("file_id", F.array_join(F.transform("e", lambda x: F.round(x * 100000).cast("bigint").cast("string")), ",").alias("embedding"))


# imports, hooks, types, flows


_ES6 = imports.ES6.replace("'", "''")
_IMPORTS = f"""{_FILES}, i0 AS (SELECT file_id, path, unnest(regexp_extract_all(content, '{_ES6}', 0)) AS s, generate_subscripts(regexp_extract_all(content, '{_ES6}', 0), 1) - 1 AS n FROM files WHERE content IS NOT NULL),
i AS (SELECT file_id, path, CAST(n AS INT) AS n, trim(regexp_extract(s, '{_ES6}', 1)) AS clause, regexp_extract(s, '{_ES6}', 2) AS module FROM i0)"""


@query(f"WITH {_IMPORTS} SELECT file_id, n, clause, module FROM i")
def es6_imports(spark: SparkSession, d: str) -> DataFrame:
    return imports.es6_imports(_files(spark, d, "content")).select("file_id", "n", "clause", "module")


@query(
    f"""WITH {_IMPORTS}, b AS (SELECT file_id, n, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || module AS p FROM i WHERE starts_with(module, '.')),
c AS (SELECT file_id, n, regexp_replace(regexp_replace(p, '/(\\./)+', '/', 'g'), '/[^/.]+/\\.\\./', '/') AS p FROM b),
t AS (SELECT file_id, n, o, CASE WHEN o < 10 THEN p ELSE regexp_replace(p, '\\.(js|jsx|mjs)$', '') END || ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.json', '/index.ts', '/index.tsx', '/index.js'][o % 10 + 1] AS f FROM c, (SELECT unnest(range(20)) AS o))
SELECT t.file_id, t.n, arg_min(t.f, o) AS target FROM t WHERE f IN (SELECT path FROM files) GROUP BY 1, 2"""
)
def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """Relative imports and the files they lead to."""
    f = _files(spark, d, "content")
    found = imports.resolve(imports.es6_imports(f), table(spark, d, "hier_files").select("path"))
    return found.where("target IS NOT NULL").select("file_id", "n", "target")


@query(
    f"""WITH {_IMPORTS}, names AS (SELECT module, unnest(list_filter(list_transform(string_split(regexp_replace(clause, '[{{}}]', ',', 'g'), ','), lambda x: trim(regexp_replace(x, '^.* as ', ''))), lambda x: x <> '')) AS name FROM i)
SELECT CASE WHEN module = 'react' THEN 'component' WHEN regexp_matches(name, '(Service|API)$') THEN 'service' WHEN regexp_matches(name, 'Config$') THEN 'configuration' ELSE 'service' END AS category,
count(*) AS n, count(DISTINCT name) AS n_names FROM names GROUP BY 1"""
)
def di_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Imported names by the kind of dependency they are."""
    i = imports.es6_imports(_files(spark, d, "content"))
    names = i.select("module", F.explode(imports.imported_names(F.col("clause"))).alias("name"))
    return names.groupBy(imports.di_category(F.col("name"), F.col("module")).alias("category")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


_HOOK = imports.HOOK_CALL.replace("'", "''")


@query(
    f"""WITH {_FILES}, c AS (SELECT file_id, unnest(regexp_extract_all(content, '{_HOOK}', 1)) AS hook FROM files WHERE content IS NOT NULL)
SELECT hook, {exprs.sql_case('hook', imports.HOOKS, 'custom')} AS category, count(*) AS n_calls, count(DISTINCT file_id) AS n_files FROM c GROUP BY 1"""
)
def hook_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = imports.hook_calls(_files(spark, d, "content"))
    return c.groupBy("hook").agg(F.count("*").alias("n_calls"), F.countDistinct("file_id").alias("n_files")).select(
        "hook", exprs.mapped(F.col("hook"), imports.HOOKS, "custom").alias("category"), "n_calls", "n_files"
    )


@query(
    """WITH h AS (SELECT json_extract_string(js, '$.hook_info.hook_name') AS hook, json_extract(js, '$.hook_info.dependencies') AS deps
FROM (SELECT CASE WHEN json_valid(metadata) THEN metadata ELSE '{}' END AS js FROM nodes_now))
SELECT hook, CASE WHEN deps IS NULL OR json_type(deps) <> 'ARRAY' THEN 'always' WHEN json_array_length(deps) = 0 THEN 'mount' ELSE 'update' END AS runs, count(*) AS n FROM h WHERE hook IS NOT NULL GROUP BY 1, 2""",
    "nodes_now",
)
def effect_types(spark: SparkSession, d: str) -> DataFrame:
    """When the effects that nodes tell of run."""
    h = F.from_json(exprs.whole_json(F.col("metadata")), "hook_info struct<hook_name:string,dependencies:array<string>>")["hook_info"]
    n = nodes_now(spark, d).select(h["hook_name"].alias("hook"), imports.effect_type(h["dependencies"]).alias("runs"))
    return n.where("hook IS NOT NULL").groupBy("hook", "runs").agg(F.count("*").alias("n"))


@query(
    f"SELECT {exprs.sql_case('type', exprs.FLOW_OF_EDGE, 'generic_relationship')} AS flow_type, count(*) AS n, count(DISTINCT source) AS n_sources FROM links_now GROUP BY 1", "links_now"
)
def flow_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = links_now(spark, d).select("source", exprs.mapped(F.col("type"), exprs.FLOW_OF_EDGE, "generic_relationship").alias("flow_type"))
    return e.groupBy("flow_type").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


@query(
    """WITH a AS (SELECT edge_id, CASE WHEN json_valid(metadata) AND json_type(metadata, '$.imported_names') = 'ARRAY' THEN CAST(json_extract(metadata, '$.imported_names') AS VARCHAR[]) ELSE [] END AS names FROM links_now)
SELECT edge_id, CAST(generate_subscripts(names, 1) - 1 AS INT) AS position, unnest(names) AS name, 0.9::DOUBLE AS confidence FROM a""",
    "links_now",
)
def argument_flows(spark: SparkSession, d: str) -> DataFrame:
    """One flow per name that a link carries."""
    names = F.from_json(exprs.whole_json(F.col("metadata")), "imported_names array<string>")["imported_names"]
    return links_now(spark, d).select("edge_id", F.posexplode(names).alias("position", "name")).withColumn("confidence", F.lit(0.9))


@query(
    """SELECT target AS id, arg_max(type_name, edge_id) AS type_name, round(0.95 * arg_max(e.confidence, edge_id), 6) AS confidence FROM links_now l JOIN entities e ON e.id = l.source
WHERE l.type IN ('uses', 'references', 'returns') AND type_name IS NOT NULL GROUP BY 1""",
    "entities", "links_now",
)
def propagated_types(spark: SparkSession, d: str) -> DataFrame:
    """Types carried one link on; of several the last wins."""
    from .plans.graph_tables import entities

    e = entities(spark, d).where("type_name IS NOT NULL").select(F.col("id").alias("source"), "type_name", F.col("confidence").alias("c"))
    hop = links_now(spark, d).where(F.col("type").isin("uses", "references", "returns")).select("edge_id", "source", "target").join(e, "source")
    best = hop.groupBy(F.col("target").alias("id")).agg(F.max_by(F.struct("type_name", "c"), "edge_id").alias("r"))
    return best.select("id", F.col("r.type_name").alias("type_name"), F.round(0.95 * F.col("r.c"), 6).alias("confidence"))


# files and projects


_FN = imports.FUNCTIONS.replace("'", "''")


@query(f"WITH {_FILES} SELECT file_id, unnest(regexp_extract_all(content, '{_FN}', 1)) AS name FROM files WHERE content IS NOT NULL")
def declared_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions that a pattern finds, for languages without a parser at hand."""
    return _files(spark, d, "content").where("content IS NOT NULL").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(imports.FUNCTIONS), F.lit(1))).alias("name"))


@query()
def parsed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the parsers find in every file, counted per language and type."""
    f = _files(spark, d, "content")
    return parsers.parsed(f).groupBy("language", "type").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


@query(
    f"WITH {_FILES} SELECT file_id, md5 IS NULL AS unknown FROM files WHERE content IS NOT NULL AND (md5 IS NULL OR lower(md5) <> md5(content))"
)
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text is not the one that their stored hash was taken of."""
    f = _files(spark, d, "content", "md5").where("content IS NOT NULL")
    return f.where(F.col("md5").isNull() | (F.lower("md5") != F.md5("content"))).select("file_id", F.col("md5").isNull().alias("unknown"))


@query(
    f"""WITH {_FILES} SELECT split_part(path, '/', 1) AS project, arg_min(kind, p) AS project_type FROM (SELECT path, unnest([
CASE WHEN contains(content, '@SpringBootApplication') OR regexp_matches(content, 'org\\.springframework') THEN {{'p': 0, 'kind': 'spring_boot'}} END,
CASE WHEN regexp_matches(content, 'from [''"]react[''"]') THEN {{'p': 1, 'kind': 'react_vite'}} END,
CASE WHEN contains(content, '@angular/core') THEN {{'p': 2, 'kind': 'angular'}} END,
CASE WHEN regexp_matches(content, '(?m)^from django') OR regexp_matches(path, '/(manage|wsgi|asgi)\\.py$') THEN {{'p': 3, 'kind': 'django'}} END,
CASE WHEN regexp_matches(content, 'from [''"]express[''"]|require\\([''"]express[''"]\\)') THEN {{'p': 4, 'kind': 'express_node'}} END,
CASE WHEN regexp_matches(path, '\\.java$') THEN {{'p': 5, 'kind': 'maven_java'}} END,
CASE WHEN regexp_matches(path, '\\.py$') THEN {{'p': 8, 'kind': 'python_app'}} END], recursive := false) AS e FROM files) x, (SELECT 1), LATERAL (SELECT e.p AS p, e.kind AS kind) WHERE e IS NOT NULL GROUP BY 1"""
)
def project_types(spark: SparkSession, d: str) -> DataFrame:
    """All signs are looked at; the one that comes first in the order of priority decides."""
    return projects.detected(_files(spark, d, "content"))


@query(f"WITH {_FILES} SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM files GROUP BY 1")
def language_statistics(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d, "content")
    return f.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext")).agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("n_chars"))


@query(
    f"""WITH {_FILES}, k AS (SELECT path AS key, path, file_id FROM files UNION ALL SELECT regexp_replace(path, '\\.[^./]+$', ''), path, file_id FROM files
UNION ALL SELECT regexp_replace(path, '/(index|__init__)\\.[^./]+$', ''), path, file_id FROM files WHERE regexp_matches(path, '/(index|__init__)\\.[^./]+$'))
SELECT key, arg_max(path, file_id) AS path FROM k GROUP BY 1"""
)
def module_index(spark: SparkSession, d: str) -> DataFrame:
    """Keys by which modules are looked up; the last file with a key holds it."""
    return projects.module_index(_files(spark, d))


# vectors


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return vectors.usable(table(spark, d, "semantic_embeddings"), "embedding_id", "embedding", order="computed_at")


_VECTORS = """v AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM (SELECT embedding_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM (
SELECT *, row_number() OVER (PARTITION BY embedding_id ORDER BY computed_at DESC NULLS LAST, embedding DESC) AS rn FROM semantic_embeddings WHERE embedding IS NOT NULL) WHERE rn = 1 AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))),
s AS (SELECT a.id AS p, b.id AS q, round(list_dot_product(a.v, b.v) / (a.l * b.l), 10) AS r FROM v a JOIN v b ON a.id <> b.id)"""


@query(f"WITH {_VECTORS} SELECT query_id, other_id, rank FROM (SELECT p AS query_id, q AS other_id, row_number() OVER (PARTITION BY p ORDER BY r DESC, q) AS rank FROM s WHERE p % 20 = 0) WHERE rank <= 10")
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all rows, for each row whose id is divisible by 20."""
    v = _embeddings(spark, d)
    return vectors.top_k(v, v.where("id % 20 = 0")).select("query_id", "other_id", F.col("rank").cast("bigint").alias("rank"))


_CLUSTERS = f"""{_VECTORS}, e AS MATERIALIZED (SELECT p, q FROM s WHERE r >= 0.7), w AS (SELECT id AS node, id AS label FROM v UNION SELECT e.q, w.label FROM w JOIN e ON e.p = w.node),
cl AS (SELECT id, CASE WHEN n > 0 THEN label ELSE -1 END AS label FROM (SELECT node AS id, min(label) AS label FROM w GROUP BY 1) x LEFT JOIN (SELECT p, count(*) AS n FROM e GROUP BY 1) c ON c.p = x.id)"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT id, label FROM cl")
def similarity_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of vectors within a cosine of 0.7, by their smallest member; -1 for vectors alone."""
    return vectors.clusters(_embeddings(spark, d), 0.7).select("id", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label"))


@query(
    """WITH v AS (SELECT DISTINCT ON (embedding_id) embedding_id, file_path AS file, CAST(embedding AS DOUBLE[]) AS v FROM semantic_embeddings
WHERE file_path IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) ORDER BY embedding_id),
u AS (SELECT file, unnest(list_transform(v, lambda x: x / l)) AS x, generate_subscripts(v, 1) AS i FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM v))
SELECT file, max(n) AS n, round(sum(m * m), 6) AS mean_similarity FROM (SELECT file, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1"""
)
def file_cohesion(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "semantic_embeddings").where("file_path IS NOT NULL").groupBy(F.col("embedding_id").alias("id")).agg(F.min("file_path").alias("file"))
    return vectors.cohesion(_embeddings(spark, d).join(paths, "id").select("file", "v"))


# progress


_EVENT_WEIGHTS = {"signup": 0.1, "view": 0.2, "click": 0.3, "error": 0.1, "purchase": 0.3}


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return progress.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_type", "event_id")


@query(
    """SELECT user_id, round(CASE event_type WHEN 'signup' THEN 0.0 WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.3 WHEN 'error' THEN 0.6 WHEN 'purchase' THEN 0.7 END +
CASE event_type WHEN 'view' THEN 0.2 WHEN 'click' THEN 0.3 WHEN 'purchase' THEN 0.3 ELSE 0.1 END * greatest(0.0, least(1.0, value / 100)), 6) AS overall
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def overall_progress(spark: SparkSession, d: str) -> DataFrame:
    last = progress.latest(table(spark, d, "events"), "user_id", "ts", "event_id").withColumn("done", F.col("value") / 100)
    return progress.overall(last, "event_type", "done", _EVENT_WEIGHTS).select("user_id", F.round("overall", 6).alias("overall"))


@query("SELECT user_id, max(value) AS peak, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents, count(*) AS n, arg_max(event_id, (value, event_id)) AS peak_event FROM events WHERE value IS NOT NULL GROUP BY 1")
def peak_usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value IS NOT NULL")
    return e.groupBy("user_id").agg(F.max("value").alias("peak"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total_cents"), F.count("*").alias("n"), F.max_by("event_id", F.struct("value", "event_id")).alias("peak_event"))


@query("SELECT event_type AS operation, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean, round(sum(value), 2) AS total FROM events GROUP BY 1")
def profiler_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("operation"))
    return e.agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH s AS (SELECT user_id, event_id, ts, CASE WHEN value > 100 THEN 'exceeded' WHEN value > 80 THEN 'warning' ELSE 'ok' END AS state FROM events)
SELECT event_id, state FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s) WHERE state <> 'ok' AND was IS DISTINCT FROM state"""
)
def threshold_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events at which a session enters a state of too much."""
    return progress.over_limit(table(spark, d, "events"), "user_id", "value", 100.0).where("state <> 'ok' AND entered").select("event_id", "state")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def progress_stream(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream over the events."""
    path = f"{d}/events.parquet"
    schema = T.StructType([f for f in spark.read.parquet(path).schema if f.name in ("event_id", "ts", "event_type", "value")])
    return progress.stream_counts(spark, path, schema)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
