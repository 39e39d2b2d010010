"""Project scans: files of a folder, project types, configuration, entry points, module keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a scan leaves out, and project types in order of priority.
PRUNED = (".git", "node_modules", "_pycache_", "__pycache__", ".venv", "venv", "target", "build", "dist")
ANGULAR = "projects map<string,struct<architect:struct<build:struct<options:struct<main:string>>>>>"
MAIN_ACTIVITY = r"<activity[^>]*android:name=\"([^\"]+)\"[^>]*>(?:(?!</activity>)[\s\S])*android\.intent\.action\.MAIN"
PRIORITY = ("spring_boot", "react_vite", "angular", "django", "express_node", "maven_java", "gradle_java", "android", "python_app")
LANGUAGE_OF = {
    "react_vite": ("typescript", "react"), "angular": ("typescript", "angular"), "express_node": ("javascript", "express"),
    "django": ("python", "django"), "python_app": ("python", "python"), "spring_boot": ("java", "spring_boot"),
    "maven_java": ("java", "java"), "gradle_java": ("java", "java"), "android": ("java", "android"),
}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, md5): all text files below a folder, paths relative to it, some folders left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = F.regexp_replace("path", r"^file:/*", "/")
    below = F.regexp_replace(plain, "^.*?" + _quoted(folder.rstrip("/").removeprefix("file:")) + "/", "")
    pruned = r"(^|/)(" + "|".join(_quoted(p) for p in PRUNED) + ")/"
    rows = raw.select(below.alias("path"), F.col("content").alias("raw"))
    return rows.where(~F.col("path").rlike(pruned)).select("path", F.decode("raw", "UTF-8").alias("content"), F.md5("raw").alias("md5"))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def detected(files: DataFrame) -> DataFrame:
    """(project, project_type): the sign of highest priority in each project; files: (path, content)."""
    c, p = F.col("content"), F.col("path")
    signs: dict[str, Column] = {
        "spring_boot": F.contains(c, F.lit("@SpringBootApplication")) | c.rlike(r"org\.springframework"),
        "react_vite": c.rlike("from ['\"]react['\"]"),
        "angular": F.contains(c, F.lit("@angular/core")),
        "django": c.rlike("(?m)^from django") | p.rlike(r"/(manage|wsgi|asgi)\.py$"),
        "express_node": c.rlike("from ['\"]express['\"]|require\\(['\"]express['\"]\\)"),
        "maven_java": p.rlike(r"\.java$"),
        "python_app": p.rlike(r"\.py$"),
    }
    found = F.filter(F.array(*(F.when(s, PRIORITY.index(k)) for k, s in signs.items())), lambda x: x.isNotNull())
    best = files.select(F.split("path", "/")[0].alias("project"), F.array_min(found).alias("p")).where("p IS NOT NULL").groupBy("project").agg(F.min("p").alias("p"))
    return best.select("project", F.element_at(F.array(*(F.lit(x) for x in PRIORITY)), F.col("p") + 1).alias("project_type"))


def module_index(files: DataFrame) -> DataFrame:
    """(key, path): the path, the path without extension, and folders of index files; the last file wins."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    folder = F.when(F.col("path").rlike(r"/(index|__init__)\.[^./]+$"), F.regexp_replace("path", r"/(index|__init__)\.[^./]+$", ""))
    keys = F.filter(F.array(F.col("path"), stem, folder), lambda x: x.isNotNull())
    return files.select("file_id", "path", F.explode(keys).alias("key")).groupBy("key").agg(F.max_by("path", "file_id").alias("path"))


def without_comments(text: Column) -> Column:
    """JSON with comments as JSON: comments to the end of a line go, but not inside strings."""
    kept = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(kept, r",(\s*[}\]])", "$1")


def path_aliases(configs: DataFrame) -> DataFrame:
    """(path, alias, target) of the paths in tsconfig files; configs: (path, content)."""
    schema = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
    o = F.from_json(without_comments(F.col("content")), schema)["compilerOptions"]
    rows = configs.where(F.col("path").rlike(r"(^|/)tsconfig[^/]*\.json$")).select("path", F.coalesce(o["baseUrl"], F.lit(".")).alias("base"), F.explode(o["paths"]).alias("alias", "targets"))
    trim = lambda c: F.regexp_replace(c, r"/?\*$", "")
    joined = F.regexp_replace(F.concat_ws("/", "base", trim(F.element_at("targets", 1))), r"^\./|/\./", "")
    return rows.where(F.size("targets") > 0).select("path", trim(F.col("alias")).alias("alias"), joined.alias("target"))


def dependencies(configs: DataFrame) -> DataFrame:
    """(path, name, dev) of the dependencies in package.json files."""
    p = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    packages = configs.where(F.col("path").rlike(r"(^|/)package\.json$")).select("path", p.alias("p"))
    one = lambda m, dev: packages.select("path", F.explode(F.map_keys(m)).alias("name")).withColumn("dev", F.lit(dev))
    return one(F.col("p.dependencies"), False).unionByName(one(F.col("p.devDependencies"), True))


def entry_points(files: DataFrame) -> DataFrame:
    """(path, type, value) of places where programs start; files: (path, content)."""
    c, p = F.col("content"), F.col("path")
    script = F.ltrim(F.regexp_extract(c, r"<script[^>]*\ssrc=[\"']([^\"']+)[\"']", 1), F.lit("/"))
    main_class = F.explode(F.regexp_extract_all(c, F.lit(r"<(?:[\w]+:)?\w*mainClass>\s*([^<\s]+)\s*<"), F.lit(1)))
    rows = [
        files.where(p.rlike(r"(^|/)index\.html$") & (script != "")).select("path", F.lit("html_script").alias("type"), script.alias("value")),
        files.where(p.rlike(r"(^|/)src/main\.(tsx|jsx|ts|js)$")).select("path", F.lit("main_module").alias("type"), p.alias("value")),
        files.where(p.rlike(r"(^|/)pom\.xml$")).select("path", F.lit("main_class").alias("type"), main_class.alias("value")),
        files.where(p.rlike(r"\.java$") & F.contains(c, F.lit("@SpringBootApplication")) & F.contains(c, F.lit("public static void main"))).select("path", F.lit("spring_boot").alias("type"), p.alias("value")),
        files.where(p.rlike(r"(^|/)(urls|settings)\.py$")).select("path", F.lit("django").alias("type"), p.alias("value")),
        files.where(p.rlike(r"(^|/)(index|server|app)\.js$") & c.rlike(r"app\.listen|express\(\)")).select("path", F.lit("express").alias("type"), p.alias("value")),
        files.where(p.rlike(r"(^|/)angular\.json$")).select(
            "path", F.lit("angular_main").alias("type"), F.explode(F.transform(F.map_values(F.from_json(c, ANGULAR)["projects"]), lambda x: x["architect"]["build"]["options"]["main"])).alias("value")
        ).where("value IS NOT NULL"),
        files.where(p.rlike(r"(^|/)AndroidManifest\.xml$")).select("path", F.lit("android_activity").alias("type"), F.explode(F.regexp_extract_all(c, F.lit(MAIN_ACTIVITY), F.lit(1))).alias("value")),
        files.where(p.rlike(r"^main\.(py|js|ts|java)$")).select("path", F.lit("generic").alias("type"), p.alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def applicable(files: DataFrame) -> DataFrame:
    """(project_type): every type whose signs a project's files show; files: (path, content) of one project.

    All signs are flags of one aggregate over the files, so the table is read once.
    """
    base = F.regexp_extract("path", "([^/]*)$", 1)
    c = F.col("content")
    deps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    named = F.when(base == "package.json", F.array_union(F.coalesce(F.map_keys(deps["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(deps["devDependencies"]), F.array().cast("array<string>"))))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    any_of = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    dep = lambda *names: any_of(F.arrays_overlap(named, F.array(*(F.lit(n) for n in names))))
    flags = files.agg(
        (any_of(base.rlike(r"^vite\.config\.(js|ts|mjs)$")) | dep("vite") | (dep("react") & any_of(base == "index.html"))).alias("react_vite"),
        any_of(base == "pom.xml").alias("maven_java"),
        (any_of(base.isin("manage.py", "settings.py", "urls.py", "wsgi.py", "asgi.py")) | any_of((base == "requirements.txt") & F.contains(F.lower(c), F.lit("django")))).alias("django"),
        (any_of(base == "angular.json") | dep("@angular/core", "angular")).alias("angular"),
        (dep("express") | any_of(base.isin("app.js", "server.js", "index.js"))).alias("express_node"),
        (any_of(base.isin("pom.xml", "build.gradle") & F.contains(c, F.lit("spring-boot"))) | any_of(F.endswith(base, F.lit(".java")) & F.contains(c, F.lit("@SpringBootApplication")))).alias("spring_boot"),
        (any_of(base.isin("AndroidManifest.xml", "build.gradle", "gradle.properties")) | (any_of(F.array_contains(folders, "app")) & any_of(F.array_contains(folders, "src")) & any_of(F.array_contains(folders, "res")))).alias("android"),
    )
    each = F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in flags.columns)), lambda x: x.isNotNull())
    return flags.select(F.explode(each).alias("project_type"))


def chosen(types: DataFrame) -> DataFrame:
    """The one type that comes first in the order of priority, with its language and framework."""
    rank = F.array_position(F.array(*(F.lit(p) for p in PRIORITY)), F.col("project_type"))
    best = types.agg(F.min_by("project_type", rank).alias("project_type"))
    both = F.create_map(*[x for k, (a, b) in LANGUAGE_OF.items() for x in (F.lit(k), F.struct(F.lit(a).alias("language"), F.lit(b).alias("framework")))])
    return best.select("project_type", F.coalesce(both[F.col("project_type")]["language"], F.lit("unknown")).alias("language"), F.coalesce(both[F.col("project_type")]["framework"], F.lit("unknown")).alias("framework"))
