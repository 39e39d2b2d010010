"""Module systems: exports, CommonJS, aliases, and lookups in node_modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .imports import REQUIRE, collapsed

# Statements, and names of modules that the runtime brings along.
EXPORTED = r"(?m)^export (default )?(?:abstract )?(?:async )?(?:(function|class|const|let|var|interface|type|enum)\*? +([A-Za-z_$][A-Za-z0-9_$]*)|\{([^}\n]*)\}(?: from ['\"]([^'\"\n]+)['\"])?|\* from ['\"]([^'\"\n]+)['\"])"
MODULE_EXPORTS = r"(?m)^(?:module\.)?exports(?:\.([A-Za-z_$][A-Za-z0-9_$]*))? = ([A-Za-z_$][A-Za-z0-9_$]*|\{[^}\n]*\})"
CORE = (
    "assert", "buffer", "child_process", "cluster", "crypto", "dns", "events", "fs", "http", "https", "net", "os", "path", "process", "querystring",
    "readline", "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib",
)


def es6_exports(files: DataFrame) -> DataFrame:
    """(file_id, n, kind, name, module, is_default) of export statements, one row per name."""
    rows = files.where(F.col("content").isNotNull()).select("file_id", F.posexplode(F.regexp_extract_all("content", F.lit(EXPORTED), F.lit(0))).alias("n", "s"))
    part = lambda i: F.regexp_extract("s", EXPORTED, i)
    braces = F.filter(F.transform(F.split(part(4), ","), lambda x: F.trim(F.regexp_replace(x, "^.* as ", ""))), lambda x: x != "")
    names = F.when(part(3) != "", F.array(part(3))).when(part(6) != "", F.array(F.lit("*"))).otherwise(braces)
    kind = F.when(part(2) != "", part(2)).when((part(5) != "") | (part(6) != ""), "re_export").otherwise("list")
    return rows.select("file_id", "n", kind.alias("kind"), F.explode(names).alias("name"), F.coalesce(F.nullif(part(5), F.lit("")), F.nullif(part(6), F.lit(""))).alias("module"), (part(1) != "").alias("is_default"))


def requires(files: DataFrame) -> DataFrame:
    """(file_id, path, n, module, is_core)."""
    rows = files.where(F.col("content").isNotNull()).select("file_id", "path", F.posexplode(F.regexp_extract_all("content", F.lit(REQUIRE), F.lit(1))).alias("n", "module"))
    return rows.withColumn("is_core", F.regexp_replace("module", "^node:", "").isin(*CORE))


def commonjs_exports(files: DataFrame) -> DataFrame:
    """(file_id, name) that a CommonJS module exports; default for the module itself."""
    rows = files.where(F.col("content").isNotNull()).select("file_id", F.explode(F.regexp_extract_all("content", F.lit(MODULE_EXPORTS), F.lit(0))).alias("s"))
    member, value = F.regexp_extract("s", MODULE_EXPORTS, 1), F.regexp_extract("s", MODULE_EXPORTS, 2)
    inside = F.filter(F.transform(F.split(F.regexp_replace(value, r"[{}]", ""), ","), lambda x: F.trim(F.regexp_replace(x, ":.*$", ""))), lambda x: x != "")
    names = F.when(member != "", F.array(member)).when(F.startswith(value, F.lit("{")), inside).otherwise(F.array(F.lit("default")))
    return rows.select("file_id", F.explode(names).alias("name"))


def aliased(module: Column, aliases: DataFrame, df: DataFrame) -> DataFrame:
    """df with ``module`` rewritten by the longest alias that is one of its leading parts; aliases: (alias, target)."""
    keys = [c for c in df.columns]
    steps = F.split(module, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    each = df.select(*keys, F.explode(heads).alias("alias"))
    hits = each.join(aliases.select("alias", F.col("target").alias("_to")), "alias")
    rest = F.substr(module, F.char_length("alias") + 1)
    best = hits.groupBy(*keys).agg(F.max_by(F.concat("_to", rest), F.char_length("alias")).alias("_new"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = df.alias("d").join(best.alias("b"), same, "left")
    return joined.select(*(F.coalesce("b._new", "d.module").alias(k) if k == "module" else F.col(f"d.{k}").alias(k) for k in keys))


def in_node_modules(bare: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, target): the nearest node_modules folder above each file that has the module.

    bare: (path, module).  All folders above a file are candidates, the deepest wins; in a package its
    package.json names the file (module, then main), else index.js.
    """
    depth = F.size(F.split("path", "/")) - 1
    each = bare.select("path", "module", F.explode(F.sequence(F.lit(0), depth)).alias("up"))
    root = F.array_join(F.slice(F.split("path", "/"), 1, F.greatest(depth - F.col("up"), F.lit(0))), "/")
    folder = F.concat(F.when(root == "", "").otherwise(F.concat(root, F.lit("/"))), F.lit("node_modules/"), "module")
    tries = each.select("path", "module", "up", folder.alias("folder"))
    manifest = files.where(F.endswith("path", F.lit("/package.json"))).select(
        F.regexp_replace("path", "/package.json$", "").alias("folder"), F.coalesce(F.get_json_object("content", "$.module"), F.get_json_object("content", "$.main"), F.lit("index.js")).alias("entry")
    )
    packaged = tries.join(manifest, "folder").select("path", "module", "up", F.lit(0).alias("o"), collapsed(F.concat("folder", F.lit("/"), "entry")).alias("target"))
    plain = [("", 1), (".js", 2), (".json", 3), ("/index.js", 4)]
    direct = tries.select("path", "module", "up", F.inline(F.array(*(F.struct(F.lit(o).alias("o"), F.concat("folder", F.lit(e)).alias("target")) for e, o in plain))))
    known = files.select(F.col("path").alias("target")).distinct()
    found = packaged.unionByName(direct).join(known, "target", "left_semi")
    return found.groupBy("path", "module").agg(F.min_by("target", F.struct("up", "o")).alias("target"))
