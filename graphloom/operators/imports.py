"""Import statements and what they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statements, extensions and index files that a specifier is tried with, in this order.
ES6 = r"(?m)^import (?:type )?([^'\"\n]*?)(?: from )?['\"]([^'\"\n]+)['\"]"
REQUIRE = r"require\(\s*['\"]([^'\"\n]+)['\"]\s*\)"
PYTHON = r"(?m)^(?:from ([.\w]+) import|import ([\w.]+))"
EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".json", "/index.ts", "/index.tsx", "/index.js")
FUNCTIONS = r"(?m)^[ \t]*(?:export )?(?:default )?(?:async )?function\*? *([A-Za-z_$][A-Za-z0-9_$]*)"


def es6_imports(files: DataFrame) -> DataFrame:
    """(file_id, path, n, clause, module) of each import statement, in order."""
    hits = F.regexp_extract_all("content", F.lit(ES6), F.lit(0))
    rows = files.where(F.col("content").isNotNull()).select("file_id", "path", F.posexplode(hits).alias("n", "s"))
    return rows.select("file_id", "path", "n", F.trim(F.regexp_extract("s", ES6, 1)).alias("clause"), F.regexp_extract("s", ES6, 2).alias("module"))


def imported_names(clause: Column) -> Column:
    """Names that an import clause brings in."""
    inner = F.regexp_replace(clause, r"[{}]", ",")
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, r"^.* as ", "")))
    return F.filter(parts, lambda x: x != "")


def collapsed(path: Column) -> Column:
    """The path without ./ and ../ steps, however many; steps above its start stay."""

    def step(held: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(held) > 0) & (F.element_at(held, -1) != "..")
        return F.when(x == ".", held).when(up, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(F.array_append(held, x))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with ``target``: the file of a relative module, tried with each extension; null if there is none.

    An explicit script extension is also tried as its TypeScript source.
    """
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    base = collapsed(F.concat(folder, F.lit("/"), F.col("module")))
    bare = F.regexp_replace(base, r"\.(js|jsx|mjs)$", "")
    tries = F.array(*(F.concat(base, F.lit(e)) for e in EXTENSIONS), *(F.concat(bare, F.lit(e)) for e in EXTENSIONS))
    relative = imports.where(F.startswith("module", F.lit(".")))
    each = relative.select("file_id", "n", F.posexplode(tries).alias("o", "candidate"))
    known = files.select(F.col("path").alias("candidate")).distinct()
    best = each.join(known, "candidate").groupBy("file_id", "n").agg(F.min_by("candidate", "o").alias("target"))
    return imports.join(best, ["file_id", "n"], "left")


def di_category(name: Column, module: Column) -> Column:
    """What kind of dependency an imported name is."""
    return (
        F.when(module == "react", "component")
        .when(name.rlike("(Service|API)$"), "service")
        .when(name.rlike("Config$"), "configuration")
        .otherwise("service")
    )


#: Known hooks and their categories.
HOOKS = {
    "useState": "state", "useReducer": "state", "useEffect": "effect", "useLayoutEffect": "effect", "useInsertionEffect": "effect",
    "useContext": "context", "useRef": "ref", "useImperativeHandle": "ref", "useMemo": "performance", "useCallback": "performance",
    "useTransition": "performance", "useDeferredValue": "performance", "useDebugValue": "custom", "useId": "custom",
    "useSyncExternalStore": "custom",
}
HOOK_CALL = r"\b(use[A-Z][A-Za-z0-9]*)(?:<[^>\n]*>)?\("


def hook_calls(files: DataFrame) -> DataFrame:
    """(file_id, n, hook) of each call of a hook."""
    hits = F.regexp_extract_all("content", F.lit(HOOK_CALL), F.lit(1))
    return files.where(F.col("content").isNotNull()).select("file_id", F.posexplode(hits).alias("n", "hook"))


def effect_type(dependencies: Column) -> Column:
    """When an effect runs: always without a list, once with an empty one, else on updates."""
    return F.when(dependencies.isNull(), "always").when(F.size(dependencies) == 0, "mount").otherwise("update")
