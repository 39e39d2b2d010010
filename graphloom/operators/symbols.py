"""Symbols, references and edges that are built from them.

Source lines are exploded once; patterns find declarations and uses.  References resolve by priority:
the file that a name is imported from, the file itself, then any file, exported symbols first.  For
"any file" there is one best symbol per name, chosen before the join, so that a name that is declared
everywhere meets each reference once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .imports import es6_imports, imported_names, resolve

# Declarations and uses, valid both here and in SQL engines without look-around.
DECLARED = r"^[ \t]*(export )?(default )?(?:public |private |protected |static |final |abstract )*(?:async )?(function\*?|class|interface|enum|record|def|const) +([A-Za-z_$][A-Za-z0-9_$]*)"
KINDS = {"function": "function", "function*": "function", "def": "function", "class": "class", "interface": "interface", "enum": "class", "record": "class", "const": "variable"}
CONTEXTS = {
    "async_call": r"\bawait +(?:[A-Za-z_$][A-Za-z0-9_$]*\.)*([A-Za-z_$][A-Za-z0-9_$]*)\(",
    "instantiate": r"\bnew +([A-Z][A-Za-z0-9_$]*)",
    "extends": r"\bextends +([A-Z][A-Za-z0-9_$]*)",
    "implements": r"\bimplements +([A-Z][A-Za-z0-9_$]*)",
    "jsx": r"<([A-Z][A-Za-z0-9]*)[ />]",
    "call": r"\b([A-Za-z_$][A-Za-z0-9_$]*)\(",
}
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "function", "def", "new", "typeof", "await", "super", "elif", "print", "constructor")
#: Edge types of contexts, and names that runtimes bring along.
EDGE_OF_CONTEXT = {"call": "calls", "async_call": "async_calls", "instantiate": "instantiates", "extends": "extends", "implements": "implements", "jsx": "renders", "import": "imports", "export": "exports", "access": "uses"}
BUILTINS = (
    "Array", "Boolean", "Date", "Error", "JSON", "Map", "Math", "Number", "Object", "Promise", "Proxy", "RegExp", "Set", "String", "Symbol", "WeakMap",
    "console", "decodeURIComponent", "encodeURIComponent", "fetch", "isNaN", "parseFloat", "parseInt", "require", "setInterval", "setTimeout", "useCallback",
    "useContext", "useEffect", "useMemo", "useReducer", "useRef", "useState",
)


def lines(files: DataFrame) -> DataFrame:
    """(file_id, path, line, text) of each line, from 1."""
    rows = files.where(F.col("content").isNotNull())
    return rows.select("file_id", "path", F.posexplode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("n", "text")).select("file_id", "path", (F.col("n") + 1).alias("line"), "text")


def symbols(files: DataFrame) -> DataFrame:
    """(file_id, path, line, name, symbol_type, is_exported, is_default)."""
    part = lambda i: F.regexp_extract("text", DECLARED, i)
    kind = None
    for k, v in KINDS.items():
        kind = F.when(part(3) == k, v) if kind is None else kind.when(part(3) == k, v)
    found = lines(files).where(F.col("text").rlike(DECLARED))
    return found.select("file_id", "path", "line", part(4).alias("name"), kind.alias("symbol_type"), (part(1) != "").alias("is_exported"), (part(2) != "").alias("is_default"))


def references(files: DataFrame) -> DataFrame:
    """(file_id, path, line, name, context) of each use; a declaration is no call of its own name."""
    hits = [F.transform(F.regexp_extract_all("text", F.lit(rx), F.lit(1)), _labelled(k)) for k, rx in CONTEXTS.items()]
    rows = lines(files).select("file_id", "path", "line", "text", F.inline(F.concat(*hits)))
    declared = F.col("text").rlike(DECLARED) & (F.regexp_extract("text", DECLARED, 4) == F.col("name"))
    return rows.where(~F.col("name").isin(*KEYWORDS) & ~((F.col("context") == "call") & declared)).drop("text")


def _labelled(context: str):
    return lambda x: F.struct(x.alias("name"), F.lit(context).alias("context"))


def resolved(refs: DataFrame, syms: DataFrame, files: DataFrame) -> DataFrame:
    """refs with ``target_file``, ``target_line`` and ``step``: imported, same_file, any_file, or null."""
    found = F.struct(F.col("file_id").alias("f"), F.col("line").alias("l"))
    order = F.struct(~F.col("is_exported"), "file_id", "line")
    per_file = syms.groupBy("file_id", "name").agg(F.min_by(found, "line").alias("own"))
    anywhere = syms.groupBy("name").agg(F.min_by(found, order).alias("best"))
    exported = syms.where("is_exported").groupBy("path", "name").agg(F.min_by(found, "line").alias("there"))
    imported = resolve(es6_imports(files), files).where("target IS NOT NULL").select("file_id", F.col("target").alias("path"), F.explode(imported_names(F.col("clause"))).alias("name"))
    brought = imported.join(exported, ["path", "name"]).groupBy("file_id", "name").agg(F.min("there").alias("there"))
    every = refs.join(brought, ["file_id", "name"], "left").join(per_file, ["file_id", "name"], "left").join(anywhere, "name", "left")
    step = F.when(F.col("there").isNotNull(), "imported").when(F.col("own").isNotNull(), "same_file").when(F.col("best").isNotNull(), "any_file")
    target = F.coalesce("there", "own", "best")
    return every.select(*refs.columns, target["f"].alias("target_file"), target["l"].alias("target_line"), step.alias("step"))


def edges(refs: DataFrame) -> DataFrame:
    """(source_file, target, type, n) of resolved references; unresolved ones lead to external names."""
    kind = None
    for k, v in EDGE_OF_CONTEXT.items():
        kind = F.when(F.col("context") == k, v) if kind is None else kind.when(F.col("context") == k, v)
    target = F.coalesce(F.col("target_file").cast("string"), F.concat(F.lit("external:"), "name"))
    rows = refs.select(F.col("file_id").alias("source_file"), target.alias("target"), kind.otherwise("calls").alias("type"))
    return rows.groupBy("source_file", "target", "type").agg(F.count("*").alias("n"))


def is_builtin(name: Column) -> Column:
    return name.isin(*BUILTINS)


def statistics(syms: DataFrame, refs: DataFrame) -> DataFrame:
    """One row of totals."""
    s = syms.agg(F.count("*").alias("n_symbols"), F.countDistinct("name").alias("n_names"), F.countDistinct("file_id").alias("n_files"), F.count_if("is_exported").alias("n_exported"))
    return s.crossJoin(refs.agg(F.count("*").alias("n_references")))  # one row by one row
