"""Parsers: nodes of source files.  Python by its own syntax tree, other languages by patterns in SQL."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Declarations by language, as (type, pattern); the first group is the name.
JS = (
    ("function", r"(?m)^[ \t]*(?:export )?(?:default )?(?:async )?function\*? *([A-Za-z_$][\w$]*)"),
    ("function", r"(?m)^[ \t]*(?:export )?(?:const|let|var) ([A-Za-z_$][\w$]*)[^=\n]*= *(?:async *)?(?:function\b|\([^()\n]*\)[^=\n]*=>|[A-Za-z_$][\w$]* *=>)"),
    ("class", r"(?m)^[ \t]*(?:export )?(?:default )?(?:abstract )?class ([A-Za-z_$][\w$]*)"),
)
JAVA = (
    ("class", r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract) )*(?:class|interface|enum|record) (\w+)"),
    ("api_endpoint", r"@(?:Get|Post|Put|Delete|Request)Mapping\(\s*(?:value *= *)?\"([^\"]*)\""),
)
OUT = "file_id bigint, type string, name string, line int"


def _python(batches: Iterator) -> Iterator:
    import pyarrow as pa

    warnings.simplefilter("ignore", SyntaxWarning)
    for batch in batches:
        ids, of, types, names, lines = batch.column(0), [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
            for node in ast.walk(tree):
                if isinstance(node, ast.ClassDef):
                    kind = "class"
                elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    kind = "view" if "view" in node.name.lower() else "function"
                else:
                    continue
                of.append(k)
                types.append(kind)
                names.append(node.name)
                lines.append(node.lineno)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(of, pa.int64())), pa.array(types, pa.string()), pa.array(names, pa.string()), pa.array(lines, pa.int32())], ["file_id", "type", "name", "line"]
        )


def python_nodes(files: DataFrame) -> DataFrame:
    """(file_id, type, name, line) of classes and functions; files that don't parse have none."""
    return files.where(F.col("path").rlike(r"\.py$")).select("file_id", "content").mapInArrow(_python, OUT)


def pattern_nodes(files: DataFrame, patterns: tuple) -> DataFrame:
    """(file_id, type, name) of declarations that patterns find; the first pattern holds a name."""

    def found(o: int, kind: str, pattern: str):
        named = lambda x: F.struct(F.lit(o).alias("o"), F.lit(kind).alias("type"), x.alias("name"))
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), named)

    each = [found(i, kind, pattern) for i, (kind, pattern) in enumerate(patterns)]
    rows = files.where(F.col("content").isNotNull()).select("file_id", "path", F.inline(F.concat(*each)))
    first = rows.groupBy("file_id", "path", "name").agg(F.min_by("type", "o").alias("type"))
    shown = (F.col("type") == "function") & F.col("path").rlike(r"\.(tsx|jsx)$") & F.col("name").rlike("^[A-Z]")
    return first.select("file_id", F.when(shown, "component").otherwise(F.col("type")).alias("type"), "name")


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, language, type, name) of all nodes, modules included; files: (file_id, path, content)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.when(ext == "py", "python").when(ext == "java", "java").otherwise("script")
    modules = files.select("file_id", language.alias("language"), F.lit("module").alias("type"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    scripts = files.where(ext.isin("js", "jsx", "ts", "tsx", "mjs"))
    parts = [
        python_nodes(files).select("file_id", F.lit("python").alias("language"), "type", "name"),
        pattern_nodes(scripts, JS).select("file_id", F.lit("script").alias("language"), "type", "name"),
        pattern_nodes(files.where(ext == "java"), JAVA).select("file_id", F.lit("java").alias("language"), "type", "name"),
    ]
    out = modules
    for p in parts:
        out = out.unionByName(p)
    return out
