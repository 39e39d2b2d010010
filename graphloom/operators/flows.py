"""Data flows, hooks, injected dependencies and Python imports, read from source lines.

All operators take lines (file_id, path, line, text) and stay in SQL functions: each line is read once,
and only lines that declare or call something meet a window within their file.

Cases: null texts have no lines; a line may hold several flows; lines of any language are read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .imports import HOOK_CALL

NAME = "[A-Za-z_$][A-Za-z0-9_$]*"
#: A flow's pattern, its source and target as groups or text, and its confidence.  Fixed values.
FLOWS: dict[str, tuple[str, int | str, int | str, float]] = {
    "assignment": (rf"^[ \t]*(?:const |let |var )({NAME})(?:: [^=]+)? = ({NAME});?[ \t]*$", 2, 1, 1.0),
    "member_read": (rf"^[ \t]*(?:const |let |var )({NAME})(?:: [^=]+)? = ({NAME})\??\.{NAME}", 2, 1, 0.9),
    "state_update": (rf"\bset([A-Z][A-Za-z0-9_$]*)\(({NAME})", 2, 1, 1.0),
    "index_read": (rf"({NAME})\[({NAME}|[0-9]+)\]", 1, 2, 0.85),
    "return": (rf"^[ \t]*return ({NAME})(?:\.{NAME})*;?[ \t]*$", 1, "return", 0.95),
    "expression_left": (rf"= ({NAME})[A-Za-z0-9_$.]* [-+*/%] {NAME}", 1, "expression", 0.9),
    "expression_right": (rf"= {NAME}[A-Za-z0-9_$.]* [-+*/%] ({NAME})", 1, "expression", 0.9),
}
OBJECT = rf"^[ \t]*(?:const |let |var )\{{ ([^{{}}]*) \}}(?:: [^=]+)? = ({NAME})"
ARRAY = rf"^[ \t]*(?:const |let |var )\[([^\[\]]*)\] = ({NAME})"
CALL = rf"({NAME})\(({NAME}(?:\.{NAME})*(?:, {NAME}(?:\.{NAME})*)*)\)"
#: Words before a bracket that call nothing.
NO_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "elif", "def", "and", "or", "not", "in", "is", "constructor")
DECLARES = rf"^[ \t]*(?:export )?(?:default )?(?:async )?(?:function\*?|class|const|let|def|public class|class) ({NAME})"
CLOSES = r"^[ \t]*\}, \[([^\]\n]*)\]\)"


def flows(lines: DataFrame) -> DataFrame:
    """(file_id, line, flow, source, target, confidence) of assignments, reads, calls, returns, expressions and destructuring."""

    def row(kind: str, source: Column, target: Column, sure: float) -> Column:
        return F.struct(F.lit(kind).alias("flow"), source.alias("source"), target.alias("target"), F.lit(sure).alias("confidence"))

    part = lambda rx, i: F.regexp_extract("text", rx, i) if isinstance(i, int) else F.lit(i)
    single = [F.when(F.col("text").rlike(rx), row(k, part(rx, s), part(rx, t), c)) for k, (rx, s, t, c) in FLOWS.items()]
    names = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "^.*: *", ""), " *=.*$", ""))), lambda x: x != "")

    def taken(kind: str, rx: str) -> Column:
        return F.transform(names(part(rx, 1)), lambda x: row(kind, part(rx, 2), x, 0.95))

    spread = [taken("destructuring", OBJECT), taken("array_destructuring", ARRAY)]
    calls = F.filter(F.regexp_extract_all("text", F.lit(CALL), F.lit(0)), lambda h: ~F.regexp_extract(h, CALL, 1).isin(*NO_CALLS))
    passed = F.flatten(F.transform(calls, lambda h: F.transform(F.split(F.regexp_extract(h, CALL, 2), ", "), lambda a: row("argument", a, F.regexp_extract(h, CALL, 1), 0.9))))
    every = F.concat(F.filter(F.array(*single), lambda x: x.isNotNull()), *spread, passed)
    return lines.select("file_id", "line", F.inline(every))


def scoped(lines: DataFrame, keep: Column) -> DataFrame:
    """The lines to keep with ``scope``, the last name declared at or before each in its file."""
    some = lines.where(keep | F.col("text").rlike(DECLARES)).withColumn("d", F.when(F.col("text").rlike(DECLARES), F.regexp_extract("text", DECLARES, 1)))
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return some.withColumn("scope", F.last("d", ignorenulls=True).over(before)).where(keep).drop("d")


def hooks(lines: DataFrame) -> DataFrame:
    """(file_id, line, hook, component, dependencies): hook calls; dependencies are those of the list that
    closes the call, null without one.

    The component is the last name with a capital declared before.  A list of dependencies belongs to the
    last call before it.
    """
    called, closes = F.col("text").rlike(HOOK_CALL), F.col("text").rlike(CLOSES)
    capital = rf"^[ \t]*(?:export )?(?:default )?(?:async )?(?:function|class|const) ([A-Z][A-Za-z0-9_$]*)"
    some = lines.where(called | closes | F.col("text").rlike(capital))
    w = Window.partitionBy("file_id").orderBy("line")
    some = some.select(
        "file_id", "line", called.alias("called"), closes.alias("closes"), F.regexp_extract("text", HOOK_CALL, 1).alias("hook"), F.regexp_extract("text", CLOSES, 1).alias("list"),
        F.last(F.when(F.col("text").rlike(capital), F.regexp_extract("text", capital, 1)), ignorenulls=True).over(w).alias("component"),
    )
    marks = some.where("called OR closes").withColumns({"after": F.lead("closes").over(w), "next_list": F.lead("list").over(w)})
    inner = F.filter(F.split("next_list", ", *"), lambda x: x != "")
    return marks.where("called").select("file_id", "line", "hook", "component", F.when(F.col("after"), inner).alias("dependencies"))


def entities(dependencies: DataFrame) -> DataFrame:
    """(file_id, entity, kind, n): how many dependencies of each kind an entity has; dependencies: (file_id, entity, kind, provider)."""
    return dependencies.groupBy("file_id", "entity", "kind").agg(F.count("*").alias("n"))


# Python imports

FROM = r"^from (\.*)([\w.]*) import (.+?)[ \t]*$"
IMPORT = r"^import ([\w.]+)(?: as \w+)?[ \t]*$"


def python_imports(lines: DataFrame) -> DataFrame:
    """(file_id, path, line, level, module, names) of the import statements of Python files; level counts leading dots."""
    py = lines.where(F.endswith("path", F.lit(".py")) & (F.col("text").rlike(FROM) | F.col("text").rlike(IMPORT)))
    whole = F.col("text").rlike(IMPORT)
    names = F.array_join(F.transform(F.split(F.regexp_replace(F.regexp_extract("text", FROM, 3), r"[()]", ""), ","), lambda x: F.trim(F.regexp_replace(x, " as .*$", ""))), ",")
    return py.select(
        "file_id", "path", "line", F.length(F.regexp_extract("text", FROM, 1)).alias("level"),
        F.when(whole, F.regexp_extract("text", IMPORT, 1)).otherwise(F.regexp_extract("text", FROM, 2)).alias("module"), F.when(whole, "").otherwise(names).alias("names"),
    )


def python_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with ``target``: the module's file or package below the folder its dots lead to, or below the
    project for an absolute one; null if there is none.  files: (path)."""
    steps = F.split("path", "/")
    depth = F.when(F.col("level") == 0, F.lit(1)).otherwise(F.greatest(F.size(steps) - F.col("level"), F.lit(0)))
    folder = F.array_join(F.slice(steps, F.lit(1), depth), "/")
    inside = F.concat(folder, F.when(F.col("module") != "", F.concat(F.lit("/"), F.translate("module", ".", "/"))).otherwise(F.lit("")))
    tries = F.array(F.concat(inside, F.lit(".py")), F.concat(inside, F.lit("/__init__.py")))
    each = imports.select("file_id", "line", F.posexplode(tries).alias("o", "candidate"))
    best = each.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("file_id", "line").agg(F.min_by("candidate", "o").alias("target"))
    return imports.join(best, ["file_id", "line"], "left")
