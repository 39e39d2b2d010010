"""Rules of type inference, hooks, dependency injection and data flow, as columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of literals, results of operators, signatures of hooks.
HOOK_TYPES = {
    "useState": "[T, (value: T) => void]", "useEffect": "void", "useContext": "T", "useReducer": "[S, (action: A) => void]",
    "useCallback": "(...args: any[]) => any", "useMemo": "T", "useRef": "{ current: T }",
}
LITERAL = r"^[ \t]*(?:export )?(const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*)[^=\n]*= *([^\n]*?);?[ \t\r]*$"


def literal_type(value: Column) -> Column:
    """The type of a literal as written; booleans before numbers."""
    return (
        F.when(value.rlike("^(true|false)$"), "boolean")
        .when(value.rlike(r"^-?(0x[0-9a-fA-F]+|[0-9][0-9_]*(\.[0-9]+)?)$"), "number")
        .when(value.rlike("^['\"`]"), "string")
        .when(value == "null", "null")
        .when(value == "undefined", "undefined")
        .when(value.rlike(r"^\["), "array")
        .when(value.rlike(r"^\{"), "object")
        .when(value.rlike(r"^(async )?(function\b|\([^()]*\)[^=]*=>|[A-Za-z_$][A-Za-z0-9_$]* =>)"), "function")
        .when(value.rlike("^/[^/*]"), "regexp")
        .when(value.rlike("^new [A-Z]"), F.regexp_extract(value, "^new ([A-Za-z0-9_$]+)", 1))
        .otherwise("unknown")
    )


def binary_type(left: Column, operator: Column, right: Column) -> Column:
    """The type of an expression with two operands."""
    return (
        F.when((operator == "+") & ((left == "string") | (right == "string")), "string")
        .when(operator.isin("+", "-", "*", "/", "%", "**"), "number")
        .when(operator.isin("<", ">", "<=", ">=", "==", "!=", "===", "!==", "instanceof", "in"), "boolean")
        .when(operator.isin("&&", "||"), "boolean")
        .otherwise("unknown")
    )


def unary_type(operator: Column) -> Column:
    return F.when(operator == "!", "boolean").when(operator == "typeof", "string").when(operator.isin("+", "-", "~", "++", "--"), "number").when(operator == "void", "undefined").otherwise("unknown")


def element_type(types: Column) -> Column:
    """The element type of an array literal: none, one, or a union."""
    distinct = F.array_distinct(types)
    return F.when(F.size(distinct) == 0, "unknown").when(F.size(distinct) == 1, F.element_at(distinct, 1)).otherwise(F.array_join(F.array_sort(distinct), " | "))


def return_type(types: Column) -> Column:
    """The result of a function from the types it returns."""
    return F.when(F.size(types) == 0, "undefined").otherwise(element_type(types))


def function_type(parameters: Column, result: Column, is_async: Column) -> Column:
    """A signature from (name, type) pairs."""
    written = F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type"], F.lit("any")))), ", ")
    wrapped = F.when(is_async, F.concat(F.lit("Promise<"), result, F.lit(">"))).otherwise(result)
    return F.concat(F.lit("("), written, F.lit(") => "), wrapped)


def usage_type(contexts: Column) -> Column:
    """What the uses of a name say about its type, with a confidence."""
    has = lambda w: F.exists(contexts, lambda c: F.contains(c, F.lit(w)))
    row = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    return F.when(has("call"), row("function", 0.75)).when(has("property_access"), row("object", 0.7)).when(has("index"), row("array", 0.7)).otherwise(row("unknown", 0.3))


def type_category(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.isin("string", "number", "boolean", "null", "undefined", "symbol", "bigint"), "primitive")
        .when(F.contains(low, F.lit("array")) | F.contains(name, F.lit("[]")), "array")
        .when(F.contains(low, F.lit("function")) | F.contains(name, F.lit("=>")), "function")
        .when(F.contains(low, F.lit("jsx")) | F.contains(low, F.lit("element")), "jsx")
        .when(name.rlike("^use[A-Z]"), "hook")
        .when(F.contains(low, F.lit("object")), "object")
        .otherwise("unknown")
    )


def adjusted_confidence(confidence: Column, n_evidence: Column, annotated: Column, category: Column, digits: int = 2) -> Column:
    raised = confidence + F.when(annotated, 0.2).otherwise(0.0) + F.least(F.lit(0.15), 0.05 * n_evidence)
    return F.round(F.least(F.lit(1.0), F.when(category == "unknown", raised * 0.5).otherwise(raised)), digits)


def compatible(a: Column, b: Column, b_nullable: Column) -> Column:
    """May a value of type a stand for one of type b?  Unions written with bars are read as any of theirs."""
    free = a.isin("any", "unknown") | b.isin("any", "unknown")
    members = F.split(b, r" \| ")
    return free | (a == b) | F.array_contains(members, a) | (b_nullable & a.isin("null", "undefined"))


def narrowed(lines: DataFrame) -> DataFrame:
    """(file_id, line, name, type, confidence): what conditions say about names in their branch."""
    typeof = r"typeof ([A-Za-z_$][A-Za-z0-9_$]*) *===? *['\"]([a-z]+)['\"]"
    compared = r"\(([A-Za-z_$][A-Za-z0-9_$]*) *[<>]=? *[0-9]"
    truth = r"if \(!?([A-Za-z_$][A-Za-z0-9_$]*)\)"
    part = lambda rx, i: F.regexp_extract("text", rx, i)
    rules = [(typeof, part(typeof, 1), part(typeof, 2), 0.95), (compared, part(compared, 1), F.lit("number"), 0.9), (truth, part(truth, 1), F.lit("truthy"), 0.7)]
    each = F.array(*(F.when(F.col("text").rlike(rx), F.struct(n.alias("name"), t.alias("type"), F.lit(c).alias("confidence"))) for rx, n, t, c in rules))
    return lines.select("file_id", "line", F.inline(F.filter(each, lambda x: x.isNotNull())))


def declared_types(lines: DataFrame) -> DataFrame:
    """(file_id, line, name, type, confidence) of variables from what they are assigned; constants are surer."""
    part = lambda i: F.regexp_extract("text", LITERAL, i)
    found = lines.where(F.col("text").rlike(LITERAL))
    return found.select("file_id", "line", part(2).alias("name"), literal_type(part(3)).alias("type"), F.when(part(1) == "const", 0.85).otherwise(0.7).alias("confidence"))


# data flow

STATE = r"const \[([A-Za-z_$][A-Za-z0-9_$]*), *([A-Za-z_$][A-Za-z0-9_$]*)\] = useState(?:<[^>\n]*>)?\(([^\n]*?)\);?"


def state_flows(lines: DataFrame) -> DataFrame:
    """(file_id, line, state, setter, flow, source, confidence): a state's initial value, and its setter."""
    part = lambda i: F.regexp_extract("text", STATE, i)
    row = lambda flow, source, c: F.struct(F.lit(flow).alias("flow"), source.alias("source"), F.lit(c).alias("confidence"))
    both = F.filter(F.array(F.when(part(3) != "", row("state_init", part(3), 0.95)), row("state_update", part(2), 1.0)), lambda x: x.isNotNull())
    return lines.where(F.col("text").rlike(STATE)).select("file_id", "line", part(1).alias("state"), part(2).alias("setter"), F.inline(both))


def member_flows(lines: DataFrame) -> DataFrame:
    """(file_id, line, object, property, direction): reads, and writes that flow both ways."""
    read = r"([A-Za-z_$][A-Za-z0-9_$]*)\.([A-Za-z_$][A-Za-z0-9_$]*)"
    hits = F.regexp_extract_all("text", F.lit(read), F.lit(0))
    rows = lines.select("file_id", "line", "text", F.explode(hits).alias("hit"))
    obj, prop = F.regexp_extract("hit", read, 1), F.regexp_extract("hit", read, 2)
    written = F.regexp_extract("text", r"^[ \t]*(" + read + r") = ", 1) == F.col("hit")
    return rows.select("file_id", "line", obj.alias("object"), prop.alias("property"), F.when(written, "bidirectional").otherwise("forward").alias("direction"))


# dependency injection

CONSTRUCTOR = r"(?:constructor|public [A-Z][A-Za-z0-9_]*|private [A-Z][A-Za-z0-9_]*)\(([^()\n]*)\) *\{"


def constructor_injection(lines: DataFrame) -> DataFrame:
    """(file_id, line, parameter, provider): a constructor's parameters; the provider is the type, else the name."""
    inside = F.regexp_replace(F.regexp_extract("text", CONSTRUCTOR, 1), r"<[^<>]*(<[^<>]*>)?[^<>]*>", "")
    rows = lines.where(F.col("text").rlike(CONSTRUCTOR)).select("file_id", "line", F.explode(F.split(inside, " *, *")).alias("p"))
    ts = r"^(?:(?:public|private|protected|readonly) )*([A-Za-z_$][A-Za-z0-9_$]*)\??(?: *: *([A-Za-z_$][A-Za-z0-9_$.]*))?"
    java = r"^(?:final )?([A-Z][A-Za-z0-9_.]*)(?:\[\])* ([A-Za-z_][A-Za-z0-9_]*)$"
    is_java = F.col("p").rlike(java)
    name = F.when(is_java, F.regexp_extract("p", java, 2)).otherwise(F.regexp_extract("p", ts, 1))
    kind = F.when(is_java, F.regexp_extract("p", java, 1)).otherwise(F.regexp_extract("p", ts, 2))
    return rows.where(F.trim("p") != "").select("file_id", "line", name.alias("parameter"), F.when(kind != "", kind).otherwise(name).alias("provider"))


def property_injection(lines: DataFrame) -> DataFrame:
    """(file_id, line, property, provider, created): assignments of names or new objects to members."""
    rx = r"^[ \t]*this\.([A-Za-z_$][A-Za-z0-9_$]*) = (new )?([A-Za-z_$][A-Za-z0-9_$]*)(?:\([^\n]*\))?;?[ \t\r]*$"
    part = lambda i: F.regexp_extract("text", rx, i)
    return lines.where(F.col("text").rlike(rx)).select("file_id", "line", part(1).alias("property"), part(3).alias("provider"), (part(2) != "").alias("created"))


def prop_category(name: Column, kind: Column) -> Column:
    """What a component's property depends on."""
    return F.when(F.contains(F.lower(kind), F.lit("function")) | name.rlike("^(on|handle)"), "function").when(name.rlike("(Context|Provider)"), "context").otherwise("data")
