"""Column expressions of the scalar operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_json(text: Column) -> Column:
    """The text if it is JSON from end to end, else null: schema readers take what stands before a break."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative(path: Column, base: Column) -> Column:
    """The path below base; unchanged if it isn't below."""
    prefix = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.char_length(prefix) + 1)).otherwise(posix(path))


def node_id(path: Column, name: Column) -> Column:
    """Readable id with eight digits of a hash of path and name."""
    return F.concat_ws("_", F.translate(path, "/.", "__"), name, F.substring(F.md5(F.concat_ws(":", path, name)), 1, 8))


def sanitised(id_: Column) -> Column:
    return F.regexp_replace(posix(id_), "[^A-Za-z0-9/_-]", "_")


#: Fixed value: the words of a camelCase name.
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\W|$)|\d+"


def identifier_words(name: Column) -> Column:
    """snake_case parts as they are, else camelCase parts in lower case."""
    camel = F.regexp_extract_all(name, F.lit(CAMEL), F.lit(0))
    return F.when(F.contains(name, F.lit("_")), F.split(name, "_")).otherwise(F.transform(camel, F.lower))


def c4_level(type_: Column, file: Column, name: Column, is_entry: Column) -> Column:
    """Level of a node in the C4 model."""
    low = F.lower(name)
    top = is_entry | (type_ == "module") & low.rlike(r"^(main|app|index)\b")
    parts = file.rlike("/(pages|components|views|controllers|services)/")
    return (
        F.when(type_ == "api_endpoint", "system")
        .when(top, "container")
        .when(type_.isin("component", "view", "controller", "service") | (type_ == "module") & parts, "component")
        .otherwise("code")
    )


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "very_high").when(score >= 0.6, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("very_low")


def confidence_bucket(score: Column) -> Column:
    """One of five buckets of width 0.2."""
    low = F.least(F.floor(score * 5) * 2, F.lit(8)).cast("int")
    return F.concat(F.lit("0."), low.cast("string"), F.lit("-"), F.when(low == 8, "1.0").otherwise(F.concat(F.lit("0."), (low + 2).cast("string"))))


def importance(n_in: Column, n_out: Column) -> Column:
    return 2 * F.log1p(n_in) + F.log1p(n_out)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a vector of zeros."""
    da, db = (x.cast("array<double>") for x in (a, b))
    dot = F.aggregate(F.zip_with(da, db, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / F.nullif(norm(da) * norm(db), F.lit(0.0))


#: Words whose number makes up the fallback embedding.
EMBEDDING_WORDS = ("function", "class", "import", "return", "async", "await", "(", "{", ";")


def with_fallback_embedding(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with length and word counts of a text, scaled to length one.

    In steps, so that the text is lowered once and the norm is taken once per row.
    """
    low = F.col("_low")
    count = lambda w: ((F.char_length(low) - F.char_length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("double")
    raw = F.array(F.char_length(low).cast("double"), *(count(w) for w in EMBEDDING_WORDS))
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x * x))
    scaled = F.zip_with("_raw", F.array_repeat(F.when(norm > 0, norm).otherwise(1.0), F.size("_raw")), lambda x, n: x / n)
    return df.withColumn("_low", F.lower(text)).withColumn("_raw", raw).withColumn(out, scaled).drop("_low", "_raw")


def naming(name: Column) -> dict[str, Column]:
    """What a variable's name says about its type."""
    return {
        "is_boolean_name": name.rlike("^(is|has|can|should|will)"),
        "is_array_name": name.rlike("(s|List|Array|Items)$"),
        "is_handler_name": name.rlike("^(on|handle|process|execute)"),
        "is_constant_name": (F.upper(name) == name) & name.rlike("[A-Za-z]"),
        "has_underscore": F.contains(name, F.lit("_")),
        "is_camel": name.rlike("^[a-z]+([A-Z][a-z0-9]*)+$"),
        "is_pascal": name.rlike("^([A-Z][a-z0-9]*)+$"),
        "is_snake": name.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"),
        "is_kebab": name.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"),
    }


#: Data flow that an edge type stands for; its share of an edge's confidence.
FLOW_OF_EDGE = {
    "renders": "component_render", "calls": "function_call", "imports": "module_import", "uses": "dependency_use",
    "depends_on": "dependency", "extends": "class_extension", "implements": "interface_implementation",
}
CONFIDENCE_OF_EDGE = {"renders": 0.9, "calls": 0.85, "imports": 0.95, "depends_on": 0.8, "uses": 0.75}


def mapped(key: Column, values: dict, default) -> Column:
    """A lookup in a small fixed table."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def sql_case(key: str, values: dict, default) -> str:
    """The same lookup in SQL."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + f" ELSE {lit(default)} END"
