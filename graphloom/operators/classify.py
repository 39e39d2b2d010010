"""Rule-based classification of code: intents, runtime behaviours, architectural patterns.

A rule has words, patterns and contexts.  The score of a rule is a sum of capped shares of hits:
all rules are columns of one projection, so a file is read once and nothing is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules as (words, patterns, contexts).
INTENTS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "data_fetching": ("fetch get load retrieve query find search fetchdata getdata".split(), ["fetch.*data", "get.*from", "load.*from", "query.*database", "api.*get"], "http api database repository service".split()),
    "data_processing": ("process transform convert parse format map filter reduce calculate".split(), ["process.*data", "transform.*to", "convert.*from", "parse.*json", "format.*string"], "data array object json xml".split()),
    "validation": ("validate check verify ensure assert isvalid validateinput".split(), ["validate.*input", "check.*valid", "verify.*data", "ensure.*correct"], "input data form parameter argument".split()),
    "authentication": ("auth login authenticate signin signin loginuser checkauth".split(), ["login.*user", "auth.*token", "signin.*with", "authenticate.*user"], "user password token session credential".split()),
    "authorization": ("authorize permission access role privilege checkpermission".split(), ["check.*permission", "authorize.*access", "has.*role", "can.*access"], "permission role access privilege authorization".split()),
    "error_handling": ("handle catch error exception try catch throw errorhandler".split(), ["handle.*error", "catch.*exception", "throw.*error", "try.*catch"], "error exception failure invalid error".split()),
    "ui_rendering": ("render display show draw paint rendercomponent displayui".split(), ["render.*component", "display.*ui", "show.*page", "draw.*element"], "component ui view page element dom".split()),
    "business_logic": ("calculate compute execute run process business logic algorithm".split(), ["calculate.*total", "compute.*result", "execute.*business", "run.*algorithm"], "business logic rule algorithm calculation".split()),
    "utility": ("util helper common shared tool utility helperfunction".split(), ["util.*function", "helper.*method", "common.*tool", "shared.*utility"], "util helper common shared tool".split()),
    "configuration": ("config setup init initialize configure settings setupconfig".split(), ["config.*setup", "init.*config", "setup.*environment", "configure.*app"], "config setting environment initialization".split()),
    "logging": ("log logger debug info warn error trace logmessage".split(), ["log.*message", "debug.*info", "logger.*debug", "console.*log"], "log debug info warning error trace".split()),
    "caching": ("cache memoize store buffer cache memoization".split(), ["cache.*data", "memoize.*function", "store.*cache", "buffer.*data"], "cache memoization buffer storage".split()),
    "network": ("http request response api endpoint network socket".split(), ["http.*request", "api.*call", "network.*request", "socket.*connection"], "http api network request response endpoint".split()),
    "file_operations": ("file read write save load upload download fileoperation".split(), ["read.*file", "write.*file", "save.*data", "upload.*file"], "file path directory upload download".split()),
    "database": ("database db sql query insert update delete select".split(), ["database.*query", "sql.*statement", "insert.*into", "update.*set"], "database sql table record query".split()),
}
INTENT_WEIGHTS = (0.3, 0.4, 0.2, 0.3)
# The same for runtime behaviours; words are looked for in lower-case text as they stand.
BEHAVIOURS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "async_operation": ("async await promise then catch finally".split(), [r"async\s+function", r"await\s+\w+", r"promise\.", r"\.then\s*\(", r"settimeout\s*\(", r"setinterval\s*\(", r"fetch\s*\("], "asynchronous non-blocking concurrent".split()),
    "error_prone": ("throw catch error exception try finally".split(), [r"throw\s+new\s+\w*error", r"try\s*\{", r"catch\s*\(", r"\.catch\s*\(", r"if\s*\(\s*!\w+\)\s*throw", r"assert\s*\("], "error exception failure invalid".split()),
    "performance_bottleneck": ("loop for while foreach map filter reduce".split(), [r"for\s*\([^)]*\)\s*\{", r"while\s*\([^)]*\)\s*\{", r"\.foreach\s*\(", r"\.map\s*\(", r"\.filter\s*\(", r"\.reduce\s*\("], "iteration processing calculation".split()),
    "side_effect": ("console log print alert confirm prompt".split(), [r"console\.\w+", r"print\s*\(", r"alert\s*\(", r"confirm\s*\(", r"window\.", r"document\.", r"global\."], "output interaction global".split()),
    "memory_intensive": ("new Array Object Buffer allocate malloc".split(), [r"new\s+array\s*\(", r"new\s+object\s*\(", r"new\s+buffer\s*\(", r"array\s*\(\s*\d+", r"\.push\s*\(", r"\.concat\s*\("], "allocation memory buffer".split()),
    "network_operation": ("http fetch request response ajax xhr".split(), [r"fetch\s*\(", r"xmlhttprequest", r"\.get\s*\(", r"\.post\s*\(", r"http\.", r"https\.", r"ajax\s*\("], "network api http request".split()),
    "file_operation": ("read write file fs path stream".split(), [r"fs\.\w+", r"readfile\s*\(", r"writefile\s*\(", r"createreadstream", r"createwritestream", r"path\."], "file filesystem path stream".split()),
    "database_operation": ("sql query select insert update delete".split(), [r"select\s+", r"insert\s+into", r"update\s+", r"delete\s+from", r"\.query\s*\(", r"\.execute\s*\(", r"\.find\s*\("], "database sql query table".split()),
    "caching_operation": ("cache memoize store get set redis".split(), [r"cache\.\w+", r"memoize\s*\(", r"\.get\s*\(", r"\.set\s*\(", r"redis\.", r"localstorage\.", r"sessionstorage\."], "cache storage memoization".split()),
    "logging_operation": ("log debug info warn error trace".split(), [r"console\.log", r"console\.debug", r"console\.info", r"console\.warn", r"console\.error", r"logger\.\w+", r"log\.\w+"], "logging debug trace".split()),
    "security_sensitive": ("password token auth encrypt decrypt hash".split(), [r"password\s*=", r"token\s*=", r"encrypt\s*\(", r"decrypt\s*\(", r"hash\s*\(", r"bcrypt\.", r"jwt\.", r"oauth\."], "security authentication authorization".split()),
    "thread_safe": ("lock mutex semaphore synchronized atomic".split(), [r"lock\s*\(", r"mutex\s*\(", r"synchronized\s+", r"atomic\s+", r"\.lock\s*\(", r"\.unlock\s*\("], "concurrency threading synchronization".split()),
    "blocking_operation": ("sleep wait block sync synchronous".split(), [r"sleep\s*\(", r"wait\s*\(", r"block\s*\(", r"sync\s+", r"thread\.sleep", r"\.join\s*\("], "blocking waiting synchronous".split()),
    "recursive": ("recursive recursion self this".split(), [r"function\s+\w+.*\w+\s*\(", r"return\s+\w+\s*\(", r"this\.\w+\s*\("], "recursive self-calling".split()),
    "infinite_loop_risk": ("while for loop infinite".split(), [r"while\s*\(\s*true\s*\)", r"for\s*\(\s*;\s*;\s*\)", r"while\s*\(\s*1\s*\)", r"for\s*\(\s*;\s*true\s*;\s*\)"], "infinite endless loop".split()),
    "resource_leak": ("open close connect disconnect alloc free".split(), [r"open\s*\(", r"close\s*\(", r"connect\s*\(", r"disconnect\s*\(", r"alloc\s*\(", r"free\s*\(", r"\.open\s*\(", r"\.close\s*\("], "resource connection allocation".split()),
}
BEHAVIOUR_WEIGHTS = (0.2, 0.3, 0.1, 0.2)
# What is said of a behaviour whose score is above a bound.
RISKS = (
    ("infinite_loop_risk", 0.5, "Potential infinite loop detected"),
    ("resource_leak", 0.5, "Potential resource leak - ensure proper cleanup"),
    ("memory_intensive", 0.7, "Memory-intensive operation - monitor memory usage"),
    ("security_sensitive", 0.6, "Security-sensitive operation - ensure proper validation"),
    ("error_prone", 0.6, "Error-prone operation - ensure proper error handling"),
    ("performance_bottleneck", 0.6, "Potential performance bottleneck - consider optimization"),
    ("blocking_operation", 0.5, "Blocking operation - consider async alternatives"),
)
ADVICE = (
    ("async_operation", 0.5, "Consider using async/await for better error handling"),
    ("error_prone", 0.5, "Add comprehensive error handling and validation"),
    ("performance_bottleneck", 0.5, "Consider optimizing loops and data processing"),
    ("memory_intensive", 0.5, "Monitor memory usage and consider streaming for large data"),
    ("security_sensitive", 0.5, "Implement proper security measures and input validation"),
    ("resource_leak", 0.5, "Ensure proper resource cleanup in finally blocks"),
)
MANY_RISKS = "Consider refactoring to reduce complexity and risks"


def rule_score(text: Column, name: Column, rule: tuple, label: str, weights: tuple) -> Column:
    """Score of one rule, at most 1; text and name in lower case."""
    words, patterns, contexts = rule
    hit = lambda c: c.cast("int")
    n_words = sum((hit(F.contains(text, F.lit(w))) for w in words), F.lit(0))
    n_patterns = sum((hit(text.rlike(p)) for p in patterns), F.lit(0))
    n_contexts = sum((hit(F.contains(text, F.lit(w))) for w in contexts), F.lit(0))
    named = hit(reduce(Column.__or__, (F.contains(name, F.lit(w)) for w in words)))
    part = lambda n, w: F.least(n * F.lit(w), F.lit(1.0))
    return F.least(F.lit(1.0), part(n_words, weights[0]) + part(n_patterns, weights[1]) + part(n_contexts, weights[2]) + named * F.lit(weights[3]))


def sql_score(text: str, name: str, rule: tuple, label: str, weights: tuple) -> str:
    words, patterns, contexts = rule
    q = lambda s: s.replace("'", "''")
    count = lambda ws: " + ".join(f"CAST(contains({text}, '{q(w)}') AS INT)" for w in ws)
    rx = " + ".join(f"CAST(regexp_matches({text}, '{q(p)}') AS INT)" for p in patterns)
    named = "CAST(" + " OR ".join(f"contains({name}, '{q(w)}')" for w in words) + " AS INT)"
    w = [f"CAST({x} AS DOUBLE)" for x in weights]
    return f"least(1.0::DOUBLE, least(({count(words)}) * {w[0]}, 1.0) + least(({rx}) * {w[1]}, 1.0) + least(({count(contexts)}) * {w[2]}, 1.0) + {named} * {w[3]})"


def scores(df: DataFrame, text: Column, name: Column, rules: dict, weights: tuple) -> DataFrame:
    """df with one column of scores, in the order of the rules."""
    low, short = F.lower(text), F.lower(name)
    base = df.withColumns({"_t": F.coalesce(low, F.lit("")), "_n": F.coalesce(short, F.lit(""))})
    each = [F.struct(rule_score(F.col("_t"), F.col("_n"), r, k, weights).alias("score"), F.lit(-i).alias("ord"), F.lit(k).alias("label")) for i, (k, r) in enumerate(rules.items())]
    return base.withColumn("scores", F.array(*each)).drop("_t", "_n")


def best(scored: DataFrame) -> DataFrame:
    """The label with the highest score, the first on ties; null if nothing scores."""
    # the generator keeps the scores from being worked out once for each of its uses
    rows = scored.select(*[c for c in scored.columns if c != "scores"], F.explode(F.array(F.array_max("scores"))).alias("_top"))
    top = F.col("_top")
    return rows.withColumns({"label": F.when(top["score"] > 0, top["label"]), "score": F.round(top["score"], 6)}).drop("_top")


def said_of(scores: Column, rules: tuple) -> Column:
    """The sentences whose behaviour scores above its bound; scores: array of (score, ord, label)."""
    of = lambda k: F.element_at(F.filter(scores, lambda x: x["label"] == k), 1)["score"]
    return F.filter(F.array(*(F.when(of(k) > bound, F.lit(text)) for k, bound, text in rules)), lambda x: x.isNotNull())


def evidence(df: DataFrame, text: Column, label: Column, rules: dict) -> DataFrame:
    """df with the words, patterns and contexts of its label that the text has, at most three, two and two."""
    def held(part: int, most: int) -> Column:
        own = F.create_map(*[x for k, r in rules.items() for x in (F.lit(k), F.array(*map(F.lit, r[part])))])[label]
        found = F.filter(own, (lambda x: F.rlike("_t", x)) if part == 1 else (lambda x: F.contains("_t", x)))
        return F.array_join(F.slice(found, 1, most), ", ")

    base = df.withColumn("_t", F.coalesce(F.lower(text), F.lit("")))
    return base.withColumns({"words": held(0, 3), "patterns": held(1, 2), "contexts": held(2, 2)}).drop("_t")


# Patterns as (roles and the parts of names that play them, links expected between roles, endings of names).
PATTERNS: dict[str, tuple[dict[str, str], list[tuple[str, str]], str]] = {
    "mvc": ({"controllers": "controller|ctrl|handler|action", "models": "model|entity|domain|data", "views": "view|component|template|page|ui"}, [("controllers", "models"), ("controllers", "views"), ("views", "models")], "controller|model|view|component"),
    "repository": ({"repositories": "repository|repo|dao|dataaccess", "entities": "entity|model|domain", "services": "service|business|logic"}, [("services", "repositories"), ("repositories", "entities")], "repository|dao|dataaccess"),
    "factory": ({"factories": "factory|builder|creator|maker", "products": "product|object|instance|item"}, [("factories", "products")], "factory|builder|creator"),
    "singleton": ({"singletons": "singleton|instance|manager|registry"}, [], "singleton|manager|registry"),
    "observer": ({"subjects": "subject|observable|publisher|event", "observers": "observer|listener|subscriber|handler"}, [("subjects", "observers")], "observer|listener|subscriber"),
    "dependency_injection": ({"services": "service|component|bean", "injectors": "injector|container|registry|module"}, [("injectors", "services")], "service|component|bean"),
    "command": ({"commands": "command|action|operation|task", "invokers": "invoker|executor|dispatcher", "receivers": "receiver|handler|processor"}, [("invokers", "commands"), ("commands", "receivers")], "command|action|operation"),
    "strategy": ({"strategies": "strategy|algorithm|policy|behavior", "contexts": "context|client|executor"}, [("contexts", "strategies")], "strategy|algorithm|policy"),
    "adapter": ({"adapters": "adapter|wrapper|converter", "targets": "target|interface|contract", "adaptees": "adaptee|legacy|external"}, [("adapters", "targets"), ("adapters", "adaptees")], "adapter|wrapper|converter"),
    "decorator": ({"decorators": "decorator|wrapper|enhancer", "components": "component|base|core"}, [("decorators", "components")], "decorator|wrapper|enhancer"),
    "facade": ({"facades": "facade|interface|api|gateway", "subsystems": "subsystem|module|service"}, [("facades", "subsystems")], "facade|gateway|interface"),
    "proxy": ({"proxies": "proxy|stub|surrogate", "subjects": "subject|real|target"}, [("proxies", "subjects")], "proxy|stub|surrogate"),
    "builder": ({"builders": "builder|constructor|assembler", "products": "product|object|result"}, [("builders", "products")], "builder|constructor|assembler"),
    "microservice": ({"services": "service|microservice|api", "gateways": "gateway|router|proxy"}, [("gateways", "services")], "service|api|gateway"),
    "layered": ({"presentation": "presentation|ui|view|controller", "business": "business|service|logic|domain", "data": "data|repository|dao|persistence"}, [("presentation", "business"), ("business", "data")], "controller|service|repository"),
}
#: Patterns that have a name but no rule.
UNRULED = ("chain_of_responsibility", "mediator", "state", "template_method", "visitor", "pipe_and_filter", "publish_subscribe")


def roles(nodes: DataFrame) -> DataFrame:
    """(pattern, role, id, named): every node by each role that its name plays, and whether it ends as such names do."""
    low = F.lower("name")
    each = [
        F.when(low.rlike(rx), F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("role"), low.rlike(f"({ends})$").alias("named")))
        for p, (rs, _, ends) in PATTERNS.items() for r, rx in rs.items()
    ]
    found = F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return nodes.where(F.col("name").isNotNull()).select("id", found.alias("r")).select("r.pattern", "r.role", "id", "r.named")


def _of_pattern(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col("pattern")]


def role_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(pattern, from_role, to_role, n) of the expected links that there are."""
    member = roles(nodes)
    a = member.select("pattern", F.col("role").alias("from_role"), F.col("id").alias("source"))
    b = member.select("pattern", F.col("role").alias("to_role"), F.col("id").alias("target"))
    wanted = F.create_map(*[x for p, (_, ls, _) in PATTERNS.items() for x in (F.lit(p), F.array(*[F.lit(f"{s}>{t}") for s, t in ls]).cast("array<string>"))])
    pairs = links.select("source", "target").join(a, "source").join(b, ["pattern", "target"])
    hits = pairs.where(F.array_contains(wanted[F.col("pattern")], F.concat("from_role", F.lit(">"), "to_role")))
    return hits.groupBy("pattern", "from_role", "to_role").agg(F.count("*").alias("n"))


def patterns(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(pattern, n_members, n_links, confidence): roles present 0.4, expected links present 0.3, balance of the roles' sizes 0.2, names 0.1."""
    sizes = roles(nodes).groupBy("pattern", "role").agg(F.count("*").alias("n"), F.count_if("named").alias("k"))
    per = sizes.groupBy("pattern").agg(F.count("*").alias("present"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("n_members"), F.sum("k").alias("n_named"))
    hits = role_links(nodes, links).groupBy("pattern").agg(F.sum("n").alias("n_links"), F.count("*").alias("kinds"))
    both = per.join(hits, "pattern", "left").na.fill(0, ["n_links", "kinds"])
    n_wanted = _of_pattern({p: len(ls) for p, (_, ls, _) in PATTERNS.items()})
    linked = F.when(n_wanted > 0, F.col("kinds") / n_wanted).otherwise(0.0)
    score = 0.4 * F.col("present") / _of_pattern({p: len(rs) for p, (rs, _, _) in PATTERNS.items()}) + 0.3 * linked + 0.2 * F.col("least") / F.col("most") + 0.1 * F.col("n_named") / F.col("n_members")
    return both.select("pattern", "n_members", "n_links", F.round(F.least(F.lit(1.0), score), 6).alias("confidence"))


def violations(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(pattern, missing, advice): roles that nothing plays and expected links between present roles that there are none of, of patterns of which any role is present."""
    seen = roles(nodes).select("pattern", "role").distinct()
    spark = nodes.sparkSession
    every = spark.createDataFrame([(p, r) for p, (rs, _, _) in PATTERNS.items() for r in rs], "pattern string, role string")
    expected = [(p, s, t) for p, (_, ls, _) in PATTERNS.items() for s, t in ls]
    wanted = spark.createDataFrame(expected, "pattern string, from_role string, to_role string")
    some = seen.select("pattern").distinct()
    absent = every.join(some, "pattern", "left_semi").join(seen, ["pattern", "role"], "left_anti")
    roles_ = absent.select("pattern", F.concat(F.lit("Missing "), "role", F.lit(" components")).alias("missing"), F.concat(F.lit("Add missing components to complete "), "pattern", F.lit(" pattern")).alias("advice"))
    present = wanted.join(seen.withColumnRenamed("role", "from_role"), ["pattern", "from_role"], "left_semi").join(seen.withColumnRenamed("role", "to_role"), ["pattern", "to_role"], "left_semi")
    loose = present.join(role_links(nodes, links), ["pattern", "from_role", "to_role"], "left_anti")
    links_ = loose.select("pattern", F.concat(F.lit("Missing "), "from_role", F.lit(" -> "), "to_role", F.lit(" relationships")).alias("missing"), F.concat(F.lit("Establish missing relationships for "), "pattern", F.lit(" pattern")).alias("advice"))
    return roles_.unionByName(links_)
