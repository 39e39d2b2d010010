"""Functions paired with their documentation (problem 7).

The lexers' state machines give tokens without strings and comments, and the offsets of
documentation comments.  Whatever a comment stands right above is read as a declaration:
annotations and modifiers, then a function, a method, a constructor, or a name that a function is
assigned to.  Matching braces delimit its body; without one it is no pair.  Python has no braces:
there the syntax tree, which the parse made anyway, gives functions and their docstrings.

Documentation is trivial if nothing is left of it without tags, if it says that it is missing or
still to come, if it fits any function, or if it only repeats the name's words.

Cases: null content, unknown extensions and files that do not parse yield nothing; of a file sent
twice the latest record counts; texts are read whole; extra columns are not read.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexers import (
    ARROW, END, IDENT, INCREMENT, JAVA_WORDS, JS_CONTEXTUAL, JS_WORDS, NEWLINE, PAIRS, PRIVATE, Broken, Tokens,
)
from .syntax import Undecided, language_of, parsers, record_order

_J = JAVA_WORDS
_S = JS_WORDS
_CLOSES = frozenset(PAIRS.values())
_JS_NAMES = frozenset([IDENT, *JS_CONTEXTUAL.values()])
_JS_MODIFIERS = frozenset(_S[w] for w in "export default async public private protected static readonly abstract override declare get set accessor".split())
_NOT_METHODS = frozenset(_S[w] for w in "if for while switch with catch return do else try function new typeof delete void await throw case super this import in of".split() if w in _S)
_JAVA_MODIFIERS = frozenset(_J[w] for w in "abstract default final native private protected public static strictfp synchronized".split())
_JAVA_NAMES = frozenset([IDENT, *(_J[w] for w in ("var", "record", "sealed", "permits", "yield"))])
_NAME = re.compile(r"#?[\w$]+")

# What says nothing.
_TAG = re.compile(r"(?m)^[ \t]*[@\\][A-Za-z]+")
_SECTIONS = re.compile(
    r"(?mi)^[ \t]*(?:(?:args|arguments|parameters|params|returns?|raises|yields?|throws|examples?|attributes|keyword args)\s*(?::[ \t]*$|\n[ \t]*-{3,})|:(?:param|type|returns?|rtype|raises?)\b)"
)
_MISSING = re.compile(
    r"""(?xi)^\W*(?:
      (?:todo|fixme|xxx|tbd|hack)\b\W*(?:\(\w+\))?\W*(?:please\W+)?(?:(?:document|describe|write|add|fill|complete|explain|comment)\b.{0,40})?
    | n/?a | none | tbd | missing | undocumented | empty
    | (?:auto[- ]?generated|generated)(?:\s+(?:method|function|constructor))?\s+(?:stub|doc\w*|comment|code)?
    | (?:documentation|docs?|description|docstring|comment|details)\s+(?:to\s+follow|(?:goes|go)\s+here|(?:is\s+)?missing|pending|to\s+be\s+\w+|coming\s+soon|follows|needed)
    | (?:no|add|missing|insert)\s+(?:documentation|docs?|description|comment)s?(?:\s+(?:here|yet|available|provided))?
    | not\s+(?:yet\s+)?documented(?:\s+yet)? | to\s+be\s+(?:documented|done|written|defined) | work\s+in\s+progress | wip | placeholder
    )\W*$"""
)
_ANY = re.compile(
    r"""(?xi)^\W*(?:
      (?:an?\s+|the\s+|this\s+is\s+an?\s+)?(?:simple\s+|small\s+|internal\s+|private\s+|generic\s+)?(?:helper|utility|util|main|internal|convenience|wrapper|callback|handler|default)(?:\s+(?:function|method|class|routine))?
    | see\s+(?:above|below|the\s+code|code|description|class|parent|super\s?class|implementation|docs?)
    | same\s+as\s+above | as\s+above | self[- ]explanatory | inherit(?:ed|s)?(?:\s?doc\w*)? | ditto
    | (?:does|do)\s+(?:stuff|things?|something|the\s+work|what\s+it\s+says|its\s+job)
    | (?:the\s+|an?\s+|default\s+)*(?:function|method|constructor|getter|setter|implementation)
    )\W*$"""
)
_FILLER = frozenset(
    """a an the this that these it its of to for from in on with and or is are be by as at into all given new
    function method constructor class instance object value values data result results item items thing things stuff helper
    property properties field fields attribute attributes member members variable variables
    returns return does do performs perform handles handle shows show creates create makes make runs run calls call
    init inits initialise initialises initialize initializes initializer construct constructs""".split()
)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def comment_text(raw: str) -> str:
    """The text of a block comment without its stars."""
    return re.sub(r"(?m)^[ \t]*\*+[ \t]?", "", raw[3:-2].replace("\r", "")).strip()


def description(doc: str, script: bool) -> str:
    """The documentation without tags and sections."""
    doc = doc.replace("\r", "")
    cut = _TAG.search(doc)
    if cut:
        doc = doc[: cut.start()]
    if not script and (cut := _SECTIONS.search(doc)):
        doc = doc[: cut.start()]
    doc = re.sub(r"\{@(?:link|code|literal|linkplain)\s+([^}]*)\}", r"\1", doc)
    doc = re.sub(r"\{@\w+\}|</?\w+/?>", " ", doc)
    return " ".join(doc.split())


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ing", "ed", "es", "s", "er", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def trivial(text: str, name: str) -> bool:
    if not any(c.isalnum() for c in text) or _MISSING.match(text) or _ANY.match(text):
        return True
    own = {w.lower() for w in _WORD.findall(name)}
    own |= {_stem(w) for w in own} | {"".join(_WORD.findall(name)).lower()}
    if own & {"constructor", "init"}:
        own |= {"constructor", "constructs", "init", "inits", "initial", "initialise", "initialize", "create", "creat"}
    said = [w.lower() for w in _WORD.findall(text)]
    if all(w in _FILLER or w in own or _stem(w) in own for w in said):
        return True
    # a verb with nothing but fillers fits any function
    return len([w for w in said if w not in _FILLER]) <= 1 and 1 < len(said) <= 4 and said[-1] in _FILLER


class _Reader:
    """Reads the declaration that begins at a token."""

    def __init__(self, text: str, tokens: Tokens):
        keep = [i for i, k in enumerate(tokens.kinds) if k != NEWLINE]
        self.text = text
        self.kinds = [tokens.kinds[i] for i in keep] + [END] * 4
        self.starts = [tokens.starts[i] for i in keep]
        self.breaks = frozenset(tokens.starts[i] for i, k in enumerate(tokens.kinds) if k == NEWLINE)

    def word(self, i: int) -> str:
        return _NAME.match(self.text, self.starts[i]).group()

    def end(self, i: int) -> int:
        """Behind the text of a token."""
        start = self.starts[i]
        if self.kinds[i] in _CLOSES:
            return start + 1
        if m := _NAME.match(self.text, start):
            return m.end()
        stop = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
        return start + len(self.text[start:stop].rstrip())

    def past(self, i: int) -> int:
        """Behind the group that opens at i."""
        depth = 0
        kinds = self.kinds
        while True:
            k = kinds[i]
            if k in PAIRS:
                depth += 1
            elif k in _CLOSES:
                depth -= 1
            elif k == END:
                return i
            i += 1
            if not depth:
                return i

    def past_types(self, i: int) -> int:
        """Behind the type arguments or parameters that open at i."""
        depth = 0
        while True:
            k = self.kinds[i]
            if k == "<":
                depth += 1
            elif k == ">":
                depth -= 1
            elif k == END:
                return i
            if k in PAIRS:
                i = self.past(i)
            else:
                i += 1
            if depth <= 0:
                return i

    def annotations(self, i: int, names: frozenset) -> int:
        while self.kinds[i] == "@":
            i += 2
            while self.kinds[i] == "." and self.kinds[i + 1] in names:
                i += 2
            if self.kinds[i] == "(":
                i = self.past(i)
        return i

    # each returns (token of the name, token behind the body)

    def java(self, i: int, classes: set[str]) -> tuple[int, int] | None:
        kinds = self.kinds
        while kinds[i] == "@" and kinds[i + 1] != _J["interface"] or kinds[i] in _JAVA_MODIFIERS:
            i = self.annotations(i, _JAVA_NAMES) if kinds[i] == "@" else i + 1
        if kinds[i] == "<":
            i = self.past_types(i)
        if kinds[i] in _JAVA_NAMES and kinds[i + 1] in ("(", "{") and self.word(i) in classes:
            name = i
            i = self.past(i + 1) if kinds[i + 1] == "(" else i + 1
        else:
            begin = i
            i = self.annotations(i, _JAVA_NAMES)
            if not (kinds[i] in _JAVA_NAMES or "Ȁ" <= kinds[i] < "ʀ"):
                return None
            i += 1
            while True:
                if kinds[i] == "<":
                    i = self.past_types(i)
                elif kinds[i] == "[" and kinds[i + 1] == "]":
                    i += 2
                elif kinds[i] == "." and kinds[i + 1] in _JAVA_NAMES:
                    i += 2
                elif kinds[i] == "@":
                    i = self.annotations(i, _JAVA_NAMES)
                else:
                    break
            if kinds[i] not in _JAVA_NAMES or kinds[i + 1] != "(" or i == begin:
                return None
            name = i
            i = self.past(i + 1)
        while kinds[i] not in ("{", ";", "=", END, _J["default"]):
            i += 1
        return (name, self.past(i)) if kinds[i] == "{" else None

    def script(self, i: int) -> tuple[int, int] | None:
        kinds = self.kinds
        while True:
            if kinds[i] == "@":
                i = self.annotations(i, _JS_NAMES)
            elif kinds[i] in _JS_MODIFIERS and (kinds[i + 1] not in ("(", "=", ";", ":", "<", ",", "?", "!") or kinds[i] in (_S["export"], _S["default"])):
                if kinds[i] == _S["declare"]:
                    return None
                i += 1
            elif kinds[i] == "*":
                i += 1
            else:
                break
        k = kinds[i]
        if k == _S["function"]:
            i += 1
            if kinds[i] == "*":
                i += 1
            if kinds[i] not in _JS_NAMES:
                return None
            end = self.callable(i + 1)
            return (i, end) if end else None
        if k in (_S["const"], _S["var"], _S["let"]) and kinds[i + 1] in _JS_NAMES:
            i += 1
            end = self.assigned(i + 1)
            return (i, end) if end else None
        if (k in _JS_NAMES or k == PRIVATE or k in _S.values()) and k not in _NOT_METHODS:
            if kinds[i + 1] in ("(", "<") or (kinds[i + 1] == "?" and kinds[i + 2] in "(<"):
                end = self.callable(i + 1 + (kinds[i + 1] == "?"))
            else:
                end = self.assigned(i + 1)
            return (i, end) if end else None
        return None

    def callable(self, i: int) -> int | None:
        """Behind the body of what has type parameters or parameters at i."""
        kinds = self.kinds
        if kinds[i] == "<":
            i = self.past_types(i)
        if kinds[i] != "(":
            return None
        i = self.past(i)
        if kinds[i] == ":":
            i = self.result(i + 1)
        return self.past(i) if kinds[i] == "{" else None

    def result(self, i: int) -> int:
        """Behind a type: at a body, an arrow or something else."""
        kinds = self.kinds
        wants = True  # a part of the type must follow
        while True:
            k = kinds[i]
            if k in (";", "=", END, ",") or k in _CLOSES:
                return i
            if not wants and (k == "{" or self.starts[i] in self.breaks):
                return i
            if k == "<":
                i = self.past_types(i)
                wants = False
            elif k in PAIRS:
                after = self.past(i)
                if k == "(" and kinds[after] == ARROW:
                    i, wants = after + 1, True
                    continue
                i, wants = after, False
            elif k == ARROW:
                return i
            else:
                wants = k in "|&.:?-" or k in (_S["keyof"], _S["is"], _S["extends"], _S["typeof"], _S["readonly"], _S["new"], _S["infer"], _S["unique"])
                i += 1

    def assigned(self, i: int) -> int | None:
        """Behind the function that is assigned at i, perhaps after a type."""
        kinds = self.kinds
        if kinds[i] in "?!":
            i += 1
        if kinds[i] == ":":
            i += 1
            while kinds[i] not in ("=", ";", ",", END) and kinds[i] not in _CLOSES:
                if self.starts[i] in self.breaks:
                    return None
                i = self.past_types(i) if kinds[i] == "<" else self.past(i) if kinds[i] in PAIRS else i + 1
        if kinds[i] != "=":
            return None
        i += 1
        if kinds[i] == _S["async"]:
            i += 1
        if kinds[i] == _S["function"]:
            i += 1
            if kinds[i] == "*":
                i += 1
            if kinds[i] in _JS_NAMES:
                i += 1
            return self.callable(i)
        if kinds[i] in _JS_NAMES and kinds[i + 1] == ARROW:
            i += 1
        else:
            if kinds[i] == "<":
                i = self.past_types(i)
            if kinds[i] != "(":
                return None
            i = self.past(i)
            if kinds[i] == ":":
                i = self.result(i + 1)
        if kinds[i] != ARROW:
            return None
        i += 1
        if kinds[i] == "{":
            return self.past(i)
        while kinds[i] not in (";", ",", END) and kinds[i] not in _CLOSES and self.starts[i] not in self.breaks:
            i = self.past(i) if kinds[i] in PAIRS else i + 1
        return i


def _commented(text: str, tokens: Tokens, java: bool) -> list[tuple[int, str, str, str]]:
    if not tokens.docs:
        return []
    r = _Reader(text, tokens)
    classes = set(re.findall(r"\b(?:class|enum|record|interface)\s+(\w+)", text)) if java else set()
    breaks = [m.start() for m in re.finditer("\n", text)]
    out = []
    for start, end in tokens.docs:
        i = bisect_left(r.starts, end)
        if i >= len(r.starts):
            continue
        gap = text[end : r.starts[i]]
        if gap.strip() or gap.count("\n") > 1:
            continue
        found = r.java(i, classes) if java else r.script(i)
        if found is None:
            continue
        name, behind = found
        words = description(comment_text(text[start:end]), True)
        called = r.word(name)
        if not trivial(words, called):
            out.append((bisect_left(breaks, r.starts[name]) + 1, called, words, text[r.starts[i] : r.end(min(behind, len(r.starts)) - 1)]))
    return out


def _docstrings(text: str, tree: ast.AST) -> list[tuple[int, str, str, str]]:
    out = []
    lines = None
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = ast.get_docstring(node)
            if doc is not None:
                words = description(doc, False)
                if not trivial(words, node.name):
                    lines = lines or text.split("\n")
                    out.append((node.lineno, node.name, words, "\n".join(lines[node.lineno - 1 : node.end_lineno])))
    return out


def pairs_of(path: str | None, text: str | None) -> list[tuple[int, str, str, str]]:
    """(line, name, documentation, code) of the documented functions of a file."""
    language = language_of(path)
    if language is None or not text:
        return []
    try:
        parsed = parsers().parse(language, text)
    except (Broken, Undecided):
        return []
    if language == "python":
        return _docstrings(text, parsed)
    return _commented(text, parsed, language == "java")


def _run(with_text: bool):
    def run(batches):
        import pyarrow as pa

        fields = [("decl_line", pa.int32()), ("func_name", pa.string()), ("documentation", pa.string()), ("code", pa.string())][: 4 if with_text else 2]
        for batch in batches:
            offsets, rows = [0], []
            for path, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rows += pairs_of(path, text)
                offsets.append(len(rows))
            columns = list(zip(*rows)) or [()] * 4
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["file_id", "sent", "pairs"])

    return run


def documented_functions(files: DataFrame, with_text: bool = True) -> DataFrame:
    """(file_id, decl_line, func_name[, documentation, code]) of all pairs of each file's latest record."""
    source = files.select(F.col("file_id").cast("bigint").alias("file_id"), record_order(files).alias("sent"), "path", "content")
    pair = "struct<decl_line:int,func_name:string" + ",documentation:string,code:string" * with_text + ">"
    rows = source.mapInArrow(_run(with_text), f"file_id bigint, sent {source.schema['sent'].dataType.simpleString()}, pairs array<{pair}>")
    latest = rows.groupBy("file_id").agg(F.max_by("pairs", "sent").alias("pairs"))
    return latest.select("file_id", F.inline("pairs")).dropDuplicates(["file_id", "decl_line", "func_name"])
