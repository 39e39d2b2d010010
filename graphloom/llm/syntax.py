"""Source files that do not parse (problem 3).

Every file is parsed with all grammars.  One that the grammar of its extension refuses has a wrong
extension if others accept it, named by the one of them that its tokens rank first; a file that none accepts is corrupt; one that languages of several kinds accept is
ambiguous.  Dialects of one family share the lexing of a text and what is known of its bracket
groups.  Python is parsed by the interpreter's own parser, which must be 3.13 or later, the others by
the grammars of script_grammar and java_grammar.

Reports of earlier runs are evidence beside the parse, not instead of it: the rates count, per
project and language, files, invalid files by cause, and those that an error report had named.

Cases: null content and unknown extensions are no case (``valid`` is null), nor is a text nested too
deeply to be judged; empty and blank texts are valid.  A worker short of memory fails its task and
judges nothing.  A file sent twice counts once, by its latest record.  Extra columns are not read.
"""

from __future__ import annotations

import ast
import sys
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .java_grammar import Java
from .lexers import Broken, Groups, Lexed
from .script_grammar import Script

#: The language of an extension.
EXTENSIONS = {"py": "python", "java": "java", "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "jsx": "javascript"}
LANGUAGES = ("python", "java", "typescript", "tsx", "javascript")
#: What speaks for a language.
MARKS = {
    "python": ("\ndef ", "    def ", "elif ", "self.", "None", "import "),
    "java": ("public ", "private ", "final ", "void ", "package ", ";\nimport "),
    "typescript": (": string", ": number", ": boolean", ": unknown", "interface ", "readonly "),
    "tsx": ("</", "/>", "className="),
    "javascript": ("const ", "function ", "=>", "let ", "===", "module.exports"),
}
FAMILY = {"typescript": "script", "tsx": "script", "javascript": "script"}


class Undecided(Exception):
    """The text is nested too deeply to be judged."""


class Parsers:
    """The grammars of one Python worker; they share the interned groups."""

    def __init__(self):
        if sys.version_info < (3, 13):
            raise RuntimeError("Python files are parsed by the interpreter, which must be 3.13 or later")
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        warnings.simplefilter("ignore", SyntaxWarning)
        groups, lexed = Groups(), Lexed()
        self.java = Java(groups)
        self.typescript = Script(groups, True, False, lexed)
        self.tsx = Script(groups, True, True, lexed)
        self.javascript = Script(groups, False, True, lexed)

    def parse(self, language: str, text: str):
        """A syntax tree (Python) or tokens; raises Broken if the text isn't valid."""
        try:
            if language != "python":
                return getattr(self, language).parse(text)
            return compile(text.removeprefix("\ufeff"), "<text>", "exec", ast.PyCF_ONLY_AST)
        except (SyntaxError, ValueError) as e:
            raise Broken(str(e.args[0] if e.args else e)) from e
        except RecursionError as e:
            raise Undecided("nested too deeply") from e
        except MemoryError as e:
            if "stack overflowed" in str(e):  # the parser's own limit, the same for every worker
                raise Undecided("nested too deeply") from e
            raise

    def accepting(self, text: str) -> tuple[list[str], dict[str, str], bool]:
        """The languages whose grammar accepts the text, why others don't, and whether all could tell."""
        found, errors, sure = [], {}, True
        for language in LANGUAGES:
            try:
                self.parse(language, text)
                found.append(language)
            except Broken as e:
                errors[language] = str(e.args[0])
            except Undecided as e:
                errors[language], sure = str(e), False
        return found, errors, sure

    def verdict(self, language: str, text: str) -> tuple[bool | None, str | None, str | None, bool]:
        """(valid, the other language that accepts it, error, do languages of several kinds accept it?)."""
        if not text.strip():
            return True, None, None, False
        found, errors, sure = self.accepting(text)
        kinds = {FAMILY.get(x, x) for x in found}
        if language in found:
            return True, None, None, len(kinds) > 1
        if not sure and not found:
            return None, None, errors[language], False
        # the rank of a text's tokens says which of several is meant
        other = next((x for x in ranked(text) if x in found), None) if found else None
        return False, other, errors[language], len(kinds) > 1


def ranked(text: str) -> list[str]:
    """The languages, the one with most tokens of its own first."""
    hits = {x: sum(map(text.count, MARKS[x])) for x in LANGUAGES}
    return sorted(LANGUAGES, key=lambda x: -hits[x])


_PARSERS: list[Parsers] = []


def parsers() -> Parsers:
    if not _PARSERS:
        _PARSERS.append(Parsers())
    return _PARSERS[0]


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def _run(batches):
    import pyarrow as pa

    p = parsers()
    for batch in batches:
        found = []
        for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            language = language_of(path)
            found.append((language, None, None, None, None) if text is None or language is None else (language, *p.verdict(language, text)))
        columns = list(zip(*found)) or [[]] * 5
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column(3)],
            ["file_id", "language", "valid", "parses_as", "error", "ambiguous", "sent"],
        )


def record_order(files: DataFrame) -> Column:
    """What the latest of a file's records has most of: the time it arrived, then its text."""
    return F.struct(F.col("ingested_at").cast("timestamp_ntz").alias("at"), F.xxhash64("content", "path").alias("text"))


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, language, valid, parses_as, error, ambiguous, sent) of each record."""
    source = files.select(F.col("file_id").cast("bigint").alias("file_id"), "path", "content", record_order(files).alias("sent"))
    return source.mapInArrow(_run, f"file_id bigint, language string, valid boolean, parses_as string, error string, ambiguous boolean, sent {source.schema['sent'].dataType.simpleString()}")


def latest(df: DataFrame) -> DataFrame:
    """The latest record of each file."""
    rest = [c for c in df.columns if c not in ("file_id", "sent")]
    return df.groupBy("file_id").agg(F.max_by(F.struct(*rest), "sent").alias("r")).select("file_id", *(F.col("r")[c].alias(c) for c in rest))


def invalid_files(files: DataFrame) -> DataFrame:
    """Files whose latest record does not parse."""
    return latest(verdicts(files)).where(~F.col("valid"))


def clean_path(path: Column) -> Column:
    """One form of the ways in which reports write a path."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(path), r"[\\/]+", "/"), r"^(\./)+|^/", ""))


def rates(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Per project and language: files, invalid ones by cause, and what reports had named."""
    paths = latest(files.select("file_id", record_order(files).alias("sent"), "project", clean_path(F.col("path")).alias("path")))
    reported = (
        reports.where(F.lower(F.trim("severity")).isin("error", "err", "fatal", "critical"))
        .select(clean_path(F.col("file")).alias("path"))
        .distinct()
        .withColumn("reported", F.lit(True))
    )
    judged = latest(verdicts(files)).where(F.col("valid").isNotNull())
    each = judged.join(paths, "file_id").join(reported, "path", "left")
    bad = ~F.col("valid")
    return each.groupBy("project", "language").agg(
        F.count("*").alias("n_files"),
        F.count_if(bad).alias("n_invalid"),
        F.count_if(bad & F.col("parses_as").isNotNull()).alias("n_wrong_extension"),
        F.count_if(bad & F.col("parses_as").isNull()).alias("n_corrupt"),
        F.count_if("ambiguous").alias("n_ambiguous"),
        F.count_if(bad & F.coalesce("reported", F.lit(False))).alias("n_invalid_reported"),
        F.count_if(F.col("valid") & F.coalesce("reported", F.lit(False))).alias("n_valid_reported"),
        F.round(F.avg(bad.cast("double")), 6).alias("rate"),
    )
