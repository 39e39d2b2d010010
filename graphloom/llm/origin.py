"""Generated, minified and vendored source files, and data saved as code (problem 1).

One table of rules decides, in the form of attribute files (``.gitattributes``): a glob, the folder it
stands in, and whether it marks or clears.  Its rows are

1. *declared*: the lines of a project's attribute files about generated or vendored paths;
2. *mined patterns*: globs that the corpus shows to mean the same, applied to every project that
   declares nothing: globs that several projects declare, and folder names and compound extensions
   whose files mostly are marked by a declaration or bear evidence of their own;
3. *mined lines*: one for each file with evidence of its own, as if its project had listed it.

Of all rules that match a path, declared ones go before mined ones, then the deepest folder, then the
last line, and the rule that is left marks or clears the file.  Declared globs are met by the files
below their folder only, by a join over (project, folder above the file); mined patterns by a join over
the names and endings of the path.

Evidence of its own seeds the miner: a tool's notice or a licence in the comment at the head, text
without white space, literals instead of code, *line shapes* (lines with names and values masked)
that appear almost only in files with a tool's notice, and *copies* of third-party files, which are
found by MinHash over word shingles of five words and verified by the exact similarity of their
shingles, 0.8 or more.

All statistics count every file, and distinct projects exactly.  Hot shapes and folders are
aggregated map-side before they are shuffled.  Copies are compared between classes of equal
signatures; a class first meets one third-party class of each band, and only one that none of these
proves a copy meets all the others.

Cases: null content is judged by its path alone; empty and blank texts are written by hand.  A file
sent twice counts once, by its latest record.  Null paths and projects match no pattern.  Empty
tables give empty results.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import spill_table

from .syntax import record_order

SHINGLE = 5
HASHES, ROWS = 128, 4
SIMILAR = 0.8
#: A pattern of paths counts if this many files of so many projects bear it, and so many of them show evidence.
PATH_FILES, PATH_PROJECTS, PATH_RATE = 5, 3, 0.3
#: A line shape counts by the same numbers, with files that bear a tool's notice.
SHAPE_FILES, SHAPE_PROJECTS, SHAPE_RATE = 5, 3, 0.2
#: Code with fewer punctuation marks, or fewer values, shows no habit of writing.
MARKS = 8
#: A file is a tool's if at least so many of its shapes are.
SHAPE_SHARE = 0.5

# What tools write at the head of their files, in several languages.
_NOTICE = re.compile(
    r"""(?xim)^[\s/*\#!;<-]*(?:
      @generated\b | <auto-?generated | code\s+generated\s+(?:by|from)\b | auto-?\s?generated\b(?!\s+stub)
    | (?:this|the)\s+(?:file|code|class|module|source)\s+(?:is|was|has\s+been)\s+(?:automatically\s+|auto-?|machine[- ])?(?:generated|produced|created)\s+(?:by|from|with|using)\b
    | (?:this|the)\s+(?:file|code|class|module|source)\s+(?:is|was|has\s+been)\s+(?:automatically|auto-?|machine-)\s?generated\b
    | (?:automatically|machine)[-\s]generated\b | generated\s+(?:by|with|using|on|from\s+\S+\s+(?:on|by|with))\b
    | do\s+not\s+(?:edit|modify|change)\b\s*(?:[.!:;,-]|$|this\s+file|manually|by\s+hand)
    | .*(?:自动生成|自動生成|자동\s?생성|автоматически\s+(?:сгенерирован|создан)|сгенерирован|(?:erzeugt|generiert)\b.*nicht|(?:produit|généré|genere|créé)\s+(?:automatiquement|par)\b|generado\s+(?:automáticamente|por)\b|gerado\s+automaticamente)
    )"""
)
_ANNOTATED = re.compile(r"(?m)^@(?:javax?\.annotation\.(?:processing\.)?)?Generated\b")
_LICENCE = re.compile(
    r"""(?xim)^[\s/*\#!]*(?:
      (?:released|licen[cs]ed|distributed)\s+under\b | spdx-license-identifier | @license\b | @preserve\b
    | \(c\)\s.*\b(?:authors|contributors|project)\b | copyright\s.*\b(?:authors|contributors|foundation|project)\b
    | permission\s+is\s+hereby\s+granted | .*\bv?\d+\.\d+\.\d+\b\s*[|-].*\blicen[cs]e | mit\s+licen[cs]e | apache\s+licen[cs]e
    )"""
)
_HEAD = re.compile(r"\A﻿?(?:\s*(?:#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/))*")
_LITERAL = re.compile(
    r"""/\*[\s\S]*?\*/|//[^\n]*|(?<=[=(,:]\s)/(?![*/\s])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|(?<=[=(,:])/(?![*/\s])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|(?:[rbfRBF]{0,2})(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\b0[xX][\da-fA-F_]+\b|(?<![\w$])-?\d[\w.]*"""
)
_QUOTED = re.compile(r"""[rbf]?(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)""")
_NAMED = re.compile(r"[a-z$]+[A-Z\d_][\w$]*|[A-Z_][\w$]+")
_NUMBER = re.compile(r"\b\d[\w.]*")
_LINES = re.compile(r"(?m)^[ \t]*([^\s*#/][^\r\n]{6,})")
_IMPORTS = re.compile(r"(?m)^(?:import|from|#include|require)\b")
_STEPS = re.compile(r"\b(?:return|def|if|for|function|while|self|this|await)\b")
_WORDS = re.compile(r"\w+")
_HASHED = re.compile(r"[._-](?=[0-9a-f]*\d)[0-9a-f]{6,}(?=\.)")


def head_of(text: str) -> str:
    """The comments before the first code."""
    return _HEAD.match(text).group()


def is_minified(text: str) -> bool:
    """Code in which white space has been left out."""
    blank = sum(map(text.count, " \t\n\r"))
    if blank > 0.11 * len(text):
        return False
    code = _LITERAL.sub("0", text)
    marks = sum(map(code.count, "(){};=,"))
    return marks >= MARKS and marks > 0.15 * len(code) and sum(map(code.count, " \t\n\r")) < 0.13 * len(code)


def is_data(text: str) -> bool:
    """Literals with next to no code around them."""
    if len(_STEPS.findall(text)) * 400 > len(text):  # too many steps for data
        return False
    if len(_IMPORTS.findall(text)) > 1:  # data needs no modules
        return False
    held = 0  # characters of literals that are no comments and no long prose
    literals = 0
    rest = 0  # characters of words outside literals
    names: set[str] = set()
    at = 0
    for m in _LITERAL.finditer(text):
        for w in _WORDS.findall(text, at, m.start()):
            rest += len(w)
            names.add(w)
        at = m.end()
        token = m.group()
        if not token.startswith(("//", "/*")) and 12 * token.count(" ") < max(12, len(token)):
            held += len(token)
            literals += 1
    for w in _WORDS.findall(text, at):
        rest += len(w)
    if literals < MARKS and held < 25 * MARKS:  # a few values are no data yet
        return False
    return held > 0.4 * len(text) and rest < 0.12 * len(text) and (len(names) <= 15 or rest < 0.03 * len(text))


def shapes_of(body: str) -> dict[str, int]:
    """Lines with names and values masked, and how often each stands there."""
    out: dict[str, int] = {}
    masked = _NUMBER.sub("0", _NAMED.sub("X", _QUOTED.sub('"', body)))
    for shape in _LINES.findall(masked):
        out[shape] = out.get(shape, 0) + 1
    return out


def path_keys(path: str | None) -> list[str]:
    """Names of the folders below the project, and what the file's name ends with."""
    if not path:
        return []
    *folders, name = path.replace("\\", "/").split("/")
    keys = {"d:" + re.sub(r"\d+(?:\.\d+)*", "0", f) for f in folders[1:] if f}
    name = _HASHED.sub(".0", name)
    stem, _, ext = name.partition(".")
    if "." in ext:
        keys.add("e:" + ext)
    if "_" in stem and any(c.isdigit() for c in stem.rsplit("_", 1)[1]):
        keys.add("e:" + stem.rsplit("_", 1)[1] + "." + ext)
    return sorted(keys)


def _hash64(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


class _WordHashes(dict):
    """Hashes of words, kept for at most a million."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES_OF = _WordHashes()


def shingles(body: str):
    """Hashes of the body's distinct word shingles, sorted."""
    import numpy as np

    words = _WORDS.findall(body)
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES_OF.__getitem__, words), dtype=np.uint64, count=len(words))
    x = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(32)))


def signature(body: str):
    """MinHash of one permutation, cut into HASHES bins; an empty bin takes the next that isn't.  None without shingles."""
    import numpy as np

    x = shingles(body)
    if not len(x):
        return None
    bins = (x >> np.uint64(57)).astype(np.int64)  # 128 of them; x is sorted, so each begins with its least
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    held, least = bins[first], (x[first] & np.uint64(0x7FFFFFFF)).astype(np.int32)
    at = np.searchsorted(held, np.arange(HASHES))
    return np.where(at < len(held), least[at % len(held)], ~least[0])


FEATURES = (
    "file_id bigint, project string, path string, sent struct, tool boolean, licensed boolean, minified boolean,"
    " data boolean, attributes string, keys array<string>, shapes array<struct<shape:bigint,times:int>>, sig array<int>"
)


def _features(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    names = [f.split()[0] for f in FEATURES.split(", ")]
    for batch in batches:
        rows, hashes, times, ends, sigs, signed = [], [], [], [0], [], []
        for path, text in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            text = text or ""
            head = head_of(text)
            body = text[len(head) :]
            tool = bool(_NOTICE.search(head)) or (path or "").endswith(".java") and bool(_ANNOTATED.search(text))
            licensed = bool(_LICENCE.search(head))
            attributes = text if (path or "").endswith("/.gitattributes") or path == ".gitattributes" else None
            rows.append((tool, licensed, is_minified(text), is_data(body), attributes, path_keys(path)))
            shapes = shapes_of(body)
            hashes += map(_hash64, shapes)
            times += shapes.values()
            ends.append(len(hashes))
            sig = signature(body)
            signed.append(sig is not None)
            if sig is not None:
                sigs.append(sig)
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string()))
        shapes = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(times, pa.int32())], names=["shape", "times"])
        flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32), pa.int32())
        # an offset that is null makes a null list
        offsets = np.concatenate([[0], np.cumsum(signed)]) * HASHES
        sig = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.array([not x for x in signed] + [False])), flat)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), shapes), sig], names)


def features(files: DataFrame) -> DataFrame:
    """What the text and path of each file say by themselves; one row per file."""
    source = files.select(F.col("file_id").cast("bigint").alias("file_id"), "project", "path", record_order(files).alias("sent"), "content")
    rows = source.mapInArrow(_features, FEATURES.replace("sent struct", "sent " + source.schema["sent"].dataType.simpleString()))
    rest = [c for c in rows.columns if c != "file_id"]
    one = rows.groupBy("file_id").agg(F.max_by(F.struct(*rest), "sent").alias("r"))
    return spill_table(one.select("file_id", "r.*").drop("sent"), "origin-features")


def _mined(marks: DataFrame, key: str, files: int, projects: int, rate: float) -> DataFrame:
    """Keys that enough files of enough projects bear, with enough evidence among them."""
    each = marks.groupBy(key, "project").agg(F.count("*").alias("n"), F.count_if("proof").alias("k"))
    found = each.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("p"))
    return found.where((F.col("n") >= files) & (F.col("p") >= projects) & (F.col("k") >= rate * F.col("n"))).select(key)


def by_shape(f: DataFrame) -> DataFrame:
    """file_id of files made of line shapes that tools leave."""
    of = F.aggregate("shapes", F.lit(0), lambda n, x: n + x["times"])
    lines = f.select("file_id", "project", F.col("tool").alias("proof"), of.alias("of"), F.inline("shapes"))
    # only shapes of files with a notice can tell; the rest need not be counted
    lines = lines.join(lines.where("proof").select("shape").distinct(), "shape", "left_semi")
    told = _mined(lines, "shape", SHAPE_FILES, SHAPE_PROJECTS, SHAPE_RATE)
    hits = lines.select("file_id", "of", "times", "shape").join(told, "shape", "left_semi")
    hits = hits.groupBy("file_id", "of").agg(F.sum("times").alias("n"))
    return hits.where((F.col("n") >= SHAPE_SHARE * F.col("of")) & (F.col("n") >= 3)).select("file_id")


def _shingled(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sets = [shingles(text[len(head_of(text)) :]).astype("<u8").tobytes() for text in ((t or "") for t in batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["class", "shingles"])


def _alike(batches: Iterator) -> Iterator:
    """class of the pairs whose shingles agree to SIMILAR or more."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        keep = []
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["class"])


def by_copy(f: DataFrame, third: DataFrame, files: DataFrame) -> DataFrame:
    """file_id of files that agree with one of the third-party files to SIMILAR or more; third: (file_id)."""
    member = f.where(F.col("sig").isNotNull()).select("file_id", F.xxhash64("sig").alias("class"), "sig")
    one = (F.min("file_id").alias("file_id"), F.any_value("sig").alias("sig"))
    known = spill_table(member.join(third, "file_id", "left_semi").groupBy("class").agg(*one), "origin-known")
    others = member.join(third, "file_id", "left_anti")
    classes = others.groupBy("class").agg(*one)

    def banded(c: DataFrame) -> DataFrame:
        bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda i: F.xxhash64(F.slice("sig", i * ROWS + 1, ROWS), i))
        return c.select("class", F.explode(bands).alias("band"))

    near = spill_table(banded(known).withColumnRenamed("class", "like"), "origin-bands")
    met = spill_table(banded(classes).join(near.select("band"), "band", "left_semi"), "origin-met")
    # shingles of the classes that share a band with a third-party class, and of those
    asked = classes.join(met.select("class").distinct(), "class", "left_semi").select("class", "file_id")
    held = known.join(near.join(met.select("band").distinct(), "band", "left_semi").select(F.col("like").alias("class")).distinct(), "class", "left_semi").select("class", "file_id")
    both = asked.unionByName(held).dropDuplicates(["class"])
    text = files.select(F.col("file_id").cast("bigint").alias("file_id"), "path", "content", "ingested_at").join(both, "file_id")
    text = text.groupBy("class").agg(F.max_by("content", record_order(text)).alias("content"))
    sets = spill_table(text.mapInArrow(_shingled, "class bigint, shingles binary"), "origin-shingles")

    def proven(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sets, "class").join(sets.select(F.col("class").alias("like"), F.col("shingles").alias("other")), "like")
        return p.select("class", "shingles", "other").mapInArrow(_alike, "class bigint").distinct()

    first = met.join(near.groupBy("band").agg(F.min("like").alias("like")), "band").select("class", "like").distinct()
    quick = spill_table(proven(first), "origin-copies")
    rest = met.join(quick, "class", "left_anti").join(near, "band").select("class", "like").distinct().join(first, ["class", "like"], "left_anti")
    return others.join(quick.unionByName(proven(rest)), "class", "left_semi").select("file_id")


# attribute files


def glob_pattern(glob: str) -> tuple[str, bool] | None:
    """The pattern of an attribute file's glob, relative to its folder."""
    glob = glob.strip().strip('"')
    if not glob or glob.startswith(("#", "!")):
        return None
    anchored = "/" in glob.rstrip("/")
    out, i = [], 0
    body = glob.lstrip("/")
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out.append("[" + ("^" if body[i + 1] in "!^" else "") + body[i + 1 + (body[i + 1] in "!^") : end].replace("\\", r"\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + ("" if out and out[-1] == ".*" else "$"), anchored


def attribute_rules(path: str, text: str) -> list[tuple[str, int, str, str, bool]]:
    """(folder, place, glob, pattern, marked) of each line about generated or vendored paths."""
    folder = path.replace("\\", "/").rpartition("/")[0]
    rules = []
    for place, line in enumerate(text.splitlines()):
        parts = line.split()
        if len(parts) < 2 or (pattern := glob_pattern(parts[0])) is None:
            continue
        for attribute in parts[1:]:
            name, _, value = attribute.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored", "generated", "vendored"):
                marked = not attribute.startswith(("-", "!")) and value.lower() not in ("false", "0", "no", "unset")
                rules.append((folder, place, parts[0].strip('"'), pattern[0], marked))
    return rules


def _rules(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        of, rows = [], []
        for k, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            found = attribute_rules(path or "", text or "")
            of += [k] * len(found)
            rows += found
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["project", "folder", "place", "glob", "pattern", "marked"],
        )


def declared_rules(f: DataFrame) -> DataFrame:
    """(project, folder, place, glob, pattern, marked) of the lines of all attribute files."""
    attributes = f.where(F.col("attributes").isNotNull() & F.col("project").isNotNull()).select("project", "path", "attributes")
    return spill_table(attributes.mapInArrow(_rules, "project string, folder string, place int, glob string, pattern string, marked boolean"), "origin-rules")


def matched(f: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, depth, place, marked): the rules that match a file, of the folders above it."""
    steps = F.split(F.translate("path", "\\", "/"), "/")
    above = f.where("path IS NOT NULL AND project IS NOT NULL").select("file_id", "project", steps.alias("steps"))
    above = above.select("file_id", "project", "steps", F.explode(F.sequence(F.lit(0), F.size("steps") - 1)).alias("depth"))
    folder = F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/")
    below = F.array_join(F.slice("steps", F.col("depth") + 1, F.size("steps")), "/")
    hits = above.select("file_id", "project", "depth", folder.alias("folder"), below.alias("below")).join(rules, ["project", "folder"])
    return hits.where(F.rlike("below", F.col("pattern"))).select("file_id", "depth", "place", "marked")


def mined_patterns(f: DataFrame, rules: DataFrame, proof: DataFrame) -> DataFrame:
    """(key): names of folders (d:) and endings (e:) that mean generated or vendored, mined from evidence; proof: (file_id)."""
    marks = f.select("file_id", F.coalesce("project", F.lit("")).alias("project"), F.explode("keys").alias("key"))
    marks = marks.join(proof.withColumn("proof", F.lit(True)), "file_id", "left").select("project", "key", F.coalesce("proof", F.lit(False)).alias("proof"))
    return _mined(marks, "key", PATH_FILES, PATH_PROJECTS, PATH_RATE)


def shared_globs(rules: DataFrame) -> DataFrame:
    """(glob, pattern): globs that several projects declare, and none clears."""
    each = rules.groupBy("glob", "pattern", "project").agg(F.bool_and("marked").alias("marked"))
    return each.groupBy("glob", "pattern").agg(F.count("*").alias("p"), F.bool_and("marked").alias("marked")).where((F.col("p") >= PATH_PROJECTS) & F.col("marked")).select("glob", "pattern")


def resolved(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, (file_id, marked, source) after precedence, and (file_id, reason) of what seeded the miner."""
    f = features(files)
    rules = declared_rules(f)
    said = spill_table(matched(f, rules), "origin-declared")
    order = F.struct("depth", "place")
    marked = said.groupBy("file_id").agg(F.max_by("marked", order).alias("marked")).where("marked").select("file_id")
    text = [f.where(F.col(c)).select("file_id", F.lit(k).alias("reason")) for k, c in (("tool", "tool"), ("third_party", "licensed"), ("minified", "minified"), ("data", "data"))]
    text.append(by_shape(f).select("file_id", F.lit("tool_shape").alias("reason")))
    seen = spill_table(reduce(DataFrame.unionByName, text), "origin-evidence")
    patterns = spill_table(mined_patterns(f, rules, seen.where("reason <> 'tool_shape'").select("file_id").union(marked).distinct()), "origin-patterns")
    # patterns apply to projects that declare nothing
    undeclared = f.join(rules.select("project").distinct(), "project", "left_anti")
    by_key = undeclared.select("file_id", F.explode("keys").alias("key")).join(patterns, "key", "left_semi").select("file_id")
    roots = undeclared.where("path IS NOT NULL AND project IS NOT NULL").select("project", F.element_at(F.split(F.translate("path", "\\", "/"), "/"), 1).alias("folder")).distinct()
    shared = roots.crossJoin(F.broadcast(shared_globs(rules))).select("project", "folder", F.lit(-1).alias("place"), "pattern", F.lit(True).alias("marked"))
    by_glob = matched(undeclared, shared).select("file_id")
    placed = spill_table(by_key.unionByName(by_glob).distinct(), "origin-paths")
    third = seen.where("reason = 'third_party'").select("file_id").union(placed).distinct()
    copies = spill_table(by_copy(f, third, files), "origin-copied")
    seeds = seen.unionByName(copies.select("file_id", F.lit("copy").alias("reason")))
    hits = (
        said.select("file_id", F.lit("declared").alias("source"), F.lit(2).alias("rank"), "depth", "place", "marked")
        .unionByName(placed.select("file_id", F.lit("pattern").alias("source"), F.lit(1).alias("rank"), F.lit(1).alias("depth"), F.lit(-1).alias("place"), F.lit(True).alias("marked")))
        .unionByName(seeds.select("file_id", F.lit("line").alias("source"), F.lit(1).alias("rank"), F.lit(1 << 20).alias("depth"), F.lit(0).alias("place"), F.lit(True).alias("marked")))
    )
    last = hits.groupBy("file_id").agg(F.max_by(F.struct("marked", "source"), F.struct("rank", "depth", "place")).alias("r"))
    return f, last.select("file_id", "r.marked", "r.source"), seeds.unionByName(placed.select("file_id", F.lit("path").alias("reason"))).unionByName(marked.select("file_id", F.lit("declared").alias("reason")))


def origins(files: DataFrame) -> DataFrame:
    """(file_id, reason) of files not written by hand in their project, with all that speaks for it."""
    _, last, why = resolved(files)
    return why.distinct().join(last.where("marked").select("file_id"), "file_id", "left_semi")


def not_by_hand(files: DataFrame) -> DataFrame:
    """file_id of all files that the rules mark."""
    return resolved(files)[1].where("marked").select("file_id")


def rules_of(files: DataFrame) -> DataFrame:
    """(glob, source, n_files): the lines that mark files, declared and mined."""
    f = features(files)
    rules = declared_rules(f)
    proof = f.where(F.col("tool") | F.col("licensed") | F.col("minified") | F.col("data")).select("file_id")
    said = matched(f, rules).groupBy("file_id").agg(F.max_by("marked", F.struct("depth", "place")).alias("marked")).where("marked").select("file_id")
    keys = mined_patterns(f, rules, proof.union(said).distinct())
    used = f.select(F.explode("keys").alias("key")).join(keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_files"))
    name = F.substr("key", F.lit(3))
    glob = F.when(F.startswith("key", F.lit("d:")), F.concat(F.lit("**/"), name, F.lit("/**"))).otherwise(F.concat(F.lit("*."), name))
    told = rules.where("marked").groupBy("glob").agg(F.count("*").alias("n_files")).select("glob", F.lit("declared").alias("source"), "n_files")
    return used.select(glob.alias("glob"), F.lit("mined").alias("source"), "n_files").unionByName(told)
