"""Sentences of texts in many languages and scripts (problem 10).

A pushdown automaton reads each text once.  Lines group into blocks: headings, fenced blocks, list
items and paragraphs; within a block the automaton stops only at terminators, quotation marks and
brackets.  Its one stack holds the levels of the list it is in and above them the open quotations
and brackets of the block; a terminator ends a sentence only while no mark is open, which is known
when the block ends.  Time grows with the length of a text, whatever marks it holds.  A full stop
is looked up backwards in a trie of abbreviations, in which some never end a sentence and some end
one if the next word can begin one.  Scripts without spaces end sentences at their own
terminators, Greek also at its question mark, Thai at white space.  Opening marks that are not
closed within their block are ordinary characters.

Offsets are code points from 0, the end is exclusive.  Cases: null, empty and blank texts have no
sentence.  Repeated rows come out once.  Texts of any length are read whole.  Other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that stand before the word or number they belong to.
NEVER = """
dr mr mrs ms prof st sr jr rev gen col capt lt hon fig figs sec secs eq eqs no nos vol vols ch chap p pp ed eds
vs v e.g eg i.e ie cf approx est dept ref refs resp incl excl art par app tab
jan feb mar apr jun jul aug sep sept oct nov dec
ca z. b z.b d. h d.h bzw vgl nr abb abschn kap bd hrsg sog evtl ggf inkl zzgl fr hr hrn str tel s. o s.o u. a u.a o. ä
i. d. r bspw dt engl geb gest jh mio mrd
m mm mme mlle me mgr p. ex p.ex env sect chap n° av apr. j.-c
sra srta srta ud uds dra d dña núm pág págs secc aprox p. ej p.ej ej vol cap
см рис разд стр гл ок т. е т.е т. н т. к напр г ул им тыс млн млрд ср
βλ σχ ενότ σελ κεφ περ π.χ π. χ δηλ αρ κ κα
डॉ श्री सुश्री प्रो पृ सं
د أ م ص
"""
# Abbreviations that also stand at the end of a sentence.
MAYBE = """
etc inc ltd co corp al ff a.m p.m am pm u.s u.k e.u min max hrs
usw u. ä u.ä usf etc u. s. w
etc ee. uu
и т. д и т. п и др т. д т. п т.д т.п др
κ.λπ κ.ά κτλ κ. λπ
"""
#: Words that continue a sentence behind a quotation, for scripts without case.
JA_AFTER = ("と", "って", "を", "に", "は", "が", "も", "の", "で", "から", "まで", "や", "へ", "など")
ZH_AFTER = ("然后", "并", "而", "就", "但", "接着", "随后", "便", "的", "地", "得", "等", "来", "之", "还", "也")
#: What follows a day in a date.
MONTHS = tuple(
    "jan feb mär mar apr mai may jun jul aug sep okt oct nov dez dec januar februar märz april juni juli august"
    " september oktober november dezember".split()
)

CLOSE = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉"}
QUOTES = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "‹": "›", '"': '"', "`": "`"}
CLOSERS = set(CLOSE.values()) | set(QUOTES.values()) | {"”", "’", "'"}
FULL = "。！？．｡"  # end a sentence wherever they stand
ENDS = ".!?…‽؟।॥۔።"
_STOP = re.compile(r"[.!?…‽؟।॥۔።。！？．｡;;]+|[()\[\]{}（）［］【】《》〈〉«»“”„「」『』‹›\"`]|(?<=[฀-๿])\s|\s(?=[฀-๿])")
_FENCE = re.compile(r"[ \t]{0,8}(```+|~~~+)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_BULLET = re.compile(r"[ \t]*(?:[-*+•‣]|\(?\d{1,9}[.)]|[a-z][)])[ \t]+(?=\S)")
_ORDERED = re.compile(r"[ \t]*\(?(\d{1,9})[.)]")
_CODE = re.compile(r"[\w$]+(?:\.[\w$]+)*(?:\(\))?")
#: A unit behind a number is no abbreviation.
_UNIT = re.compile(r"\d[ \xa0][smhg]\Z")
_SPACE = re.compile(r"\s*")
_LINE = re.compile(r"[^\n\r\u2028\u2029\x85]*(?:\r\n|[\n\r\u2028\u2029\x85]|$)")


def _trie() -> dict:
    root: dict = {}
    for words, kind in ((MAYBE, "maybe"), (NEVER, "never")):
        for line in words.strip().split("\n"):
            for word in _entries(line):
                _insert(root, word, kind)
                for i, c in enumerate(word):
                    if c == "." and word[i + 1 : i + 2] == " ":  # a full stop between the parts
                        _insert(root, word[:i], "never")
    return root


def _insert(root: dict, word: str, kind: str) -> None:
    for c in reversed(word):
        root = root.setdefault(c, {})
    root.setdefault("", kind)


def _entries(line: str) -> list[str]:
    """The abbreviations of a line; a part that ends in a full stop goes with the next."""
    out, held = [], ""
    for part in line.split():
        held += part
        if part.endswith("."):
            held += " "
        elif part == "и":
            held = ""
        else:
            out.append(held)
            held = ""
    return out


_TRIE = _trie()


def abbreviation(text: str, dot: int, begin: int) -> str | None:
    """Class of the longest abbreviation that ends before the full stop at ``dot``."""
    at, kind, i = _TRIE, None, dot - 1
    while i >= begin:
        c = text[i]
        if c.isspace():
            c = " "
            while i > begin and text[i - 1].isspace():
                i -= 1
        at = at.get(c.lower() if c != " " else c)
        if at is None:
            break
        if "" in at and (i == begin or not (text[i - 1].isalnum() or text[i - 1] in "_.")):
            kind = at[""]
        i -= 1
    return kind


class _Automaton:
    """The pushdown automaton: one stack of list levels and, above them, of open quotations and brackets."""

    def __init__(self, text: str):
        self.text = text
        self.levels: list[tuple[int, bool]] = []  # bottom of the stack: indent and kind of each list level
        self.marks: list[tuple[str, int]] = []  # top of the stack: character and place
        self.by_closer: dict[str, list[int]] = {}  # heights of the marks that a character closes
        self.start: int | None = None  # of the open block
        self.end = 0
        self.stops: list = []
        self.pairs: dict[int, int] = {}

    def open(self, start: int, end: int) -> None:
        self.start, self.end = start, end

    def close(self, whole: bool = False) -> Iterator[tuple[int, int]]:
        """The sentences of the block that ends here; marks left open in it are ordinary characters."""
        if self.start is not None:
            yield from [(self.start, self.end)] if whole else _cut(self.text, self.start, self.end, self.stops, self.pairs)
        self.start, self.stops, self.pairs, self.marks, self.by_closer = None, [], {}, [], {}

    def push(self, c: str, i: int) -> None:
        for closer in _closers(c):
            self.by_closer.setdefault(closer, []).append(len(self.marks))
        self.marks.append((c, i))

    def pop_to(self, height: int) -> None:
        while len(self.marks) > height:
            c, _ = self.marks.pop()
            for closer in _closers(c):
                if (held := self.by_closer[closer]) and held[-1] == len(self.marks):
                    held.pop()

    def read(self, m: re.Match) -> None:
        """One terminator, quotation mark, bracket or white space of Thai."""
        self.stops.append(m)
        c, i, text = m.group(), m.start(), self.text
        if len(c) != 1:
            return
        held = self.by_closer.get(c)
        top = held[-1] if held else None
        if c == '"' and top is not None and (i == self.start or text[i - 1].isspace() or text[i - 1] in "([{（「"):
            # behind white space it opens, unless one is open and nothing follows it
            if i + 1 < len(text) and not text[i + 1].isspace():
                top = None
                held.clear()
        if top is not None:
            self.pairs[self.marks[top][1]] = i
            self.pop_to(top)
        elif c in CLOSE or c in QUOTES:
            self.push(c, i)

    def item(self, line: str) -> bool:
        """Is the line an item of a list?  A number begins a list only as 1 or where no paragraph is open; it goes on with an open level."""
        mark = _BULLET.match(line)
        if mark is None:
            return False
        ordered = _ORDERED.match(line)
        indent = len(line) - len(line.lstrip(" \t"))
        if ordered and ordered.group(1) != "1" and self.start is not None and not self.levels:
            return False
        while self.levels and self.levels[-1][0] > indent:
            self.levels.pop()
        if not self.levels or self.levels[-1][0] < indent:
            self.levels.append((indent, bool(ordered)))
        else:
            self.levels[-1] = (indent, bool(ordered))
        return True

    def run(self) -> Iterator[tuple[int, int]]:
        """(start, end) of all units, not trimmed."""
        text, pos, fence = self.text, 0, None
        stops = _STOP.finditer(text)
        stop = next(stops, None)
        while pos < len(text):
            behind = _LINE.match(text, pos).end()
            line = text[pos:behind]
            blank = not line.strip()
            body = behind  # where marks and terminators count
            if fence is not None:
                self.end = behind
                if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                    yield from self.close(True)
                    fence = None
            elif blank:
                yield from self.close()
                self.levels.clear()
            elif f := _FENCE.match(line):
                yield from self.close()
                self.levels.clear()
                self.open(pos, behind)
                fence = f.group(1)
            elif _HEADING.match(line):
                yield from self.close()
                self.levels.clear()
                self.open(pos, behind)
                yield from self.close(True)
            elif self.item(line):
                yield from self.close()
                self.open(pos, behind)
                body = pos + _BULLET.match(line).end()
            else:
                if self.start is None:
                    self.open(pos, behind)
                self.end = body = behind
                body = pos
            while stop is not None and stop.start() < behind:
                if stop.start() >= body and self.start is not None and fence is None:
                    self.read(stop)
                stop = next(stops, None)
            pos = behind
        yield from self.close(fence is not None)


def _closers(c: str) -> str:
    return "“”" if c == "„" else CLOSE.get(c) or QUOTES[c]


def _codelike(word: str) -> bool:
    return (
        "_" in word or "(" in word or "." in word or any(c.isdigit() for c in word)
        or (word[:1].islower() and any(c.isupper() for c in word[1:]))
    )


def _begins(text: str, i: int, end: int) -> bool:
    """Can what stands at i begin a sentence?"""
    if i >= end:
        return True
    c = text[i]
    if c.islower():
        word = _CODE.match(text, i)
        return word is not None and _codelike(word.group())
    return c not in ",;:-–—)]}%،、，"


def _after_full_stop(text: str, i: int, dots: str, begin: int, nxt: int, end: int) -> bool:
    """Does the full stop at i end a sentence, given what begins at nxt?"""
    if nxt >= end:
        return True
    if len(dots) > 1:
        return _begins(text, nxt, end)
    kind = abbreviation(text, i, begin)
    if kind == "never" and not _UNIT.search(text, max(begin, i - 4), i):
        return False
    if kind == "maybe":
        return text[nxt] != "(" and not text[nxt].isdigit() and _begins(text, nxt, end)
    k = i
    while k > begin and text[k - 1].isalnum():
        k -= 1
    word = text[k:i]
    if kind != "never" and len(word) == 1 and word.isalpha() and (k == begin or text[k - 1].isspace() or text[k - 1] in ".(") and word < "\u0e00":
        return False  # an initial
    if word.isdigit() and len(word) <= 2 and (k == begin or text[k - 1].isspace()):
        following = re.match(r"\w+", text[nxt:nxt + 12])
        if following and following.group().lower() in MONTHS:
            return False
    return _begins(text, nxt, end)


def _after_close(text: str, opener: str, opened: int, sentence: int, p: int, nxt: int, end: int) -> bool:
    """Does a sentence end behind a quotation or bracket with a terminator inside, at p?"""
    at_start = opened == sentence
    if opener in CLOSE:
        return at_start and (nxt >= end or nxt > p or text[nxt] not in ",;:.，、；：—–-")
    if nxt >= end:
        return True
    c = text[nxt]
    if c in QUOTES or c in CLOSE:
        return True
    if nxt == p:  # no white space between
        if opener in "「『":
            return c.isalpha() and not text.startswith(JA_AFTER, nxt)
        if opener == "“" and "一" <= c <= "鿿":
            return not at_start and not text.startswith(ZH_AFTER, nxt)
        return False
    if c.isalpha() and not c.isupper() and not c.islower() and at_start:
        return False
    return _begins(text, nxt, end)


_GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff]")


def _cut(text: str, begin: int, end: int, stops: list, pairs: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Sentences of a paragraph or list item, not trimmed."""
    mark = _BULLET.match(text, begin, end)
    sentence = mark.end() if mark else begin  # where the sentence's own text starts
    first = begin  # where its unit starts
    skip = sentence
    greek, counted = 0, sentence  # Greek letters of the sentence up to a place
    for m in stops:
        i, p, c = m.start(), m.end(), m.group()
        if i < skip:
            continue
        ended = False
        if c.isspace():
            nxt = _SPACE.match(text, i, end).end()
            ended = nxt < end
            p = i
        elif i in pairs:
            shut = pairs[i]
            inner = shut - 1
            while inner > i and (text[inner] in CLOSERS or text[inner].isspace()):
                inner -= 1
            p = shut + 1
            skip = p
            if text[inner] in ENDS or text[inner] in FULL:
                while p < end and text[p] in CLOSERS and p not in pairs and text[p] not in "\"'`":
                    p += 1
                nxt = _SPACE.match(text, p, end).end()
                ended = _after_close(text, c, i, sentence, p, nxt, end)
        elif c[0] in ENDS or c[0] in FULL or c[0] in ";\u037e":
            if c[0] == ";":
                greek += len(_GREEK.findall(text, counted, i))
                counted = i
                if greek * 3 <= i - sentence:
                    continue
            while p < end and (text[p] in CLOSERS and p not in pairs and text[p] not in "'’`"):
                p += 1
            nxt = _SPACE.match(text, p, end).end()
            if any(x in FULL for x in c):
                ended = nxt >= end or text[nxt] not in "，、；：,"
            elif any(x in "।॥۔።" for x in c):
                ended = True
            elif nxt == p and nxt < end:
                ended = c[-1] in "!?" and "぀" <= text[nxt] <= "鿿"
            elif set(c) <= {"."}:
                ended = _after_full_stop(text, i, c, sentence, nxt, end)
            else:
                ended = _begins(text, nxt, end)
        if ended:
            yield first, p
            sentence = first = _SPACE.match(text, p, end).end()
            skip = max(skip, sentence)
            greek, counted = 0, sentence
    if first < end:
        yield first, end


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text."""
    if not text:
        return []
    out = []
    for a, b in _Automaton(text).run():
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _run(batches):
    import pyarrow as pa

    for batch in batches:
        ids, of, starts, ends = batch.column(0), [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            found = sentences(text)
            of += [k] * len(found)
            starts += [a for a, _ in found]
            ends += [b for _, b in found]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(of, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            ["doc_id", "start_pos", "end_pos"],
        )


def sentence_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence of documents.text."""
    some = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return some.mapInArrow(_run, "doc_id bigint, start_pos int, end_pos int").distinct()
