"""Lexers of the ECMAScript family and Java.

A lexer turns a text into one character per token (its kind), the tokens' offsets, and the offsets
of documentation comments.  It is aware of strings, comments, regular expressions, templates and
JSX, so that brackets inside them never count.  ``Broken`` is raised where a text has no tokens.
"""

from __future__ import annotations

import re


class Broken(Exception):
    """The text isn't valid; args: message, offset."""


# Kinds.  Punctuation stands for itself; the rest:
IDENT, NUMBER, STRING, TEMPLATE, REGEX, PRIVATE = "i", "n", "s", "t", "r", "#"
ASSIGN, BINARY, INCREMENT, ARROW, SPREAD, OPTIONAL, REFERENCE = "A", "b", "U", "F", "E", "Q", "M"
LOGICAL, COALESCE, POWER = "l", "o", "w"
TEMPLATE_OPEN, TEMPLATE_CLOSE, SUBST_OPEN, SUBST_CLOSE = "\x11", "\x12", "\x13", "\x14"
JSX_OPEN, JSX_CLOSE, CHILD_OPEN, CHILD_CLOSE = "\x15", "\x16", "\x17", "\x18"
VALUE_OPEN, VALUE_CLOSE, ALL_OPEN, ALL_CLOSE = "\x19", "\x1a", "\x1b", "\x1c"
NEWLINE, END = "\n", "\x00"
PAIRS = {"(": ")", "[": "]", "{": "}", TEMPLATE_OPEN: TEMPLATE_CLOSE, SUBST_OPEN: SUBST_CLOSE, JSX_OPEN: JSX_CLOSE,
         CHILD_OPEN: CHILD_CLOSE, VALUE_OPEN: VALUE_CLOSE, ALL_OPEN: ALL_CLOSE}


def _kinds(words: str, at: int) -> dict[str, str]:
    return {w: chr(at + i) for i, w in enumerate(words.split())}


# Words of the languages.  Contextual ones are names as well.
JS_RESERVED = _kinds(
    "break case catch class const continue debugger default delete do else enum export extends false finally for"
    " function if import in instanceof new null return super switch this throw true try typeof var void while with", 0x100
)
JS_CONTEXTUAL = _kinds(
    "async await yield let of get set static as from type interface namespace module declare abstract readonly public"
    " private protected override keyof is infer asserts unique satisfies implements accessor global out", 0x180
)
JAVA_RESERVED = _kinds(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final"
    " finally float for goto if implements import instanceof int interface long native new package private protected"
    " public return short static strictfp super switch synchronized this throw throws transient try void volatile while"
    " true false null _", 0x200
)
JAVA_CONTEXTUAL = _kinds("var record sealed permits yield", 0x280)
JS_WORDS = JS_RESERVED | JS_CONTEXTUAL
JAVA_WORDS = JAVA_RESERVED | JAVA_CONTEXTUAL

_OPERATORS = {
    **dict.fromkeys("+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split(), ASSIGN),
    **dict.fromkeys("=== !== == != <= <<".split(), BINARY), "&&": LOGICAL, "||": LOGICAL, "??": COALESCE, "**": POWER,
    "++": INCREMENT, "--": INCREMENT, "=>": ARROW, "...": SPREAD, "?.": OPTIONAL,
}

_JS = re.compile(
    r"""[\s\ufeff]*(?:
    (?P<w>(?:[^\W\d]|\$)[\w$\u200c\u200d]*)
  | (?P<p>[(){}\[\];,~:@])
  | (?P<s>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
  | (?P<n>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:(?:0|[1-9][\d_]*)(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)n?(?![\w$]))
  | (?P<c>//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)
  | (?P<t>`)
  | (?P<o>\.\.\.|\?\.(?!\d)|=>|[=!]==?|\*\*=?|\+\+|--|<<=?|<=|&&=?|\|\|=?|\?\?=?|[-+*%&|^]=|/=(?!\S*/)|[-+*/%&|^<>=!?.])
  | (?P<h>\#[A-Za-z_$][\w$]*)
  | (?P<x>\Z)
    )""", re.X
).match
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*").match
#: Escapes with digits of their own must be whole.
_JS_ESCAPES = re.compile(r"(?:[^\\]|\\(?:u[\da-fA-F]{4}|u\{0*(?:10|[\da-fA-F])?[\da-fA-F]{1,4}\}|x[\da-fA-F]{2}|0(?!\d)|[^ux\d]))*\Z").match
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match
_TAG = re.compile(r"\s*([A-Za-z_$][\w$]*(?:[-.:][A-Za-z_$][\w$]*)*|(?=>))").match
_ATTRIBUTE = re.compile(r"""\s*(?:(?P<end>/\s*>|>)|(?P<spread>\{\s*(?=\.\.\.))|(?P<name>[A-Za-z_$][\w$-]*(?::[\w$-]+)?)(?:\s*=\s*(?P<value>"[^"]*"|'[^']*'|\{|<))?)|(?P<comment>\s*(?://[^\n]*|/\*[\s\S]*?\*/))""").match
_JSX_TEXT = re.compile(r"[^<{>}]*").match
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|>\s*\()").match
#: Kinds behind which a slash divides and a less-than compares.
_OPERANDS = frozenset(
    [IDENT, NUMBER, STRING, TEMPLATE, REGEX, PRIVATE, ")", "]", "}", TEMPLATE_CLOSE, JSX_CLOSE, INCREMENT]
    + [JS_RESERVED[w] for w in "this super null true false".split()]
    + [k for w, k in JS_CONTEXTUAL.items() if w not in ("await", "yield", "of")]
)
#: A line break between one of the first and one of the second may end a statement.
_BEFORE = _OPERANDS | {">"} | {JS_WORDS[w] for w in "break continue return yield debugger await of void".split()}
_GO_ON = frozenset(JS_RESERVED[w] for w in "instanceof in extends".split()) | {JS_CONTEXTUAL["of"]}
_AFTER = (
    frozenset([IDENT, NUMBER, STRING, REGEX, PRIVATE, "{", "!", "~", "@", INCREMENT, JSX_OPEN]) | frozenset(JS_WORDS.values())
) - _GO_ON


class Tokens:
    """kinds and starts of the tokens; docs: (start, end) of comments that begin with two stars; jsx: was any met?"""

    __slots__ = ("kinds", "starts", "docs", "jsx")

    def __init__(self):
        self.jsx = False
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.docs: list[tuple[int, int]] = []


def lex_script(text: str, jsx: bool, out: Tokens | None = None) -> Tokens:
    """Tokens of an ECMAScript or TypeScript text, with line breaks that may end a statement; those before an error stay in ``out``."""
    out = out or Tokens()
    pos = 0
    if text.startswith("#!"):
        pos = (text.find("\n") + 1) or len(text)
    end = _script(text, pos, jsx, out, False)
    if end != len(text):
        raise Broken("unexpected end", end)
    return out


def _script(text: str, pos: int, jsx: bool, out: Tokens, inner: bool) -> int:
    """Lexes up to the end, or, if inner, up to the brace that closes more than was opened."""
    kinds, starts, words, operators = out.kinds, out.starts, JS_WORDS, _OPERATORS
    add, mark = kinds.append, starts.append
    prev = kinds[-1] if kinds else END
    depth = 0
    last = pos  # end of the token before
    while True:
        m = _JS(text, pos)
        if m is None:
            raise Broken("no token", pos)
        group = m.lastgroup
        start, pos_ = m.start(group), m.end()
        if group == "c":
            if text.startswith("/**", start) and pos_ - start > 4:
                out.docs.append((start, pos_))
            pos = pos_
            continue
        if group == "w":
            word = m[group]
            k = IDENT if prev == "." or prev == OPTIONAL else words.get(word, IDENT)
        elif group == "p":
            k = m[group]
        elif group == "o":
            op = m[group]
            if op[0] == "/" and prev not in _OPERANDS:
                r = _REGEX(text, start)
                if r is None:
                    raise Broken("no token", start)
                k, pos_ = REGEX, r.end()
            elif op == "<" and jsx and prev not in _OPERANDS and not _GENERIC(text, start) and text[start + 1 : start + 2].strip():
                if prev in _BEFORE and "\n" in text[last:start]:
                    add(NEWLINE)
                    mark(start)
                out.jsx = True
                pos = last = _jsx(text, start, out)
                prev = JSX_CLOSE
                continue
            else:
                k = operators.get(op, op)
        elif group == "s":
            k = STRING
            if "\\" in m[group] and not _JS_ESCAPES(m[group]):
                raise Broken("escape in a string", start)
        elif group == "n":
            k = NUMBER
            if text[start] == "0" and pos_ - start == 1 and text[pos_ : pos_ + 1].isdigit():
                raise Broken("octal number", start)
        elif group == "t":
            k = None
        elif group == "h":
            k = PRIVATE
        else:
            if inner:
                raise Broken("unexpected end", start)
            return len(text)
        if prev in _BEFORE and (k in _AFTER) and ("\n" in text[last:start] or "\r" in text[last:start] or "\u2028" in text[last:start]):
            add(NEWLINE)
            mark(start)
        if k is None:
            pos = last = _template(text, start, jsx, out)
            prev = kinds[-1]
            continue
        if inner:
            if k == "{":
                depth += 1
            elif k == "}":
                if not depth:
                    return pos_
                depth -= 1
        add(k)
        mark(start)
        prev = k
        pos = last = pos_


def _template(text: str, start: int, jsx: bool, out: Tokens) -> int:
    pos = _CHUNK(text, start + 1).end()
    if text.startswith("`", pos):
        out.kinds.append(TEMPLATE)
        out.starts.append(start)
        return pos + 1
    _emit(out, TEMPLATE_OPEN, start)
    while text.startswith("${", pos):
        _emit(out, SUBST_OPEN, pos)
        pos = _script(text, pos + 2, jsx, out, True)
        _emit(out, SUBST_CLOSE, pos - 1)
        pos = _CHUNK(text, pos).end()
    if not text.startswith("`", pos):
        raise Broken("template without end", start)
    _emit(out, TEMPLATE_CLOSE, pos)
    return pos + 1


def _emit(out: Tokens, kind: str, at: int) -> None:
    out.kinds.append(kind)
    out.starts.append(at)


def _jsx(text: str, start: int, out: Tokens) -> int:
    """Lexes the JSX element that starts with the less-than at ``start``."""
    _emit(out, JSX_OPEN, start)
    open_: list[str] = []
    pos = start
    while True:
        # at a less-than
        if text.startswith("/", pos + 1) or re.match(r"<\s*/", text[pos : pos + 8]):
            m = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(text, pos)
            if m is None or not open_ or open_.pop() != m.group(1):
                raise Broken("closing tag", pos)
            pos = m.end()
        else:
            tag = _TAG(text, pos + 1)
            if tag is None:
                raise Broken("tag", pos)
            name, pos = tag.group(1), tag.end()
            while True:
                a = _ATTRIBUTE(text, pos)
                if a is None:
                    raise Broken("attribute", pos)
                pos = a.end()
                if a["comment"]:
                    continue
                if a["end"]:
                    if a["end"] == ">":
                        open_.append(name)
                    elif not name:
                        raise Broken("tag", pos)
                    break
                if a["spread"]:
                    _emit(out, ALL_OPEN, pos)
                    pos = _script(text, pos, True, out, True)
                    _emit(out, ALL_CLOSE, pos - 1)
                elif a["value"] == "{":
                    _emit(out, VALUE_OPEN, pos)
                    pos = _script(text, pos, True, out, True)
                    _emit(out, VALUE_CLOSE, pos - 1)
                elif a["value"] == "<":
                    pos = _jsx(text, pos - 1, out)
                elif not name:
                    raise Broken("attribute of a fragment", pos)
        while open_:
            pos = _JSX_TEXT(text, pos).end()
            if text.startswith("<", pos):
                break
            if not text.startswith("{", pos):
                raise Broken("text in an element", pos)
            _emit(out, CHILD_OPEN, pos)
            pos = _script(text, pos + 1, True, out, True)
            _emit(out, CHILD_CLOSE, pos - 1)
        if not open_:
            _emit(out, JSX_CLOSE, pos - 1)
            return pos


_JAVA = re.compile(
    r"""\s*(?:
    (?P<w>(?:[^\W\d]|\$)[\w$]*)
  | (?P<p>[(){}\[\];,~@])
  | (?P<s>\"\"\"[ \t\f]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|"(?:[^"\\\n\r]|\\[^\n\r])*"|'(?:[^'\\\n\r]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|[^\n\r]))')
  | (?P<n>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))
  | (?P<c>//[^\n\r]*|/\*[\s\S]*?\*/)
  | (?P<o>\.\.\.|->|::|[=!]=|\+\+|--|<<=?|<=|&&|\|\||[-+*%&|^/]=|[-+*/%&|^<>=!?:.])
  | (?P<x>\x1a?\Z)
    )""", re.X
).match
_JAVA_OPERATORS = {
    **dict.fromkeys("+= -= *= /= %= <<= &= |= ^=".split(), ASSIGN), **dict.fromkeys("== != <= << && ||".split(), BINARY),
    "++": INCREMENT, "--": INCREMENT, "->": ARROW, "...": SPREAD, "::": REFERENCE,
}


#: A whole number that begins with 0 has octal digits only.
_OCTAL = re.compile(r"0[\d_]*[89][\d_]*[lL]?\Z").match
#: What may stand behind a backslash in Java.
_ESCAPES = re.compile(r"(?:[^\\]|\\(?:[btnfrs\"'\\0-7\n]|\r\n?|u+[\da-fA-F]{4}))*\Z").match


def lex_java(text: str) -> Tokens:
    """Tokens of a Java text."""
    out = Tokens()
    add, mark, words, operators = out.kinds.append, out.starts.append, JAVA_WORDS, _JAVA_OPERATORS
    pos = 1 if text.startswith("\ufeff") else 0
    while True:
        m = _JAVA(text, pos)
        if m is None:
            raise Broken("no token", pos)
        group = m.lastgroup
        start = m.start(group)
        pos = m.end()
        if group == "w":
            add(words.get(m[group], IDENT))
        elif group == "p":
            add(m[group])
        elif group == "n" and _OCTAL(m[group]):
            raise Broken("octal number", start)
        elif group == "o":
            op = m[group]
            add(operators.get(op, op))
        elif group == "c":
            if text.startswith("/**", start) and pos - start > 4:
                out.docs.append((start, pos))
            continue
        elif group == "s":
            if "\\" in m[group] and not _ESCAPES(m[group]):
                raise Broken("escape in a string", start)
            add(STRING)
        elif group == "n":
            add(NUMBER)
        else:
            return out
        mark(start)


class Lexed:
    """The tokens of one text at a time, lexed once for all dialects that read it alike."""

    def __init__(self):
        self.text: str | None = None
        self.found: dict = {}

    def of(self, text: str, groups: Groups, jsx: bool) -> tuple[Tokens, str]:
        """Tokens and the flat kinds of the whole text; raises Broken."""
        if text is not self.text:
            self.text, self.found = text, {}
        # what is read without meeting JSX is the same with it and without
        for way in (True, jsx):
            if jsx in self.found:
                break
            tokens = Tokens()
            try:
                got = lex_script(text, way, tokens), groups.tree(tokens.kinds)
            except Broken as e:
                got = e
            self.found[way] = got
            if not tokens.jsx:
                self.found[False] = got
        got = self.found[jsx]
        if isinstance(got, Broken):
            raise got
        return got


class Groups:
    """Interned bracket groups: equal groups, nested ones included, get one number.

    A group is its opening bracket and its flat kinds, in which each nested group is one character
    of the supplementary planes.  What a grammar says about a group is thus found once for all
    places where it stands.
    """

    BASE = 0x10000

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, str] = {}
        self.flat: list[str] = []
        self.verdicts: dict = {}

    def tree(self, kinds: list[str]) -> str:
        """The flat kinds of the whole text."""
        if len(self.flat) > self.most:
            self.clear()
        stack: list[list[str]] = []
        now: list[str] = []
        ids, flat, pairs = self.ids, self.flat, PAIRS
        closers = _CLOSERS
        for k in kinds:
            if k in pairs:
                stack.append(now)
                now = [k]
            elif k in closers:
                if not stack or pairs[now[0]] != k:
                    raise Broken("closing bracket")
                key = "".join(now)
                if key[0] in "([":
                    key = key.replace(NEWLINE, "")
                c = ids.get(key)
                if c is None:
                    ids[key] = c = chr(self.BASE + len(flat))
                    flat.append(key)
                now = stack.pop()
                now.append(c)
            else:
                now.append(k)
        if stack:
            raise Broken("bracket without end")
        return "".join(now)

    def opener(self, c: str) -> str:
        return self.flat[ord(c) - self.BASE][0]

    def content(self, c: str) -> str:
        return self.flat[ord(c) - self.BASE][1:]


_CLOSERS = frozenset(PAIRS.values())
