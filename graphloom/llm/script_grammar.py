"""Grammar of ECMAScript modules, JSX and TypeScript over interned bracket groups.

``Script`` answers whether a text is valid.  It descends recursively over the flat kinds of one
bracket group at a time; a nested group is one symbol, asked for a *role* (arguments, parameters,
block, object, ...) by the grammar around it.  Answers are kept per group and role.
"""

from __future__ import annotations

import re

from .lexers import (
    ALL_OPEN, ARROW, ASSIGN, BINARY, CHILD_OPEN, COALESCE, END, IDENT, INCREMENT, JS_CONTEXTUAL, JS_RESERVED, JS_WORDS, JSX_OPEN,
    LOGICAL, NEWLINE, NUMBER, OPTIONAL, POWER, PRIVATE, REGEX, SPREAD, STRING, SUBST_OPEN, TEMPLATE, TEMPLATE_OPEN, VALUE_OPEN, Broken,
    Groups, Lexed, Tokens,
)

W = JS_WORDS
NAMES = frozenset([IDENT, *JS_CONTEXTUAL.values()])
WORDS = frozenset([IDENT, *JS_WORDS.values()])
KEYS = WORDS | {STRING, NUMBER}
PREFIX = frozenset(["!", "~", "+", "-", INCREMENT, *(W[w] for w in ("typeof", "void", "delete", "await"))])
SIGNS = frozenset(["!", "~", "+", "-", *(W[w] for w in ("typeof", "void", "delete"))])
INFIX = frozenset([BINARY, LOGICAL, COALESCE, POWER, "+", "-", "*", "/", "%", "&", "|", "^", "<", W["instanceof"], W["in"]])
LITERALS = frozenset([NUMBER, STRING, TEMPLATE, REGEX, *(W[w] for w in ("this", "super", "null", "true", "false"))])
STOPS = frozenset([";", NEWLINE, END])
MODIFIERS = frozenset(W[w] for w in "public private protected readonly abstract override declare static accessor".split())
TYPE_WORDS = frozenset(W[w] for w in "void null this true false".split())
AS = frozenset((W["as"], W["satisfies"]))


_PACKAGE = re.compile(r"(?:\s|//[^\n]*\n|/\*[\s\S]*?\*/)*+package[ \t]+[A-Za-z_$]").match


class Script:
    """One dialect: with or without TypeScript, with or without JSX."""

    def __init__(self, groups: Groups, types: bool, jsx: bool, lexed: Lexed | None = None):
        self.groups, self.types, self.jsx, self.lexed = groups, types, jsx, lexed or Lexed()
        self.dialect = f"{types:d}{jsx:d}"

    def check(self, text: str) -> None:
        """Raises Broken unless the text is a valid module."""
        self.parse(text)

    def parse(self, text: str) -> Tokens:
        """The tokens of a valid module."""
        if _PACKAGE(text):  # two names in a row begin no statement, whatever follows
            raise Broken("unexpected token", 0)
        tokens, flat = self.lexed.of(text, self.groups, self.jsx)
        _Level(self, flat).run("module")
        return tokens

    def valid(self, group: str, role: str) -> bool:
        verdicts = self.groups.verdicts
        key = (group, role, self.dialect)
        v = verdicts.get(key)
        if v is None:
            try:
                _Level(self, self.groups.content(group)).run(role)
                v = True
            except Broken:
                v = False
            verdicts[key] = v
        return v


class _Level:
    """The flat kinds of one group and a place in them."""

    __slots__ = ("g", "s", "p", "ts", "openers")

    def __init__(self, g: Script, flat: str):
        self.g, self.ts, self.p = g, g.types, 0
        self.s = flat + END
        self.openers = g.groups.opener

    # places

    def fail(self):
        raise Broken("unexpected token", self.p)

    def kind(self, at: int) -> str:
        """The kind at a place; of a group, its opening bracket."""
        c = self.s[at]
        return c if c < "\U00010000" else self.openers(c)

    def now(self) -> str:
        c = self.s[self.p]
        return c if c < "\U00010000" else self.openers(c)

    def next(self) -> str:
        return self.kind(self.p + 1) if self.s[self.p] != END else END

    def take(self, k: str) -> bool:
        if self.s[self.p] == k:
            self.p += 1
            return True
        return False

    def need(self, k: str) -> None:
        if self.s[self.p] != k:
            self.fail()
        self.p += 1

    def one_of(self, kinds) -> None:
        if self.s[self.p] not in kinds:
            self.fail()
        self.p += 1

    def lines(self) -> None:
        while self.s[self.p] == NEWLINE:
            self.p += 1

    def group(self, opener: str, role: str) -> None:
        c = self.s[self.p]
        if c < "\U00010000" or self.openers(c) != opener or not self.g.valid(c, role):
            self.fail()
        self.p += 1

    def attempt(self, f) -> bool:
        at = self.p
        try:
            f()
            return True
        except Broken:
            self.p = at
            return False

    def run(self, role: str) -> None:
        getattr(self, "role_" + role)()
        self.lines()
        if self.s[self.p] != END:
            self.fail()

    def listed(self, item, separators: str = ",") -> None:
        """Items with separators between them and perhaps behind them, up to the end."""
        while self.s[self.p] != END:
            item()
            if self.s[self.p] == END:
                break
            self.one_of(separators)

    # roles of groups

    def role_module(self):
        self.statements(True)

    def role_ambient(self):
        while self.s[self.p] != END:
            self.statement(True, True)

    def role_block(self):
        self.statements(False)

    def role_arguments(self):
        self.listed(self.spread)

    def role_array(self):
        while self.s[self.p] != END:
            if not self.take(","):
                self.spread()
                if self.s[self.p] != END:
                    self.need(",")

    def role_expression(self):
        self.expression()

    def role_child(self):
        if self.s[self.p] != END:
            self.spread() if self.s[self.p] == SPREAD else self.expression()

    def role_key(self):
        self.assignment()

    def role_element(self):
        roles = {CHILD_OPEN: "child", VALUE_OPEN: "key", ALL_OPEN: "arguments", JSX_OPEN: "element"}
        while self.s[self.p] != END:
            k = self.now()
            self.group(k, roles[k])

    def role_template(self):
        while self.s[self.p] != END:
            self.group(SUBST_OPEN, "expression")

    def role_template_type(self):
        while self.s[self.p] != END:
            self.group(SUBST_OPEN, "type")

    def role_type(self):
        self.type()

    def role_object(self):
        self.listed(self.property)

    def role_object_pattern(self):
        self.listed(self.pattern_property)

    def role_array_pattern(self):
        while self.s[self.p] != END:
            if not self.take(","):
                self.take(SPREAD)
                self.target()
                if self.s[self.p] != END:
                    self.need(",")

    def role_parameters(self):
        self.listed(self.parameter)

    def role_class(self):
        while self.s[self.p] != END:
            if self.s[self.p] in (";", NEWLINE):
                self.p += 1
            else:
                self.member()

    def role_switch(self):
        while True:
            self.lines()
            if self.s[self.p] == END:
                return
            if self.take(W["case"]):
                self.expression()
            else:
                self.need(W["default"])
            self.need(":")
            while self.s[self.p] not in (END, W["case"], W["default"]):
                self.statement(False)

    def role_for(self):
        self.take(W["await"])
        s = self.s
        if s[self.p] in (W["var"], W["const"]) or (s[self.p] == W["let"] and (self.next() in NAMES or self.next() in "{[")):
            self.p += 1
            self.binding()
            if s[self.p] in (W["of"], W["in"]):
                self.p += 1
                self.expression() if s[self.p - 1] == W["in"] else self.assignment()
                return
            if self.take("="):
                self.assignment()
            while self.take(","):
                self.binding()
                if self.take("="):
                    self.assignment()
        elif s[self.p] != ";":
            if self.attempt(self._for_of):
                return
            self.expression()
            if s[self.p] == END:  # name in object, read as one expression
                return
        self.need(";")
        if s[self.p] != ";":
            self.expression()
        self.need(";")
        if s[self.p] != END:
            self.expression()

    def _for_of(self):
        self.target()
        self.one_of((W["of"], W["in"]))
        self.expression() if self.s[self.p - 1] == W["in"] else self.assignment()
        if self.s[self.p] != END:
            self.fail()

    def role_catch(self):
        self.binding()

    def role_names(self):
        def item():
            if self.ts and self.s[self.p] == W["type"] and self.next() in KEYS:
                self.p += 1
            self.one_of(WORDS | {STRING})
            if self.take(W["as"]):
                self.one_of(WORDS | {STRING})

        self.listed(item)

    def role_enum(self):
        def item():
            if self.now() == "[":
                self.group("[", "key")
            else:
                self.one_of(KEYS)
            if self.take("="):
                self.assignment()

        self.listed(item)

    def role_type_members(self):
        while self.s[self.p] != END:
            if self.s[self.p] in (";", ",", NEWLINE):
                self.p += 1
                continue
            self.type_member()
            if self.s[self.p] not in (";", ",", NEWLINE, END):
                self.fail()

    def role_tuple(self):
        def item():
            self.take(SPREAD)
            if self.s[self.p] in WORDS and (self.next() == ":" or (self.next() == "?" and self.kind(self.p + 2) == ":")):
                self.p += 1
                self.take("?")
                self.need(":")
            self.type()
            self.take("?")

        self.listed(item)

    def role_index(self):
        self.one_of(NAMES)
        self.need(":")
        self.type()

    def role_mapped(self):
        self.one_of(NAMES)
        self.need(W["in"])
        self.type()
        if self.take(W["as"]):
            self.type()

    # expressions

    def expression(self):
        self.assignment()
        while self.take(","):
            self.assignment()

    def spread(self):
        self.take(SPREAD)
        self.assignment()

    def assignment(self):
        k = self.now()
        if k in NAMES:
            if self.s[self.p + 1] == ARROW:
                self.p += 2
                return self.arrow_body()
            if k == W["async"] and self.arrow_ahead(self.p + 1):
                self.p += 1
                return self.arrow()
            if k == W["yield"] and self.next() != "=":
                self.p += 1
                self.take("*")
                if self.s[self.p] not in STOPS and self.now() not in ",):]":
                    self.assignment()
                return None
        elif k == "(" or (k == "<" and self.ts):
            if self.arrow_ahead(self.p):
                return self.arrow()
        elif k in "{[" and self.s[self.p + 1] == "=":
            self.group(k, "object_pattern" if k == "{" else "array_pattern")
            self.p += 1
            return self.assignment()
        settable = self.binary()
        k = self.s[self.p]
        if k == "?":
            self.p += 1
            self.assignment()
            self.need(":")
            return self.assignment()
        if k == "=" or k == ASSIGN:
            if not settable:
                self.fail()
            self.p += 1
            return self.assignment()
        return None

    def arrow_ahead(self, at: int) -> bool:
        """Is an arrow function's head at a place?"""
        k = self.kind(at)
        if k in NAMES:
            return self.s[at + 1] == ARROW
        if k == "(":
            if self.s[at + 1] == ARROW:
                return True
            if not self.ts or self.s[at + 1] != ":":
                return False
        elif k != "<" or not self.ts:
            return False
        here = self.p
        self.p = at
        try:
            self.arrow_head()
            return True
        except Broken:
            return False
        finally:
            self.p = here

    def arrow_head(self):
        if self.s[self.p] in NAMES:
            self.p += 1
        else:
            if self.s[self.p] == "<":
                self.type_parameters()
            self.group("(", "parameters")
            if self.ts and self.take(":"):
                self.type(True)
        self.need(ARROW)

    def arrow(self):
        self.arrow_head()
        self.arrow_body()

    def arrow_body(self):
        if self.now() == "{":
            self.group("{", "block")
        else:
            self.assignment()

    def binary(self) -> bool:
        """Operands with operators; says whether it is a single one that can be assigned to."""
        first = self.s[self.p]
        settable = self.unary()
        mixed = set()  # operators that must not meet without brackets
        while True:
            k = self.s[self.p]
            if k in INFIX:
                if k == POWER and first in SIGNS:
                    self.fail()
                if k == LOGICAL or k == COALESCE:
                    mixed.add(k)
                    if len(mixed) > 1:
                        self.fail()
                self.p += 1
            elif k == ">":
                n = 1
                while n < 3 and self.s[self.p + n] == ">":
                    n += 1
                if self.s[self.p + n] == "=" and n > 1:  # shift and assign
                    if not settable:
                        self.fail()
                    self.p += n + 1
                    self.assignment()
                    return False
                self.p += n
                self.take("=")
                self.lines()
            elif self.ts and k in AS:
                self.p += 1
                if not (self.take(W["const"])):
                    self.type()
                continue
            else:
                return settable
            settable = False
            first = self.s[self.p]
            self.unary()

    def unary(self) -> bool:
        k = self.s[self.p]
        if k in PREFIX:
            if k == W["await"] and self.next() in (".", ARROW, "=", ASSIGN, ",", ")", END, ";", OPTIONAL):
                return self.chain()
            self.p += 1
            self.lines()
            self.unary()
            return False
        if k == "<" and self.ts and not self.g.jsx:
            self.p += 1
            self.type()
            self.need(">")
            self.unary()
            return False
        return self.chain()

    def chain(self, calls: bool = True) -> bool:
        s = self.s
        k = self.now()
        settable = False
        if k in NAMES:
            if k == W["async"] and s[self.p + 1] == W["function"]:
                self.p += 1
                self.function()
            else:
                self.p += 1
                settable = True
        elif k in LITERALS:
            self.p += 1
        elif k == "(":
            self.group("(", "expression")
            settable = True
        elif k == "[":
            self.group("[", "array")
        elif k == "{":
            self.group("{", "object")
        elif k == TEMPLATE_OPEN:
            self.group(k, "template")
        elif k == JSX_OPEN:
            self.group(k, "element")
        elif k == W["function"]:
            self.function()
        elif k == W["class"] or k == "@":
            self.decorators()
            self.class_()
        elif k == W["new"]:
            self.p += 1
            if self.take("."):
                self.need(IDENT)
            else:
                if self.s[self.p] == W["new"] or self.now() != "(":
                    self.chain(False)
                else:
                    self.group("(", "expression")
                if self.now() == "(":
                    self.group("(", "arguments")
        elif k == W["import"]:
            self.p += 1
            if self.take("."):
                self.one_of(NAMES)
            else:
                self.group("(", "arguments")
        elif k == PRIVATE and s[self.p + 1] == W["in"]:
            self.p += 1
        else:
            self.fail()
        return self.tail(settable, calls)

    def tail(self, settable: bool, calls: bool) -> bool:
        s = self.s
        optional = False
        while True:
            k = self.now()
            if k == ".":
                self.p += 1
                self.one_of(WORDS | {PRIVATE})
                settable = True
            elif k == "(":
                if not calls:
                    return False
                self.group("(", "arguments")
                settable = False
            elif k == "[":
                self.group("[", "expression")
                settable = True
            elif k == OPTIONAL:
                if not calls:
                    self.fail()
                self.p += 1
                optional = True
                k = self.now()
                if k in WORDS or k == PRIVATE:
                    self.p += 1
                elif k == "(":
                    self.group("(", "arguments")
                elif k == "[":
                    self.group("[", "expression")
                else:
                    self.fail()
                settable = True
            elif k == TEMPLATE:
                self.p += 1
                settable = False
            elif k == TEMPLATE_OPEN:
                self.group(k, "template")
                settable = False
            elif k == "!" and self.ts and self.s[self.p + 1] != "=":
                self.p += 1
            elif k == "<" and self.ts and self.attempt(self.call_types):
                settable = False
            else:
                break
        if s[self.p] == INCREMENT and calls:
            if not settable or optional:
                self.fail()
            self.p += 1
            return False
        return settable and not optional

    def call_types(self):
        self.type_arguments()
        k = self.now()
        if k in WORDS or k in (NUMBER, STRING, "{", "[", "+", "-", "!", "~") and k != NEWLINE:
            self.fail()

    def function(self):
        self.need(W["function"])
        self.take("*")
        if self.s[self.p] in NAMES:
            self.p += 1
        self.signature()
        self.body()

    def signature(self):
        if self.ts and self.s[self.p] == "<":
            self.type_parameters()
        self.group("(", "parameters")
        if self.ts and self.take(":"):
            self.type(True)

    def body(self, optional: bool = False):
        at = self.p
        self.lines()
        if self.now() == "{":
            self.group("{", "block")
        elif optional:
            self.p = at
            self.semicolon()
        else:
            self.fail()

    def key(self):
        if self.now() == "[":
            self.group("[", "key")
        else:
            self.one_of(KEYS | {PRIVATE})

    def property(self):
        if self.take(SPREAD):
            return self.assignment()
        k = self.now()
        follows = self.next()
        if k in (W["async"], W["get"], W["set"]) and (follows in KEYS or follows in ("[", PRIVATE) or (follows == "*" and k == W["async"])):
            self.p += 1
            self.take("*")
            self.key()
            self.signature()
            return self.body()
        if self.take("*"):
            self.key()
            self.signature()
            return self.body()
        self.key()
        if self.take(":"):
            return self.assignment()
        if self.now() == "(" or (self.ts and self.s[self.p] == "<"):
            self.signature()
            return self.body()
        if k not in NAMES:
            self.fail()
        return None

    def pattern_property(self):
        if self.take(SPREAD):
            return self.target()
        k = self.now()
        self.key()
        if self.take(":"):
            return self.target()
        if k not in NAMES:
            self.fail()
        if self.take("="):
            self.assignment()
        return None

    def target(self):
        """What a destructuring assigns to, with its default."""
        k = self.now()
        if k in "{[" and self.kind(self.p + 1) not in (".", "["):
            self.group(k, "object_pattern" if k == "{" else "array_pattern")
        elif not self.chain():
            self.fail()
        if self.take("="):
            self.assignment()

    def binding(self) -> bool:
        """A name or pattern with its type; says whether it is a pattern."""
        k = self.now()
        if k in NAMES:
            self.p += 1
        elif k == "{" or k == "[":
            self.group(k, "object_pattern" if k == "{" else "array_pattern")
        else:
            self.fail()
        if self.ts:
            if self.s[self.p] == "!" and self.s[self.p + 1] == ":":
                self.p += 1
            if self.take(":"):
                self.type()
        return k not in NAMES

    def parameter(self):
        self.decorators()
        if self.ts:
            while self.s[self.p] in MODIFIERS and (self.next() in NAMES or self.next() in "{["):
                self.p += 1
        self.take(SPREAD)
        if self.ts and self.s[self.p] == W["this"]:
            self.p += 1
        elif self.now() in NAMES:
            self.p += 1
        else:
            k = self.now()
            if k != "{" and k != "[":
                self.fail()
            self.group(k, "object_pattern" if k == "{" else "array_pattern")
        if self.ts:
            self.take("?")
            if self.take(":"):
                self.type()
        if self.take("="):
            self.assignment()

    def decorators(self):
        while self.take("@"):
            if self.now() == "(":
                self.group("(", "expression")
            else:
                self.one_of(NAMES)
                while self.take("."):
                    self.one_of(WORDS)
                if self.ts and self.s[self.p] == "<":
                    self.attempt(self.type_arguments)
                if self.now() == "(":
                    self.group("(", "arguments")
            self.lines()

    def class_(self):
        self.need(W["class"])
        if self.s[self.p] in NAMES and self.s[self.p] != W["implements"]:
            self.p += 1
        if self.ts and self.s[self.p] == "<":
            self.type_parameters()
        if self.take(W["extends"]):
            self.chain()
            if self.ts and self.s[self.p] == "<":
                self.type_arguments()
        if self.ts and self.take(W["implements"]):
            self.type()
            while self.take(","):
                self.type()
        self.lines()
        self.group("{", "class")

    def member(self):
        self.decorators()
        allowed = MODIFIERS | {W["async"], W["get"], W["set"]} if self.ts else frozenset(W[w] for w in ("static", "async", "get", "set", "accessor"))
        while self.s[self.p] in allowed:
            f = self.next()
            if f in KEYS or f in ("[", PRIVATE, "*") or (f == "{" and self.s[self.p] == W["static"]):
                self.p += 1
            elif f == NEWLINE and self.s[self.p] in MODIFIERS and self.s[self.p] != W["static"] and self.ts:
                self.p += 2
            else:
                break
        if self.s[self.p - 1 : self.p] == W["static"] and self.now() == "{":
            return self.group("{", "block")
        self.take("*")
        if self.ts and self.now() == "[" and self.g.valid(self.s[self.p], "index"):
            self.p += 1
            self.need(":")
            self.type()
            return self.semicolon()
        self.key()
        if self.ts and self.s[self.p] in "?!":
            self.p += 1
        if self.now() == "(" or (self.ts and self.s[self.p] == "<"):
            self.signature()
            return self.body(self.ts)
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        return self.semicolon()

    # statements

    def semicolon(self):
        if self.s[self.p] not in STOPS:
            self.fail()
        if self.s[self.p] != END:
            self.p += 1

    def statements(self, module: bool):
        while self.s[self.p] != END:
            self.statement(module)

    def nested(self):
        self.lines()
        if self.s[self.p] == END:
            self.fail()
        self.statement(False)

    def declarations(self, must: bool):
        while True:
            pattern = self.binding()
            if self.take("="):
                self.assignment()
            elif must or pattern:
                self.fail()
            if not self.take(","):
                return self.semicolon()

    def statement(self, module: bool, ambient: bool = False):
        s = self.s
        k = self.now()
        if k == ";" or k == NEWLINE:
            self.p += 1
            return None
        if k == "{":
            return self.group("{", "block")
        if k in _STATEMENTS:
            return _STATEMENTS[k](self, module, ambient)
        if k == "@":
            self.decorators()
            if s[self.p] == W["export"]:
                return self.statement(module)
            self.take(W["abstract"])
            return self.class_()
        if k in NAMES:
            f = self.next()
            if f == ":" and k != W["await"]:
                self.p += 2
                return self.nested()
            if k == W["let"] and (f in NAMES or f in "{["):
                self.p += 1
                return self.declarations(False)
            if k == W["async"] and f == W["function"]:
                self.p += 1
                self.function()
                return None
            if self.ts and self.typed(k, f, module, ambient):
                return None
        self.expression()
        return self.semicolon()

    def typed(self, k: str, f: str, module: bool, ambient: bool = False) -> bool:
        """Statements that only TypeScript has."""
        if k == W["type"] and f in NAMES:
            self.p += 2
            if self.s[self.p] == "<":
                self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif k == W["interface"] and f in NAMES:
            self.p += 2
            if self.s[self.p] == "<":
                self.type_parameters()
            if self.take(W["extends"]):
                self.type()
                while self.take(","):
                    self.type()
            self.lines()
            self.group("{", "type_members")
        elif k == W["abstract"] and f == W["class"]:
            self.p += 1
            self.class_()
        elif k in (W["namespace"], W["module"]) and (f in NAMES or f == STRING) and f != NEWLINE:
            self.p += 2
            while self.take("."):
                self.one_of(NAMES)
            if self.now() == "{":
                self.group("{", "ambient" if ambient else "module")
            else:
                self.semicolon()
        elif k == W["global"] and f == "{":
            self.p += 1
            self.group("{", "ambient")
        elif k == W["declare"] and (f in WORDS) and f != NEWLINE:
            self.p += 1
            self.statement(module, True)
        else:
            return False
        return True

    def s_var(self, module, ambient):
        k = self.s[self.p]
        self.p += 1
        if k == W["const"] and self.ts and self.s[self.p] == W["enum"]:
            return self.s_enum(module, ambient)
        if ambient:
            self.binding()
            while self.take(","):
                self.binding()
            return self.semicolon()
        return self.declarations(k == W["const"])

    def s_enum(self, module, ambient):
        if not self.ts:
            self.fail()
        self.p += 1
        self.one_of(NAMES)
        self.lines()
        self.group("{", "enum")

    def s_function(self, module, ambient):
        self.p += 1
        self.take("*")
        self.one_of(NAMES)
        self.signature()
        self.body(self.ts)

    def s_class(self, module, ambient):
        if self.next() not in NAMES:
            self.fail()
        self.class_()

    def s_if(self, module, ambient):
        self.p += 1
        self.group("(", "expression")
        self.nested()
        at = self.p
        self.lines()
        if self.take(W["else"]):
            self.nested()
        else:
            self.p = at

    def s_for(self, module, ambient):
        self.p += 1
        self.take(W["await"])
        self.group("(", "for")
        self.nested()

    def s_while(self, module, ambient):
        self.p += 1
        self.group("(", "expression")
        self.nested()

    def s_do(self, module, ambient):
        self.p += 1
        self.nested()
        self.lines()
        self.need(W["while"])
        self.group("(", "expression")
        self.take(";")

    def s_switch(self, module, ambient):
        self.p += 1
        self.group("(", "expression")
        self.lines()
        self.group("{", "switch")

    def s_try(self, module, ambient):
        self.p += 1
        self.group("{", "block")
        n = 0
        self.lines()
        if self.take(W["catch"]):
            if self.now() == "(":
                self.group("(", "catch")
            self.lines()
            self.group("{", "block")
            n += 1
        at = self.p
        self.lines()
        if self.take(W["finally"]):
            self.lines()
            self.group("{", "block")
            n += 1
        else:
            self.p = at
        if not n:
            self.fail()

    def s_return(self, module, ambient):
        self.p += 1
        if self.s[self.p] not in STOPS:
            self.expression()
        self.semicolon()

    def s_throw(self, module, ambient):
        self.p += 1
        self.expression()
        self.semicolon()

    def s_break(self, module, ambient):
        self.p += 1
        if self.s[self.p] in NAMES:
            self.p += 1
        self.semicolon()

    def s_import(self, module, ambient):
        f = self.next()
        if f == "(" or f == ".":
            self.expression()
            return self.semicolon()
        if not module:
            self.fail()
        self.p += 1
        if self.s[self.p] != STRING:
            if self.ts and self.s[self.p] == W["type"] and (self.next() in NAMES - {W["from"]} or self.next() in ("{", "*") or (self.next() == W["from"] and self.kind(self.p + 2) == W["from"])):
                self.p += 1
            if self.s[self.p] in NAMES:
                self.p += 1
                if self.ts and self.take("="):
                    self.expression()
                    return self.semicolon()
                if self.s[self.p] != W["from"]:
                    self.need(",")
            if self.now() == "{":
                self.group("{", "names")
            elif self.take("*"):
                self.need(W["as"])
                self.one_of(NAMES)
            self.need(W["from"])
        return self.source()

    def source(self):
        self.need(STRING)
        if self.s[self.p] == W["with"]:
            self.p += 1
            self.group("{", "object")
        self.semicolon()

    def s_export(self, module, ambient):
        if not module:
            self.fail()
        self.p += 1
        k = self.now()
        f = self.next()
        if k == W["default"]:
            self.p += 1
            k, f = self.now(), self.next()
            if k == W["async"] and f == W["function"]:
                self.p += 1
                k = f
            if k == W["function"]:
                self.p += 1
                self.take("*")
                if self.s[self.p] in NAMES:
                    self.p += 1
                self.signature()
                return self.body(self.ts)
            if k == W["class"] or k == "@" or (self.ts and k == W["abstract"] and f == W["class"]):
                self.decorators()
                self.take(W["abstract"])
                return self.class_()
            if self.ts and k == W["interface"] and self.typed(k, f, module):
                return None
            self.assignment()
            return self.semicolon()
        if self.ts and self.take("="):
            self.expression()
            return self.semicolon()
        if self.ts and k == W["type"] and f in ("{", "*"):
            self.p += 1
            k = f
        if self.take("*"):
            if self.take(W["as"]):
                self.one_of(WORDS | {STRING})
            self.need(W["from"])
            return self.source()
        if k == "{":
            self.group("{", "names")
            if self.take(W["from"]):
                return self.source()
            return self.semicolon()
        if self.ts and k == W["as"]:
            self.p += 1
            self.need(W["namespace"])
            self.one_of(NAMES)
            return self.semicolon()
        if self.ts and k == W["import"]:
            return self.s_import(module, ambient)
        if k in (W["var"], W["const"], W["function"], W["class"], W["enum"], "@") or (
            k == W["let"] or (k == W["async"] and f == W["function"])
        ):
            return self.statement(module, ambient)
        if self.ts and self.typed(k, f, module, ambient):
            return None
        return self.fail()

    def s_simple(self, module, ambient):
        self.p += 1
        self.semicolon()

    # types

    def type(self, result: bool = False):
        if self.s[self.p] in (W["asserts"],) and (self.next() in NAMES or self.next() == W["this"]) and result:
            self.p += 2
            if self.take(W["is"]):
                self.type()
            return
        if result and (self.s[self.p] in NAMES or self.s[self.p] == W["this"]) and self.s[self.p + 1] == W["is"]:
            self.p += 2
            return self.type()
        self.union()
        if self.s[self.p] == W["extends"]:
            at = self.p
            self.p += 1
            self.union()
            if not self.take("?"):
                self.p = at
                return
            self.type()
            self.need(":")
            self.type()
        return

    def union(self):
        if self.s[self.p] in "|&":
            self.p += 1
        self.prefixed()
        while self.s[self.p] in "|&":
            self.p += 1
            self.prefixed()

    def prefixed(self):
        k = self.s[self.p]
        if k in (W["keyof"], W["unique"], W["readonly"], W["infer"]) and (self.next() in WORDS or self.next() in "{[(" or self.next() in (STRING, NUMBER)):
            self.p += 1
            self.prefixed()
            if k == W["infer"] and self.s[self.p] == W["extends"]:
                at = self.p
                self.p += 1
                self.prefixed()
                if self.s[self.p] == "?":
                    self.p = at
            return
        self.primary_type()
        while self.now() == "[":
            if self.g.groups.content(self.s[self.p]):
                self.group("[", "type")
            else:
                self.p += 1

    def primary_type(self):
        k = self.now()
        if k == W["abstract"] and self.next() == W["new"]:
            self.p += 1
            k = self.now()
        if k == W["new"] or k == "<" or (k == "(" and self.s[self.p + 1] == ARROW):
            if k == W["new"]:
                self.p += 1
            if self.s[self.p] == "<":
                self.type_parameters()
            self.group("(", "parameters")
            self.need(ARROW)
            return self.type(True)
        if k == "(":
            return self.group("(", "type")
        if k == "{":
            return self.group("{", "type_members")
        if k == "[":
            return self.group("[", "tuple")
        if k == TEMPLATE_OPEN:
            return self.group(k, "template_type")
        if k in (STRING, NUMBER, TEMPLATE) or k in TYPE_WORDS:
            self.p += 1
            return None
        if k == "-":
            self.p += 1
            return self.need(NUMBER)
        if k == W["typeof"]:
            self.p += 1
            if self.s[self.p] == W["import"]:
                return self.primary_type()
            self.one_of(NAMES | {W["this"]})
        elif k == W["import"]:
            self.p += 1
            self.group("(", "arguments")
        elif k in NAMES:
            self.p += 1
        else:
            self.fail()
        while self.take("."):
            self.one_of(WORDS | {PRIVATE})
        if self.s[self.p] == "<":
            self.type_arguments()
        return None

    def type_arguments(self):
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.need(">")

    def type_parameters(self):
        self.need("<")
        while True:
            while self.s[self.p] in (W["const"], W["in"], W["out"]) and self.next() in NAMES:
                self.p += 1
            self.one_of(NAMES)
            if self.take(W["extends"]):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                break
            if self.s[self.p] == ">":
                break
        self.need(">")

    def type_member(self):
        while self.s[self.p] in (W["readonly"], W["get"], W["set"], "+", "-") and (self.next() in KEYS or self.next() == "["):
            self.p += 1
        k = self.now()
        if k == W["new"] and self.next() in ("(", "<"):
            self.p += 1
            return self.signature()
        if k == "(" or k == "<":
            return self.signature()
        if k == "[":
            c = self.s[self.p]
            if not any(self.g.valid(c, r) for r in ("index", "mapped", "key")):
                self.fail()
            self.p += 1
        else:
            self.one_of(KEYS | {PRIVATE})
        if self.s[self.p] in "+-":
            self.p += 1
        self.take("?")
        if self.now() == "(" or self.s[self.p] == "<":
            return self.signature()
        if self.take(":"):
            self.type()
        return None


_STATEMENTS = {
    W["var"]: _Level.s_var, W["const"]: _Level.s_var, W["enum"]: _Level.s_enum, W["function"]: _Level.s_function,
    W["class"]: _Level.s_class, W["if"]: _Level.s_if, W["for"]: _Level.s_for, W["while"]: _Level.s_while,
    W["do"]: _Level.s_do, W["switch"]: _Level.s_switch, W["try"]: _Level.s_try, W["return"]: _Level.s_return,
    W["throw"]: _Level.s_throw, W["break"]: _Level.s_break, W["continue"]: _Level.s_break, W["import"]: _Level.s_import,
    W["export"]: _Level.s_export, W["debugger"]: _Level.s_simple,
}
assert set(JS_RESERVED.values()) <= set(WORDS)
