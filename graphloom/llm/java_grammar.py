"""Grammar of Java 17 over interned bracket groups; see script_grammar for the scheme."""

from __future__ import annotations

from .lexers import (
    ARROW, ASSIGN, BINARY, END, IDENT, INCREMENT, JAVA_CONTEXTUAL, JAVA_WORDS, NUMBER, REFERENCE, SPREAD, STRING, Broken,
    Groups, Tokens, lex_java,
)

W = JAVA_WORDS
NAMES = frozenset([IDENT, *JAVA_CONTEXTUAL.values()])
PRIMITIVES = frozenset(W[w] for w in "boolean byte char double float int long short void".split())
MODIFIERS = frozenset(
    W[w] for w in "abstract default final native private protected public static strictfp synchronized transient volatile sealed".split()
)
PREFIX = frozenset("+-!~") | {INCREMENT}
INFIX = frozenset([BINARY, *"+-*/%&|^<"])
LITERALS = frozenset([NUMBER, STRING, *(W[w] for w in ("true", "false", "null"))])
OPERANDS = NAMES | LITERALS | frozenset(["(", "!", "~", W["this"], W["super"], W["new"], W["switch"], *PRIMITIVES])


class Java:
    """Answers whether a text is a valid compilation unit."""

    def __init__(self, groups: Groups):
        self.groups = groups

    def check(self, text: str) -> None:
        self.parse(text)

    def parse(self, text: str) -> Tokens:
        """The tokens of a valid compilation unit."""
        tokens = lex_java(text)
        _Level(self, self.groups.tree(tokens.kinds)).run("unit")
        return tokens

    def valid(self, group: str, role: str) -> bool:
        verdicts = self.groups.verdicts
        key = (group, role, "java")
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
    __slots__ = ("g", "s", "p", "openers")

    def __init__(self, g: Java, flat: str):
        self.g, self.p = g, 0
        self.s = flat + END
        self.openers = g.groups.opener

    def fail(self):
        raise Broken("unexpected token", self.p)

    def kind(self, at: int) -> str:
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

    def name(self) -> None:
        if self.s[self.p] not in NAMES:
            self.fail()
        self.p += 1

    def is_valid(self, opener: str, role: str, at: int | None = None) -> bool:
        c = self.s[self.p if at is None else at]
        return c >= "\U00010000" and self.openers(c) == opener and self.g.valid(c, role)

    def group(self, opener: str, role: str) -> None:
        if not self.is_valid(opener, role):
            self.fail()
        self.p += 1

    def empty(self, opener: str) -> bool:
        c = self.s[self.p]
        return c >= "\U00010000" and self.openers(c) == opener and not self.g.groups.content(c)

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
        if self.s[self.p] != END:
            self.fail()

    def separated(self, item) -> None:
        """One item or more with commas between them, up to the end."""
        if self.s[self.p] == END:
            return
        item()
        while self.s[self.p] != END:
            self.need(",")
            item()

    # roles of groups

    def role_unit(self):
        at = self.p
        self.annotations()
        if self.take(W["package"]):
            self.qualified()
            self.need(";")
        else:
            self.p = at
        while self.s[self.p] in (W["import"], ";"):
            if self.take(";"):
                continue
            self.p += 1
            self.take(W["static"])
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            self.need(";")
        while self.s[self.p] != END:
            if not self.take(";"):
                self.modifiers()
                if not self.type_declaration():
                    self.fail()

    def role_class(self):
        while self.s[self.p] != END:
            self.member()

    def role_enum(self):
        while self.s[self.p] not in (END, ";"):
            self.annotations()
            self.name()
            if self.now() == "(":
                self.group("(", "arguments")
            if self.now() == "{":
                self.group("{", "class")
            if not self.take(","):
                break
        if self.take(";"):
            self.role_class()

    def role_block(self):
        while self.s[self.p] != END:
            self.statement()

    def role_switch(self):
        """Labels with arrows or with colons."""
        while self.s[self.p] != END:
            if self.take(W["case"]):
                self.ternary()
                while self.take(","):
                    self.ternary()
            else:
                self.need(W["default"])
            if self.take(ARROW):
                k = self.now()
                if k == "{":
                    self.group("{", "block")
                elif k == W["throw"]:
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.s[self.p] not in (END, W["case"], W["default"]):
                    self.statement()

    def role_arguments(self):
        self.separated(self.expression)

    def role_expression(self):
        self.expression()

    def role_elements(self):
        while self.s[self.p] != END:
            self.element()
            if self.s[self.p] != END:
                self.need(",")

    def element(self):
        if self.now() == "{":
            self.group("{", "elements")
        else:
            self.expression()

    def role_cast(self):
        self.type()
        while self.take("&"):
            self.type()

    def role_parameters(self):
        self.separated(self.parameter)

    def parameter(self):
        self.modifiers()
        self.type()
        self.annotations()
        self.take(SPREAD)
        if self.take(W["this"]):
            return
        self.name()
        if self.take("."):
            self.need(W["this"])
        self.dims()

    def role_lambda(self):
        if self.s[self.p] in NAMES and self.s[self.p + 1] in (",", END):
            self.separated(self.name)
        else:
            self.role_parameters()

    def role_for(self):
        if self.attempt(self._each):
            return
        if self.s[self.p] != ";" and not self.attempt(self._locals):
            self.expression()
            while self.take(","):
                self.expression()
        self.need(";")
        if self.s[self.p] != ";":
            self.expression()
        self.need(";")
        if self.s[self.p] != END:
            self.expression()
            while self.take(","):
                self.expression()

    def _each(self):
        self.modifiers()
        self.type()
        self.name()
        self.need(":")
        self.expression()

    def role_resources(self):
        while self.s[self.p] != END:
            if not self.attempt(self._resource):
                self.expression()
            if self.s[self.p] != END:
                self.need(";")

    def _resource(self):
        self.modifiers()
        self.type()
        self.name()
        self.need("=")
        self.expression()

    def role_catch(self):
        self.modifiers()
        self.type()
        while self.take("|"):
            self.type()
        self.name()

    def role_annotation(self):
        if self.s[self.p] in NAMES and self.s[self.p + 1] == "=":
            self.separated(self._pair)
        else:
            self.annotation_value()

    def _pair(self):
        self.name()
        self.need("=")
        self.annotation_value()

    def role_annotation_values(self):
        while self.s[self.p] != END:
            self.annotation_value()
            if self.s[self.p] != END:
                self.need(",")

    def annotation_value(self):
        if self.now() == "{":
            self.group("{", "annotation_values")
        elif self.s[self.p] == "@":
            self.annotations()
        else:
            self.ternary()

    # declarations

    def qualified(self):
        self.name()
        while self.take("."):
            self.name()

    def annotations(self):
        while self.s[self.p] == "@" and self.s[self.p + 1] != W["interface"]:
            self.p += 1
            self.qualified()
            if self.now() == "(":
                self.group("(", "annotation") if not self.empty("(") else self.take(self.s[self.p])

    def modifiers(self):
        while True:
            k = self.s[self.p]
            if k == "@" and self.s[self.p + 1] != W["interface"]:
                self.annotations()
            elif k == IDENT and self.s[self.p + 1] == "-" and self.s[self.p + 2] == W["sealed"]:
                self.p += 3  # non-sealed
            elif k in MODIFIERS and not (k == W["sealed"] and self.s[self.p + 1] in "=.;,)") and not (k == W["default"] and self.s[self.p + 1] in (":", ARROW)):
                self.p += 1
            else:
                return

    def type_declaration(self) -> bool:
        k = self.s[self.p]
        f = self.next()
        if k in (W["class"], W["interface"], W["enum"]) or (k == W["record"] and f in NAMES and self.kind(self.p + 2) in ("(", "<")):
            self.p += 1
        elif k == "@" and self.s[self.p + 1] == W["interface"]:
            self.p += 2
        else:
            return False
        self.name()
        if self.s[self.p] == "<":
            self.type_parameters()
        if k == W["record"]:
            self.group("(", "parameters")
        for word in ("extends", "implements", "permits"):
            if self.take(W[word]):
                self.type()
                while self.take(","):
                    self.type()
        self.group("{", "enum" if k == W["enum"] else "class")
        return True

    def member(self):
        if self.take(";"):
            return
        if self.now() == "{":
            return self.group("{", "block")
        self.modifiers()
        if self.now() == "{":
            if self.s[self.p - 1 : self.p] != W["static"]:
                self.fail()
            return self.group("{", "block")
        if self.type_declaration():
            return None
        if self.s[self.p] == "<":
            self.type_parameters()
            self.annotations()
        if self.s[self.p] in NAMES and self.next() in ("(", "{"):  # constructor, compact or not
            self.p += 1
            if self.now() == "(":
                self.group("(", "parameters")
                self.throws()
            return self.group("{", "block")
        self.type()
        self.name()
        if self.now() == "(":
            self.group("(", "parameters")
            self.dims()
            self.throws()
            if self.now() == "{":
                return self.group("{", "block")
            if self.take(W["default"]):
                self.annotation_value()
            return self.need(";")
        self.declarators()
        return self.need(";")

    def throws(self):
        if self.take(W["throws"]):
            self.type()
            while self.take(","):
                self.type()

    def declarators(self):
        """Behind the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.element()
            if not self.take(","):
                return
            self.name()

    def dims(self):
        while True:
            self.annotations()
            if not self.empty("["):
                return
            self.p += 1

    # types

    def type(self):
        self.annotations()
        if self.s[self.p] in PRIMITIVES:
            self.p += 1
        else:
            self.name()
            while True:
                if self.s[self.p] == "<":
                    self.type_arguments()
                if self.s[self.p] == "." and (self.s[self.p + 1] in NAMES or self.s[self.p + 1] == "@"):
                    self.p += 1
                    self.annotations()
                    self.name()
                else:
                    break
        self.dims()

    def type_arguments(self):
        self.need("<")
        if self.take(">"):
            return
        while True:
            self.annotations()
            if self.take("?"):
                if self.s[self.p] in (W["extends"], W["super"]):
                    self.p += 1
                    self.type()
            else:
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def type_parameters(self):
        self.need("<")
        while True:
            self.annotations()
            self.name()
            if self.take(W["extends"]):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.need(">")

    # expressions; each says whether it may stand as a statement, and whether it can be assigned to

    def expression(self) -> bool:
        k = self.s[self.p]
        if (k in NAMES and self.s[self.p + 1] == ARROW) or (self.now() == "(" and self.s[self.p + 1] == ARROW):
            if k in NAMES:
                self.p += 1
            else:
                self.group("(", "lambda")
            self.p += 1
            if self.now() == "{":
                self.group("{", "block")
            else:
                self.expression()
            return False
        does, settable = self.binary()
        k = self.s[self.p]
        if k == "?":
            self.p += 1
            self.expression()
            self.need(":")
            self.expression()
            return False
        if k == "=" or k == ASSIGN or (k == ">" and self.shift_assign()):
            if not settable:
                self.fail()
            self.p += 1
            self.expression()
            return True
        return does

    def shift_assign(self) -> bool:
        n = 0
        while self.s[self.p + n] == ">":
            n += 1
        if n > 1 and self.s[self.p + n] == "=":
            self.p += n
            return True
        return False

    def ternary(self):
        self.binary()
        if self.take("?"):
            self.ternary()
            self.need(":")
            self.ternary()

    def binary(self) -> tuple[bool, bool]:
        found = self.unary()
        while True:
            k = self.s[self.p]
            if k in INFIX:
                self.p += 1
                found = self.unary()
            elif k == ">":
                n = 1
                while n < 3 and self.s[self.p + n] == ">":
                    n += 1
                if n > 1 and self.s[self.p + n] == "=":
                    return found
                self.p += n
                self.take("=")
                self.unary()
            elif k == W["instanceof"]:
                self.p += 1
                self.modifiers()
                self.type()
                if self.s[self.p] in NAMES:
                    self.p += 1
            else:
                return found
            if self.s[self.p - 1] != ARROW:
                found = (False, False)

    def unary(self) -> tuple[bool, bool]:
        k = self.s[self.p]
        if k in PREFIX:
            self.p += 1
            _, settable = self.unary()
            if k == INCREMENT and not settable:
                self.fail()
            return k == INCREMENT, False
        if self.now() == "(":
            if self.s[self.p + 1] == ARROW:  # a lambda as operand of a cast
                self.expression()
                return False, False
            if self.kind(self.p + 1) in OPERANDS and self.is_valid("(", "cast"):
                self.p += 1
                if self.s[self.p] in NAMES and self.s[self.p + 1] == ARROW:
                    self.expression()
                else:
                    self.unary()
                return False, False
            if self.kind(self.p + 1) in "+-" + INCREMENT and self.is_valid("(", "cast") and self.g.groups.content(self.s[self.p])[0] in PRIMITIVES:
                self.p += 1
                self.unary()
                return False, False
        return self.chain()

    def chain(self) -> tuple[bool, bool]:
        k = self.now()
        does = settable = False
        if k in PRIMITIVES:
            self.type()
            if self.take("."):
                self.need(W["class"])
            elif self.s[self.p] != REFERENCE:
                self.fail()
        elif k in NAMES:
            if not (self.kind(self.p + 1) in ("<", "[") and self.attempt(self.referred_type)):
                self.p += 1
                settable = True
        elif k in LITERALS:
            self.p += 1
        elif k == W["this"] or k == W["super"]:
            self.p += 1
        elif k == "(":
            self.group("(", "expression")
            settable = True
        elif k == W["new"]:
            does = self.creation()
        elif k == W["switch"]:
            self.p += 1
            self.group("(", "expression")
            self.group("{", "switch")
        else:
            self.fail()
        while True:
            k = self.now()
            if k == ".":
                self.p += 1
                if self.s[self.p] == "<":
                    self.type_arguments()
                if self.take(W["new"]):
                    self.p -= 1
                    does = self.creation()
                    settable = False
                elif self.s[self.p] in (W["class"], W["this"], W["super"]):
                    self.p += 1
                    does = settable = False
                else:
                    at = self.p
                    self.name()
                    does, settable = False, True
                    if self.kind(self.p) in ("<", "["):
                        self.p = at
                        if self.attempt(self.referred_type):
                            settable = False
                        else:
                            self.p = at + 1
            elif k == "(":
                if not (self.s[self.p - 1] in NAMES or self.s[self.p - 1] in (W["this"], W["super"])):
                    self.fail()
                self.group("(", "arguments")
                does, settable = True, False
            elif k == "[":
                self.group("[", "expression")
                does, settable = False, True
            elif k == REFERENCE:
                self.p += 1
                if self.s[self.p] == "<":
                    self.type_arguments()
                if not self.take(W["new"]):
                    self.name()
                does = settable = False
            elif k == INCREMENT:
                if not settable:
                    self.fail()
                self.p += 1
                return True, False
            else:
                return does, settable

    def referred_type(self):
        """A generic or array type before :: or .class"""
        self.type()
        if self.s[self.p] != REFERENCE and not (self.s[self.p] == "." and self.s[self.p + 1] == W["class"]):
            self.fail()

    def creation(self) -> bool:
        self.p += 1
        self.annotations()
        if self.s[self.p] == "<":
            self.type_arguments()
        if self.s[self.p] in PRIMITIVES:
            self.p += 1
        else:
            self.name()
            while True:
                if self.s[self.p] == "<":
                    self.type_arguments()
                if not self.take("."):
                    break
                self.annotations()
                self.name()
        if self.now() == "(":
            self.group("(", "arguments")
            if self.now() == "{":
                self.group("{", "class")
            return True
        if self.empty("["):
            self.dims()
            self.group("{", "elements")
            return False
        self.group("[", "expression")
        while self.now() == "[":
            if self.empty("["):
                self.dims()
                break
            self.group("[", "expression")
        return False

    # statements

    def _locals(self):
        self.modifiers()
        self.type()
        self.name()
        self.declarators()

    def _local_statement(self):
        self._locals()
        self.need(";")

    def condition(self):
        self.p += 1
        self.group("(", "expression")

    def statement(self):
        s = self.s
        k = self.now()
        if k == "{":
            return self.group("{", "block")
        if k == ";":
            self.p += 1
        elif k == W["if"]:
            self.condition()
            self.statement()
            if self.take(W["else"]):
                self.statement()
        elif k == W["for"]:
            self.p += 1
            self.group("(", "for")
            self.statement()
        elif k == W["while"]:
            self.condition()
            self.statement()
        elif k == W["do"]:
            self.p += 1
            self.statement()
            if s[self.p] != W["while"]:
                self.fail()
            self.condition()
            self.need(";")
        elif k == W["try"]:
            self.p += 1
            n = 0
            if self.now() == "(":
                self.group("(", "resources")
                n += 1
            self.group("{", "block")
            while self.take(W["catch"]):
                self.group("(", "catch")
                self.group("{", "block")
                n += 1
            if self.take(W["finally"]):
                self.group("{", "block")
                n += 1
            if not n:
                self.fail()
        elif k == W["switch"]:
            self.condition()
            self.group("{", "switch")
        elif k == W["synchronized"] and self.next() == "(":
            self.condition()
            self.group("{", "block")
        elif k == W["return"]:
            self.p += 1
            if s[self.p] != ";":
                self.expression()
            self.need(";")
        elif k == W["throw"]:
            self.p += 1
            self.expression()
            self.need(";")
        elif k == W["break"] or k == W["continue"]:
            self.p += 1
            if s[self.p] in NAMES:
                self.p += 1
            self.need(";")
        elif k == W["assert"]:
            self.p += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif k in NAMES and s[self.p + 1] == ":":
            self.p += 2
            self.statement()
        elif k == W["yield"] and self.next() not in ("=", ".", ASSIGN, INCREMENT, "["):
            self.p += 1
            self.expression()
            self.need(";")
        else:
            at = self.p
            self.modifiers()
            if self.type_declaration():
                return None
            self.p = at
            if (k in NAMES or k in PRIMITIVES or k in MODIFIERS or k == "@") and self.attempt(self._local_statement):
                return None
            if not self.expression():
                self.fail()
            self.need(";")
        return None
