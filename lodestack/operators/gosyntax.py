"""Whether a Go source is well formed: the language's grammar by recursive descent, expressions by binding power.

Nothing is built; the first fault is raised with its line. Names are not resolved, so what is
well formed but means nothing (an unknown name, a wrong type) is no fault.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Tokens, keywords and precedences of the language.
_LEXEME = re.compile(
    r"[ \t\r]*+(?:(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)"
    r"|(?P<string>`[^`]*`|\"(?:\\[^\n]|[^\"\\\n])*\")|(?P<char>'(?:\\[^\n][^'\n]*|[^'\\\n])')"
    r"|(?P<name>[^\W\d]\w*)|(?P<number>(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?[\d_]+)?|0[bBoO][\d_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)i?)"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])|(?P<bad>.))",
    re.S,
)
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS_LITERAL = frozenset(("name", "number", "string", "char"))
_ENDS_LINE = frozenset("break continue fallthrough return ++ -- ) ] }".split())
_BINDING = {"||": 1, "&&": 2} | dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), 3) | dict.fromkeys(("+", "-", "|", "^"), 4) | dict.fromkeys(("*", "/", "%", "<<", ">>", "&", "&^"), 5)
_UNARY = frozenset("+ - ! ^ * & <- ~".split())
_ASSIGNS = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_QUOTES = ('"', "'", "`")
_TYPES = frozenset("[ map chan struct interface".split())


class Fault(ValueError):
    pass


class Lexemes:
    """Tokens of a source side by side: kind, text, line and place, with the semicolons that line ends stand for (of no place); keywords and
    operators are their own kind. comments: first line, last line and text of each. Raises Fault."""

    def __init__(self, text: str):
        kinds: list[str] = []
        texts: list[str] = []
        lines: list[int] = []
        at: list[int] = []
        comments: list[tuple[int, int, str]] = []
        line, ends = 1, False
        skipped = int(text.startswith("\ufeff"))
        for m in _LEXEME.finditer(text, skipped):
            kind = m.lastgroup
            t = m[kind]
            if kind == "line" or kind == "comment":
                breaks = 1 if kind == "line" else t.count("\n")
                if kind == "comment":
                    comments.append((line, line + breaks, t))
                if not breaks:
                    continue
                if ends:
                    kinds.append(";")
                    texts.append("newline")
                    lines.append(line)
                    at.append(-1)
                    ends = False
                line += breaks
                continue
            if kind == "name":
                if t in _KEYWORDS:
                    kind = t
                ends = kind == "name" or t in _ENDS_LINE
            elif kind == "op":
                if t == "/" and text.startswith("/*", m.start(kind)):
                    raise Fault(f"line {line}: a comment is not closed")
                kind = t
                ends = t in _ENDS_LINE
            elif kind == "bad":
                raise Fault(f"line {line}: {'a literal is not closed' if t in _QUOTES else f'unexpected character {t!r}'}")
            else:
                ends = True
            kinds.append(kind)
            texts.append(t)
            lines.append(line)
            at.append(m.end() - len(t))
            if kind == "string":
                line += t.count("\n")
        if kinds and kinds[-1] != ";":
            kinds.append(";")
            texts.append("end of file")
            lines.append(line)
            at.append(-1)
        kinds.append("end")
        texts.append("end of file")
        lines.append(line)
        at.append(-1)
        self.kinds, self.texts, self.lines, self.at, self.comments = kinds, texts, lines, at, comments


def lexemes(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of each token."""
    found = Lexemes(text)
    return list(zip(found.kinds, found.texts, found.lines, strict=True))


#: Declarations by the kinds of their tokens that were found well formed in this process: how many, and of how many tokens each. The grammar looks at
#: nothing else, and at nothing behind the semicolon that ends a declaration.
_MOST_KNOWN, _LONGEST_KNOWN = 4096, 512
_well_formed: set[tuple[str, ...]] = set()
_OPENS, _CLOSES = frozenset("([{"), frozenset(")]}")


class _Grammar:
    def __init__(self, found: Lexemes):
        self.found = found
        self.kinds = found.kinds
        self.at = 0
        #: Whether `name {` opens a composite literal; not in the head of a statement.
        self.literals = True

    @property
    def kind(self) -> str:
        return self.kinds[self.at]

    def ahead(self, n: int = 1) -> str:
        return self.kinds[min(self.at + n, len(self.kinds) - 1)]

    def fail(self, wanted: str) -> None:
        raise Fault(f"line {self.found.lines[self.at]}: unexpected {self.found.texts[self.at]}, expected {wanted}")

    def take(self, kind: str) -> None:
        if self.kinds[self.at] != kind:
            self.fail(kind)
        self.at += 1

    def maybe(self, *kinds: str) -> bool:
        found = self.kinds[self.at] in kinds
        self.at += found
        return found

    def attempt(self, rule: Callable[[], object], *follow: str) -> bool:
        """Whether the rule fits here (and what follows does); else nothing is taken."""
        at, literals = self.at, self.literals
        try:
            rule()
            if not follow or self.kind in follow:
                return True
        except Fault:
            pass
        self.at, self.literals = at, literals
        return False

    def within(self, literals: bool, rule: Callable[[], object]) -> object:
        before, self.literals = self.literals, literals
        out = rule()
        self.literals = before
        return out

    def listed(self, close: str, rule: Callable[[], object], separator: str = ",") -> None:
        """Rules between separators up to the closing bracket, with or without a last separator."""
        while self.kind != close:
            rule()
            if self.kind != close:
                self.take(separator)
        self.take(close)

    # -- declarations

    def file(self) -> None:
        self.take("package")
        self.take("name")
        self.take(";")
        while self.maybe("import"):
            self.group(self.import_spec)
            self.take(";")
        while self.kind != "end":
            end = self.declared()
            known = tuple(self.kinds[self.at : end + 1]) if end - self.at < _LONGEST_KNOWN else None
            if known is not None and known in _well_formed:
                self.at = end + 1
                continue
            self.declaration() if self.kind != "func" else self.function()
            whole = self.at == end
            self.take(";")
            if whole and known is not None and len(_well_formed) < _MOST_KNOWN:
                _well_formed.add(known)

    def declared(self) -> int:
        """Place of the next semicolon outside brackets, or of the end."""
        depth, last = 0, len(self.kinds) - 1
        for i in range(self.at, last):
            kind = self.kinds[i]
            if kind in _OPENS:
                depth += 1
            elif kind in _CLOSES:
                depth -= 1
            elif kind == ";" and depth <= 0:
                return i
        return last

    def group(self, spec: Callable[[], object]) -> None:
        if self.maybe("("):
            self.listed(")", spec, ";")
        else:
            spec()

    def import_spec(self) -> None:
        self.maybe("name", ".")
        self.take("string")

    def declaration(self) -> None:
        rules = {"const": self.const_spec, "var": self.var_spec, "type": self.type_spec}
        if self.kind not in rules:
            self.fail("a declaration")
        rule = rules[self.kind]
        self.at += 1
        self.group(rule)

    def names(self) -> None:
        self.take("name")
        while self.maybe(","):
            self.take("name")

    def const_spec(self) -> None:
        self.names()
        if self.kind not in (";", ")"):
            if self.kind != "=":
                self.type()
            self.take("=")
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.kind != "=":
            self.type()
        if self.maybe("="):
            self.expressions()

    def type_spec(self) -> None:
        self.take("name")
        if self.kind == "[":
            self.attempt(self.type_parameters)
        self.maybe("=")
        self.type()

    def type_parameters(self) -> None:
        self.take("[")
        if self.kind == "]":
            self.fail("a type parameter")

        def parameter() -> None:
            self.names()
            self.union()

        self.listed("]", parameter)
        if self.kind in (";", ")"):
            self.fail("a type")

    def function(self) -> None:
        self.take("func")
        if self.kind == "(":
            self.parameters()
        self.take("name")
        if self.kind == "[":
            self.type_parameters()
        self.signature()
        if self.kind == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.kind == "(":
            self.parameters()
        elif self.kind in ("name", "*", "func", "<-", *_TYPES):
            self.type()

    def parameters(self) -> None:
        self.take("(")
        forms: list[str] = []

        def typed() -> None:
            self.take("name")
            self.maybe("...")
            self.type()

        def entry() -> None:
            if self.kind == "name" and self.ahead() not in (",", ")", ".") and self.attempt(typed, ",", ")"):
                forms.append("named")
            else:
                bare = self.kind == "name" and self.ahead() in (",", ")")
                self.maybe("...")
                self.type()
                forms.append("bare" if bare else "type")

        self.listed(")", entry)
        if "named" in forms and ("type" in forms or forms[-1] != "named"):
            self.at -= 1
            self.fail("a name and a type for each parameter")

    # -- types

    def type(self) -> None:
        if self.maybe("name"):
            if self.maybe("."):
                self.take("name")
            if self.kind == "[" and self.ahead() != "]":
                self.attempt(self.type_arguments)
        elif self.maybe("("):
            self.type()
            self.take(")")
        elif self.maybe("*"):
            self.type()
        elif self.maybe("["):
            if self.kind != "]" and not self.maybe("..."):
                self.within(True, self.expression)
            self.take("]")
            self.type()
        elif self.maybe("map"):
            self.take("[")
            self.type()
            self.take("]")
            self.type()
        elif self.maybe("chan"):
            self.maybe("<-")
            self.type()
        elif self.maybe("<-"):
            self.take("chan")
            self.type()
        elif self.maybe("func"):
            self.signature()
        elif self.maybe("struct"):
            self.take("{")
            self.listed("}", self.field, ";")
        elif self.maybe("interface"):
            self.take("{")
            self.listed("}", self.element, ";")
        else:
            self.fail("a type")

    def type_arguments(self) -> None:
        self.take("[")
        self.listed("]", self.type)

    def field(self) -> None:
        def named() -> None:
            self.names()
            self.type()

        if self.kind in ("*", "(") or self.ahead() in (";", "}", ".", "string") or not self.attempt(named, ";", "}", "string"):
            self.type()
        self.maybe("string")

    def element(self) -> None:
        if self.kind == "name" and self.ahead() == "(":
            self.at += 1
            self.signature()
        else:
            self.union()

    def union(self) -> None:
        while True:
            self.maybe("~")
            self.type()
            if not self.maybe("|"):
                return

    # -- statements

    def block(self) -> None:
        self.take("{")
        self.within(True, self.statements)
        self.take("}")

    def statements(self) -> None:
        while self.kind not in ("}", "case", "default", "end"):
            self.statement()
            if self.kind not in ("}", "case", "default"):
                self.take(";")

    def statement(self) -> None:
        kind = self.kind
        if kind in ("const", "var", "type"):
            self.declaration()
        elif kind == "{":
            self.block()
        elif kind in ("if", "for", "switch", "select"):
            self.at += 1
            getattr(self, f"{kind}_statement")()
        elif self.maybe("go", "defer"):
            if self.expression() != "call":
                self.fail("a call")
        elif self.maybe("return"):
            if self.kind not in (";", "}"):
                self.expressions()
        elif self.maybe("break", "continue"):
            self.maybe("name")
        elif self.maybe("goto"):
            self.take("name")
        elif kind == "name" and self.ahead() == ":":
            self.at += 2
            if self.kind != "}":
                self.statement()
        elif kind not in (";",) and not self.maybe("fallthrough"):
            self.simple()

    def simple(self, ranges: bool = False) -> str:
        """A simple statement; its kind: expression, range or other."""
        if ranges and self.maybe("range"):
            self.expression()
            return "range"
        forms = self.expressions()
        if self.kind == ":=" and any(f != "name" for f in forms):
            self.fail("names before :=")
        if self.kind == ":=" or self.kind in _ASSIGNS:
            self.at += 1
            if ranges and self.maybe("range"):
                self.expression()
                return "range"
            self.expressions()
            return "other"
        if self.maybe("++", "--"):
            return "other"
        if self.maybe("<-"):
            self.expression()
            return "other"
        return "expression"

    def head(self, must: str) -> None:
        """[simple ;] [simple] before a block, the last an expression."""
        last = None
        if self.kind not in (";", "{"):
            last = self.simple()
        if self.maybe(";"):
            last = self.simple() if self.kind != "{" else None
        if must and last != "expression":
            self.fail(must)

    def if_statement(self) -> None:
        self.within(False, lambda: self.head("a condition"))
        self.block()
        if self.maybe("else"):
            if self.maybe("if"):
                self.if_statement()
            else:
                self.block()

    def for_statement(self) -> None:
        self.within(False, self.for_head)
        self.block()

    def for_head(self) -> None:
        if self.kind == "{":
            return
        first = self.simple(ranges=True) if self.kind != ";" else "other"
        if first == "range" or (first == "expression" and self.kind == "{"):
            return
        self.take(";")
        if self.kind != ";":
            self.expression()
        self.take(";")
        if self.kind != "{":
            self.simple()

    def switch_statement(self) -> None:
        self.within(False, lambda: self.head(""))
        self.clauses(self.expressions)

    def select_statement(self) -> None:
        self.clauses(self.simple)

    def clauses(self, guard: Callable[[], object]) -> None:
        self.take("{")
        while not self.maybe("}"):
            if self.maybe("case"):
                self.within(True, guard)
            else:
                self.take("default")
            self.take(":")
            self.within(True, self.statements)

    # -- expressions

    def expressions(self) -> list[str]:
        forms = [self.expression()]
        while self.maybe(","):
            forms.append(self.expression())
        return forms

    def expression(self, least: int = 1) -> str:
        """name, call or other"""
        form = self.unary()
        while _BINDING.get(self.kind, 0) >= least:
            power = _BINDING[self.kind]
            self.at += 1
            self.expression(power + 1)
            form = "other"
        return form

    def unary(self) -> str:
        if self.kind == "<-" and self.ahead() == "chan":
            self.type()
            return self.postfix("type")
        if self.maybe(*_UNARY):
            self.unary()
            return "other"
        return self.postfix(self.operand())

    def operand(self) -> str:
        if self.maybe("name"):
            return "name"
        if self.maybe("number", "string", "char"):
            return "other"
        if self.maybe("("):
            self.within(True, self.expression)
            self.take(")")
            return "other"
        if self.maybe("func"):
            self.signature()
            if self.kind == "{":
                self.block()
                return "other"
            return "type"
        if self.kind in _TYPES:
            self.type()
            return "literal type"
        self.fail("an operand")
        return ""

    def postfix(self, form: str) -> str:
        typed = form in ("name", "literal type")  # may stand before a composite literal
        while True:
            if self.maybe("."):
                if self.maybe("("):
                    if not self.maybe("type"):
                        self.type()
                    self.take(")")
                    typed = False
                else:
                    self.take("name")
                form = "other"
            elif self.maybe("["):
                self.within(True, self.index)
                form = "other"
            elif self.maybe("("):
                self.within(True, lambda: self.listed(")", self.argument))
                form, typed = "call", False
            elif self.kind == "{" and typed and (self.literals or form == "literal type"):
                self.composite()
                form, typed = "other", False
            else:
                return form

    def index(self) -> None:
        if self.kind == "]":
            self.fail("an index")
        n = 0
        while self.kind != "]":
            if self.maybe(":", ","):
                n += 1
            else:
                self.expression()
                if self.kind not in ("]", ":", ","):
                    self.fail("]")
        self.at += 1

    def argument(self) -> None:
        self.expression()
        self.maybe("...")

    def composite(self) -> None:
        def value() -> None:
            if self.kind == "{":
                self.composite()
            else:
                self.expression()

        def pair() -> None:
            value()
            if self.maybe(":"):
                value()

        self.take("{")
        self.within(True, lambda: self.listed("}", pair))


def check(text: str) -> Lexemes:
    """The tokens of a source; raises Fault with its first fault."""
    found = Lexemes(text)
    try:
        _Grammar(found).file()
    except RecursionError:
        raise Fault("nested too deeply") from None
    return found
