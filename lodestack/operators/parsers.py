"""Functions of sources by language: one table function in a lateral join, with a parser for each language.

Go goes through its grammar. Languages with braces go through a lexer: a `{` opens a function if a
parameter list, or a list and an arrow, stands before it, with no keyword of control in front. Other parsers
can be given by name; a language without one has no functions, and neither has a source that its
parser refuses.

Defined results: null and empty contents and unknown languages give no rows; sources of any length are whole; repeated rows give
their functions again; other columns stay, as the join is lateral.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from lodestack.operators import goparse

FUNCTION = "name string, start_line int, end_line int, loc int, complexity int, parameters array<string>, is_exported boolean"
Parser = Callable[[str], list[dict]]

# Words that may stand before a list and a brace without being a function's name, and those that count for complexity.
_CONTROL = frozenset("if for while switch catch with synchronized return new else do try".split())
_DECISIONS = frozenset("if for while case default catch && || ?".split())
_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|&&|\|\||\?\?|\?\.|\.\.\.|[^\s\w])",
    re.S,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class _Braces:
    """Tokens of a source without comments, their lines, and which brackets belong together."""

    def __init__(self, text: str):
        self.tokens: list[str] = []
        self.lines: list[int] = []
        line = at = 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if m.lastgroup != "comment":
                self.tokens.append('""' if m.lastgroup == "string" else m.group())
                self.lines.append(line + 1)
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t in _PAIRS:
                stack.append(i)
            elif t in _PAIRS.values():
                if not stack or _PAIRS[self.tokens[stack[-1]]] != t:
                    raise ValueError(f"line {self.lines[i]}: unexpected {t}")
                self.partner[i] = stack[-1]
                self.partner[stack.pop()] = i
        if stack:
            raise ValueError(f"line {self.lines[stack[-1]]}: {self.tokens[stack[-1]]} is not closed")

    def _is_name(self, i: int) -> bool:
        return i >= 0 and (self.tokens[i][0].isalpha() or self.tokens[i][0] in "_$")

    def _list_before(self, i: int) -> int | None:
        """The closing parenthesis of the parameter list before the brace at i, past a result's type or a throws clause."""
        k = i - 1
        while k >= 0 and (self._is_name(k) or self.tokens[k] in (".", ",", ":", "<", ">", "|", "]", "[", "?")):
            if self.tokens[k] in _CONTROL or self.tokens[k] in ("class", "interface", "enum"):
                return None
            k -= 1
        if k < 0 or self.tokens[k] != ")":
            return None
        # between list and brace: nothing, a type behind a colon, or throws
        between = self.tokens[k + 1 : i]
        return k if not between or between[0] in (":", "throws") else None

    def _named_before(self, i: int) -> tuple[str, int]:
        """Name and first token of what is assigned at i: `name =` or `name :`; else none."""
        if i >= 2 and self.tokens[i - 1] in ("=", ":") and self._is_name(i - 2):
            return self.tokens[i - 2], i - 2
        return "", i

    def _arrow(self, i: int) -> tuple[str, int, int, int] | None:
        """(name, first token, open and closing parenthesis) of an arrow function whose arrow is at i."""
        if (k := self._list_before(i)) is not None:  # with a result's type or without
            opened = self.partner[k]
            start = opened - 1 if opened and self.tokens[opened - 1] == "async" else opened
            name, first = self._named_before(start)
            return name, first, opened, k
        k = i - 1
        if self._is_name(k):
            name, first = self._named_before(k)
            return name, first, k - 1, k + 1
        return None

    def found(self, i: int) -> tuple[str, int, int, int] | None:
        """The same for whatever function the brace at i opens."""
        if i and self.tokens[i - 1] == "=>":
            return self._arrow(i - 1)
        if (k := self._list_before(i)) is None:
            return None
        opened = self.partner[k]
        before = opened - 1
        if before > 0 and self.tokens[before] == ">":  # type parameters
            depth = 1
            while depth and before > 0:
                before -= 1
                depth += (self.tokens[before] == ">") - (self.tokens[before] == "<")
            before -= 1
        if before >= 0 and self.tokens[before] == "function":
            name, first = self._named_before(before)
            return name, first, opened, k
        if self._is_name(before) and self.tokens[before] not in _CONTROL and not (before and self.tokens[before - 1] in ("new", ".")):
            return self.tokens[before], before, opened, k
        return None

    def parameters(self, opened: int, closed: int) -> list[str]:
        out, part, k = [], [], opened + 1
        while k <= closed:
            if k == closed or self.tokens[k] == ",":
                words = [t for t in part if t[0].isalpha() or t[0] in "_$"]
                cut = next((j for j, t in enumerate(part) if t in (":", "=", "?")), None)
                if cut is not None:  # name: type = default
                    words = [t for t in part[:cut] if t[0].isalpha() or t[0] in "_$"]
                if words:
                    out.append(words[-1])
                part = []
            elif k in self.partner and self.partner[k] > k:
                k = self.partner[k]
            elif self.tokens[k] == "<":  # type arguments
                depth = 1
                while depth and k + 1 < closed:
                    k += 1
                    depth += (self.tokens[k] == "<") - (self.tokens[k] == ">")
            else:
                part.append(self.tokens[k])
            k += 1
        return out


def brace_functions(text: str) -> list[dict]:
    """Named functions of a source in JavaScript, TypeScript or Java."""
    s, out = _Braces(text), []
    for i, t in enumerate(s.tokens):
        if t != "{" or not (f := s.found(i)) or not f[0]:
            continue
        name, first, opened, closed = f
        k = first
        while k and s.tokens[k - 1] not in (";", "}", "{", ")", ",", "(", '""') and s.lines[k - 1] == s.lines[first]:
            k -= 1
        words = s.tokens[k:first]
        end = s.partner[i]
        start_line, end_line = s.lines[k], s.lines[end]
        out.append({
            "name": name, "start_line": start_line, "end_line": end_line, "loc": end_line - start_line + 1, "complexity": 1 + sum(x in _DECISIONS for x in s.tokens[i:end]),
            "parameters": s.parameters(opened, closed), "is_exported": "export" in words or "public" in words,
        })
    return out


def go_functions(text: str) -> list[dict]:
    parsed = goparse.parse(text)
    if parsed["error"]:
        raise ValueError(parsed["error"])
    return parsed["functions"]


#: Parsers by language.
PARSERS: dict[str, Parser] = {"Go": go_functions, "JavaScript": brace_functions, "TypeScript": brace_functions, "Java": brace_functions}
_COLUMNS = [c.split()[0] for c in FUNCTION.split(", ")]


def functions_of(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """files(language, content, ...) -> their columns but content, and those of each function."""
    known = PARSERS | (parsers or {})

    class Functions:
        def eval(self, language: str, content: str) -> Iterator[tuple]:
            if content and language in known:
                try:
                    found = known[language](content)
                except ValueError:
                    return
                for f in found:
                    yield tuple(f[c] for c in _COLUMNS)

    spark = files.sparkSession
    spark.udtf.register("functions_of_source", udtf(Functions, returnType=FUNCTION))
    kept = ", ".join("s.`" + c.replace("`", "``") + "`" for c in files.columns if c not in ("content", *_COLUMNS))
    return spark.sql(f"SELECT {kept}, f.* FROM {{files}} s, LATERAL functions_of_source(s.language, s.content) f", files=files)
