"""Functions, structs and imports of Go sources, from tokens.

A file that the language's grammar doesn't fit (gosyntax.py) is unparseable: its row has an
error and nothing else. In one that it does fit, the keywords if, for, case and default and
the operators && and || stand for exactly the nodes that count for complexity, so tokens
are enough for all else.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import gosyntax
from lodestack.schemas import FUNCTION, IMPORT, STRUCT, array_of

TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')"
    r"|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<op>&&|\|\||<-|\.\.\.|:=|[^\s\w])",
    re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_DECISIONS = {"if", "for", "case", "default", "&&", "||"}
_TYPE_START = {"*", "(", "[", "<-", "...", "func", "map", "chan", "struct", "interface"}
#: Sources whose parts are held at once: a batch has as many as fit its bytes, and their parts are larger than they are.
ROWS = 128


class Unparseable(ValueError):
    pass


class Source:
    """Tokens without comments, where brackets close, and line numbers."""

    def __init__(self, text: str, found: gosyntax.Lexemes | None = None):
        """found: the tokens of a source that the grammar fits, which are not looked for again."""
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokens: list[str] = []
        self.at: list[int] = []
        self.comments: list[tuple[int, int, str]] = []
        self.lines: list[int] | None = None
        if found is not None:
            kept = [k for k, at in enumerate(found.at) if at >= 0]
            self.tokens, self.at, self.lines = ([x[k] for k in kept] for x in (found.texts, found.at, found.lines))
            self.comments = found.comments
        else:
            for m in TOKEN.finditer(text):
                if m.lastgroup == "comment":
                    self.comments.append((self.line(m.start()), self.line(m.end() - 1), m.group()))
                else:
                    self.tokens.append(m.group())
                    self.at.append(m.start())
        self.close: dict[int, int] = {}
        self.depth: list[int] = []
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t in _CLOSE:
                if not stack or _OPEN[self.tokens[stack[-1]]] != t:
                    raise Unparseable(f"line {self.line(self.at[i])}: unexpected {t}")
                self.close[stack.pop()] = i
            self.depth.append(len(stack))
            if t in _OPEN:
                stack.append(i)
        if stack:
            raise Unparseable(f"line {self.line(self.at[stack[-1]])}: {self.tokens[stack[-1]]} is not closed")
        if self.tokens[:1] != ["package"]:
            raise Unparseable("no package clause")

    def line(self, position: int) -> int:
        return bisect.bisect_left(self.breaks, position) + 1

    def line_of(self, i: int) -> int:
        return self.lines[i] if self.lines is not None else self.line(self.at[i])

    def doc(self, line: int) -> str:
        """Text of the comments that end right above a line."""
        found = []
        for first, last, text in reversed(self.comments):
            if last == line - 1:
                found.append(text)
                line = first
            elif last < line - 1:
                break
        out = []
        for c in reversed(found):
            out += [c[2:].removeprefix(" ")] if c.startswith("//") else c[2:-2].strip("\n").split("\n")
        return "".join(f"{x.rstrip()}\n" for x in out)

    def source(self, i: int, j: int) -> str:
        """Text of tokens i .. j - 1."""
        return self.text[self.at[i] : self.at[j - 1] + len(self.tokens[j - 1])] if j > i else ""

    def split(self, i: int, j: int, separators: tuple[str, ...], by_line: bool = False) -> list[tuple[int, int]]:
        """Token ranges of i .. j - 1 between separators (or line ends) outside brackets."""
        out, start, k = [], i, i
        while k < j:
            if self.tokens[k] in separators:
                out.append((start, k))
                start = k + 1
            k = self.close.get(k, k) + 1
            if by_line and start < k < j and self.line_of(k) > self.line(self.at[k - 1] + len(self.tokens[k - 1]) - 1) and self.tokens[k - 1] != ",":
                out.append((start, k))
                start = k
        return [(a, b) for a, b in [*out, (start, j)] if a < b]


def is_word(token: str) -> bool:
    return re.fullmatch(r"[^\W\d]\w*", token) is not None


def _named(s: Source, a: int, b: int) -> bool:
    """Whether `name type` stands in tokens a .. b - 1, rather than a type alone."""
    if b - a < 2 or not is_word(s.tokens[a]) or s.tokens[a] in _TYPE_START:
        return False
    after = s.tokens[a + 1]
    if after == "[":
        return s.close[a + 1] + 1 < b
    return after in _TYPE_START or is_word(after)


def _parameters(s: Source, opened: int) -> list[str]:
    parts = s.split(opened + 1, s.close[opened], (",",))
    if not any(_named(s, a, b) for a, b in parts):
        return []
    return [s.tokens[a] for a, _ in parts]


def _function(s: Source, i: int) -> tuple[dict, int]:
    """The declaration whose `func` is token i, and the token after it."""
    tokens, k, n = s.tokens, i + 1, len(s.tokens)
    if tokens[k : k + 1] == ["("]:
        k = s.close[k] + 1
    name = tokens[k]
    k += 1
    if tokens[k : k + 1] == ["["]:
        k = s.close[k] + 1
    if tokens[k : k + 1] != ["("]:
        raise Unparseable(f"line {s.line_of(i)}: no parameters")
    parameters = _parameters(s, k)
    k = s.close[k] + 1
    # the result may hold braces itself: those of interface and struct types
    while k < n and tokens[k] != "{" and s.line_of(k) == s.line_of(k - 1):
        if tokens[k] in ("interface", "struct") and tokens[k + 1 : k + 2] == ["{"]:
            k += 1
        k = s.close.get(k, k) + 1
    has_body = k < n and tokens[k] == "{" and s.line_of(k) == s.line_of(k - 1)
    end = s.close[k] if has_body else k - 1
    first, last = s.line_of(i), s.line_of(end)
    complexity = 1 + sum(t in _DECISIONS for t in tokens[k : end + 1]) if has_body else 1
    return {
        "name": name, "start_line": first, "end_line": last, "loc": last - first + 1, "complexity": complexity, "parameters": parameters,
        "return_type": None, "is_exported": name[:1].isupper(), "comments": s.doc(first),
    }, end + 1


def _fields(s: Source, opened: int) -> list[dict]:
    out = []
    for a, b in s.split(opened + 1, s.close[opened], (";",), by_line=True):
        while b > a and s.tokens[b - 1][:1] in "`\"":
            b -= 1
        names, k = [], a
        while k < b and is_word(s.tokens[k]):
            names.append(s.tokens[k])
            if s.tokens[k + 1 : k + 2] != [","]:
                break
            k += 2
        if names and _named(s, k, b):
            out += [{"name": x, "type": s.source(k + 1, b)} for x in names]
    return out


def _structs(s: Source) -> list[dict]:
    out, tokens = [], s.tokens
    for i, t in enumerate(tokens):
        if t != "type":
            continue
        grouped = tokens[i + 1 : i + 2] == ["("]
        specs = s.split(i + 2, s.close[i + 1], (";",), by_line=True) if grouped else [(i + 1, len(tokens))]
        for a, b in specs:
            k = a + 1
            if k < b and tokens[k] == "[" and tokens[s.close[k] + 1 : s.close[k] + 2] == ["struct"] and s.close[k] > k + 2:
                k = s.close[k] + 1
            if k + 1 < b and is_word(tokens[a]) and tokens[k] == "struct" and tokens[k + 1] == "{":
                out.append({"name": tokens[a], "start_line": s.line_of(a), "end_line": s.line_of(s.close[k + 1]), "fields": _fields(s, k + 1), "is_exported": tokens[a][:1].isupper()})
    return out


def import_specs(s: Source) -> list[dict]:
    out, tokens = [], s.tokens
    for i, t in enumerate(tokens):
        if t == "import" and s.depth[i] == 0:
            grouped = tokens[i + 1 : i + 2] == ["("]
            specs = s.split(i + 2, s.close[i + 1], (";",), by_line=True) if grouped else [(i + 1, i + (2 if tokens[i + 1][:1] in "\"`" else 3))]
            out += [{"path": tokens[b - 1], "alias": tokens[a] if b - a > 1 else None, "line": s.line_of(a)} for a, b in specs]
    return out


def _declared(s: Source) -> Iterator[tuple[dict, int, int]]:
    """Each function, its first token and the token after it."""
    i = 0
    while i < len(s.tokens):
        starts = i == 0 or s.tokens[i - 1] == ";" or s.line_of(i) > s.line_of(i - 1)
        if s.tokens[i] == "func" and s.depth[i] == 0 and starts and s.tokens[i - 1] != "=":
            f, end = _function(s, i)
            yield f, i, end
            i = end
        else:
            i += 1


def function_ranges(s: Source) -> Iterator[tuple[int, int, str]]:
    """First token, token after the last, and name of each function."""
    for f, start, end in _declared(s):
        yield start, end, f["name"]


def parse(text: str) -> dict:
    """functions, structs and imports of one source, or an error."""
    try:
        found = gosyntax.check(text)
        if text.startswith("\ufeff"):
            raise Unparseable("no package clause")
        s = Source(text, found)
        functions = [f for f, _, _ in _declared(s)]
        imports = [{k: v for k, v in i.items() if k != "line"} for i in import_specs(s)]
        return {"functions": functions, "structs": _structs(s), "imports": imports, "error": None}
    except (gosyntax.Fault, Unparseable, IndexError, KeyError) as e:
        return {"functions": [], "structs": [], "imports": [], "error": str(e) or type(e).__name__}


PARSED = f"functions {array_of(FUNCTION)}, structs {array_of(STRUCT)}, imports {array_of(IMPORT)}, error string"


def parse_go(files: DataFrame, with_content: bool = True) -> DataFrame:
    """Go files of files(repo_id, path, content) plus functions, structs, imports and error; without their content, nothing but what is found comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                pdf = whole.iloc[at : at + ROWS]
                found = pd.DataFrame([parse(t or "") for t in pdf["content"]], index=pdf.index, columns=["functions", "structs", "imports", "error"])
                yield pd.concat([pdf if with_content else pdf.drop(columns="content"), found], axis=1)

    return files.select("repo_id", "path", "content").mapInPandas(run, f"repo_id string, path string, {'content string, ' if with_content else ''}{PARSED}")


def functions_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", F.col("path").alias("file_path"), F.explode("functions").alias("f")).select("repo_id", "file_path", "f.*")


def structs_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", F.col("path").alias("file_path"), F.explode("structs").alias("s")).select("repo_id", "file_path", "s.*")


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("repo_id", F.col("path").alias("file_path"), F.explode("imports").alias("i")).select("repo_id", "file_path", "i.*")
