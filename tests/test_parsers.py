"""Functions of several languages by one table function."""

import pytest

from lodestack.operators import parsers

JS = '''// function no() {
import x from "y"
export function one(a, b = 2, ...rest) {
  if (a && b) { return "function no() {" }
  for (const i of a) { x?.y() }
}
const two = async (a) => {
  return a ? 1 : 2
}
const three = x => { }
class A extends B {
  method(a, { b }) {
    switch (a) { case 1: default: }
  }
  get value() { return `}{ ${this.v}` }
}
const o = { key: function (a) { }, short() { } }
items.forEach(function (x) { })
if (a) { } else { }
while (f(1)) { }
'''
TS = "export function f<T>(a: Map<string, number>, b?: string): Promise<T[]> {\n  return g(a)\n}\nexport const h = (x: number, y = 1): void => { }\n"
JAVA = '''package p;
public class A<T> {
  @Override
  public static List<String> run(final Map<String, Integer> m, int... xs) throws IOException, E {
    try { new Thread() { public void run() { } }.start(); } catch (E e) { }
    return null;
  }
  private int n = f(1);
  int bare(int a, int b) {
    while (a > 0 || b > 0) { }
  }
}
'''


def _short(rows):
    return [(r["name"], r["start_line"], r["end_line"], r["complexity"], r["parameters"], r["is_exported"]) for r in rows]


def test_javascript():
    assert _short(parsers.brace_functions(JS)) == [
        ("one", 3, 6, 4, ["a", "b", "rest"], True), ("two", 7, 9, 2, ["a"], False), ("three", 10, 10, 1, ["x"], False), ("method", 12, 14, 3, ["a"], False), ("value", 15, 15, 1, [], False),
        ("key", 17, 17, 1, ["a"], False), ("short", 17, 17, 1, [], False),
    ]


def test_typescript_and_java():
    assert _short(parsers.brace_functions(TS)) == [("f", 1, 3, 1, ["a", "b"], True), ("h", 4, 4, 1, ["x", "y"], True)]
    assert [x[0] for x in _short(parsers.brace_functions(JAVA))] == ["run", "run", "bare"]
    run = _short(parsers.brace_functions(JAVA))[0]
    assert run[:4] == ("run", 4, 7, 2) and run[4] == ["m", "xs"] and run[5]
    assert _short(parsers.brace_functions(JAVA))[2] == ("bare", 9, 11, 3, ["a", "b"], False)
    assert _short(parsers.brace_functions("function g() {\n}\n")) == [("g", 1, 2, 1, [], False)]


@pytest.mark.parametrize("text", ["function f() {", "function f() } {", "(]"])
def test_refused(text):
    with pytest.raises(ValueError):
        parsers.brace_functions(text)


def test_table_function(spark):
    rows = [("a", "Go", "package p\nfunc F(x int) {\n}\n"), ("b", "JavaScript", JS), ("c", "Java", JAVA), ("d", "Go", "package"), ("e", "Rust", "fn f() {}"), ("f", "Own", "p q"), ("g", "JavaScript", None), ("h", None, "x"), ("i", "Java", "")]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, language string, content string, `odd``name` int")
    out = parsers.functions_of(files, {"Own": lambda t: [{"name": w, "start_line": 1, "end_line": 1, "loc": 1, "complexity": 1, "parameters": [], "is_exported": True} for w in t.split()]})
    got = sorted((r["path"], r["name"], r["start_line"]) for r in out.collect())
    assert [x for x in got if x[0] in "adefghi"] == [("a", "F", 2), ("f", "p", 1), ("f", "q", 1)] and len(got) == 13 and out.columns[:3] == ["path", "language", "odd`name"]
