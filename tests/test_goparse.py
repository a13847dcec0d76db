"""The Go token parser on hand-written sources."""

from lodestack.operators import goparse

SOURCE = '''// Package p has one of each.
package p

import "fmt"
import (
\tx "os"
\t"strings" // trailing
)

// Adder adds.
type Adder struct {
\ta, b int `json:"a"`
\tfmt.Stringer
\t*Other
\tm map[string][]func(int) error
\tinner struct {
\t\tz int
\t}
}

type (
\tA struct{ x int; y string }
\tB int
\tG[T any] struct{ v T }
)

var f = func(a int) int { if a > 0 { return 1 }; return 2 }

// Sum sums things.
// It has two lines.
func (r *Adder) Sum(xs []int, _ string, opts ...func(int) bool) (n int, err error) {
\tfor _, x := range xs {
\t\tif x > 0 && x < 10 || x == 42 {
\t\t\tn += x // if for && ||
\t\t}
\t}
\tswitch n {
\tcase 1, 2:
\tdefault:
\t\ts := "if && }" + `raw
{ for` + string('}')
\t\t_ = func() { if s == "" { } }
\t}
\ttype local struct { q int }
\treturn
}

func dyn(m map[string]interface{}) map[string]interface{} { return m }

func unnamed(int, string) struct{} { return struct{}{} }

func external(a int)
func Generic[K comparable, V any](a, b K, c map[K]V) {}
'''


def test_functions():
    f = {x["name"]: x for x in goparse.parse(SOURCE)["functions"]}
    assert list(f) == ["Sum", "dyn", "unnamed", "external", "Generic"]
    s = f["Sum"]
    # 1 + for + if + && + || + case + default + nested if
    assert s["complexity"] == 8 and s["loc"] == s["end_line"] - s["start_line"] + 1 == 16
    assert s["parameters"] == ["xs", "_", "opts"] and s["is_exported"] and s["comments"] == "Sum sums things.\nIt has two lines.\n"
    assert f["dyn"]["parameters"] == ["m"] and f["dyn"]["complexity"] == 1 and f["unnamed"]["parameters"] == [] and not f["dyn"]["is_exported"]
    assert f["external"]["loc"] == 1 and f["Generic"]["parameters"] == ["a", "b", "c"]


def test_structs_and_imports():
    p = goparse.parse(SOURCE)
    s = {x["name"]: [(f["name"], f["type"]) for f in x["fields"]] for x in p["structs"]}
    assert set(s) == {"Adder", "A", "G", "local"}
    assert s["Adder"][:3] == [("a", "int"), ("b", "int"), ("m", "map[string][]func(int) error")] and s["Adder"][3][0] == "inner"
    assert s["A"] == [("x", "int"), ("y", "string")] and s["local"] == [("q", "int")]
    assert [(i["path"], i["alias"]) for i in p["imports"]] == [('"fmt"', None), ('"os"', "x"), ('"strings"', None)]


def test_broken_sources_have_an_error():
    for text in ("", "func f() {}", "package p\nfunc f() {", "package p\nfunc f() )", "package p\nfunc"):
        p = goparse.parse(text)
        assert p["error"] and not p["functions"]


def test_tables(spark):
    files = spark.createDataFrame([("r", "a.go", SOURCE), ("r", "b.go", "package b"), ("r", "c.go", None)], "repo_id string, path string, content string")
    parsed = goparse.parse_go(files)
    assert goparse.functions_of(parsed).count() == 5 and goparse.structs_of(parsed).count() == 4 and goparse.imports_of(parsed).count() == 3
    assert [r["path"] for r in parsed.where("error is not null").collect()] == ["c.go"]
