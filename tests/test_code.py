"""Clones against all pairs of places, unused code against a plain search, and the grammar on fit and broken sources."""

import random

import numpy as np
import pytest

from lodestack.operators import clones, goparse, gosyntax, unused

# -- clones -------------------------------------------------------------------


def _streams_of(texts):
    return [clones.tokens(t or "")[0] for t in texts]


def _earlier_runs(streams, least):
    """For each file, the places of tokens that start a run of `least` that also stands earlier."""
    first, out = {}, []
    for f, s in enumerate(streams):
        mine = []
        for i in range(len(s) - least + 1):
            key = tuple(s[i : i + least])
            places = first.setdefault(key, [])
            # a copy in the same file must not overlap
            mine += [i] if any(g < f or j + least <= i for g, j in places) else []
            places.append((f, i))
        out.append(mine)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clones_cover_all_that_stands_earlier(spark, seed):
    rng = random.Random(seed)
    least, window = 12, 4
    pieces = [" ".join(rng.choice("+-*/%") + rng.choice([" n", " 1", " if"]) for _ in range(rng.randrange(6, 30))) for _ in range(12)]
    texts = ["\n".join(rng.choice(pieces).replace("n", f"n{rng.randrange(3)}") for _ in range(rng.randrange(0, 7))) for _ in range(25)] + [None, "", pieces[0], pieces[0]]
    rows = [("r", f"{i:03}.go", t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "repo_id string, path string, content string, file int").repartition(3)
    found = clones.clone_pairs(df, least, window).collect()
    lined = [clones.tokens(t or "") for t in texts]
    covered = [set() for _ in texts]
    for r in found:
        a, b = int(r.path_a[:3]), int(r.path_b[:3])
        assert (a, r.start_a) <= (b, r.start_b) and r.tokens >= least
        # some places of these lines and this length are equal
        places = [(i, j) for i in np.flatnonzero(lined[a][2] == r.start_a) for j in np.flatnonzero(lined[b][2] == r.start_b)]
        fits = [j for i, j in places if len(lined[a][0]) >= i + r.tokens and len(lined[b][0]) >= j + r.tokens and (lined[a][0][i : i + r.tokens] == lined[b][0][j : j + r.tokens]).all()]
        assert fits
        for j in fits:
            if lined[b][3][j + r.tokens - 1] == r.end_b:
                covered[b] |= set(range(j, j + r.tokens))
    for f, starts in enumerate(_earlier_runs(_streams_of(texts), least + window - 1)):
        for i in starts:
            assert set(range(i + window - 1, i + least)) <= covered[f], (f, i)


def test_a_hot_stretch_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(clones, "HOT_SHARE", 1 << 30)
    body = "package p\nfunc f() {\n" + "".join(f"  a{i} {'+-*/%&|^'[i * i * i % 23 % 8]}= {i} * b\n" for i in range(20)) + "}\n"
    df = spark.createDataFrame([("r", f"f{i}.go", body.replace("b\n", f"c{i}\n")) for i in range(40)], "repo_id string, path string, content string")
    pairs = clones.clone_pairs(df)
    rows = pairs.collect()
    assert len(rows) == 39, rows
    assert {r.path_a for r in rows} == {"f0.go"} and all(r.consistent and r.start_b == 1 and r.end_b == 23 for r in rows)
    assert [(r.n_places, r.n_files) for r in clones.clone_classes(pairs).collect()] == [(40, 40)]


def test_consistent_renaming(spark):
    line = "x = x + y * (z - 1) / w\n"
    texts = ["package p\nvar _ = 1\n" + line * 6, "package p\nvar _ = 2\n" + line.translate(str.maketrans("xyzw", "abcd")) * 6, "package p\nvar _ = 3\n" + line * 5 + line.replace("y", "z")]
    df = spark.createDataFrame([(None, f"{i}.go", t) for i, t in enumerate(texts)], "repo_id string, path string, content string")
    got = {(r.path_b, r.consistent, round(r.similarity * r.tokens)) for r in clones.clone_pairs(df).where("path_a <> path_b").collect()}
    n = len(clones.tokens(texts[0])[0])
    assert got == {("1.go", True, n - 31), ("2.go", False, n - 2)}


def test_clones_of_nothing(spark):
    df = spark.createDataFrame([], "repo_id string, path string, content string")
    assert clones.clone_pairs(df).count() == 0 and clones.clone_classes(clones.clone_pairs(df)).count() == 0


def test_a_very_long_source(spark):
    text = "package p\n" + "".join(f"var v{i} = {i} + f(g[{i}], `a`)\n" for i in range(20_000))
    df = spark.createDataFrame([("r", "a.go", text), ("r", "b.go", text.replace("g[", "h["))], "repo_id string, path string, content string")
    rows = [r for r in clones.clone_pairs(df).collect() if r.path_a != r.path_b]
    assert [(r.start_b, r.end_b) for r in rows] == [(1, 20_001)]


# -- unused code --------------------------------------------------------------


def test_unused_functions_equal_a_plain_search(spark):
    rng = random.Random(7)
    rows, functions, mentions = [], {}, {}
    for f in range(60):
        folder, text = f"r{f % 2}", f"package p{f % 2}\n"
        for k in range(5):
            name = f"{rng.choice(['a', 'b', 'C'])}{rng.randrange(60)}"
            called = [f"{rng.choice('ab')}{rng.randrange(60)}" for _ in range(rng.randrange(3))]
            text += f"func (t *T{f}{k}) {name}() {{\n" + "".join(rng.choice(["  {}()\n", "  t.{}(1)\n", "  go q.{}()\n"]).format(c) for c in called) + "}\n"
            functions.setdefault((folder, name), []).append((f, k))
            mentions.setdefault((folder, name), set()).update(called)
        rows.append((folder, f"d/{f}.go", text))
    reached, todo = set(), [x for x in functions if x[1][0] == "C"]
    while todo:
        x = todo.pop()
        if x not in reached:
            reached.add(x)
            todo += [(x[0], c) for c in mentions[x] if (x[0], c) in functions]
    df = spark.createDataFrame(rows, "repo_id string, path string, content string").repartition(4)
    got = unused.unused_functions(unused.symbol_table(df)).collect()
    assert sorted((r.repo_id, r.name) for r in got) == sorted(x for x, places in functions.items() for _ in places if x not in reached)


def test_packages_and_roots(spark):
    rows = [
        ("r", "a/x.go", "package p\nfunc Run() { used() }\nfunc used() {}\nfunc other() {}\nvar _ = outside\nfunc outside() {}\nfunc init() { one() }\nfunc one() {}\nfunc main() {}\n"),
        ("r", "b/x.go", "package p\nfunc used() {}\n"), ("s", "a/x.go", "package p\nfunc used() {}\n"),
        (None, "x.go", "package main\nfunc main() { self() }\nfunc self() { self() }\nfunc alone() { alone() }\n"), ("r", "bad.go", "package p\nfunc ("), ("r", "null.go", None),
    ]
    got = unused.unused_functions(unused.symbol_table(spark.createDataFrame(rows, "repo_id string, path string, content string"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [("r", "a/x.go", "other", 4), ("r", "a/x.go", "main", 9), ("r", "b/x.go", "used", 2), ("s", "a/x.go", "used", 2), (None, "x.go", "alone", 4)]))


def test_long_chains_of_calls(spark):
    text = "package p\nfunc Start() { f0() }\n" + "".join(f"func f{i}() {{ f{i + 1}() }}\n" for i in range(20)) + "func lost() { f3() }\n"
    table = unused.symbol_table(spark.createDataFrame([("r", "a.go", text)], "repo_id string, path string, content string"))
    assert [r.name for r in unused.unused_functions(table).collect()] == ["lost"]


@pytest.mark.parametrize(
    ("spec", "body", "used"),
    [
        ('"fmt"', "fmt.Println()", True), ('"fmt"', "x.fmt.Println()", False), ('"fmt"', "fmt()", False), ('f "fmt"', "fmt.Println()", False), ('f "fmt"', "f.Println()", True), ('_ "fmt"', "", True),
        ('. "fmt"', "", True), ('"gopkg.in/yaml.v3"', "yaml.Load()", True), ('"a.b/c/go-git/v5"', "git.Open()", True), ('"a/sqlite3-go"', "x()", False), ('"C"', "", True), ('"net/http"', "http.Get()", True),
    ],
)
def test_unused_imports(spec, body, used):
    found = unused.symbols(f"package p\nimport {spec}\nfunc f() {{ {body} }}\n")
    assert [i["is_used"] for i in found["imports"]] == [used]


# -- grammar ------------------------------------------------------------------

FIT = [
    'import ("fmt"; . "os"; _ "x"; y "z/w")\nconst ( A = iota; B; C )\nconst X, Y int = 1, 2',
    "type ( T struct { a, b int `tag`; *Q; pkg.R; m map[string][]func(int) error; e [5]int; G[int]; arr [N]int }\n I interface { F(x int) (int, error); fmt.Stringer; ~int | ~string; G() } )",
    "type S[K comparable, V any] struct { k K; v V }\ntype A [N]int\ntype B [N * 2]int\ntype C = D\ntype F func(a, b int, c ...string) (x int, err error)",
    "var v, w = 1, 2.5e-3\nvar z chan<- int\nvar q <-chan int\nvar f = func(x int) int { return x }\nvar h = 0x1F + 0b11 + 0o7 + 1_000 + 3i + .5",
    "func (t *T[K]) M(a, b int, c ...interface{}) (r int, err error) {\nL:\n for i := 0; i < 10; i++ { if i == 3 { continue L } else if i > 5 { break } else { i += 2 } }\n goto L\n}",
    "func f() { for { break }; for k, v := range m { _, _ = k, v }; for range ch { }; for x < 3 { x++ }; for ; ; { }; for i = range 10 { } }",
    "func f() { switch x := y.(type) { case int, []string: a(); fallthrough\n case *T: b()\n default: } }\nfunc g() { switch { case a && b || !c: return }; switch x { }; switch a := 1; a { case 1: } }",
    "func f() { select { case v := <-ch: f(v)\n case ch <- 3:\n case v, ok := <-ch: _ = ok\n default: } }",
    "func f() { go func() { defer wg.Done() }(); defer t.mu.Unlock(); ch <- 1; a, b = b, a; ; { y := 1; _ = y } }",
    'var x = []int{1, 2, 3,}\nvar y = map[string]T{"a": {a: 1}, "b": {1, 2}}\nvar p = &T{a: 1}\nvar a = [...]string{2: "x"}\nvar w = S[int, string]{k: 1}',
    "func f() { s = x[1:2]; s = x[:]; s = x[1:2:3]; u := f[int](3); if p := (T{a: 1}); p.a > 0 { }; if v, ok := m[k]; ok { }; if f(T{1}) { } }",
    "var n = make(map[string]func(), 10)\nvar c = new([]int)\nvar d = make(chan struct{}, 1)\nvar i = x.(int)\nvar k = -x ^ y &^ z << 2\nvar r = (*T)(nil).a\nvar t = '\\''",
    "func g[T any, U int | string](x T) U { var u U; return u }\nfunc ext(a int) int\nfunc h(a, b, c int, d ...pkg.T) {}\nfunc k(int, string, *T, []byte, func()) {}\nfunc l() (a, b int) { return }",
    "/* a\nb */ var x = 1 // c\n\n",
    "",
]
BROKEN = [
    "func f() { x := }", "func f() { if { } }", 'func f() { x := "abc\n }', "foo bar baz", "func f(a int b int) {}", 'import "fmt', "func () {}", "func f() { for x in y { } }", "func f() { a b }", "func f() { x = 1 + }",
    "func f() { g(1, }", "var x = []int{1\n}", "func f() { if x { }\n else { } }", "var", "type T struct { a, b }", "func f() { go x }", "func f() { switch x { y: } }", "func f() { a.b := 1 }", "func f() { if x := 1 { } }",
    "var x = `abc", "/* abc", "var x = 'ab'", "func f() { return 1 2 }", 'var x = 1\nimport "fmt"', "var x = $y", "func f { }", "type I interface { f( }", "var m map[string", "var c chan", "func f() { goto }",
    "func f() { for i := range { } }", "func f() {", "func f() }", "const A, = 1", "type T[", "x := 1", "func f() { var }", "func f(a, b int, string) {}", "func f() { x[ ] = 1 }", "func f() { defer }", "package q", "func f() { case 1: }",
]


@pytest.mark.parametrize("text", FIT)
def test_fit_sources(text):
    gosyntax.check(f"package p\n\n{text}\n")


@pytest.mark.parametrize("text", BROKEN)
def test_broken_sources(text):
    with pytest.raises(gosyntax.Fault, match=r"line \d+: "):
        gosyntax.check(f"package p\n\n{text}\n")
    assert goparse.parse(f"package p\n\n{text}\n")["error"]


def test_deep_nesting_is_a_fault():
    with pytest.raises(gosyntax.Fault):
        gosyntax.check("package p\nvar x = " + "(" * 5000 + "1" + ")" * 5000 + "\n")
