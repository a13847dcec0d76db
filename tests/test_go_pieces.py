"""Go sources are parsed in small pieces of a batch."""

import pandas as pd

from lodestack.operators import goparse, unused


class _Files:
    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):  # noqa: N802
        return run


def test_a_large_batch_leaves_in_pieces():
    n = 3 * goparse.ROWS + 5
    whole = pd.DataFrame({"repo_id": "r", "path": [f"f{i}.go" for i in range(n)], "content": [f"package p\n\nfunc f{i}() {{}}\n" for i in range(n)]})
    parts = list(goparse.parse_go(_Files())(iter([whole])))
    assert [len(p) for p in parts] == [goparse.ROWS] * 3 + [5]
    assert [f["name"] for p in parts for fs in p["functions"] for f in fs] == [f"f{i}" for i in range(n)]


def test_symbols_leave_in_pieces(monkeypatch):
    n, runs = goparse.ROWS + 5, []

    class Stop(Exception):
        pass

    def kept(self, run, schema):
        runs.append(run)
        raise Stop

    monkeypatch.setattr(_Files, "mapInPandas", kept)
    try:
        unused.symbol_table(_Files())
    except Stop:
        pass
    whole = pd.DataFrame({"repo_id": "r", "path": [f"f{i}.go" for i in range(n)], "content": ["package p\n\nfunc f() {}\n" if i % 2 else "no" for i in range(n)]})
    parts = list(runs[0](iter([whole])))
    assert [len(p) for p in parts] == [goparse.ROWS // 2, 2] and parts[1]["path"].tolist() == [f"f{i}.go" for i in range(goparse.ROWS, n) if i % 2]
