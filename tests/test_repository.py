"""The git source, tree readers, store, reports and commands over a small repository made here."""

import json
import subprocess

import pytest

from lodestack import cli, config, store
from lodestack.sources import files as tree
from lodestack.sources import git

LONG = "package p\n\n// Big does it.\nfunc Big(a, b int) int {\n" + "\tif a > b && b > 0 {\n\t\ta++\n\t}\n" * 20 + "\treturn a\n}\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-c", "user.name=A B", "-c", "user.email=a@b", "-C", str(root), *args], check=True, capture_output=True)

    run("init", "-b", "main")
    (root / "src dir").mkdir()
    (root / "src dir" / "old.go").write_text("package p\n\nfunc small() {\n}\n" + "// filler\n" * 20)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("useState")
    (root / "go.mod").write_text("module x\nrequire github.com/gin-gonic/gin v1\n")
    run("add", ".")
    run("commit", "-m", "first | with bar")
    run("mv", "src dir/old.go", "src dir/new name.go")
    (root / "big.go").write_text(LONG)
    (root / "bin.dat").write_bytes(bytes(range(256)))
    run("add", ".")
    run("commit", "-m", "second")
    return str(root)


@pytest.fixture
def source(spark):
    git.register(spark)
    return lambda root, **o: spark.read.format("git").options(path=root, **o).load()


def test_commits(source, repo):
    rows = source(repo).collect()
    assert sorted(r["message"] for r in rows) == ["first | with bar", "second"]
    r = next(r for r in rows if r["message"] == "second")
    assert r["short_hash"] == r["hash"][:7] and (r["author"], r["email"]) == ("A B", "a@b") and len(r["parents"]) == 1
    assert source(repo, range="HEAD~1..HEAD").count() == 1 and source(repo, latest="true").first()["message"] == "second"


def test_diff_files(source, repo):
    rows = {r["path"]: r for r in source(repo, table="diff_files", latest="true").collect()}
    assert set(rows) == {"src dir/new name.go", "big.go", "bin.dat"}
    moved = rows["src dir/new name.go"]
    assert (moved["status"], moved["old_path"], moved["additions"]) == ("R", "src dir/old.go", 0)
    assert rows["big.go"]["status"] == "A" and rows["big.go"]["additions"] == LONG.count("\n") and "+func Big" in rows["big.go"]["patch"]
    assert rows["bin.dat"]["additions"] == 0
    assert source(repo, table="diff_files").count() == 6  # the root commit's files, too
    assert source(repo, table="range_diff", range="HEAD~1..HEAD").count() == 3
    assert "func Big" in {r["path"]: r["content"] for r in source(repo, table="content", latest="true").where("path = 'big.go'").collect()}["big.go"]


def test_facts(repo, tmp_path):
    assert git.is_git_installed() and git.git_version().startswith("git version") and git.current_branch(repo) == "main"
    assert git.changed_paths(repo, "HEAD~1") == ["go.mod", "node_modules/x.js", "src dir/old.go"] and git.file_at(repo, "HEAD", "big.go") == LONG
    assert git.relative_path(repo, f"{repo}/a/b.go") == "a/b.go"
    assert git.find_root(f"{repo}/src dir") == repo and git.remote_url(repo) == "" and not git.has_uncommitted_changes(repo)


def test_trees(spark, repo):
    want = {"src dir/new name.go", "big.go", "bin.dat", "go.mod"}
    a = {r["path"]: r["content"] for r in tree.read_tree(spark, repo, "r").collect()}
    b = {r["path"]: r["content"] for r in tree.read_listed(spark, repo, "r").collect()}
    assert set(a) == set(b) == want and a["big.go"] == LONG and "\ufffd" in a["bin.dat"]


def test_commands(spark, repo, capsys, tmp_path):
    assert cli.main(["--root", repo, "context", "show"]) == 1
    assert cli.main(["--root", repo, "context", "build"]) == 0
    out = capsys.readouterr().out
    assert "Gin" in out and "go.mod" in out and "Big" in out
    assert cli.main(["--root", repo, "context", "build", "-i"]) == 0 and cli.main(["--root", repo, "context", "show"]) == 0
    tables = {n: store.load(spark, cli._folder(repo), n) for n in store.TABLES}
    doc = json.loads(store.context_document(tables).first()["value"])
    assert doc["detection"]["languages"] == {"Go": 2} and doc["analysis"]["total_issues"] == 2
    file = tmp_path / "out"
    for form in ("text", "json", "markdown", "html"):
        assert cli.main(["--root", repo, "review", "--ci", "-o", form, "--output-file", str(file), "latest"]) == 1
        assert "high complexity: 41" in file.read_text().replace("&#x27;", "'")
    assert cli.main(["--root", repo, "review", "diff", "HEAD~1..HEAD"]) == 0 and cli.main(["--root", repo, "review", "file", "big.go"]) == 0
    assert cli.main(["--root", repo, "context", "clear"]) == 0 and not store.exists(spark, cli._folder(repo))
    assert cli.main(["--root", repo, "doctor"]) == 0 and cli.main(["version"]) == 0


def test_index_document(spark, tmp_path):
    path = tmp_path / "index.json"
    path.write_text(json.dumps({"embeddings": [{"id": "a", "file_path": "f", "function_name": "g", "start_line": 1, "end_line": 2, "code": "c", "embedding": [0.5, 1], "language": "Go"}], "dimension": 2, "provider": "x", "version": "1.0"}, indent=2))
    r = store.read_index_document(spark, str(path)).first()
    assert (r["id"], r["dim"], r["provider"], r["embedding"]) == ("a", 2, "x", [0.5, 1.0])


def test_config(tmp_path, monkeypatch):
    for name in ("OPENAI_API_KEY", "ANTHROPIC_API_KEY", "LODESTACK_LLM_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    c = config.load(str(tmp_path / "missing.yaml"))
    assert c.analysis.max_function_length == 50
    with pytest.raises(ValueError):
        c.validate()
    c.analysis.complexity_threshold = 7
    c.llm.api_key = "k"
    c.save(str(tmp_path / "c.yaml"))
    assert config.load(str(tmp_path / "c.yaml")) == c
    c.validate()
    monkeypatch.setenv("OPENAI_API_KEY", "env")
    assert config.load(str(tmp_path / "missing.yaml")).llm.api_key == "env"


def test_patches_go_by_path(tmp_path, source):
    """Odd names, a deletion, a rename, a change of mode and one of type: each file has its own patch and status."""
    root = tmp_path / "odd"
    root.mkdir()

    def run(*args):
        subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@b", "-C", str(root), *args], check=True, capture_output=True)

    run("init", "-b", "main")
    names = ["a b/c b/d.go", "tab\there.go", 'quo"te.go', "é.go", "gone.go", "mode.sh", "empty.txt", "kind.go", "old name.go"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("" if n == "empty.txt" else f"package p\n// {n}\n" + "// filler\n" * 10)
    run("add", ".")
    run("commit", "-m", "one")
    for n in names[:4]:
        (root / n).write_text("package q\n")
    (root / "gone.go").unlink()
    (root / "mode.sh").chmod(0o755)
    (root / "kind.go").unlink()
    (root / "kind.go").symlink_to("mode.sh")
    run("mv", "old name.go", "new name.go")
    (root / "bin é.dat").write_bytes(bytes(range(256)))
    run("add", "-A")
    run("commit", "-m", "two")
    rows = {r["path"]: r for r in source(str(root), table="diff_files", latest="true").collect()}
    assert {p: r["status"] for p, r in rows.items()} == dict.fromkeys(names[:4], "M") | {"gone.go": "D", "mode.sh": "M", "kind.go": "T", "new name.go": "R", "bin é.dat": "A"}
    assert all("+package q" in rows[n]["patch"] and rows[n]["patch"].count("diff --git") == 1 for n in names[:4])
    assert "-// gone.go" in rows["gone.go"]["patch"] and "new mode" in rows["mode.sh"]["patch"] and rows["kind.go"]["patch"].count("diff --git") == 2
    assert "rename to" in rows["new name.go"]["patch"] and "Binary" in rows["bin é.dat"]["patch"]
    assert {git.patch_path(r["patch"]) for r in rows.values()} == set(rows)


def test_store_switches_versions(spark, tmp_path):
    folder = str(tmp_path / "store")
    one = {n: spark.createDataFrame([(1,)], "x int") for n in ("a", "b")}
    assert not store.exists(spark, folder)
    store.save(one, folder)
    before = store.load(spark, folder, "a")
    store.save({"a": store.load(spark, folder, "a").selectExpr("x + 1 AS x"), "b": one["b"]}, folder)
    assert store.load(spark, folder, "a").first()[0] == 2 and before.first()[0] == 1
    broken = {"a": spark.createDataFrame([(9,)], "x int"), "b": spark.createDataFrame([(9,)], "x int").selectExpr("raise_error('no') AS x")}
    with pytest.raises(Exception, match="no"):
        store.save(broken, folder)
    assert store.load(spark, folder, "a").first()[0] == 2 and store.load(spark, folder, "b").first()[0] == 1
    store.save(one, folder)
    assert len([p for p in (tmp_path / "store").iterdir() if p.is_dir()]) == 2
    assert store.clear(spark, folder) and not store.exists(spark, folder)


def test_review_lists_touched_functions_and_duplicates(spark, tmp_path, capsys):
    root = tmp_path / "rev"
    root.mkdir()

    def run(*args):
        subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@b", "-C", str(root), *args], check=True, capture_output=True)

    run("init", "-b", "main")
    other = LONG.split("\n", 2)[2].replace("Big", "Other")
    (root / "a.go").write_text(LONG + other)
    run("add", ".")
    run("commit", "-m", "one")
    (root / "a.go").write_text(LONG + other.replace("return a", "return a + 1"))
    run("commit", "-am", "two")
    settings = tmp_path / "c.yaml"
    settings.write_text("embeddings:\n  provider: hashing\nanalysis:\n  similarity_threshold: 0.5\n")
    assert cli.main(["--root", str(root), "-c", str(settings), "context", "build", "-f"]) == 0
    capsys.readouterr()
    assert cli.main(["--root", str(root), "-c", str(settings), "review", "-o", "json", "latest"]) == 0
    data = json.loads(capsys.readouterr().out)
    assert {i["message"].split("'")[1] for i in data["issues"]} == {"Other"}
    assert [(d["func_name"], d["other_name"]) for d in data["duplicates"]] == [("Other", "Big")] and data["duplicates"][0]["similarity"] >= 0.5
    settings.write_text("embeddings:\n  provider: hashing\nanalysis:\n  similarity_threshold: 1.0\n")
    assert cli.main(["--root", str(root), "-c", str(settings), "review", "-o", "json", "latest"]) == 0
    assert json.loads(capsys.readouterr().out)["duplicates"] == []
    tables = {n: store.load(spark, cli._folder(str(root)), n) for n in ("duplications", "unused")}
    assert tables["duplications"].where("message like '%repeat%'").count() > 0 and tables["unused"].count() == 0


def test_provider_follows_the_settings(monkeypatch):
    from lodestack.operators import embed

    asked = []

    def post(url, body, headers=None):
        asked.append((url, body["model"]))
        if "11434" in url:
            raise OSError("no connection")
        return {"data": [{"embedding": [1.0, 2.0]}]}

    monkeypatch.setattr(embed, "_post", post)
    c = config.Config()
    c.embeddings.model, c.embeddings.api_key = "mine", "k"
    assert cli._provider(c).name == "cloud:text-embedding-3-small" and asked[0] == ("http://localhost:11434/api/embeddings", "mine")
    c.embeddings.provider = "openai"
    assert cli._provider(c).name == "cloud:mine"
    c.embeddings.api_key = ""
    assert isinstance(cli._provider(c), embed.HashingProvider)
    c.embeddings.provider = "hashing"
    assert isinstance(cli._provider(c), embed.HashingProvider)
