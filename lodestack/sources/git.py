"""Git history as a Spark data source and as a stream, and facts about one repository.

register(spark)
spark.read.format("git").option("path", ROOT).option("table", "commits" | "diff_files" | "range_diff" | "content")
     .option("range", "A..B" or a revision).load()
spark.readStream.format("git").option("path", ROOT).option("table", ...).option("range", BRANCH).option("after", COMMIT).load()

A partition is a run of commits, planned by their number alone and listed where it is read; each commit takes
one to three git processes, whatever the number of its files. The repository must be readable at the same
path where tasks run. Fields are separated by NUL, so subjects, paths with
blanks and renames come through whole; merges are compared with their first
parent and root commits with nothing.

Filters by = and IN go to the source: of commits (a partition for these alone), and of paths and statuses, before patches
and contents are read. A stream's offset is the commit that a branch points to; a batch holds the commits that the new one reaches
and the old one does not, so each comes once, after a restart, too, and after a branch was rewritten, as long as the old commit is there.
"""

from __future__ import annotations

import datetime
import os
import re
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from lodestack.schemas import COMMITS, CONTENT, DIFF_FILES

COMMITS_PER_PARTITION = 200
#: Beyond this number partitions grow.
MOST_PARTITIONS = 2_000
#: More commits asked for by name are filtered where they are listed.
MOST_NAMES = 1_000
#: More wanted files of a commit than this, and all its patches are read.
MOST_PATHS = 100
# git's escapes in quoted paths.
_ESCAPES = {b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v"}
_FORMAT = "%H%x00%an%x00%ae%x00%at%x00%P%x00%s%x01"


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-c", "core.quotepath=off", "-C", root, *args], check=True, capture_output=True).stdout.decode("utf-8", "replace")


def is_git_installed() -> bool:
    try:
        return subprocess.run(["git", "--version"], capture_output=True).returncode == 0
    except OSError:
        return False


def git_version() -> str:
    return subprocess.run(["git", "--version"], check=True, capture_output=True, text=True).stdout.strip()


def find_root(path: str = ".") -> str:
    return git(path, "rev-parse", "--show-toplevel").strip()


def current_branch(root: str) -> str:
    return git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()


def remote_url(root: str) -> str:
    """URL of origin; empty without one."""
    try:
        return git(root, "remote", "get-url", "origin").strip()
    except subprocess.CalledProcessError:
        return ""


def has_uncommitted_changes(root: str) -> bool:
    return bool(git(root, "status", "--porcelain").strip())


def relative_path(root: str, path: str) -> str:
    return os.path.relpath(os.path.abspath(path), root)


def file_at(root: str, commit: str, path: str) -> str:
    return git(root, "show", f"{commit}:{path}")


def changed_paths(root: str, commit: str) -> list[str]:
    out = git(root, "diff-tree", "-r", "--root", "-m", "--first-parent", "--no-commit-id", "--name-only", "-z", commit)
    return [p for p in out.split("\0") if p.strip()]


def _commits(root: str, *selection: str) -> list[tuple]:
    out = []
    for record in git(root, "log", f"--format={_FORMAT}", *selection).split("\x01"):
        fields = record.lstrip("\n").split("\0")
        if len(fields) == 6:
            h, author, email, seconds, parents, subject = fields
            out.append((h, h[:7], author, email, datetime.datetime.fromtimestamp(int(seconds or 0), datetime.timezone.utc), subject, parents.split()))
    return out


def _entries(numstat: str) -> Iterator[tuple[str, str, int, int]]:
    """(path, old path, additions, deletions) of NUL-separated numstat output; a dash counts 0."""
    fields = iter(numstat.split("\0"))
    for field in fields:
        parts = field.lstrip("\n").split("\t", 2)
        if len(parts) == 3:
            added, deleted, path = parts
            old = ""
            if not path:
                old, path = next(fields), next(fields)
            yield path, old, int(added) if added.isdigit() else 0, int(deleted) if deleted.isdigit() else 0


def _statuses(name_status: str) -> dict[str, str]:
    """Status by path; of renames and copies by the new one."""
    out, fields = {}, iter(name_status.split("\0"))
    for status in fields:
        if status := status.strip("\n"):
            for _ in range(2 if status[0] in "RC" else 1):
                path = next(fields)
            out[path] = status[0]
    return out


def _unquoted(path: str) -> str:
    """A path as git prints it: in quotes with escapes if it has odd characters, and with a tab behind it if it has blanks."""
    path = path.removesuffix("\t")
    if not (path.startswith('"') and path.endswith('"') and len(path) > 1):
        return path
    raw = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _ESCAPES.get(m[1], m[1]), path[1:-1].encode())
    return raw.decode("utf-8", "replace")


def patch_path(patch: str) -> str:
    """The path that one file's patch leads to: its new path, or the old one of a deleted file."""
    old = ""
    for line in patch.split("\n")[1:]:
        if line.startswith(("rename to ", "copy to ")):
            return _unquoted(line.split(" to ", 1)[1])
        if line.startswith("--- "):
            old = line[4:]
        elif line.startswith("+++ "):
            return _unquoted(old if line.startswith("+++ /dev/null") else line[4:])[2:]
        elif line.startswith("@@"):
            break
    # neither lines nor names: both sides of the header are the same
    both = patch.split("\n", 1)[0].removeprefix("diff --git ")
    return _unquoted(both[: (len(both) - 1) // 2])[2:]


def _patches(text: str) -> dict[str, str]:
    """Patch by path; a file whose type changes has two, end to end."""
    out: dict[str, str] = {}
    for p in ("\n" + text).split("\ndiff --git ")[1:]:
        patch = f"diff --git {p}" + ("" if p.endswith("\n") else "\n")
        path = patch_path(patch)
        out[path] = out.get(path, "") + patch
    return out


Wanted = Callable[[str, str], bool]


def _all(path: str, status: str) -> bool:
    return True


def _diff(root: str, *command: str, name: str, wanted: Wanted = _all, patches: bool = True) -> Iterator[tuple]:
    entries = list(_entries(git(root, *command, "-z", "--numstat", "-M")))
    statuses = _statuses(git(root, *command, "-z", "--name-status", "-M"))
    rows = [(*e, statuses.get(e[0], "M")) for e in entries if wanted(e[0], statuses.get(e[0], "M"))]
    if not rows:
        return
    texts: dict[str, str] = {}
    if patches:
        # both paths of a rename, so that it is one still
        some = [f":(top,literal){p}" for path, old, *_ in rows for p in (path, old) if p] if len(rows) < min(len(entries), MOST_PATHS) else []
        texts = _patches(git(root, *command, "-p", "-M", *(["--", *some] if some else [])))
    for path, old, added, deleted, status in rows:
        yield name, path, old, status, added, deleted, texts.get(path, "")


def commit_diff(root: str, commit: str, wanted: Wanted = _all, patches: bool = True) -> Iterator[tuple]:
    return _diff(root, "diff-tree", "-r", "--root", "-m", "--first-parent", "--no-commit-id", commit, wanted=wanted, patches=patches, name=commit)


def range_diff(root: str, selection: str, wanted: Wanted = _all) -> Iterator[tuple]:
    return _diff(root, "diff", selection, wanted=wanted, name=selection)


def commit_content(root: str, commit: str, wanted: Wanted = _all) -> Iterator[tuple]:
    """Changed files as they are in the commit; deleted ones are absent."""
    for _, path, _, status, _, _, _ in commit_diff(root, commit, wanted, patches=False):
        if status != "D":
            yield commit, path, file_at(root, commit, path)


def read_outputs(outputs: DataFrame) -> DataFrame:
    """outputs(commit, numstat, name_status): what `git diff-tree -z` printed, kept from repositories that are not at hand.

    Gives (commit, path, old_path, status, additions, deletions); a null numstat has no files, and what name_status lacks is M."""
    names = ["commit", "path", "old_path", "status", "additions", "deletions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for commit, numstat, name_status in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                statuses = _statuses(name_status or "")
                rows += [(commit, path, old, statuses.get(path, "M"), added, deleted) for path, old, added, deleted in _entries(numstat or "")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("additions", "deletions") else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    return outputs.select("commit", "numstat", "name_status").mapInArrow(run, "commit string, path string, old_path string, status string, additions int, deletions int")


def _reaches(root: str, commit: str, from_commit: str) -> bool:
    return subprocess.run(["git", "-C", root, "merge-base", "--is-ancestor", commit, from_commit], capture_output=True).returncode == 0


class _Run(InputPartition):
    """Commits by name, or `count` of a selection after the first `skip`."""

    def __init__(self, names: list[str] | None, selection: list[str] | None = None, skip: int = 0, count: int = 0):
        self.names, self.selection, self.skip, self.count = names, selection, skip, count


def _runs(root: str, selection: list[str], latest: bool = False) -> list[_Run]:
    """Partitions of a selection of hashes, by the number of its commits."""
    n = int(git(root, "rev-list", "--count", *(["-1"] if latest else []), *selection, "--"))
    size = max(COMMITS_PER_PARTITION, -(-n // MOST_PARTITIONS))
    return [_Run(None, selection, i, min(size, n - i)) for i in range(0, n, size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.table = options.get("table", "commits")
        self.range = options.get("range", "HEAD")
        self.latest = options.get("latest", "false").lower() == "true"
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else ""
            if column in {"commits": ("hash",), "content": ("commit", "path"), "range_diff": ("path", "status")}.get(self.table, ("commit", "path", "status")):
                values = {v for v in ((f.value,) if isinstance(f, EqualTo) else f.value) if v is not None}
                column = "commit" if column == "hash" else column
                self.only[column] = self.only[column] & values if column in self.only else values
            else:
                yield f

    def _named(self, selection: list[str]) -> list[str]:
        """The commits asked for that are in the selection."""
        names = sorted(x for x in self.only["commit"] if re.fullmatch(r"[0-9a-f]{40,64}", x))
        if self.latest:
            return [x for x in git(self.root, "rev-list", "-1", *selection, "--").split() if x in names]
        some, none = [x for x in selection if x[0] != "^"], [x[1:] for x in selection if x[0] == "^"]
        return [x for x in names if any(_reaches(self.root, x, y) for y in some) and not any(_reaches(self.root, x, y) for y in none)]

    def partitions(self) -> list[InputPartition]:
        if self.table == "range_diff":
            return [_Run([self.range])]
        selection = git(self.root, "rev-parse", "--revs-only", self.range, "--").split()
        if not selection:
            raise ValueError(f"no revision: {self.range}")
        if "commit" in self.only and len(self.only["commit"]) <= MOST_NAMES:
            names = self._named(selection)
            return [_Run(names[i : i + COMMITS_PER_PARTITION]) for i in range(0, len(names), COMMITS_PER_PARTITION)] or [_Run([])]
        return _runs(self.root, selection, self.latest) or [_Run([])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        names = partition.names
        if names is None:
            listed = git(self.root, "rev-list", f"--skip={partition.skip}", f"--max-count={partition.count}", *partition.selection, "--").split()
            names = [x for x in listed if x in self.only["commit"]] if "commit" in self.only else listed
        if self.table == "commits":
            if names:
                yield from _commits(self.root, "--no-walk=unsorted", *names)
            return
        paths, statuses = self.only.get("path"), self.only.get("status")
        wanted = lambda path, status: (paths is None or path in paths) and (statuses is None or status in statuses)
        one = {"diff_files": commit_diff, "content": commit_content, "range_diff": range_diff}[self.table]
        for name in names:
            yield from one(self.root, name, wanted)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if ".." in options.get("range", "HEAD") or options.get("table") == "range_diff":
            raise ValueError("a stream follows one revision, and the commits that it comes to reach")
        self.reader = _Reader(options)
        self.after = options.get("after", "")

    def _tip(self, revision: str) -> str:
        return git(self.reader.root, "rev-parse", "--verify", f"{revision}^{{commit}}").strip()

    def initialOffset(self) -> dict:
        return {"commit": self._tip(self.after) if self.after else ""}

    def latestOffset(self) -> dict:
        return {"commit": self._tip(self.reader.range)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["commit"] == end["commit"]:
            return []
        return _runs(self.reader.root, [end["commit"], *(["^" + start["commit"]] if start["commit"] else [])])

    def read(self, partition: _Run) -> Iterator[tuple]:
        return self.reader.read(partition)


class GitDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return {"commits": COMMITS, "diff_files": DIFF_FILES, "range_diff": DIFF_FILES, "content": CONTENT}[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format `git` known, and let Spark push filters to sources in Python, which it needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitDataSource)
