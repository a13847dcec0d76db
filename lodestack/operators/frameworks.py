"""Frameworks from manifests and from content.

All indicators are found in one pass over each file's content by an Aho-Corasick automaton, so the
time doesn't follow their number; no row is joined with the registry, and only the numbers of
the frameworks that a repository shows leave the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestack.functions.registry import FRAMEWORKS, IMPORTANT_FILES, PATTERNS, TYPE_ORDER, Framework
from lodestack.functions.scalar import is_pruned, is_source_file, language_of


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


@lru_cache(maxsize=8)
def _automaton(words: tuple[tuple[str, ...], ...]) -> tuple[ahocorasick.Automaton | None, tuple[int, ...]]:
    """The automaton whose outputs are, for each word, the numbers of the sets that it is of; and the sets with an empty word, which any text holds."""
    owners: dict[str, list[int]] = {}
    for k, some in enumerate(words):
        for w in set(some):
            owners.setdefault(w, []).append(k)
    always = tuple(owners.pop("", ()))
    if not owners:
        return None, always
    automaton = ahocorasick.Automaton()
    for w, numbers in owners.items():
        automaton.add_word(w, tuple(numbers))
    automaton.make_automaton()
    return automaton, always


def words_in(text: str, words: tuple[tuple[str, ...], ...]) -> set[int]:
    """Numbers of the sets of which the text holds a word."""
    automaton, always = _automaton(words)
    found = set(always)
    if automaton is not None:
        for _, numbers in automaton.iter(text):
            found.update(numbers)
    return found


def content_hits(files: DataFrame, frameworks: list[Framework] = FRAMEWORKS, language_filter: bool = False) -> DataFrame:
    """(repo_id, number) of frameworks that some source file shows. language_filter: only files of the framework's language count. Null content shows nothing."""
    words = tuple(tuple(f.indicators) for f in frameworks)
    languages = [f.language for f in frameworks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, set] = {}
            for i, (language, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                numbers = words_in(text, words)
                found[i] = {k for k in numbers if languages[k] == language} if language_filter else numbers
            pairs = [(i, k) for i, numbers in found.items() for k in sorted(numbers)]
            repos = batch.column(0).take(pa.array([i for i, _ in pairs], pa.int64()))
            yield pa.RecordBatch.from_arrays([repos, pa.array([k for _, k in pairs], pa.int32())], names=["repo_id", "number"])

    sources = files.where(~is_pruned(F.col("path")) & is_source_file(F.col("path")) & F.col("content").isNotNull())
    schema = StructType([files.schema["repo_id"], StructField("number", IntegerType())])
    return sources.select("repo_id", language_of(F.col("path")).alias("language"), "content").mapInArrow(run, schema).distinct()


def manifests(files: DataFrame) -> DataFrame:
    """(repo_id, package_json, go_mod, python, java) from files at the repositories' roots, in one aggregation."""
    names = ["package.json", "go.mod", "requirements.txt", "pyproject.toml", "pom.xml", "build.gradle"]
    text = lambda name: F.max(F.when(F.col("path") == name, F.col("content")))
    return files.where(F.col("path").isin(names)).groupBy("repo_id").agg(
        text("package.json").alias("package_json"), text("go.mod").alias("go_mod"),
        F.concat_ws("\n", text("requirements.txt"), text("pyproject.toml")).alias("python"), F.coalesce(text("pom.xml"), text("build.gradle")).alias("java"),
    )


def node_dependencies(package_json: Column) -> Column:
    """Names in dependencies and devDependencies; empty if the text is not JSON."""
    both = F.from_json(package_json, "dependencies map<string,string>, devDependencies map<string,string>")
    names = lambda part: F.coalesce(F.map_keys(both[part]), F.array().cast("array<string>"))
    return F.array_union(names("dependencies"), names("devDependencies"))


def manifest_hits(found: DataFrame, frameworks: list[Framework] = FRAMEWORKS) -> DataFrame:
    """(repo_id, number, place): place orders hits by manifest: node, go, python, java. found: as manifests() gives it.

    One pass: package.json is parsed once, each hit is a number and a place, and a framework's first place stays."""
    parsed = found.withColumn("node", node_dependencies(F.col("package_json")))
    hit = lambda test, k, place: F.when(test, F.struct(F.lit(k).alias("number"), F.lit(place).alias("place")))
    tests = []
    for k, f in enumerate(frameworks):
        in_node = reduce(lambda a, b: a | b, [F.array_contains("node", key) for key in f.package_keys])
        column = {"Go": "go_mod", "Python": "python", "Java": "java"}.get(f.language)
        elsewhere = hit(_any_in(F.col(column), f.package_keys), k, ("go_mod", "python", "java").index(column) + 1) if column else F.lit(None)
        tests.append(F.coalesce(hit(in_node, k, 0), elsewhere))
    return parsed.select("repo_id", F.explode(F.array_compact(F.array(*tests))).alias("h")).select("repo_id", "h.number", "h.place")


def detect(files: DataFrame, frameworks: list[Framework] = FRAMEWORKS, language_filter: bool = False) -> DataFrame:
    """(repo_id, ordinal, name, type, language): manifest hits first, then what only content shows."""
    by_manifest = manifest_hits(manifests(files), frameworks)
    by_content = content_hits(files, frameworks, language_filter).join(by_manifest, ["repo_id", "number"], "left_anti").withColumn("place", F.lit(4))
    return named(by_manifest.unionByName(by_content), frameworks)


def named(hits: DataFrame, frameworks: list[Framework] = FRAMEWORKS) -> DataFrame:
    """Numbers to names; the registry is a literal, as large as the code."""
    row = F.get(F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.type).alias("type"), F.lit(f.language).alias("language")) for f in frameworks]), F.col("number"))
    return hits.select("repo_id", (F.col("place") * len(frameworks) + F.col("number")).alias("ordinal"), row.alias("f")).select("repo_id", "ordinal", "f.*")


def by_type(detected: DataFrame) -> DataFrame:
    """(repo_id, rank, type, frameworks): types in the order they are shown, names in order of detection."""
    rank = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "language"))), lambda x: F.struct(x["name"].alias("name"), x["language"].alias("language")))
    return detected.groupBy("repo_id", rank.alias("rank"), "type").agg(listed.alias("frameworks"))


def patterns(detected: DataFrame, labels: dict[str, str] = PATTERNS) -> DataFrame:
    """(repo_id, pattern, ordinal): each label once, at its first framework."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("name"))
    return detected.withColumn("pattern", label).where("pattern is not null").groupBy("repo_id", "pattern").agg(F.min("ordinal").alias("ordinal"))


def important_files(files: DataFrame, names: list[str] = IMPORTANT_FILES) -> DataFrame:
    return files.where(F.col("path").isin(names)).select("repo_id", "path").distinct()
