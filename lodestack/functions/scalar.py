"""Column expressions. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.registry import EXTENSIONS, GENERIC_WORDS, IGNORED_DIRECTORIES, LOWEST_LEVEL, SIMILARITY_LEVELS, UNKNOWN

_PRUNED = r"(^|/)(\.[^/]*|" + "|".join(map(re.escape, IGNORED_DIRECTORIES)) + ")/"


def extension(path: Column) -> Column:
    """From the last dot of the last path segment, lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_of(path: Column, extensions: dict[str, str] = EXTENSIONS) -> Column:
    known = F.create_map(*[F.lit(x) for kv in extensions.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(UNKNOWN))


def is_source_file(path: Column) -> Column:
    return language_of(path) != UNKNOWN


def is_pruned(path: Column) -> Column:
    """Whether a directory on the way (relative to the repository) is left out of scans."""
    return path.rlike(_PRUNED)


def lines(content: Column) -> Column:
    """Lines of a text; an empty piece after the last line feed is none."""
    pieces = F.split(F.coalesce(content, F.lit("")), "\n", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def trimmed(line: Column) -> Column:
    """Without blanks, tabs, carriage returns and line feeds at either end."""
    return F.btrim(line, F.lit(" \t\r\n"))


def is_comment(line: Column) -> Column:
    """Two bytes or more, starting like a comment; a lone # is code."""
    t = trimmed(line)
    return (F.octet_length(t) >= 2) & (F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("#")) | F.startswith(t, F.lit("/*")))


def is_generic_name(name: Column, words: list[str] = GENERIC_WORDS) -> Column:
    return F.lower(name).rlike("|".join(map(re.escape, words)))


def has_invalid_name(name: Column) -> Column:
    """Shorter than two bytes, or without a lower-case letter."""
    return (F.octet_length(name) < 2) | (F.upper(name) == name)


def row_id(path: Column, name: Column, line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, name, line.cast("string")), 256), 1, 16)


def embedding_text(language: Column, name: Column, parameters: Column, return_type: Column, comments: Column, complexity: Column, loc: Column) -> Column:
    """The description of a function that is embedded; parts that are empty are left out."""
    part = lambda label, value, given: F.when(given, F.concat(F.lit(f"// {label}: "), value, F.lit("\n"))).otherwise("")
    always = F.lit(True)
    return F.concat(
        part("Language", language, always), part("Function", name, always),
        part("Parameters", F.concat(F.lit("["), F.array_join(parameters, " "), F.lit("]")), F.coalesce(F.size(parameters), F.lit(0)) > 0),
        part("Returns", return_type, F.coalesce(return_type, F.lit("")) != ""), part("Comments", comments, F.coalesce(comments, F.lit("")) != ""),
        part("Complexity", complexity.cast("string"), always), part("Lines", loc.cast("string"), always),
    )


def similarity_level(similarity: Column) -> Column:
    """Label of a similarity; bounds compare in single precision."""
    out = F.lit(LOWEST_LEVEL)
    for least, label in reversed(SIMILARITY_LEVELS):
        out = F.when(similarity >= F.lit(least).cast("float"), label).otherwise(out)
    return out


def shown_status(status: Column) -> Column:
    return F.when(F.coalesce(status, F.lit("")) == "", "M").otherwise(status)


def severity_icon(severity: Column) -> Column:
    return F.when(severity == "warning", "⚠️").when(severity == "error", "❌").otherwise("ℹ️")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, summed in double and narrowed to float; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms).cast("float")


def commit_fields(line: Column) -> Column:
    """Struct of a log line `hash|author|email|seconds|subject`; the subject keeps further bars; null for fewer fields."""
    p = F.split(line, r"\|", 5)
    get = lambda i: F.get(p, F.lit(i))
    return F.when(
        F.size(p) == 5,
        F.struct(get(0).alias("hash"), F.substring(get(0), 1, 7).alias("short_hash"), get(1).alias("author"), get(2).alias("email"), F.timestamp_seconds(F.coalesce(get(3).try_cast("long"), F.lit(0))).alias("date"), get(4).alias("message")),
    )


def numstat_fields(p: Column) -> Column:
    """Struct of the parts of a line `additions TAB deletions TAB path`; a dash (binary) counts 0; null for fewer parts."""
    n = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(F.size(p) == 3, F.struct(n(0).alias("additions"), n(1).alias("deletions"), F.get(p, F.lit(2)).alias("path")))
