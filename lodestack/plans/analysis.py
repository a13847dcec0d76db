"""The whole analysis of repositories, from files to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.config import Config
from lodestack.operators import embed, frameworks, goparse, languages, lines, metrics, rules
from lodestack.shared import stored


def analyse(files: DataFrame, config: Config | None = None, provider: embed.Provider | None = None, language_filter: bool = False) -> dict[str, DataFrame]:
    """files(repo_id, path, content) -> tables by name. Sources are parsed once, here; the rest is lazy. A file whose Go source is unparseable counts in none but `errors`."""
    config = config or Config()
    sources = languages.source_files(files)
    parsed = stored(goparse.parse_go(sources.where("language = 'Go'"), with_content=False), "parsed")
    bad = parsed.where("error is not null").select("repo_id", "path", "error")
    functions, structs = goparse.functions_of(parsed), goparse.structs_of(parsed)
    # numbers meet what is unparseable, not contents; an anti join would be moved below the counting
    counted = lines.line_metrics(sources).drop("content").join(bad.select("repo_id", "path", F.lit(True).alias("is_bad")), ["repo_id", "path"], "left").where("is_bad is null").drop("is_bad")
    stats = metrics.file_function_stats(counted, functions).withColumnRenamed("file_path", "path")
    n_structs = structs.groupBy("repo_id", F.col("file_path").alias("path")).agg(F.count("*").alias("class_count"))
    file_metrics = counted.join(stats, ["repo_id", "path"]).join(n_structs, ["repo_id", "path"], "left").withColumn("class_count", F.coalesce("class_count", F.lit(0)))
    detected = frameworks.detect(files, language_filter=language_filter)
    return {
        "languages": languages.language_counts(files), "frameworks": detected, "patterns": frameworks.patterns(detected), "important_files": frameworks.important_files(files),
        "file_metrics": file_metrics, "functions": functions, "structs": structs, "imports": goparse.imports_of(parsed),
        "issues": rules.issues(functions, config.analysis.complexity_threshold, config.analysis.max_function_length), "totals": metrics.repo_totals(file_metrics), "errors": bad,
    } | ({"embeddings": embed.embed(embed.describe(functions), provider)} if provider else {})


def detected_once(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables of analyse() whose frameworks are stored, for a use that wants the patterns, too: both come from a scan of all contents."""
    detected = stored(tables["frameworks"], "detected")
    return tables | {"frameworks": detected, "patterns": frameworks.patterns(detected)}
