"""All queries over the reference's own operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import registry
from lodestack.functions.scalar import commit_fields, row_id, severity_icon
from lodestack.operators import duplication, embed, frameworks, languages, lines, metrics, review, rules, similarity
from lodestack.plans import catalogue_changes, catalogue_code, catalogue_sources
from lodestack.plans.views import manifests, seeded_files, table, virtual_files, virtual_functions

# -- vectors ------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def knn_topk(spark, sf_dir):
    """Ten nearest of all vectors to vector 0, itself included."""
    index = _index(spark, sf_dir)
    vector = index.where("id = 0").first()["embedding"]
    top = similarity.search_one(index, similarity.literal(vector), 10)
    return top.select(F.col("id").alias("vec_id"), F.round(F.col("similarity").cast("double"), 6).alias("similarity"))


def knn_topk_batch(spark, sf_dir):
    """Five nearest of each tenth vector; the vector itself is not its own neighbour."""
    index = _index(spark, sf_dir)
    out = similarity.search(index, index.where("id % 10 = 0"), 5, exclude_self=True)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


def _pairs(threshold):
    def query(spark, sf_dir):
        out = similarity.similar_pairs(_index(spark, sf_dir), threshold)
        return out.select("id_a", "id_b", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))

    return query


def similarity_level_hist(spark, sf_dir):
    return similarity.level_histogram(_index(spark, sf_dir))


def vector_classes(spark, sf_dir):
    return similarity.classes(_index(spark, sf_dir))


def exact_duplicate_docs(spark, sf_dir):
    return duplication.exact_duplicates(table(spark, sf_dir, "documents"))


def duplicate_line_blocks(spark, sf_dir):
    out = duplication.duplicate_blocks(virtual_files(spark, sf_dir), 3)
    return out.select("hash", "n_places", "first_path", F.col("first_line").cast("long").alias("first_line"))


# -- files --------------------------------------------------------------------


def language_counts(spark, sf_dir):
    return languages.language_counts(virtual_files(spark, sf_dir))


def primary_language(spark, sf_dir):
    return languages.primary_language(languages.language_counts(virtual_files(spark, sf_dir)))


def source_files(spark, sf_dir):
    return languages.source_files(virtual_files(spark, sf_dir)).select("path", "language")


def line_metrics(spark, sf_dir):
    return lines.line_metrics(virtual_files(spark, sf_dir)).select("path", "blank_lines", "comment_lines", "lines_of_code")


def repo_totals(spark, sf_dir):
    counted = lines.line_metrics(languages.source_files(virtual_files(spark, sf_dir)))
    functions = F.expr("doc_id % 4").cast("long")
    stats = counted.withColumns({"function_count": functions, "class_count": F.expr("doc_id % 2"), "cyclomatic_complexity": functions * 3, "max_function_length": F.expr("doc_id % 100"), "avg_function_length": F.expr("cast(doc_id % 10 AS double)")})
    return metrics.repo_totals(stats).withColumn("avg_function_length", F.round("avg_function_length", 6))


def important_files(spark, sf_dir):
    return frameworks.important_files(manifests(spark, sf_dir))


def changed_source_files(spark, sf_dir):
    files = languages.source_files(virtual_files(spark, sf_dir))
    diff = virtual_files(spark, sf_dir).where("doc_id % 3 = 0").select("path").unionAll(spark.sql("SELECT 'gone.go' AS path"))
    return review.changed_files(files, diff).select("path", "language")


# -- functions ----------------------------------------------------------------


def complexity_issues(spark, sf_dir):
    return rules.complexity_issues(virtual_functions(spark, sf_dir))


def length_issues(spark, sf_dir):
    return rules.length_issues(virtual_functions(spark, sf_dir))


def issue_summary(spark, sf_dir):
    f = virtual_functions(spark, sf_dir)
    return metrics.issue_summary(rules.issues(f).unionByName(rules.naming_issues(f)))


def ai_patterns(spark, sf_dir):
    out = rules.ai_patterns(virtual_functions(spark, sf_dir))
    return out.select("file_path", "name", "start_line", "end_line", F.round("confidence", 6).alias("confidence"), F.array_join("indicators", "; ").alias("indicators"))


def naming_issues(spark, sf_dir):
    return rules.naming_issues(virtual_functions(spark, sf_dir)).select("file_path", "line", "type", "severity", "message")


def _top(by):
    def query(spark, sf_dir):
        return by(virtual_functions(spark, sf_dir)).select("file_path", "name", "start_line", "loc", "complexity")

    return query


def file_function_stats(spark, sf_dir):
    functions = virtual_functions(spark, sf_dir)
    files = table(spark, sf_dir, "supplier").select(F.lit("corpus").alias("repo_id"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit(".go")).alias("path")).unionAll(spark.sql("SELECT 'corpus', 'empty.go'"))
    out = metrics.file_function_stats(files, functions)
    return out.withColumn("avg_function_length", F.round("avg_function_length", 6)).drop("repo_id")


def embedding_ids(spark, sf_dir):
    return virtual_functions(spark, sf_dir).select("file_path", "name", "start_line", row_id(F.col("file_path"), F.col("name"), F.col("start_line")).alias("id"))


def embedding_snippets(spark, sf_dir):
    return embed.describe(virtual_functions(spark, sf_dir)).select("id", "language", "code")


# -- frameworks ---------------------------------------------------------------


def framework_hits(spark, sf_dir):
    hits = frameworks.content_hits(seeded_files(spark, sf_dir)).withColumn("place", F.lit(4))
    return frameworks.named(hits).select("repo_id", "name", "type", "language")


def framework_new_hits(spark, sf_dir):
    """Content hits less what a manifest has shown already (React)."""
    hits = frameworks.content_hits(seeded_files(spark, sf_dir)).withColumn("place", F.lit(4))
    known = spark.sql("SELECT 'corpus' AS repo_id, 'React' AS name")
    return frameworks.named(hits).join(known, ["repo_id", "name"], "left_anti").select("repo_id", "name")


def manifest_frameworks(spark, sf_dir):
    """Hits in package.json, go.mod, Python and Java manifests."""
    hits = frameworks.manifest_hits(frameworks.manifests(manifests(spark, sf_dir)))
    return frameworks.named(hits).select("repo_id", "name")


def node_deps_match(spark, sf_dir):
    found = frameworks.manifests(manifests(spark, sf_dir)).select("repo_id", F.explode(frameworks.node_dependencies(F.col("package_json"))).alias("dependency"))
    return found.groupBy("dependency").agg(F.count("*").alias("n"))


def frameworks_by_type(spark, sf_dir):
    detected = frameworks.detect(manifests(spark, sf_dir))
    out = frameworks.by_type(detected)
    return out.select("repo_id", F.col("rank").cast("long").alias("rank"), "type", F.array_join(F.transform("frameworks", lambda f: f["name"]), ", ").alias("names"))


def arch_patterns(spark, sf_dir):
    return frameworks.patterns(frameworks.detect(manifests(spark, sf_dir))).select("repo_id", "pattern")


# -- commits ------------------------------------------------------------------


def _commits(spark, sf_dir) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    line = F.concat_ws("|", F.sha2(F.col("o_orderkey").cast("string"), 256), "c_name", F.concat("c_mktsegment", F.lit("@x")), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), F.concat("o_orderpriority", F.lit("|"), "o_orderstatus"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(commit_fields(line).alias("c")).where("c is not null").select("c.*")


def commit_parse(spark, sf_dir):
    return _commits(spark, sf_dir).select("hash", "short_hash", "author", "email", F.unix_seconds("date").alias("seconds"), "message")


def latest_commit(spark, sf_dir):
    return review.latest_commit(_commits(spark, sf_dir)).select("hash", "author", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


def _numstat(spark, sf_dir) -> DataFrame:
    line = F.concat_ws("\t", F.when(F.col("l_linenumber") == 7, "-").otherwise(F.col("l_quantity").cast("int").cast("string")), F.col("l_linenumber").cast("string"), F.concat(F.lit("a b/f"), F.col("l_partkey").cast("string"), F.lit(".go")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), line.alias("line"), F.concat(F.lit("a b/f"), F.col("l_partkey").cast("string"), F.lit(".go")).alias("path"), "l_linestatus", "l_returnflag")


def diff_stats(spark, sf_dir):
    n = _numstat(spark, sf_dir)
    return review.diff_summary(review.changes(n.select("commit", "line")))


def diff_status_default(spark, sf_dir):
    n = _numstat(spark, sf_dir)
    statuses = n.where("l_returnflag = 'A'").groupBy("commit", "path").agg(F.min("l_linestatus").alias("status"))
    out = review.changes(n.select("commit", "line"), statuses)
    return out.groupBy("commit", "path").agg(F.min("status").alias("status"), F.sum("additions").cast("long").alias("additions"), F.sum("deletions").cast("long").alias("deletions"))


def severity_icons(spark, sf_dir):
    """Severities by icon, over the labels of all line items."""
    s = F.when(F.col("l_returnflag") == "A", "warning").when(F.col("l_returnflag") == "N", "error").otherwise("info")
    return table(spark, sf_dir, "lineitem").select(severity_icon(s).alias("icon")).groupBy("icon").agg(F.count("*").alias("n"))


def event_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {
        "knn_topk": knn_topk, "knn_topk_batch": knn_topk_batch, "vector_dup_pairs_03": _pairs(0.3), "vector_dup_pairs_05": _pairs(0.5),
        "similarity_level_hist": similarity_level_hist, "vector_classes": vector_classes, "exact_duplicate_docs": exact_duplicate_docs, "duplicate_line_blocks": duplicate_line_blocks,
        "language_counts": language_counts, "primary_language": primary_language, "source_files": source_files, "line_metrics": line_metrics, "repo_totals": repo_totals,
        "important_files": important_files, "changed_source_files": changed_source_files,
        "complexity_issues": complexity_issues, "length_issues": length_issues, "issue_summary": issue_summary, "ai_patterns": ai_patterns, "naming_issues": naming_issues,
        "top_complexity": _top(metrics.top_by_complexity), "top_length": _top(metrics.top_by_length), "file_function_stats": file_function_stats,
        "embedding_ids": embedding_ids, "embedding_snippets": embedding_snippets,
        "framework_hits": framework_hits, "framework_new_hits": framework_new_hits, "manifest_frameworks": manifest_frameworks, "node_deps_match": node_deps_match,
        "frameworks_by_type": frameworks_by_type, "arch_patterns": arch_patterns,
        "commit_parse": commit_parse, "latest_commit": latest_commit, "diff_stats": diff_stats, "diff_status_default": diff_status_default, "severity_icons": severity_icons, "event_props_json": event_props_json,
    } | catalogue_sources.queries() | catalogue_code.queries() | catalogue_changes.queries()


# -- the same in DuckDB -------------------------------------------------------

_FILES = """files AS (
  SELECT 'corpus' AS repo_id, doc_id, 'src/' || source || '/f' || doc_id ||
    CASE doc_id % 8 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.TSX' WHEN 3 THEN '.h' WHEN 4 THEN '.cc' WHEN 5 THEN '.md' WHEN 6 THEN '.kts' ELSE '' END AS path,
    CASE doc_id % 4 WHEN 0 THEN '// lic' || chr(10) || chr(10) WHEN 1 THEN '# hdr' || chr(10) || ' ' || chr(10) WHEN 2 THEN '/* blk */' || chr(10) || '#' || chr(10) ELSE '' END
      || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END AS content
  FROM documents
), sources AS (
  SELECT *, CASE doc_id % 8 WHEN 0 THEN 'Go' WHEN 1 THEN 'Python' WHEN 2 THEN 'TypeScript' WHEN 3 THEN 'C' WHEN 4 THEN 'C++' WHEN 6 THEN 'Kotlin' END AS language
  FROM files WHERE doc_id % 8 NOT IN (5, 7)
), pieces AS (SELECT *, string_split(content, chr(10)) AS p FROM files
), cut AS (SELECT *, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS raw FROM pieces
), trimmed AS (SELECT *, list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))) AS l FROM cut
), counted AS (
  SELECT *, len(list_filter(l, lambda x: x = ''))::BIGINT AS blank_lines,
    len(list_filter(l, lambda x: octet_length(encode(x)) >= 2 AND (starts_with(x, '//') OR starts_with(x, '#') OR starts_with(x, '/*'))))::BIGINT AS comment_lines FROM trimmed
), lined AS (SELECT *, (len(l) - blank_lines - comment_lines)::BIGINT AS lines_of_code FROM counted)"""

_FUNCTIONS = """functions AS (
  SELECT 'corpus' AS repo_id, 'f' || l_suppkey || '.go' AS file_path,
    CASE l_partkey % 5 WHEN 0 THEN 'UserManager' WHEN 1 THEN 'getHTTPhelper' WHEN 2 THEN 'X' WHEN 3 THEN 'RUN' ELSE 'loadRow' END
      || CASE WHEN l_partkey % 5 IN (2, 3) THEN '' ELSE l_partkey::VARCHAR END AS name,
    (l_orderkey * 100 + l_linenumber * 10)::INTEGER AS start_line, (l_orderkey * 100 + l_linenumber * 10 + floor(l_quantity * 2.5))::INTEGER AS end_line,
    floor(l_quantity * 2.5)::INTEGER + 1 AS loc, (1 + l_orderkey % 27)::INTEGER AS complexity, (l_suppkey % 8)::INTEGER AS n_params,
    CASE WHEN l_linenumber = 1 THEN 'first' ELSE '' END AS comments
  FROM lineitem
)"""

_COMPLEX = "SELECT repo_id, file_path, 'complexity' AS type, 'warning' AS severity, start_line AS line, 'Function ''' || name || ''' has high complexity: ' || complexity AS message, 'Consider breaking down this function into smaller functions' AS suggestion FROM functions WHERE complexity > 10"
_LONG = "SELECT repo_id, file_path, 'function_length' AS type, 'warning' AS severity, start_line AS line, 'Function ''' || name || ''' is too long: ' || loc || ' lines' AS message, 'Consider refactoring into smaller functions' AS suggestion FROM functions WHERE loc > 50"
_NAMING = "SELECT repo_id, file_path, 'naming' AS type, 'info' AS severity, start_line AS line, 'Function ''' || name || ''' may not follow naming conventions' AS message, NULL AS suggestion FROM functions WHERE octet_length(encode(name)) < 2 OR upper(name) = name"

_SEEDED = """seeded AS (
  SELECT 'corpus' AS repo_id, text || CASE doc_id % 5 WHEN 0 THEN 'gin.Default()' WHEN 1 THEN 'useState' WHEN 2 THEN 'FastAPI(' WHEN 3 THEN 'x-data' ELSE '' END AS content FROM documents
)"""


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


_REGISTRY = f"registry AS (SELECT * FROM {_values([(k, f.name, f.type, f.language) for k, f in enumerate(registry.FRAMEWORKS)])} AS t(number, name, type, language))"
_INDICATORS = f"indicators AS (SELECT * FROM {_values([(f.name, i) for f in registry.FRAMEWORKS for i in f.indicators])} AS t(name, word))"
_KEYS = f"package_keys AS (SELECT * FROM {_values([(f.name, i) for f in registry.FRAMEWORKS for i in f.package_keys])} AS t(name, word))"
_HITS = f"{_SEEDED}, {_REGISTRY}, {_INDICATORS}, hits AS (SELECT DISTINCT repo_id, r.name, r.type, r.language FROM seeded JOIN indicators i ON contains(content, i.word) JOIN registry r USING (name))"

_MANIFESTS = f"""m AS (
  SELECT 'r' || s_suppkey AS repo_id, [CASE s_suppkey % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'vue' WHEN 2 THEN 'left-pad' ELSE 'next' END, CASE s_suppkey % 3 WHEN 0 THEN 'vite' WHEN 1 THEN 'webpack' ELSE 'jest' END] AS node,
    CASE WHEN s_suppkey % 5 = 0 THEN 'require github.com/gin-gonic/gin v1.9' ELSE 'module x' END AS go,
    CASE s_suppkey % 3 WHEN 0 THEN 'Django==4' WHEN 1 THEN 'flask-x==1' ELSE 'numpy' END AS python,
    CASE WHEN s_suppkey % 7 = 0 THEN '<artifactId>spring-boot-starter-web' ELSE 'none' END AS java, s_suppkey
  FROM supplier
), {_REGISTRY}, {_KEYS}, hits AS (
  SELECT repo_id, name, min(place) AS place FROM (
    SELECT repo_id, name, 0 AS place FROM m JOIN package_keys k ON list_contains(node, k.word)
    UNION ALL SELECT repo_id, name, 1 FROM m JOIN package_keys k ON contains(go, k.word) JOIN registry USING (name) WHERE language = 'Go'
    UNION ALL SELECT repo_id, name, 2 FROM m JOIN package_keys k ON contains(python, k.word) JOIN registry USING (name) WHERE language = 'Python'
    UNION ALL SELECT repo_id, name, 3 FROM m JOIN package_keys k ON contains(java, k.word) JOIN registry USING (name) WHERE language = 'Java'
  ) GROUP BY repo_id, name
), detected AS (SELECT repo_id, place * 30 + number AS ordinal, r.* FROM hits JOIN registry r USING (name))"""

_COMMITS = """commits AS (
  SELECT sha256(o_orderkey::VARCHAR) AS hash, c_name AS author, c_mktsegment || '@x' AS email, epoch(o_orderdate)::BIGINT AS seconds, o_orderpriority || '|' || o_orderstatus AS message, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

_NUMSTAT = """numstat AS (
  SELECT l_orderkey::VARCHAR AS commit, 'a b/f' || l_partkey || '.go' AS path, CASE WHEN l_linenumber = 7 THEN 0 ELSE floor(l_quantity)::BIGINT END AS additions, l_linenumber::BIGINT AS deletions, l_returnflag, l_linestatus FROM lineitem
)"""

_VECTORS = "v AS (SELECT min(vec_id) AS id, embedding FROM embeddings GROUP BY embedding), pairs AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])::FLOAT AS s FROM v a JOIN v b ON a.id < b.id)"


def oracle_sql() -> dict[str, str]:
    pair = lambda t: f"WITH {_VECTORS} SELECT id_a, id_b, round(s::DOUBLE, 5) AS similarity FROM pairs WHERE s >= {t}::FLOAT"
    top = lambda by: f"WITH {_FUNCTIONS} SELECT file_path, name, start_line, loc, complexity FROM functions ORDER BY {by} DESC, repo_id, file_path, start_line, name, {'complexity' if by == 'loc' else 'loc'} LIMIT 10"
    return {
        "knn_topk": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))::FLOAT::DOUBLE, 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))::FLOAT DESC, vec_id LIMIT 10",
        "knn_topk_batch": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])::FLOAT AS s FROM embeddings q JOIN embeddings e ON q.vec_id % 10 = 0 AND q.vec_id <> e.vec_id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, id, round(s::DOUBLE, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5",
        "vector_dup_pairs_03": pair(0.3), "vector_dup_pairs_05": pair(0.5),
        "similarity_level_hist": f"WITH {_VECTORS} SELECT CASE WHEN s >= 0.95::FLOAT THEN 'Nearly Identical' WHEN s >= 0.85::FLOAT THEN 'Very Similar' WHEN s >= 0.75::FLOAT THEN 'Similar' WHEN s >= 0.60::FLOAT THEN 'Somewhat Similar' ELSE 'Different' END AS level, count(*) AS n FROM pairs GROUP BY 1",
        "vector_classes": "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM embeddings",
        "exact_duplicate_docs": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "duplicate_line_blocks": f"WITH {_FILES}, numbered AS (SELECT path, x, i FROM (SELECT path, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM lined) WHERE x <> ''), runs AS (SELECT path, i, sha256(x || chr(10) || lead(x) OVER w || chr(10) || lead(x, 2) OVER w) AS hash FROM numbered WINDOW w AS (PARTITION BY path ORDER BY i)) SELECT hash, count(*) AS n_places, min((path, i))[1] AS first_path, min((path, i))[2] AS first_line FROM runs WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1",
        "language_counts": f"WITH {_FILES} SELECT repo_id, language, count(*) AS n_files FROM sources GROUP BY ALL",
        "primary_language": f"WITH {_FILES}, n AS (SELECT repo_id, language, count(*) AS n FROM sources GROUP BY ALL) SELECT repo_id, language FROM n QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) = 1",
        "source_files": f"WITH {_FILES} SELECT path, language FROM sources",
        "line_metrics": f"WITH {_FILES} SELECT path, blank_lines, comment_lines, lines_of_code FROM lined",
        "repo_totals": f"WITH {_FILES} SELECT repo_id, count(*) AS file_count, sum(lines_of_code)::BIGINT AS lines_of_code, sum(comment_lines)::BIGINT AS comment_lines, sum(blank_lines)::BIGINT AS blank_lines, sum(doc_id % 4 * 3)::BIGINT AS cyclomatic_complexity, sum(doc_id % 4)::BIGINT AS function_count, sum(doc_id % 2)::BIGINT AS class_count, max(doc_id % 100) AS max_function_length, round(sum((doc_id % 10)::DOUBLE * (doc_id % 4)) / sum(doc_id % 4), 6) AS avg_function_length FROM lined WHERE doc_id % 8 NOT IN (5, 7) GROUP BY repo_id",
        "important_files": "SELECT 'r' || s_suppkey AS repo_id, unnest(['package.json', 'go.mod', 'requirements.txt', CASE WHEN s_suppkey % 2 = 0 THEN 'pom.xml' ELSE 'build.gradle' END]) AS path FROM supplier",
        "changed_source_files": f"WITH {_FILES} SELECT path, language FROM sources WHERE doc_id % 3 = 0",
        "complexity_issues": f"WITH {_FUNCTIONS} {_COMPLEX}", "length_issues": f"WITH {_FUNCTIONS} {_LONG}",
        "issue_summary": f"WITH {_FUNCTIONS}, i AS ({_COMPLEX} UNION ALL {_LONG} UNION ALL {_NAMING}) SELECT repo_id, 'type' AS by, type AS value, count(*) AS n FROM i GROUP BY ALL UNION ALL SELECT repo_id, 'severity', severity, count(*) FROM i GROUP BY ALL UNION ALL SELECT repo_id, 'total', '', count(*) FROM i GROUP BY ALL",
        "ai_patterns": f"WITH {_FUNCTIONS}, t AS (SELECT *, regexp_matches(lower(name), 'manager|helper|util|processor|handler|service|controller|provider|factory|builder|wrapper|adapter') AS g FROM functions), s AS (SELECT *, (CASE WHEN g THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN loc > 100 THEN 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN complexity > 20 THEN 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN n_params > 5 THEN 0.2 ELSE 0 END)::DOUBLE AS c FROM t) SELECT file_path, name, start_line, end_line, round(c, 6) AS confidence, concat_ws('; ', CASE WHEN g THEN 'Generic function name' END, CASE WHEN loc > 100 THEN 'Excessively long function' END, CASE WHEN complexity > 20 THEN 'Very high complexity' END, CASE WHEN n_params > 5 THEN 'Too many parameters' END) AS indicators FROM s WHERE c > 0.5::DOUBLE",
        "naming_issues": f"WITH {_FUNCTIONS}, i AS ({_NAMING}) SELECT file_path, line, type, severity, message FROM i",
        "top_complexity": top("complexity"), "top_length": top("loc"),
        "file_function_stats": f"WITH {_FUNCTIONS}, f AS (SELECT 'f' || s_suppkey || '.go' AS file_path FROM supplier UNION ALL SELECT 'empty.go') SELECT f.file_path, count(name) AS function_count, coalesce(max(loc), 0)::BIGINT AS max_function_length, round(coalesce(avg(loc), 0)::DOUBLE, 6) AS avg_function_length, coalesce(sum(complexity), 0)::BIGINT AS cyclomatic_complexity FROM f LEFT JOIN functions USING (file_path) GROUP BY 1",
        "embedding_ids": f"WITH {_FUNCTIONS} SELECT file_path, name, start_line, left(sha256(file_path || ':' || name || ':' || start_line), 16) AS id FROM functions",
        "embedding_snippets": f"WITH {_FUNCTIONS} SELECT left(sha256(file_path || ':' || name || ':' || start_line), 16) AS id, 'Go' AS language, '// Language: Go' || chr(10) || '// Function: ' || name || chr(10) || CASE WHEN n_params > 0 THEN '// Parameters: [' || array_to_string(['a', 'b', 'c', 'd', 'e', 'f', 'g'][1:n_params], ' ') || ']' || chr(10) ELSE '' END || CASE WHEN comments <> '' THEN '// Comments: ' || comments || chr(10) ELSE '' END || '// Complexity: ' || complexity || chr(10) || '// Lines: ' || loc || chr(10) AS code FROM functions",
        "framework_hits": f"WITH {_HITS} SELECT * FROM hits", "framework_new_hits": f"WITH {_HITS} SELECT repo_id, name FROM hits WHERE name <> 'React'",
        "manifest_frameworks": f"WITH {_MANIFESTS} SELECT repo_id, name FROM hits",
        "node_deps_match": f"WITH {_MANIFESTS} SELECT dependency, count(*) AS n FROM (SELECT unnest(node) AS dependency FROM m) GROUP BY 1",
        "frameworks_by_type": f"WITH {_MANIFESTS} SELECT repo_id, list_position({registry.TYPE_ORDER}, type)::BIGINT AS rank, type, string_agg(name, ', ' ORDER BY ordinal) AS names FROM detected GROUP BY repo_id, type",
        "arch_patterns": f"WITH {_MANIFESTS}, p AS (SELECT * FROM {_values(list(registry.PATTERNS.items()))} AS t(name, pattern)) SELECT DISTINCT repo_id, pattern FROM detected JOIN p USING (name)",
        "commit_parse": f"WITH {_COMMITS} SELECT hash, left(hash, 7) AS short_hash, author, email, seconds, message FROM commits",
        "latest_commit": f"WITH {_COMMITS} SELECT hash, author, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date FROM commits ORDER BY seconds DESC, hash LIMIT 1",
        "diff_stats": f"WITH {_NUMSTAT} SELECT commit, count(*) AS n_files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM numstat GROUP BY 1",
        "diff_status_default": f"WITH {_NUMSTAT}, s AS (SELECT commit, path, min(l_linestatus) AS status FROM numstat WHERE l_returnflag = 'A' GROUP BY ALL) SELECT n.commit, n.path, min(coalesce(s.status, 'M')) AS status, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM numstat n LEFT JOIN s ON s.commit = n.commit AND s.path = n.path GROUP BY ALL",
        "severity_icons": "SELECT CASE l_returnflag WHEN 'A' THEN '⚠️' WHEN 'N' THEN '❌' ELSE 'ℹ️' END AS icon, count(*) AS n FROM lineitem GROUP BY 1",
        "event_props_json": "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    } | catalogue_sources.oracle_sql() | catalogue_code.oracle_sql() | catalogue_changes.oracle_sql()
