"""Queries over Go sources, scans, whole detections, near vectors, providers and patches, with their DuckDB SQL.

The sources are written from templates whose functions, structs, imports, lines and
complexity follow from the document's id; the document's text stands in a string
literal, so that nothing in it may count. Each eleventh source does not parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import is_pruned, language_of, shown_status
from lodestack.operators import embed, frameworks, goparse, metrics, review, rules, similarity
from lodestack.plans.analysis import analyse, detected_once
from lodestack.plans.views import manifests, table, virtual_functions
from lodestack.sources.files import read_tree
from lodestack.store import context_document

# A source by document; {string} and {n} are filled in.
_GO = """
SELECT concat('r', cast(doc_id % 10 AS {string})) AS repo_id, doc_id, concat('src/f', cast(doc_id AS {string}), '.go') AS path,
  concat('package p', cast(doc_id % 7 AS {string}), '{n}{n}import "fmt"{n}import ({n}  x', cast(doc_id AS {string}), ' "os"{n}  "strings"{n}){n}{n}',
    '// Box', cast(doc_id AS {string}), ' holds numbers.{n}type Box', cast(doc_id AS {string}), ' struct {{{n}  a, b int{n}  name map[string][]func(int) error{n}}}{n}{n}',
    '// Run', cast(doc_id AS {string}), ' runs.{n}func (b *Box', cast(doc_id AS {string}), ') Run', cast(doc_id AS {string}), '(xs []int, n int) error {{{n}',
    repeat('  if n > 0 && n < 9 {{ n++ }} // if for &&{n}', cast(doc_id % 5 AS int)),
    '  switch n {{{n}  case 1:{n}  default:{n}  }}{n}  return nil{n}}}{n}{n}',
    'func helper', cast(doc_id AS {string}), '() {{{n}', repeat('  for i := 0; i < 3; i++ {{{n}  }}{n}', cast(doc_id % 31 AS int)), '}}{n}{n}',
    CASE WHEN doc_id % 11 = 0 THEN 'func broken( {{{n}' ELSE '' END,
    'var text = `if for && || func x() {{ ', replace(coalesce(text, ''), '`', ''), '`{n}') AS content
FROM {documents}
"""


def go_files(spark, sf_dir: str) -> DataFrame:
    return spark.sql(_GO.format(string="string", n="\\n", documents="{documents}").replace("{", "{{").replace("}", "}}").replace("{{documents}}", "{documents}"), documents=table(spark, sf_dir, "documents"))


def _parsed(spark, sf_dir: str) -> DataFrame:
    return goparse.parse_go(go_files(spark, sf_dir), with_content=False)


def go_functions(spark, sf_dir):
    """Functions of Go sources: places, length, complexity, parameters, visibility, comments."""
    f = goparse.functions_of(_parsed(spark, sf_dir))
    return f.select("repo_id", "file_path", "name", "start_line", "end_line", "loc", "complexity", F.array_join("parameters", ",").alias("parameters"), "is_exported", "comments")


def go_structs(spark, sf_dir):
    fields = F.array_join(F.transform("fields", lambda x: F.concat(x["name"], F.lit(" "), x["type"])), "; ")
    return goparse.structs_of(_parsed(spark, sf_dir)).select("repo_id", "file_path", "name", "start_line", "end_line", fields.alias("fields"), "is_exported")


def go_imports(spark, sf_dir):
    return goparse.imports_of(_parsed(spark, sf_dir)).select("repo_id", "file_path", F.col("path").alias("import_path"), F.coalesce("alias", F.lit("")).alias("alias"))


def go_errors(spark, sf_dir):
    """Sources that don't parse: they have an error and nothing else."""
    return _parsed(spark, sf_dir).where("error is not null and size(functions) = 0").select("repo_id", "path")


def go_issues(spark, sf_dir):
    return rules.issues(goparse.functions_of(_parsed(spark, sf_dir))).select("repo_id", "file_path", "type", "line", "message")


def go_totals(spark, sf_dir):
    """Totals of a whole analysis by repository; sources that don't parse don't count."""
    return analyse(go_files(spark, sf_dir))["totals"].withColumn("avg_function_length", F.round("avg_function_length", 6))


def go_contexts(spark, sf_dir):
    """Fields of each repository's context document."""
    value = context_document(detected_once(analyse(go_files(spark, sf_dir))))
    at = lambda path: F.get_json_object("value", path).cast("long")
    return value.select("repo_id", at("$.detection.languages.Go").alias("n_go"), at("$.analysis.totals.function_count").alias("n_functions"), at("$.analysis.total_issues").alias("n_issues"))


def functions_to_embed(spark, sf_dir):
    """How many functions are described for embedding, by repository."""
    return embed.describe(goparse.functions_of(_parsed(spark, sf_dir))).groupBy("repo_id").agg(F.count("*").alias("n"))


def embedding_returns(spark, sf_dir):
    """Descriptions of functions some of which have a result type."""
    f = virtual_functions(spark, sf_dir).withColumn("return_type", F.when(F.col("is_exported"), "error"))
    return embed.describe(f).select("id", F.sha2(F.col("code").cast("binary"), 256).alias("code_sha256"))


# -- scans and detection ------------------------------------------------------


def scanned_files(spark, sf_dir):
    """Files of a scan: ignored directories are left out wherever they are on the way, and no others."""
    path = F.concat(F.expr("""CASE doc_id % 12 WHEN 0 THEN 'src/' WHEN 1 THEN 'vendor/' WHEN 2 THEN 'a/node_modules/b/' WHEN 3 THEN '.git/' WHEN 4 THEN 'vendored/' WHEN 5 THEN 'x/target/y/'
      WHEN 6 THEN 'dist/' WHEN 7 THEN 'build.d/' WHEN 8 THEN 'p/__pycache__/' WHEN 9 THEN 'build/' WHEN 10 THEN 'a.b/.hidden/' ELSE '' END"""), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".rs")))
    return table(spark, sf_dir, "documents").select(path.alias("path")).where(~is_pruned(F.col("path"))).select("path", language_of(F.col("path")).alias("language"))


def tree_paths(spark, sf_dir):
    """Paths of a source tree on disk (the folder of the tables) by Spark's binary reader; tables that are folders count once."""
    paths = read_tree(spark, sf_dir, "tables").select("repo_id", F.regexp_replace("path", r"\.parquet/.*$", ".parquet").alias("path"))
    return paths.where(F.col("path").endswith(".parquet")).distinct()


def detected_frameworks(spark, sf_dir):
    """Manifests first, then what only sources show; sources below ignored directories and unknown files show nothing."""
    key = "cast(s_suppkey AS string)"
    sources = spark.sql(
        f"""SELECT concat('r', {key}) AS repo_id, m.path, m.content FROM {{supplier}} LATERAL VIEW explode(array(
          struct('src/main.go' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'r := gin.Default()' WHEN 1 THEN 'useState(1)' ELSE 'plain' END AS content),
          struct('vendor/v.go' AS path, 'app = FastAPI()' AS content), struct('notes.md' AS path, '<div x-data>' AS content))) t AS m""",
        supplier=table(spark, sf_dir, "supplier"),
    )
    return frameworks.detect(manifests(spark, sf_dir).unionByName(sources)).select("repo_id", "ordinal", "name", "type", "language")


# -- vectors ------------------------------------------------------------------


def _near_index(spark, sf_dir) -> DataFrame:
    """Every vector and a copy of it that is moved along one axis, by more or less."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    moved = F.expr("transform(embedding, (x, i) -> CASE WHEN i = vec_id % 64 THEN x + CASE vec_id % 5 WHEN 0 THEN 0.125F WHEN 1 THEN 0.375F WHEN 2 THEN 0.5625F WHEN 3 THEN 0.75F ELSE 1.5F END ELSE x END)")
    name = lambda c: F.concat(F.lit(c), F.col("vec_id").cast("string"))
    own = v.select(F.col("vec_id").alias("id"), "embedding", name("f").alias("file_path"), name("own").alias("func_name"))
    return own.unionByName(v.select((F.col("vec_id") + 1_000_000).alias("id"), moved.alias("embedding"), name("f").alias("file_path"), name("moved").alias("func_name")))


def near_vector_pairs(spark, sf_dir):
    """Pairs at the default threshold."""
    return similarity.similar_pairs(_near_index(spark, sf_dir), 0.0).select("id_a", "id_b", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


def near_vector_levels(spark, sf_dir):
    """All levels occur."""
    return similarity.level_histogram(_near_index(spark, sf_dir))


def duplicates_of_function(spark, sf_dir):
    """What duplicates one function's vector, at the default threshold and without the function itself."""
    index = _near_index(spark, sf_dir)
    vector = index.where("id = 0").first()["embedding"]
    found = similarity.without_self(similarity.find_duplicates(index, similarity.literal(vector), -1, 0.0), "f0", "own0")
    return found.select("id", "file_path", "func_name", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


class LetterProvider:
    """Counts of the letters a to h: an embedding that SQL can give, too."""

    name = "letters"

    def embed(self, text: str) -> list[float]:
        return [float(text.count(c)) for c in "abcdefgh"]


class DownProvider:
    """Never there."""

    name = "down"

    def embed(self, text: str) -> list[float]:
        raise OSError("no connection")


def _letter_index(spark, sf_dir, provider) -> DataFrame:
    return embed.embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("code")), provider)


def search_by_text(spark, sf_dir):
    """Ten nearest documents to a text, by a provider's vectors."""
    found = similarity.search_text(_letter_index(spark, sf_dir, LetterProvider()), LetterProvider(), "a bad face, each edge had a cabbage", 10)
    return found.select("id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


def provider_chain(spark, sf_dir):
    """A chain whose first provider is down: the second makes all vectors, and rows say so with the vectors' true length."""
    out = _letter_index(spark, sf_dir, embed.Chain([DownProvider(), LetterProvider()]))
    return out.select("id", "provider", F.col("dim").cast("long").alias("dim"), F.col("embedding")[0].cast("double").alias("first"), F.col("error").isNull().alias("fine"))


def provider_errors(spark, sf_dir):
    """A lone provider that is down: each row stays, with an error."""
    return _letter_index(spark, sf_dir, DownProvider()).groupBy("provider", "error").agg(F.count("*").alias("n"), F.count("embedding").alias("n_vectors"))


# -- changes ------------------------------------------------------------------


def _changes(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey AS string) AS commit", "concat('a b/f', cast(l_partkey AS string), '.go') AS path", "l_returnflag", "l_linestatus", "l_linenumber")
    numstat = items.groupBy("commit", "path").agg(F.concat_ws("\t", F.sum("l_linenumber").cast("string"), F.lit("-"), F.col("path")).alias("line"))
    statuses = items.where("l_returnflag <> 'A'").groupBy("commit", "path").agg(F.max(F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise("D")).alias("status"))
    patches = items.where("l_returnflag = 'R'").groupBy("commit", "path").agg(F.min(F.concat(F.lit("@@ "), F.col("path"), F.lit(" "), F.col("l_linestatus"), F.lit("\n"))).alias("patch"))
    return review.changes(numstat, statuses, patches)


def diff_patches(spark, sf_dir):
    """Changes with their shown statuses and patches; a missing or empty status is M, a missing patch empty."""
    return _changes(spark, sf_dir).select("commit", "path", "additions", "deletions", shown_status(F.col("status")).alias("status"), "patch")


def full_diffs(spark, sf_dir):
    """Patches of each commit in order of path, end to end."""
    return review.full_diff(_changes(spark, sf_dir))


def top_complexity_5(spark, sf_dir):
    """What reports show."""
    return metrics.top_by_complexity(virtual_functions(spark, sf_dir), 5).select("file_path", "name", "start_line", "loc", "complexity")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            go_functions, go_structs, go_imports, go_errors, go_issues, go_totals, go_contexts, functions_to_embed, embedding_returns, scanned_files, tree_paths, detected_frameworks,
            near_vector_pairs, near_vector_levels, duplicates_of_function, search_by_text, provider_chain, provider_errors, diff_patches, full_diffs, top_complexity_5,
        )
    }


# -- the same in DuckDB -------------------------------------------------------

_KEYS = """g AS (
  SELECT 'r' || doc_id % 10 AS repo_id, 'src/f' || doc_id || '.go' AS path, doc_id AS d, doc_id % 5 AS k, doc_id % 31 AS j, coalesce(text, '') AS text FROM documents WHERE doc_id % 11 <> 0
), functions AS (
  SELECT repo_id, path AS file_path, 'Run' || d AS name, 16 AS start_line, (22 + k)::INTEGER AS end_line, (7 + k)::INTEGER AS loc, (3 + 2 * k)::INTEGER AS complexity, 'xs,n' AS parameters, true AS is_exported,
    'Run' || d || ' runs.' || chr(10) AS comments FROM g
  UNION ALL SELECT repo_id, path, 'helper' || d, (24 + k)::INTEGER, (25 + k + 2 * j)::INTEGER, (2 + 2 * j)::INTEGER, (1 + j)::INTEGER, '', false, '' FROM g
), issues AS (
  SELECT repo_id, file_path, 'complexity' AS type, start_line AS line, 'Function ''' || name || ''' has high complexity: ' || complexity AS message FROM functions WHERE complexity > 10
  UNION ALL SELECT repo_id, file_path, 'function_length', start_line, 'Function ''' || name || ''' is too long: ' || loc || ' lines' FROM functions WHERE loc > 50
)"""

# lines of the template: 3 comments, 8 blank ones, the rest code; those of the text are counted as they are
_LINED = """t AS (
  SELECT *, list_transform(string_split(replace(text, '`', ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))) AS l FROM g
), lined AS (
  SELECT repo_id, d, k, j, len(l) AS n,
    len(list_filter(l[2:len(l) - 1], lambda x: x = '')) AS blank, len(list_filter(l[2:], lambda x: starts_with(x, '//') OR starts_with(x, '/*') OR (starts_with(x, '#') AND octet_length(encode(x)) >= 2))) AS comment
  FROM t
)"""

_NEAR = """v AS (
  SELECT vec_id AS id, embedding AS e, 'f' || vec_id AS file_path, 'own' || vec_id AS func_name FROM embeddings
  UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CASE WHEN i - 1 = vec_id % 64 THEN x + (CASE vec_id % 5 WHEN 0 THEN 0.125 WHEN 1 THEN 0.375 WHEN 2 THEN 0.5625 WHEN 3 THEN 0.75 ELSE 1.5 END)::FLOAT ELSE x END), 'f' || vec_id, 'moved' || vec_id FROM embeddings
), r AS (SELECT min(id) AS id, e FROM v GROUP BY e), pairs AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[])::FLOAT AS s FROM r a JOIN r b ON a.id < b.id)"""

_LETTERS = "list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda c: (length({0}) - length(replace({0}, c, '')))::DOUBLE)"

_CHANGED = """items AS (
  SELECT l_orderkey::VARCHAR AS commit, 'a b/f' || l_partkey || '.go' AS path, l_returnflag AS f, l_linestatus AS s, l_linenumber AS n FROM lineitem
), changed AS (
  SELECT commit, path, sum(n)::INTEGER AS additions, 0 AS deletions, CASE WHEN bool_or(f = 'R') THEN 'D' ELSE 'M' END AS status, coalesce(min('@@ ' || path || ' ' || s || chr(10)) FILTER (f = 'R'), '') AS patch
  FROM items GROUP BY ALL
)"""


def oracle_sql() -> dict[str, str]:
    asked = _LETTERS.format("'a bad face, each edge had a cabbage'")
    return {
        "go_functions": f"WITH {_KEYS} SELECT * FROM functions",
        "go_structs": f"WITH {_KEYS} SELECT repo_id, path AS file_path, 'Box' || d AS name, 10 AS start_line, 13 AS end_line, 'a int; b int; name map[string][]func(int) error' AS fields, true AS is_exported FROM g",
        "go_imports": f"WITH {_KEYS} SELECT repo_id, path AS file_path, i.p AS import_path, i.a AS alias FROM (SELECT *, unnest([{{'p': '\"fmt\"', 'a': ''}}, {{'p': '\"os\"', 'a': 'x' || d}}, {{'p': '\"strings\"', 'a': ''}}]) AS i FROM g)",
        "go_errors": "SELECT 'r' || doc_id % 10 AS repo_id, 'src/f' || doc_id || '.go' AS path FROM documents WHERE doc_id % 11 = 0",
        "go_issues": f"WITH {_KEYS} SELECT * FROM issues",
        "go_totals": f"""WITH {_KEYS}, {_LINED}, files AS (
  SELECT repo_id, count(*) AS file_count, sum(n + 26 + k + 2 * j - 5 - blank - 2 - comment)::BIGINT AS lines_of_code, sum(2 + comment)::BIGINT AS comment_lines, sum(5 + blank)::BIGINT AS blank_lines FROM lined GROUP BY repo_id
), f AS (
  SELECT repo_id, sum(complexity)::BIGINT AS cyclomatic_complexity, count(*) AS function_count, (count(*) / 2)::BIGINT AS class_count, max(loc)::BIGINT AS max_function_length, round(avg(loc), 6) AS avg_function_length FROM functions GROUP BY repo_id
) SELECT * FROM files JOIN f USING (repo_id)""",
        "go_contexts": f"WITH {_KEYS}, c AS (SELECT 'r' || doc_id % 10 AS repo_id, count(*) AS n_go FROM documents GROUP BY 1), f AS (SELECT repo_id, count(*) AS n_functions FROM functions GROUP BY 1), i AS (SELECT repo_id, count(*) AS n FROM issues GROUP BY 1) SELECT repo_id, n_go, n_functions, coalesce(n, 0) AS n_issues FROM f JOIN c USING (repo_id) LEFT JOIN i USING (repo_id)",
        "functions_to_embed": f"WITH {_KEYS} SELECT repo_id, count(*) AS n FROM functions GROUP BY 1",
        "embedding_returns": """WITH f AS (
  SELECT 'f' || l_suppkey || '.go' AS file_path, CASE l_partkey % 5 WHEN 0 THEN 'UserManager' || l_partkey WHEN 1 THEN 'getHTTPhelper' || l_partkey WHEN 2 THEN 'X' WHEN 3 THEN 'RUN' ELSE 'loadRow' || l_partkey END AS name,
    l_orderkey * 100 + l_linenumber * 10 AS start_line, * FROM lineitem
) SELECT left(sha256(file_path || ':' || name || ':' || start_line), 16) AS id, sha256('// Language: Go' || chr(10) || '// Function: ' || name || chr(10)
  || CASE WHEN l_suppkey % 8 > 0 THEN '// Parameters: [' || array_to_string(['a', 'b', 'c', 'd', 'e', 'f', 'g'][1:l_suppkey % 8], ' ') || ']' || chr(10) ELSE '' END
  || CASE WHEN l_linenumber % 2 = 0 THEN '// Returns: error' || chr(10) ELSE '' END || CASE WHEN l_linenumber = 1 THEN '// Comments: first' || chr(10) ELSE '' END
  || '// Complexity: ' || (1 + l_orderkey % 27) || chr(10) || '// Lines: ' || (floor(l_quantity * 2.5)::INTEGER + 1) || chr(10)) AS code_sha256 FROM f""",
        "scanned_files": "SELECT CASE doc_id % 12 WHEN 0 THEN 'src/' WHEN 4 THEN 'vendored/' WHEN 7 THEN 'build.d/' ELSE '' END || 'f' || doc_id || '.rs' AS path, 'Rust' AS language FROM documents WHERE doc_id % 12 IN (0, 4, 7, 11)",
        "tree_paths": "SELECT 'tables' AS repo_id, unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS path",
        "detected_frameworks": """WITH s AS (SELECT 'r' || s_suppkey AS repo_id, s_suppkey AS k FROM supplier), f AS (
  SELECT * FROM (VALUES (0, 'Spring Boot', 'Backend', 'Java'), (3, 'Gin', 'Backend', 'Go'), (5, 'Flask', 'Backend', 'Python'), (7, 'React', 'UI', 'JavaScript'), (8, 'Vue.js', 'UI', 'JavaScript'),
    (14, 'Next.js', 'FullStack', 'JavaScript'), (28, 'Vite', 'Build', 'JavaScript'), (29, 'Webpack', 'Build', 'JavaScript')) AS t(number, name, type, language)
), hits AS (
  SELECT repo_id, 0 AS place, CASE k % 4 WHEN 0 THEN 'React' WHEN 1 THEN 'Vue.js' WHEN 3 THEN 'Next.js' END AS name FROM s
  UNION ALL SELECT repo_id, 0, CASE k % 3 WHEN 0 THEN 'Vite' WHEN 1 THEN 'Webpack' END FROM s
  UNION ALL SELECT repo_id, 1, 'Gin' FROM s WHERE k % 5 = 0
  UNION ALL SELECT repo_id, 2, 'Flask' FROM s WHERE k % 3 = 1
  UNION ALL SELECT repo_id, 3, 'Spring Boot' FROM s WHERE k % 7 = 0
  UNION ALL SELECT repo_id, 4, CASE k % 3 WHEN 0 THEN 'Gin' WHEN 1 THEN 'React' END FROM s
), one AS (SELECT repo_id, name, min(place) AS place FROM hits WHERE name IS NOT NULL GROUP BY ALL)
SELECT repo_id, place * 30 + number AS ordinal, name, type, language FROM one JOIN f USING (name)""",
        "near_vector_pairs": f"WITH {_NEAR} SELECT id_a, id_b, round(s::DOUBLE, 5) AS similarity FROM pairs WHERE s >= 0.85::FLOAT",
        "near_vector_levels": f"WITH {_NEAR} SELECT CASE WHEN s >= 0.95::FLOAT THEN 'Nearly Identical' WHEN s >= 0.85::FLOAT THEN 'Very Similar' WHEN s >= 0.75::FLOAT THEN 'Similar' WHEN s >= 0.60::FLOAT THEN 'Somewhat Similar' ELSE 'Different' END AS level, count(*) AS n FROM pairs GROUP BY 1",
        "duplicates_of_function": f"WITH {_NEAR}, s AS (SELECT *, list_cosine_similarity(e::DOUBLE[], (SELECT e::DOUBLE[] FROM v WHERE id = 0))::FLOAT AS s FROM v) SELECT id, file_path, func_name, round(s::DOUBLE, 5) AS similarity FROM s WHERE s >= 0.85::FLOAT AND func_name <> 'own0'",
        "search_by_text": f"WITH d AS (SELECT doc_id AS id, {_LETTERS.format(chr(116))} AS e FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), s AS (SELECT id, CASE WHEN list_sum(e) = 0 THEN 0::FLOAT ELSE list_cosine_similarity(e, {asked})::FLOAT END AS s FROM d) SELECT id, round(s::DOUBLE, 5) AS similarity FROM s ORDER BY s DESC, id LIMIT 10",
        "provider_chain": "SELECT doc_id AS id, 'letters' AS provider, 8::BIGINT AS dim, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')))::DOUBLE AS first, true AS fine FROM documents",
        "provider_errors": "SELECT 'down' AS provider, 'no connection' AS error, count(*) AS n, 0::BIGINT AS n_vectors FROM documents",
        "diff_patches": f"WITH {_CHANGED} SELECT * FROM changed",
        "full_diffs": f"WITH {_CHANGED} SELECT commit, string_agg(patch, '' ORDER BY path) AS patch FROM changed GROUP BY commit",
        "top_complexity_5": "SELECT 'f' || l_suppkey || '.go' AS file_path, CASE l_partkey % 5 WHEN 0 THEN 'UserManager' || l_partkey WHEN 1 THEN 'getHTTPhelper' || l_partkey WHEN 2 THEN 'X' WHEN 3 THEN 'RUN' ELSE 'loadRow' || l_partkey END AS name, (l_orderkey * 100 + l_linenumber * 10)::INTEGER AS start_line, floor(l_quantity * 2.5)::INTEGER + 1 AS loc, (1 + l_orderkey % 27)::INTEGER AS complexity FROM lineitem ORDER BY complexity DESC, file_path, start_line, name, loc LIMIT 5",
    }
