"""Queries over templated Go sources for clones, unused code and syntax errors, with their DuckDB SQL.

Sources are made from documents, so their number and the literals in them follow the table. The SQL
says what is known of the templates: which files are renamed copies, which functions call which, which
sources are broken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack import store
from lodestack.operators import clones, embed, goparse, parsers, unused
from lodestack.plans.analysis import analyse, detected_once
from lodestack.plans.catalogue_sources import LetterProvider
from lodestack.plans.views import table
from lodestack.shared import folder

_PLACE = ["concat('r', cast(doc_id % 10 AS string)) AS repo_id", "concat('src/f', cast(doc_id AS string), '.go') AS path"]
#: Statements of four functions; no ten in a row are in two of them, or twice in one.
_BODIES = ("+-*+*-+**-+-*--+*+-*+-**", "**-+--+*-*-*+++-*-+--*+*", "--*+*++-***--+-+*+*--+-+", "*+-+*--++-*+***+--*+-+*-")

_COPIES = f"""concat(repeat('// note\\n', cast(doc_id % 3 AS int)), 'package p', d % 7, '\\n\\nfunc run', d, '(x', d, ', y', d, ' int) int {{\\n',
  array_join(transform(sequence(1, 24), k -> concat('  x', d, ' = x', d, ' ', substring(element_at(array({", ".join(repr(b) for b in _BODIES)}), cast(doc_id % 4 AS int) + 1), k, 1), ' y', d, '\\n')), ''),
  '  return ', CASE WHEN doc_id % 5 = 1 THEN 'y' ELSE 'x' END, d, '\\n}}\\n\\nvar t', d, ' = `', replace(coalesce(text, ''), '`', ''), '`\\n') AS content"""

_CALLS = """concat('package p\\n\\nimport "fmt"\\nimport x', d, ' "os"\\nimport "a/go-yaml/v', 2 + doc_id % 3, '"\\nimport _ "net"\\n\\n',
  'func Run', d, '() {\\n', CASE WHEN doc_id % 3 = 0 THEN concat('  h', d, '()\\n') ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN '  fmt.Println(`h0()`)\\n' ELSE '' END, '}\\n',
  'func h', d, '() {\\n', CASE WHEN doc_id % 7 <> 0 THEN concat('  h', cast(doc_id + 10 AS string), '()\\n') ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN concat('  b.step', d, '()\\n') ELSE '' END, '}\\n',
  'func (b *box) step', d, '() { x', d, CASE WHEN doc_id % 3 = 1 THEN '.Exit(1)' ELSE '(1)' END, ' }\\n',
  CASE WHEN doc_id % 5 = 0 THEN concat('var _ = k', d, '\\n') ELSE '' END, 'func k', d, '() { ', CASE WHEN doc_id % 9 = 0 THEN 'yaml.Load()' ELSE '' END, ' }\\n',
  CASE WHEN doc_id % 11 = 0 THEN concat('func init() { q', d, '() }\\n') ELSE '' END, 'func q', d, '() { q', d, '() }\\nvar s = `', replace(coalesce(text, ''), '`', ''), '`\\n') AS content"""

#: Ten kinds of fault, and seven sources that look like them and are fine.
_STATEMENTS = (
    "func f() { x := }", "func f() { if { } }", 'var s = "abc', "foo bar baz", "func f(a int b int) { }", "func () { }", "func f() { for x in y { } }", "var x = []int{1\\n}", "func f() { a.b := 1 }", "type T struct { a, b }",
    "func f() { x := 1 }", "func f() { if x { } }", 'var s = "abc"', "func f(a, b int) { }", "var x = []int{1,\\n}", "func f() { a.b = 1 }", "type T struct { a, b int }",
)
N_FAULTS = 10


def _sources(template: str):
    def files(spark, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").withColumn("d", F.col("doc_id").cast("string")).selectExpr(*_PLACE, template)

    return files


copied_files, calling_files = _sources(_COPIES), _sources(_CALLS)


def faulty_files(spark, sf_dir: str) -> DataFrame:
    """A source of each document, of one of seventeen templates by its id, with the text in a literal."""
    docs = table(spark, sf_dir, "documents")
    statement = F.element_at(F.array(*[F.lit(s.replace("\\n", "\n")) for s in _STATEMENTS]), (F.col("doc_id") % len(_STATEMENTS) + 1).cast("int"))
    text = F.concat(F.lit("package p\n\nvar t = `"), F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit("")), F.lit("`\n"), statement, F.lit("\n"))
    return docs.select(*map(F.expr, _PLACE), text.alias("content"))


def clone_pairs(spark, sf_dir):
    """Renamed copies with the first of their kind: lines, tokens, similarity, and whether names correspond one to one."""
    return clones.clone_pairs(copied_files(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def clone_classes(spark, sf_dir):
    out = clones.clone_classes(clones.clone_pairs(copied_files(spark, sf_dir)))
    return out.withColumn("least_similarity", F.round("least_similarity", 6))


def duplication_issues(spark, sf_dir):
    return clones.duplication_issues(clones.clone_pairs(copied_files(spark, sf_dir))).select("repo_id", "file_path", "type", "severity", "line", "message")


def unused_functions(spark, sf_dir):
    """Functions that no exported name, init or variable leads to, through calls across files."""
    return unused.unused_functions(unused.symbol_table(calling_files(spark, sf_dir)))


def unused_imports(spark, sf_dir):
    return unused.unused_imports(unused.symbol_table(calling_files(spark, sf_dir)))


def go_syntax_errors(spark, sf_dir):
    """Sources with one of ten kinds of fault, and the line that the fault is reported at."""
    found = goparse.parse_go(faulty_files(spark, sf_dir)).where("error is not null")
    return found.select("repo_id", "path", F.regexp_extract("error", r"^line (\d+)", 1).cast("long").alias("line"))


def functions_by_language(spark, sf_dir):
    """Functions of sources in Go, JavaScript and Java from one lateral join; the text stands in a literal or a comment."""
    docs = table(spark, sf_dir, "documents").withColumns({"d": F.col("doc_id").cast("string"), "k": F.expr("cast(doc_id % 4 AS int)"), "t": F.translate(F.coalesce("text", F.lit("")), "`\\*", "")})
    body = "repeat('  if (a > 0 && b > 0) {\\n  }\\n', k)"
    content = f"""CASE doc_id % 3 WHEN 0 THEN concat('package p\\n\\nfunc Run', d, '(a, b int) {{\\n', {body}, '}}\\nvar t = `', t, '`\\n')
      WHEN 1 THEN concat('export function run', d, '(a, b = 1) {{\\n', {body}, '}}\\nconst t', d, ' = (x) => {{\\n}}\\nconst s = `', t, '`\\n')
      ELSE concat('class A {{\\n  public int run', d, '(int a, Map<String, Integer> b) {{\\n', {body}, '  }}\\n}}\\n/* ', t, ' */') END"""
    files = docs.selectExpr("doc_id", "element_at(array('Go', 'JavaScript', 'Java'), cast(doc_id % 3 AS int) + 1) AS language", f"{content} AS content")
    out = parsers.functions_of(files)
    return out.select("doc_id", "language", "name", "start_line", "end_line", "loc", "complexity", F.array_join("parameters", ",").alias("parameters"), "is_exported")


def index_documents(spark, sf_dir):
    """Vectors of functions, written as one JSON document a repository and read again."""
    functions = goparse.functions_of(goparse.parse_go(calling_files(spark, sf_dir)))
    index = embed.embed(embed.describe(functions), LetterProvider())
    path = f"{folder(spark)}/lodestack/index-{uuid.uuid4().hex}"
    store.write_index_documents(index, path)
    back = store.read_index_document(spark, path)
    return back.select("file_path", F.col("function_name").alias("name"), F.col("start_line").cast("long").alias("line"), "provider", F.col("dim").cast("long").alias("dim"), "language")


def context_documents(spark, sf_dir):
    """Contexts, written as one JSON document a repository and read again."""
    path = f"{folder(spark)}/lodestack/context-{uuid.uuid4().hex}"
    store.write_context_documents(detected_once(analyse(calling_files(spark, sf_dir))), path)
    back = spark.read.schema("detection struct<languages:map<string,long>>, analysis struct<totals:struct<function_count:long>,total_issues:long>, repo_id string").json(path)
    return back.selectExpr("repo_id", "detection.languages['Go'] AS n_go", "analysis.totals.function_count AS n_functions", "analysis.total_issues AS n_issues")


def queries() -> dict:
    return {f.__name__: f for f in (functions_by_language, index_documents, context_documents, clone_pairs, clone_classes, duplication_issues, unused_functions, unused_imports, go_syntax_errors)}


# -- the same in DuckDB -------------------------------------------------------

_COPIED = """f AS (
  SELECT 'r' || doc_id % 10 AS repo, 'src/f' || doc_id || '.go' AS path, doc_id AS d, doc_id % 4 AS g, 1 + doc_id % 3 AS first_line, replace(coalesce(text, ''), '`', '') AS t FROM documents
), lined AS (SELECT *, first_line + 30 + length(t) - length(replace(t, chr(10), '')) AS last_line, row_number() OVER (PARTITION BY g ORDER BY repo, path) AS place FROM f
), pairs AS (
  SELECT a.repo AS repo_a, a.path AS path_a, a.first_line AS start_a, a.last_line AS end_a, b.repo AS repo_b, b.path AS path_b, b.first_line AS start_b, b.last_line AS end_b, 139::BIGINT AS tokens,
    (139 - 77 - (CASE WHEN a.d % 7 <> b.d % 7 THEN 1 ELSE 0 END) - (CASE WHEN a.t <> b.t THEN 1 ELSE 0 END))::DOUBLE / 139 AS similarity, (a.d % 5 = 1) = (b.d % 5 = 1) AS consistent
  FROM lined a JOIN lined b ON a.g = b.g AND a.place = 1 AND b.place > 1
)"""

_CALLED = """d AS (SELECT doc_id AS d, 'r' || doc_id % 10 AS repo_id, 'src/f' || doc_id || '.go' AS file_path FROM documents
), edges AS (
  SELECT 'h' || d AS name, 'h' || (d + 10) AS callee FROM d WHERE d % 7 <> 0 AND d + 10 IN (SELECT d FROM d)
  UNION ALL SELECT 'h' || d, 'step' || d FROM d WHERE d % 2 = 0
), reached AS (
  SELECT 'h' || d AS name FROM d WHERE d % 3 = 0
  UNION SELECT 'k' || d FROM d WHERE d % 5 = 0
  UNION SELECT 'q' || d FROM d WHERE d % 11 = 0
  UNION SELECT callee FROM reached JOIN edges USING (name)
), placed AS (SELECT *, 10 + (d % 3 = 0)::INT + (d % 4 = 0)::INT AS h_line, 2 + (d % 7 <> 0)::INT + (d % 2 = 0)::INT AS h_lines FROM d
), functions AS (
  SELECT repo_id, file_path, 'h' || d AS name, h_line AS line FROM placed
  UNION ALL SELECT repo_id, file_path, 'step' || d, h_line + h_lines FROM placed
  UNION ALL SELECT repo_id, file_path, 'k' || d, h_line + h_lines + 1 + (d % 5 = 0)::INT FROM placed
  UNION ALL SELECT repo_id, file_path, 'q' || d, h_line + h_lines + 2 + (d % 5 = 0)::INT + (d % 11 = 0)::INT FROM placed
)"""


def oracle_sql() -> dict[str, str]:
    n = len(_STATEMENTS)
    return {
        "functions_by_language": """WITH f AS (
  SELECT doc_id, doc_id % 3 AS l, (doc_id % 4)::INTEGER AS k, CASE doc_id % 3 WHEN 0 THEN 'Run' ELSE 'run' END || doc_id AS name, [3, 1, 2][doc_id % 3 + 1] AS start_line, true AS main FROM documents
  UNION ALL SELECT doc_id, 1, (doc_id % 4)::INTEGER, 't' || doc_id, 3 + 2 * (doc_id % 4), false FROM documents WHERE doc_id % 3 = 1
), g AS (SELECT *, start_line + 1 + CASE WHEN main THEN 2 * k ELSE 0 END AS end_line FROM f)
SELECT doc_id, ['Go', 'JavaScript', 'Java'][l + 1] AS language, name, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, (end_line - start_line + 1)::INTEGER AS loc,
  (CASE WHEN main THEN 1 + 2 * k ELSE 1 END)::INTEGER AS complexity, CASE WHEN main THEN 'a,b' ELSE 'x' END AS parameters, main AS is_exported FROM g""",
        # Run, h, step, k and q of each document, and init of some
        "index_documents": f"""WITH RECURSIVE {_CALLED}, more AS (
  SELECT file_path, name, line FROM functions UNION ALL SELECT file_path, 'Run' || d, 8 FROM placed
  UNION ALL SELECT file_path, 'init', h_line + h_lines + 2 + (d % 5 = 0)::INT FROM placed WHERE d % 11 = 0
) SELECT file_path, name, line::BIGINT AS line, 'letters' AS provider, 8::BIGINT AS dim, 'Go' AS language FROM more""",
        "context_documents": "SELECT 'r' || doc_id % 10 AS repo_id, count(*) AS n_go, sum(5 + (doc_id % 11 = 0)::INT)::BIGINT AS n_functions, 0::BIGINT AS n_issues FROM documents GROUP BY 1",
        "clone_pairs": f"WITH {_COPIED} SELECT * REPLACE (round(similarity, 6) AS similarity) FROM pairs",
        "clone_classes": f"WITH {_COPIED} SELECT repo_a AS repo_id, path_a AS path, start_a AS start_line, end_a AS end_line, max(tokens) AS tokens, count(*) + 1 AS n_places, count(*) + 1 AS n_files, round(min(similarity), 6) AS least_similarity FROM pairs GROUP BY ALL",
        "duplication_issues": f"WITH {_COPIED} SELECT repo_b AS repo_id, path_b AS file_path, 'duplication' AS type, 'warning' AS severity, start_b::INTEGER AS line, 'Lines ' || start_b || '-' || end_b || ' repeat ' || path_a || ':' || start_a || '-' || end_a AS message FROM pairs",
        "unused_functions": f"WITH RECURSIVE {_CALLED} SELECT repo_id, file_path, name, line::INTEGER AS line FROM functions WHERE name NOT IN (SELECT name FROM reached)",
        "unused_imports": """WITH i AS (SELECT doc_id AS d, 'r' || doc_id % 10 AS repo_id, 'src/f' || doc_id || '.go' AS file_path FROM documents)
SELECT repo_id, file_path, '"fmt"' AS import_path, '' AS alias, 3::INTEGER AS line FROM i WHERE d % 4 <> 0
UNION ALL SELECT repo_id, file_path, '"os"', 'x' || d, 4::INTEGER FROM i WHERE d % 3 <> 1
UNION ALL SELECT repo_id, file_path, '"a/go-yaml/v' || (2 + d % 3) || '"', '', 5::INTEGER FROM i WHERE d % 9 <> 0""",
        # the statement stands behind the text; all but one fault are in its first line
        "go_syntax_errors": f"""SELECT 'r' || doc_id % 10 AS repo_id, 'src/f' || doc_id || '.go' AS path,
  4 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS line FROM documents WHERE doc_id % {n} < {N_FAULTS}""",
    }
