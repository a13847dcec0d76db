"""Queries over changes of functions, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import hunks, renames, rules, snapshots
from lodestack.plans.views import table, virtual_functions
from lodestack.shared import folder
from lodestack.sources import git
from lodestack.streaming import incremental

# One hunk for each line item: an unchanged line, removed ones, added ones (none for a third of them), an unchanged line.
_PATCHES = """
SELECT 'corpus' AS repo_id, cast(l_orderkey AS string) AS commit, concat('f', cast(l_suppkey AS string), '.go') AS path,
  concat('diff --git a/f b/f\\n--- a/f\\n+++ b/f\\n@@ -', s, ',', cast(l_quantity % 2 + 3 AS int), ' +', s, ',', cast(2 + l_linenumber % 3 AS int), ' @@ func x\\n a\\n', repeat('-b\\n', cast(1 + l_quantity % 2 AS int)),
    repeat('+c\\n', cast(l_linenumber % 3 AS int)), ' d\\n\\\\ No newline at end of file\\n') AS patch
FROM (SELECT *, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 60 - 10 AS s FROM {lineitem})
"""


def _patches(spark, sf_dir: str) -> DataFrame:
    return spark.sql(_PATCHES, lineitem=table(spark, sf_dir, "lineitem"))


def changed_ranges(spark, sf_dir):
    """Blocks of changed lines of each patch."""
    out = hunks.changed_ranges(_patches(spark, sf_dir))
    return out.selectExpr("commit", "path", "cast(first AS bigint) AS first", "cast(last AS bigint) AS last")


def touched_functions(spark, sf_dir):
    """Functions that each commit's patches meet, by an interval join."""
    out = hunks.touched_functions(virtual_functions(spark, sf_dir), _patches(spark, sf_dir))
    return out.selectExpr("commit", "file_path", "name", "cast(start_line AS bigint) AS start_line", "cast(end_line AS bigint) AS end_line").distinct()


def touched_issues(spark, sf_dir):
    """Issues of touched functions alone."""
    functions = virtual_functions(spark, sf_dir).select("repo_id", "file_path", "name", "start_line", "end_line", "loc", "complexity")
    return rules.issues(hunks.touched_functions(functions, _patches(spark, sf_dir), once=False)).select("file_path", "type", "line", "message").distinct()


def incremental_metrics(spark, sf_dir):
    """Line metrics after three batches of file versions: new files, changed and deleted ones, and versions that come late."""
    place = f"{folder(spark)}/lodestack/follow-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").selectExpr("'r' AS repo_id", "concat('f', cast(doc_id AS string), '.go') AS path", "doc_id AS d", "concat('// one\n', repeat('x = 1\n', cast(doc_id % 9 AS int))) AS one", "repeat('y = 2\n\n', cast(1 + doc_id % 4 AS int)) AS two")
    versions = (
        docs.where("d % 5 <> 4").selectExpr("repo_id", "path", "one AS content", "2L AS version"),
        docs.where("d % 3 = 0").selectExpr("repo_id", "path", "CASE WHEN d % 2 = 0 THEN two END AS content", "5L AS version"),
        docs.where("d % 4 = 0").selectExpr("repo_id", "path", "concat(two, two) AS content", "CASE WHEN d % 8 = 0 THEN 4L ELSE 7L END AS version"),
    )
    for k, batch in enumerate(versions):
        incremental.merge(batch, k, place, buckets=16)
    return incremental.current(spark, place).select("path", "blank_lines", "comment_lines", "lines_of_code")


def _moved(spark, sf_dir: str, side: str) -> DataFrame:
    """Files of fifty changes, a word of a document's text a line; the new ones lack some words and have others."""
    docs = table(spark, sf_dir, "documents").selectExpr("concat('c', cast(doc_id % 50 AS string)) AS commit", "doc_id", "split(coalesce(text, ''), ' ') AS w")
    if side == "old":
        return docs.selectExpr("commit", "concat('old', cast(doc_id AS string)) AS path", "array_join(w, '\n') AS content")
    kept = "filter(w, (x, i) -> i % 10 >= doc_id % 5 * 2)"
    return docs.selectExpr("commit", "concat('new', cast(doc_id AS string)) AS path", f"array_join(concat({kept}, transform(sequence(1, 3), i -> concat('added', cast(doc_id AS string)))), '\n') AS content")


def rename_scores(spark, sf_dir):
    """Pairs of deleted and added files of a change that have half their bytes in common."""
    out = renames.scores(_moved(spark, sf_dir, "old"), _moved(spark, sf_dir, "new"))
    return out.select("commit", "old_path", "new_path", F.round("score", 6).alias("score"))


def _snapshots(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A file a document, a word a line: of eleven one goes, one comes, one stays, and eight lose some lines and get others."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') AS text")
    whole = "concat(translate(text, ' ', '\n'), '\n')"
    edited = "array_join(transform(split(translate(text, '\n', ' '), ' '), (x, i) -> concat(IF(i % 10 < doc_id % 4, '', concat(x, '\n')), IF(i % 7 = 3, concat('+new', cast(doc_id AS string), '_', cast(i AS string), '\n'), ''))), '')"
    side = lambda rows, content: docs.where(rows).selectExpr("concat('c', cast(doc_id % 50 AS string)) AS commit", "concat('f', cast(doc_id AS string)) AS path", f"{content} AS content")
    return side("doc_id % 11 <> 1", whole), side("doc_id % 11 <> 0", f"IF(doc_id % 11 = 2, {whole}, {edited})")


def snapshot_changes(spark, sf_dir):
    """Files that differ between two snapshots, with the lines of a shortest edit."""
    out = snapshots.diff(*_snapshots(spark, sf_dir), least=None, patches=False)
    return out.select("commit", "path", "status", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"))


def patched_files(spark, sf_dir):
    """The second snapshot as the first one's patches, renames among them, lead to it."""
    old, new = _snapshots(spark, sf_dir)
    out = snapshots.patched(old, snapshots.diff(old, new))
    return out.select("commit", "path", F.sha2("content", 256).alias("content_sha256"))


# What git prints with -z for an order's line items: renames, binary files, and files without a status among them.
_OUTPUTS = """
SELECT cast(l_orderkey AS string) AS commit, array_join(transform(l, x -> x.numstat), '') AS numstat, array_join(transform(l, x -> x.status), '') AS name_status
FROM (SELECT l_orderkey, array_sort(collect_list(struct(l_linenumber,
    concat(CASE l_linenumber % 4 WHEN 0 THEN '-\t-' ELSE concat(cast(cast(l_quantity AS int) AS string), '\t', cast(l_partkey % 50 AS string)) END, '\t',
      CASE l_linenumber % 3 WHEN 0 THEN concat(chr(0), 'old | ', n, chr(0), 'new ', n, chr(0)) ELSE concat('a b/', n, chr(0)) END) AS numstat,
    CASE l_linenumber % 3 WHEN 0 THEN concat('R090', chr(0), 'old | ', n, chr(0), 'new ', n, chr(0)) WHEN 1 THEN concat(IF(l_partkey % 2 = 0, 'A', 'D'), chr(0), 'a b/', n, chr(0)) ELSE '' END AS status))) AS l
  FROM (SELECT *, concat(cast(l_linenumber AS string), '.', cast(l_partkey AS string)) AS n FROM {lineitem}) GROUP BY l_orderkey)
"""


def git_outputs(spark, sf_dir):
    """Files, old paths, statuses and counts out of git's own output, kept as text."""
    out = git.read_outputs(spark.sql(_OUTPUTS, lineitem=table(spark, sf_dir, "lineitem")))
    return out.selectExpr("commit", "path", "old_path", "status", "cast(additions AS bigint) AS additions", "cast(deletions AS bigint) AS deletions")


def queries() -> dict:
    return {f.__name__: f for f in (git_outputs, snapshot_changes, patched_files, rename_scores, incremental_metrics, changed_ranges, touched_functions, touched_issues)}


_SNAPSHOTS = """w AS (SELECT doc_id AS d, 'c' || doc_id % 50 AS commit, 'f' || doc_id AS path, string_split(replace(coalesce(text, ''), chr(10), ' '), ' ') AS w FROM documents
), lines AS (SELECT d, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM w
), edits AS (SELECT d, sum((i % 10 < d % 4)::INT)::BIGINT AS gone, sum((i % 7 = 3)::INT)::BIGINT AS come, string_agg(CASE WHEN i % 10 < d % 4 THEN '' ELSE x || chr(10) END || CASE WHEN i % 7 = 3 THEN '+new' || d || '_' || i || chr(10) ELSE '' END, '' ORDER BY i) AS text FROM lines GROUP BY d)"""

_TOUCHED = """p AS (
  SELECT l_orderkey::VARCHAR AS commit, 'f' || l_suppkey || '.go' AS path, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 60 - 10 + 1 AS first, l_linenumber % 3 AS n FROM lineitem
), changed AS (SELECT commit, path, first, first + n - 1 AS last FROM p
), f AS (
  SELECT 'f' || l_suppkey || '.go' AS file_path, CASE l_partkey % 5 WHEN 0 THEN 'UserManager' || l_partkey WHEN 1 THEN 'getHTTPhelper' || l_partkey WHEN 2 THEN 'X' WHEN 3 THEN 'RUN' ELSE 'loadRow' || l_partkey END AS name,
    l_orderkey * 100 + l_linenumber * 10 AS start_line, (l_orderkey * 100 + l_linenumber * 10 + floor(l_quantity * 2.5))::BIGINT AS end_line, (floor(l_quantity * 2.5) + 1)::BIGINT AS loc, 1 + l_orderkey % 27 AS complexity
  FROM lineitem
), touched AS (SELECT DISTINCT commit, f.* FROM f JOIN changed c ON f.file_path = c.path AND start_line <= last AND end_line >= first)"""


def oracle_sql() -> dict[str, str]:
    return {
        "git_outputs": """WITH rows AS (
  SELECT l_orderkey::VARCHAR AS commit, l_linenumber AS k, CASE l_linenumber % 3 WHEN 0 THEN 'new ' || l_linenumber || '.' || l_partkey ELSE 'a b/' || l_linenumber || '.' || l_partkey END AS path, CASE l_linenumber % 3 WHEN 0 THEN 'old | ' || l_linenumber || '.' || l_partkey ELSE '' END AS old_path,
    CASE l_linenumber % 3 WHEN 0 THEN 'R' WHEN 1 THEN CASE l_partkey % 2 WHEN 0 THEN 'A' ELSE 'D' END ELSE 'M' END AS status,
    CASE l_linenumber % 4 WHEN 0 THEN 0 ELSE l_quantity::BIGINT END AS additions, CASE l_linenumber % 4 WHEN 0 THEN 0 ELSE l_partkey % 50 END::BIGINT AS deletions FROM lineitem
) SELECT commit, path, old_path, status, additions, deletions FROM rows""",
        "snapshot_changes": f"""WITH {_SNAPSHOTS}
SELECT commit, path, CASE d % 11 WHEN 0 THEN 'D' WHEN 1 THEN 'A' ELSE 'M' END AS status, CASE d % 11 WHEN 0 THEN 0 WHEN 1 THEN len(w) - gone + come ELSE come END::BIGINT AS additions, CASE d % 11 WHEN 0 THEN len(w) WHEN 1 THEN 0 ELSE gone END::BIGINT AS deletions
FROM w JOIN edits USING (d) WHERE d % 11 <> 2 AND (d % 11 < 2 OR gone + come > 0)""",
        "patched_files": f"""WITH {_SNAPSHOTS}
SELECT commit, path, sha256(CASE WHEN d % 11 = 2 THEN array_to_string(w, chr(10)) || chr(10) ELSE text END) AS content_sha256 FROM w JOIN edits USING (d) WHERE d % 11 <> 0""",
        "rename_scores": """WITH d AS (SELECT doc_id AS d, 'c' || doc_id % 50 AS commit, string_split(coalesce(text, ''), ' ') AS w FROM documents
), files AS (
  SELECT commit, 'old' || d AS path, 'old' AS side, array_to_string(w, chr(10)) AS t FROM d
  UNION ALL SELECT commit, 'new' || d, 'new', array_to_string(list_concat(list_filter(w, lambda x, i: (i - 1) % 10 >= d % 5 * 2), ['added' || d, 'added' || d, 'added' || d]), chr(10)) FROM d
), lines AS (SELECT commit, path, side, line, count(*) AS n, octet_length(encode(line)) + 1 AS bytes FROM (SELECT commit, path, side, unnest(string_split(t, chr(10))) AS line FROM files WHERE t <> '') GROUP BY ALL
), sizes AS (SELECT commit, path, sum(n * bytes) AS size FROM lines GROUP BY ALL
), shared AS (
  SELECT commit, a.path AS old_path, b.path AS new_path, sum(least(a.n, b.n) * a.bytes) AS s FROM lines a JOIN lines b USING (commit, line) WHERE a.side = 'old' AND b.side = 'new' GROUP BY ALL
) SELECT x.commit, old_path, new_path, round(s / greatest(a.size, b.size), 6) AS score FROM shared x JOIN sizes a ON a.commit = x.commit AND a.path = old_path JOIN sizes b ON b.commit = x.commit AND b.path = new_path
WHERE s / greatest(a.size, b.size) >= 0.5""",
        "incremental_metrics": """WITH v AS (
  SELECT doc_id AS d, 2 AS version, 0 AS blank, 1 AS comment, doc_id % 9 AS code, false AS gone FROM documents WHERE doc_id % 5 <> 4
  UNION ALL SELECT doc_id, 5, 1 + doc_id % 4, 0, 1 + doc_id % 4, doc_id % 2 <> 0 FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 4 ELSE 7 END, 2 * (1 + doc_id % 4), 0, 2 * (1 + doc_id % 4), false FROM documents WHERE doc_id % 4 = 0
), newest AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY d ORDER BY version DESC) = 1)
SELECT 'f' || d || '.go' AS path, blank::BIGINT AS blank_lines, comment::BIGINT AS comment_lines, code::BIGINT AS lines_of_code FROM newest WHERE NOT gone""",
        "changed_ranges": f"WITH {_TOUCHED} SELECT * FROM changed",
        "touched_functions": f"WITH {_TOUCHED} SELECT DISTINCT commit, file_path, name, start_line, end_line FROM touched",
        "touched_issues": f"""WITH {_TOUCHED} SELECT DISTINCT file_path, 'complexity' AS type, start_line::INTEGER AS line, 'Function ''' || name || ''' has high complexity: ' || complexity AS message FROM touched WHERE complexity > 10
UNION SELECT DISTINCT file_path, 'function_length', start_line::INTEGER, 'Function ''' || name || ''' is too long: ' || loc || ' lines' FROM touched WHERE loc > 50""",
    }
