"""Virtual repositories over the synthetic tables, for queries that need files, functions or commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = """
SELECT 'corpus' AS repo_id, doc_id,
  concat('src/', source, '/f', cast(doc_id AS string),
    CASE doc_id % 8 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.TSX' WHEN 3 THEN '.h' WHEN 4 THEN '.cc' WHEN 5 THEN '.md' WHEN 6 THEN '.kts' ELSE '' END) AS path,
  concat(CASE doc_id % 4 WHEN 0 THEN '// lic\n\n' WHEN 1 THEN '# hdr\n \n' WHEN 2 THEN '/* blk */\n#\n' ELSE '' END,
    text, CASE WHEN doc_id % 3 = 0 THEN '\n' ELSE '' END) AS content
FROM {documents}
"""

SEEDED = """
SELECT 'corpus' AS repo_id, doc_id, concat('f', cast(doc_id AS string), '.go') AS path,
  concat(text, CASE doc_id % 5 WHEN 0 THEN 'gin.Default()' WHEN 1 THEN 'useState' WHEN 2 THEN 'FastAPI(' WHEN 3 THEN 'x-data' ELSE '' END) AS content
FROM {documents}
"""

FUNCTIONS = """
SELECT 'corpus' AS repo_id, concat('f', cast(l_suppkey AS string), '.go') AS file_path,
  concat(CASE l_partkey % 5 WHEN 0 THEN 'UserManager' WHEN 1 THEN 'getHTTPhelper' WHEN 2 THEN 'X' WHEN 3 THEN 'RUN' ELSE 'loadRow' END,
    CASE WHEN l_partkey % 5 IN (2, 3) THEN '' ELSE cast(l_partkey AS string) END) AS name,
  cast(l_orderkey * 100 + l_linenumber * 10 AS int) AS start_line, cast(l_orderkey * 100 + l_linenumber * 10 + floor(l_quantity * 2.5) AS int) AS end_line,
  cast(floor(l_quantity * 2.5) AS int) + 1 AS loc, cast(1 + l_orderkey % 27 AS int) AS complexity,
  transform(slice(array('a', 'b', 'c', 'd', 'e', 'f', 'g'), 1, cast(l_suppkey % 8 AS int)), x -> x) AS parameters,
  cast(NULL AS string) AS return_type, l_linenumber % 2 = 0 AS is_exported, CASE WHEN l_linenumber = 1 THEN 'first' ELSE '' END AS comments
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def virtual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES, documents=table(spark, sf_dir, "documents"))


def seeded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEEDED, documents=table(spark, sf_dir, "documents"))


def virtual_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FUNCTIONS, lineitem=table(spark, sf_dir, "lineitem"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root manifests of one repository per supplier, built from its key."""
    return spark.sql(
        """
        SELECT concat('r', cast(s_suppkey AS string)) AS repo_id, m.path, m.content FROM {supplier} LATERAL VIEW explode(array(
          struct('package.json' AS path, concat('{{"dependencies": {{"', CASE s_suppkey % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'vue' WHEN 2 THEN 'left-pad' ELSE 'next' END, '": "1"}}, "devDependencies": {{"',
            CASE s_suppkey % 3 WHEN 0 THEN 'vite' WHEN 1 THEN 'webpack' ELSE 'jest' END, '": "2"}}}}') AS content),
          struct('go.mod' AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'require github.com/gin-gonic/gin v1.9' ELSE 'module x' END AS content),
          struct('requirements.txt' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'Django==4' WHEN 1 THEN 'flask-x==1' ELSE 'numpy' END AS content),
          struct(CASE WHEN s_suppkey % 2 = 0 THEN 'pom.xml' ELSE 'build.gradle' END AS path, CASE WHEN s_suppkey % 7 = 0 THEN '<artifactId>spring-boot-starter-web' ELSE 'none' END AS content)
        )) t AS m
        """,
        supplier=table(spark, sf_dir, "supplier"),
    )
