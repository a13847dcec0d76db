"""Index documents of repositories that adaptive execution would leave in several tasks."""

from pyspark.sql import functions as F

from lodestack import store


def test_a_document_is_one_file_in_order(spark, tmp_path):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1024", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    functions = spark.range(3000).selectExpr(
        "concat('r', cast(id % 3 AS string)) AS repo_id", "IF(id >= 0, 'p', '') AS provider", "cast(size(array(id, 1)) AS int) AS dim", "sha2(cast(id AS string), 256) AS id", "concat('f', cast(id AS string)) AS file_path",
        "'f' AS func_name", "1 AS start_line", "2 AS end_line", "'code' AS code", "array(1f, 2f) AS embedding", "'Go' AS language",
    )
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        store.write_index_documents(functions.repartition(5), str(tmp_path / "index"))
        back = store.read_index_document(spark, str(tmp_path / "index"))
        assert back.count() == 3000 and back.select("file_path").distinct().count() == 3000 and back.where(F.col("dim") != 2).isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = sorted((tmp_path / "index").rglob("*.txt"))
    assert len(files) == 3
    for f in files:
        ids = [line.split('"')[3] for line in f.read_text().split("\n") if '"id":' in line]
        assert len(ids) == 1000 and ids == sorted(ids)
