"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes what a stage returns to the shared folder and reads it again.
All stages but the last return the columns of `documents`.

Defined results, for every stage: an empty table gives an empty one; a null text counts as empty, and rows with an empty text
leave with the first stage that wants letters or words of them; texts of any length are read whole, in one row, so a
row's size bounds what a task holds; rows that repeat an id are documents of their own, but for the near duplicates' rule below;
further columns of `documents`, whatever their names, are not looked at and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, langid, near_text, packing, suffix_dedup
from lodestack.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected whose predicted language covers less of its letters.
LEAST_SHARE = 0.3


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """documents with a new text; rows whose text is all gone go, too."""
    out = df.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike(r"\S")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or without one that covers LEAST_SHARE of their letters, go; a null lang is filled in."""
    docs = docs.select(*COLUMNS)
    out = langid.identify(docs, langid.learn(docs), with_spans=False)
    kept = out.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the least id stays; rows without an id stay.

    Rows that share an id but not the text are different documents, of which the one with the least hash of its text
    counts as the least; of rows that repeat both one stays."""
    docs = docs.select(*COLUMNS)
    found, _ = written(near_text.groups(docs), "near")
    gone = found.where("doc_id <> group_id or (doc_id = group_id and text_key <> group_key)").select("doc_id", "text_key").distinct()
    out = docs.withColumn("text_key", near_text.text_key()).join(gone.hint("shuffle_merge"), ["doc_id", "text_key"], "left_anti")  # the same plan at every size
    if found.where("doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        once = out.where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
        out = once.select("doc_id", "row.*").select(*COLUMNS).unionByName(out.where("doc_id is null").select(*COLUMNS))
    return out.select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a 100-byte string covers which also starts earlier are cut."""
    return _with_text(suffix_dedup.remove_repeats(docs.select(*COLUMNS)), "kept")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside a benchmark window are cut."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(decontaminate.decontaminate(docs.select(*COLUMNS), benchmark), "clean")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]

#: SQL cannot express language ID, SimHash and tokenizers; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs
