"""Mixing sources to target weights by a time-varying curriculum.

A source has a weight for each moment of the training, given as knots (moment,
weight) with straight lines between them. The integral of that schedule is the
source's weight over all of the training; weights share the mix, no source gets more
than MOST times its size, and what is above goes to the others by weight, again until
none is above. The demand of a source up to a moment is its target times the part of
the schedule's integral up to then. Documents follow each other in an order that only
their ids and the seed decide, and again from the first one when all are taken; a copy
of a document stands at the moment at which its source's cumulative demand reaches the
copy's middle, so the moment is the inverse of a piecewise quadratic function. Copies
are range-partitioned and sorted by that moment.

All of it is DataFrame functions. Sums over a source are made in steps: documents are
counted in buckets of the order, buckets are summed within a source, documents within
a bucket; so a source of any size is spread over as many groups as it has buckets.
Sources are ranked by a range partition and the shares solved by rounds of
aggregates, of which only four numbers reach the driver.

Defined results: a null source is one of its own, behind the others; null and wordless
texts have size 0 and no copy, but keep their row in taken(); null ids order as an empty id;
rows that repeat id, source and text are told apart by a number and follow each
other; a source without words has target 0; an empty table gives an empty table;
other columns are left out of the plan, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.storage import written

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
SEED = 42
#: Of sources in order, repeating: knots (moment, weight) whose integrals are 5, 2 and 1. The first comes early, the third late.
CURRICULUM = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))

Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    return math.fsum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False))


def _checked(schedule: Schedule) -> Schedule:
    moments = [t for t, _ in schedule]
    if moments[:1] != [0.0] or moments[-1:] != [1.0] or any(a >= b for a, b in zip(moments, moments[1:], strict=False)) or any(w < 0 for _, w in schedule) or integral(schedule) <= 0:
        raise ValueError("a schedule goes from moment 0 to 1 in steps, with weights of at least 0 that are not all 0")
    return schedule


def moment_of(share: Column, schedule: Schedule) -> Column:
    """The moment at which this share (0 to 1) of a schedule's integral is reached."""
    whole, before, out = integral(_checked(schedule)), 0.0, None
    for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False):
        area = (b - a) * (u + v) / 2
        if not area:
            continue
        left = F.greatest(share * whole - before, F.lit(0.0))
        slope = (v - u) / (b - a)
        # u x + slope x^2 / 2 = left, in the form that is stable for small slopes, too
        root = F.sqrt(F.greatest(F.lit(u * u) + 2 * slope * left, F.lit(0.0)))
        at = F.least(F.lit(a) + F.when(left > 0, 2 * left / (root + u)).otherwise(0.0), F.lit(b))
        out = F.when(share * whole <= before + area, at) if out is None else out.when(share * whole <= before + area, at)
        before += area
    return out.otherwise(1.0)


def order_key(seed: int = SEED) -> Column:
    """Place of a document in its source's order, as 64 hex digits of seed, colon and id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key, text_key, n): the documents without their texts; n rows are alike."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), order_key(seed).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.groupBy("doc_id", "source", "size", "key", "text_key").agg(F.count("*").alias("n"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources(source, ...) plus rank, from 0 by code point, null last."""
    parts = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    placed, _ = written(parts.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftrightunsigned("place", 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).count().collect()}  # one row a partition
    before, starts = 0, {}
    for p in sorted(counts):
        starts[p] = before
        before += counts[p]
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[part] if starts else F.lit(0)
    return placed.withColumn("rank", (start + F.col("place").bitwiseAND((1 << 33) - 1)).cast("long")).drop("place")


def targets(sources: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, most: int = MOST) -> DataFrame:
    """sources(source, source_size) plus rank and target: the words that the mix takes of each.

    A round of the sharing is one aggregate; a source that is above stays so, so rounds end."""
    ranked, _ = written(_ranked(sources), "ranked")
    weights = F.array(*[F.lit(float(integral(_checked(s)))) for s in curriculum])
    rows = ranked.withColumn("weight", F.get(weights, (F.col("rank") % len(curriculum)).cast("int"))).withColumn("most", most * F.col("source_size"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) >= F.col("most")
        found = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if found[0] == capped:
            break
        capped = found[0]
        if not found[2]:
            break
        rate = (total - (found[1] or 0)) / found[2]
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(rate), F.col("most").cast("double"))).drop("weight", "most")


def curriculum_plan(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, most: int = MOST, seed: int = SEED, bucket_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, documents). plan: a row for each copy of a document in order of training: moment, doc_id, source, copy (from 0), words, and row, the document's row;
    the last copy that a source gives is cut where its target is met. documents: row, doc_id, source, size, source_size, target."""
    spark = docs.sparkSession
    rows, _ = written(sized(docs, seed), "sized")
    per_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    shares, _ = written(targets(per_source, curriculum, most), "targets")
    # leading bits of the key number the buckets: about as many as one has rows, so that neither sum meets more than a square root of all
    bits = min(28, math.ceil(math.log2(max(1, rows.count())) / 2)) if bucket_bits is None else bucket_bits
    bucket = F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("int"), 28 - bits)
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    starts = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("words")
    starts = starts.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # source and bucket together: a source of a third of all rows is many groups
    located = rows.join(
        starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "rank", "source_size", "target").hint("shuffle_merge"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")),
    ).drop("s", "b")
    inner = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    located = located.withColumn("at", F.coalesce("before", F.lit(0)) + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0)))
    # rows that are alike part here
    located = located.select("*", F.posexplode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i", "_")).drop("_")
    row = F.struct("key", "doc_id", "rank", "size", "text_key", "i").alias("row")
    located, _ = written(located.select(row, "doc_id", "source", "size", "rank", "source_size", "target", (F.col("at") + F.col("i") * F.col("size")).alias("at")), "located")
    copies = located.withColumn("demand", F.round("target").cast("long")).select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    copies = copies.withColumn("start", F.col("at") + F.col("copy") * F.col("source_size")).withColumn("words", F.least("size", F.col("demand") - F.col("start"))).where("words > 0")
    share = (F.col("start") + F.col("words") / 2) / F.col("demand")
    moment = None
    for k, schedule in enumerate(curriculum):
        is_k = F.col("rank") % len(curriculum) == k
        moment = F.when(is_k, moment_of(share, schedule)) if moment is None else moment.when(is_k, moment_of(share, schedule))
    order = ["moment", "rank", "start", "row"]
    plan = copies.withColumn("moment", moment).repartitionByRange(*order).sortWithinPartitions(*order)
    return plan.select("moment", "doc_id", "source", "copy", "words", "row"), located.select("row", "doc_id", "source", "size", "source_size", "target")


def taken(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """documents plus taken: the words that a plan takes of each, repeats counted."""
    sums = plan.groupBy("row").agg(F.sum("words").alias("taken")).withColumnRenamed("row", "r")
    out = documents.join(sums, F.col("row").eqNullSafe(F.col("r")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op11_curriculum_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract digest of curriculum_plan() over whole documents; the plan is a written table, as training would read it."""
    plan, documents = curriculum_plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    stored, _ = written(plan, "plan")
    return taken(stored, documents).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source
), rounds AS (
  SELECT 0 AS k, 0::DOUBLE AS rate
  UNION ALL
  SELECT k + 1, ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3 * source_size), 0) FROM s WHERE weight * rate >= 3 * source_size))::DOUBLE
    / (SELECT sum(weight) FROM s WHERE weight * rate < 3 * source_size)
  FROM rounds WHERE k <= (SELECT count(*) FROM s) AND (SELECT count(*) FROM s WHERE weight * rate < 3 * source_size) > 0
), t AS (
  SELECT source, source_size, least(weight * (SELECT max(rate) FROM rounds), (3 * source_size)::DOUBLE) AS target FROM s
), p AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS demand, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) - size)::BIGINT AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, demand - place)) + greatest(0, least(size, demand - place - source_size)) + greatest(0, least(size, demand - place - 2 * source_size)))::BIGINT AS taken
FROM p
"""
