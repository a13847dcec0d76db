"""Texts that classes of shingles rule out, where one sketch has no room for all."""

import random

from pyspark.sql import functions as F

from lodestack.llm import near_text


def _docs(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(120)]
    for i in range(0, 40, 2):  # the next one: a few words off
        w = texts[i].split()
        w[rng.randrange(200)] = "changed"
        texts[i + 1] = " ".join(w)
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "two words"), (203, "two words"), (None, texts[50]), (50, texts[50])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_texts_alone_go_and_no_other(spark):
    docs = _docs(spark)
    kept = near_text.candidates_of(docs, classes=8)
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == [-1, *range(40), 50, 50, 200, 201, 202, 203]
    assert near_text.candidates_of(docs, classes=1) is docs


def test_groups_are_the_same(spark, monkeypatch):
    docs = _docs(spark).where(F.col("doc_id").isNotNull())
    once = sorted(map(tuple, near_text.groups(docs).select("doc_id", "group_id").collect()))
    monkeypatch.setattr(near_text, "CLASS_KEYS", 2000)
    assert near_text.n_classes(docs) > near_text.ONE_SKETCH
    assert sorted(map(tuple, near_text.groups(docs).select("doc_id", "group_id").collect())) == once


def test_a_bucket_gives_a_row_a_text_at_most(spark):
    rows = [(i, [0b111 if i % 2 else 0] * near_text.FINGERPRINTS) for i in range(60)]
    nodes = spark.createDataFrame(rows, "node long, fps array<long>")
    links = near_text._candidates(nodes, near_text.RADIUS)
    # with the least and the closest of those before it, a text had two
    assert links.count() <= 2 * 60 and near_text.connected_components(links).select("component").distinct().count() == 1
