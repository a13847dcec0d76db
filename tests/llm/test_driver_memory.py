"""What the driver's memory follows: exchanges of a step, and bits that come at once."""

import numpy as np

from lodestack.llm import components, sketch


def test_steps_over_few_links_shuffle_nothing(spark, monkeypatch):
    plans = []

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    written = components.written
    monkeypatch.setattr(components, "written", spy)
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (103, 102), (103, 101)], "u long, v long")
    want = {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 104)}
    assert {tuple(r) for r in components.connected_components(links).collect()} == want
    assert len(plans) > 1 and not any("Exchange" in p for p in plans[1:])
    plans.clear()
    monkeypatch.setattr(components, "FEW", 3)
    assert {tuple(r) for r in components.connected_components(links).collect()} == want
    assert any("Exchange" in p for p in plans[1:])


def test_bits_of_a_sketch_come_in_parts(spark, monkeypatch):
    parts = []

    def spy(df, name):
        parts.append(df.rdd.getNumPartitions())
        return written(df, name)

    written = sketch.written
    monkeypatch.setattr(sketch, "written", spy)
    docs = spark.createDataFrame([(k % 50,) for k in range(150)], "k long")
    twice, many = sketch.repeated_cells(docs, lambda batch: iter([batch.column(0).to_numpy().view(np.uint64)]), 4)
    assert parts == [(sketch.DEPTH << sketch.WIDTH_BITS - sketch.SLICE_BITS) // sketch.SLICES_A_TASK]
    keys = np.arange(60, dtype=np.uint64)
    assert sketch.reached(keys, twice).tolist() == [True] * 50 + [False] * 10 and not many.any()
