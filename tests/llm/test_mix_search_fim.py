"""Mixing by a curriculum, ranked lexical search, fill-in-middle."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import fill_in_middle, lexical, mixing, registry

SF = "/root/testdata/sf0.001"
# names and types that only a schema object can carry
ODD = "odd struct<`a b`:int,`c``d`:string>, `a``b` int, `n` string, `output` int, `rank` int, `row` int, `moment` int, `size` int"
ODD_VALUES = ((1, "x"), 2, "n", 3, 4, 5, 6, 7)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_curriculum_mixing", "op12_sorted_lexical_search", "op13_fill_in_middle"])
def test_query_equals_sql(spark, con, name):
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# -- bits ---------------------------------------------------------------------


@pytest.mark.parametrize("share", [0, 0.001, 0.2, 0.9, 1])
def test_rank_and_select(share):
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        bits = rng.random(size) < share
        v = fill_in_middle.BitVector(bits)
        assert v.total == bits.sum()
        at = np.arange(size + 1)
        assert (v.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
        assert (v.select(np.arange(v.total)) == np.flatnonzero(bits)).all()


TEXTS = [None, "", " ", "a", " a", "a ", "\t\n", "one two  three\n", "x <P> y", "é ü 漢字 b \x1c c", "a\x0bb\x0cc", "<", "<P", "a <S b> <M", "word " * 300_000, "same", "same"]
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text = text or ""
    w = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(w), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_plainly(spark):
    rows = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS) if t is None or len(t) < 1000] + [(7_000_001, TEXTS[-3]), (7_000_004, TEXTS[-3]), (None, "no id at all"), (3, "twice id"), (3, "twice id")]
    df = spark.createDataFrame([(*r, *ODD_VALUES) for r in rows], f"doc_id long, text string, {ODD}").repartition(3)
    out = fill_in_middle.fill_in_middle(df)
    got = out.select("doc_id", F.col("n"), "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restored(F.col("output"), F.col("form")), F.col("odd.`a b`"), "`a``b`").collect()
    key = lambda r: repr(r)
    assert sorted((tuple(r[:6]) for r in got), key=key) == sorted((plain_fim(*r) for r in rows), key=key)
    texts = Counter((i, t or "") for i, t in rows)
    assert Counter((r[0], r[6]) for r in got) == texts and {tuple(r[7:]) for r in got} == {(1, 2)}
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- mixing -------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if target[s] >= most * sizes[s]}
        if not above:
            return target
        full |= above


def _mixed(spark, rows, **more):
    df = spark.createDataFrame([(*r, *ODD_VALUES) for r in rows], f"doc_id long, text string, source string, {ODD}").repartition(3)
    plan, documents = mixing.curriculum_plan(df, **more)
    return plan, mixing.taken(plan, documents)


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    sources = ["hot"] * 60 + ["b", "é", "zz", None, "tiny", "none"]
    rows = [(i, "w " * int(rng.integers(0, 40)), sources[int(rng.integers(0, 65))]) for i in range(900)]
    rows += [(1000 + i, x, "none") for i, x in enumerate([None, "", " \n"])] + [(2000, "a b c", "tiny")] + [(5, "same row", "b")] * 4 + [(None, "no id", "b"), (None, "no id", None), (6, "long " * 2000, "zz")]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    plan, out = _mixed(spark, rows, bucket_bits=6)
    got = out.collect()
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert any(want[s] == 3 * sizes[s] and sizes[s] for s in sizes), "no source is at its limit"
    again = _mixed(spark, rows[::-1], bucket_bits=1)[1].collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_curriculum_follows_the_schedules(spark):
    """At each tenth of the training, the words of a source so far are those that its schedule's integral asks for."""
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    plan, out = _mixed(spark, rows)
    parts = plan.withColumn("part", F.spark_partition_id()).select("part", "moment", "source", "words").collect()
    by_part = {}
    for r in parts:
        by_part.setdefault(r.part, []).append(r.moment)
    ordered = [by_part[p] for p in sorted(by_part)]
    flat = [m for p in ordered for m in p]
    assert flat == sorted(flat)
    target = {r.source: r.target for r in out.select("source", "target").distinct().collect()}
    for k, s in enumerate("abc"):
        (_, u), (_, v) = mixing.CURRICULUM[k]
        for t in np.linspace(0.1, 1, 10):
            so_far = sum(r.words for r in parts if r.source == s and r.moment <= t)
            assert so_far == pytest.approx(target[s] * (u * t + (v - u) * t * t / 2) / mixing.integral(mixing.CURRICULUM[k]), abs=8)


def test_moment_inverts_any_schedule(spark):
    schedule = ((0.0, 0.0), (0.2, 3.0), (0.5, 0.0), (0.6, 0.0), (1.0, 2.0))
    whole = mixing.integral(schedule)
    for share in (0, 1e-9, 0.1, 0.3, 0.5, 0.75 / whole, 0.9, 1):
        t = spark.range(1).select(mixing.moment_of(F.lit(float(share)), schedule)).first()[0]
        grid = np.linspace(0, t, 20_001)
        area = float(np.trapezoid(np.interp(grid, *zip(*schedule, strict=True)), grid))
        assert area == pytest.approx(share * whole, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.moment_of(F.lit(0.5), ((0.0, 1.0), (0.5, 1.0)))


def test_mix_of_nothing(spark):
    plan, out = _mixed(spark, [])
    assert plan.count() == 0 and out.count() == 0
    plan, out = _mixed(spark, [(1, None, "a"), (2, "", None)])
    assert plan.count() == 0 and [(r.taken, r.target) for r in out.collect()] == [(0, 0.0)] * 2


# -- search -------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, top=10):
    parsed = [(i, terms_of(t)) for i, t in docs]
    parsed = [(i, w, Counter(w)) for i, w in parsed if w]
    n_docs, n_terms = len(parsed), sum(len(w) for _, w, _ in parsed)
    df = Counter(t for _, _, c in parsed for t in c)
    merged = {}
    for i, t in items:
        merged.setdefault(i, []).extend(terms_of(t))
    out = []
    for item, terms in merged.items():
        scores = []
        for doc, w, c in parsed:
            m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return out


def _corpus():
    rng = np.random.default_rng(8)
    word = lambda: f"W{int(rng.zipf(1.3)) % 300}é"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(400)]
    docs += [(500 + i, "the same text w1é w2é") for i in range(40)] + [(7, "repeated W3é row")] * 3 + [(None, "no id w1é"), (600, None), (601, ""), (602, "!!! ---"), (603, "w1é " * 200_000), (604, "漢字 UPPER upper")]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(30)] + [(31, "w1é w1é W1É upper"), (31, "w2é"), (32, None), (33, "?"), (None, "w4é"), (34, "nowhere"), (35, "漢字")]
    return docs, items


@pytest.mark.parametrize("block_terms", [1 << 18, 40])
def test_search_plainly(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "IMPACTS", 300)
    docs, items = _corpus()
    d = spark.createDataFrame([(*r, *ODD_VALUES) for r in docs], f"doc_id long, text string, {ODD}").repartition(5)
    b = spark.createDataFrame([(*r, "clash", 1) for r in items], "item_id long, text string, doc_id string, score int").repartition(2)
    got = lexical.search(d, b, block_terms=block_terms)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_search(docs, items)))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "...")], "doc_id long, text string"), items).collect() == []


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    for top in (0, 1, 65_535, 65_536, 1 << 40):
        keys = rng.integers(0, top + 1, 3000)
        assert (lexical.radix_order(keys, top) == np.argsort(keys, kind="stable")).all()
