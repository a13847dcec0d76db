"""Vectors, conversations, the difference cover, the sketch and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import difference_cover, mtree, preferences, sketch

SF = "/root/testdata/sf0.001"


def test_cover_meets_every_pair():
    d = set(difference_cover.COVER)
    assert {(a - b) % difference_cover.MOD for a in d for b in d} == set(range(difference_cover.MOD))


@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_prefix_classes(alphabet):
    rng = np.random.default_rng(alphabet)
    piece = rng.integers(97, 97 + min(alphabet, 26), 700).astype(np.uint8)
    text = np.concatenate([piece, rng.integers(0, alphabet, 300).astype(np.uint8), piece[100:600], piece])
    starts = rng.permutation(len(text) - 100)[:1500]
    got = difference_cover.equal_prefix_classes(text, starts, 100)
    want = {}
    for s, c in zip(starts.tolist(), got.tolist(), strict=True):
        assert want.setdefault(text[s : s + 100].tobytes(), c) == c
    assert len(set(want.values())) == len(want)


def test_buckets_bound_the_sort(monkeypatch):
    monkeypatch.setattr(difference_cover, "BUCKET", 50)
    test_prefix_classes(2)


def test_sketch_loses_no_repeated_key(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 20_000)
    keys = np.concatenate([keys, keys[:500]])
    rng.shuffle(keys)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(7)
    bits = sketch.repeated_cells(df, lambda b: iter([b.column(0).to_numpy().astype(np.uint64)]))
    values, counts = np.unique(keys.astype(np.uint64), return_counts=True)
    got = sketch.reached(values, bits[0])
    assert got[counts > 1].all() and got[counts == 1].mean() < 0.01


def _vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(30)] + [(5, rows[9][1])]
    rows += [(800, None), (801, [float("nan")] * 8), (802, [None] + [0.0] * 7), (803, [float("inf")] * 8), (None, rows[0][1])]
    return rows, spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(3)


def test_tree_search_is_exact(spark):
    rows, df = _vectors(spark)
    good = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, a in good:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    got = mtree.top_k(df, df.where("vec_id % 100 = 0"), query_block=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lengths_and_sizes_of_vectors_have_a_defined_result(spark):
    """Vectors of another length than most, and those too long for 64-bit scores, take no part."""
    rows = [(0, [1.0, 2.0]), (100, [2.0, 1.0]), (3, [1.0]), (4, [1.0, 2.0, 1.0]), (200, [1.0, 2.0, 3.0]), (5, []), (6, [1e30, 2.0]), (300, [-3e38, 0.0]), (7, [1e4, -1e4]), (8, [3e5, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    good = {i: [int(np.floor(1024 * float(np.float32(c)))) for c in v] for i, v in rows if i in (0, 100, 7, 8)}
    want = []
    for q in (0, 100):
        best = sorted((-sum(x * y for x, y in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, mtree.top_k(df, df.where("vec_id % 100 = 0")).collect())) == want


def test_bounds_avoid_computations_on_clustered_vectors():
    """Written trees search like built ones; where vectors cluster, most inner products are never computed."""
    import pickle

    rng = np.random.default_rng(20)
    centres = rng.normal(0, 300, (40, 16))
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 10, (4000, 16))).astype(np.int64)
    tree = pickle.loads(pickle.dumps(mtree.MTree(x, np.arange(4000))))
    for q in range(0, 4000, 97):
        scores = x @ x[q]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:10]
        assert tree.search(x[q], q) == [(-s, i) for s, i in want]
    assert tree.computed < 0.2 * 4000 * len(range(0, 4000, 97))


def test_tree_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.integers(-400, 400, (900, 6))
    tree = mtree.MTree(x, np.arange(900))
    for node, page in enumerate(tree.pages):
        if page is not None:
            assert (np.sqrt(((tree.full[page] - tree.centre[node]) ** 2).sum(axis=1)) <= tree.radius[node] + 1e-9).all()


def test_search_with_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, mtree.top_k(df, df).collect())) == [(0, 1, 100, 4 * 1024 * 1024), (100, 1, 0, 4 * 1024 * 1024)]
    assert mtree.top_k(df.limit(0), df).count() == 0 and mtree.top_k(df, df.limit(0)).count() == 0


def _brute_preference(c, r):
    k = 0
    while k < min(len(c), len(r)) and c[k] == r[k]:
        k += 1
    if k and k == min(len(c), len(r)) and len(c) != len(r) and c[k - 1][0] == "assistant":
        k -= 1

    def render(turns):
        text, mask = "", []
        for role, body in turns:
            text += f"<|im_start|>{role}\n"
            if role == "assistant":
                mask.append((len(text), len(text) + len(body) + len("<|im_end|>")))
            text += f"{body}<|im_end|>\n"
        return text, mask

    return k, render(c[:k])[0], *render(c[k:]), *render(r[k:])


def test_preferences_equal_brute_force(spark):
    random.seed(8)
    conversations = {i: [(random.choice(["user", "assistant"]), random.choice(["a", "bé", "", "東"])) for _ in range(random.randint(1, 5))] for i in range(60)}
    for i in range(0, 60, 6):
        conversations[i + 1] = conversations[i] + conversations[i + 1]
        conversations[i + 3] = list(conversations[i + 2])
    rows = [(i, k, role, text, "clash") for i, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    random.shuffle(rows)
    turns = spark.createDataFrame([*rows, (None, 0, "user", "x", ""), (5, None, "user", "x", "")], "conv_id long, turn long, role string, text string, prompt string")
    pairs = spark.createDataFrame([(k, 2 * k, 2 * k + 1) for k in range(30)] + [(99, 0, 12345)], "pair_id long, chosen long, rejected long")
    got = {r["pair_id"]: r for r in preferences.format_preferences(turns, pairs).collect()}
    assert sorted(got) == list(range(30))
    for k, r in got.items():
        n, prompt, chosen, cm, rejected, rm = _brute_preference(conversations[2 * k], conversations[2 * k + 1])
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, prompt, chosen, rejected)
        assert [(m["start"], m["end"]) for m in r["chosen_mask"]] == cm and [(m["start"], m["end"]) for m in r["rejected_mask"]] == rm


def test_null_roles_and_texts(spark):
    turns = spark.createDataFrame([(0, 0, None, None), (1, 0, "unknown", ""), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    r = preferences.format_preferences(turns, spark.createDataFrame([(0, 0, 1)], "pair_id long, chosen long, rejected long")).first()
    assert r["prompt"] == "<|im_start|>unknown\n<|im_end|>\n" and r["chosen"] == "" and r["chosen_mask"] == []


def test_near_texts(spark):
    from lodestack.llm import near_text

    random.seed(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[random.choice(vocabulary) for _ in range(300)] for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:6]):  # two words of 300 changed: similarity 0.93; a half replaced: far below
        near = list(w)
        near[50], near[200] = "Xx", "yy"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(w[:150] + [random.choice(vocabulary) for _ in range(150)])), (300 + i, " ".join(w))]
    rows += [(400, None), (401, ""), (402, "a b"), (403, "a b c"), (404, "A b"), (None, " ".join(base[0])), (405, "a b"), (405, "a b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, group_id int").repartition(5)
    got = {r["doc_id"]: r["group_id"] for r in near_text.groups(docs).collect()}
    want = {d: d for d, _ in rows} | {100 + i: i for i in range(6)} | {300 + i: i for i in range(6)} | {401: 400, 405: 402, 404: 402, None: 0}
    assert got == want
    assert near_text.groups(docs.limit(0)).count() == 0


def test_bucket_links_reach_all_that_pairs_reach():
    from lodestack.llm import near_text

    rng = np.random.default_rng(10)
    fps = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    later, earlier = near_text.bucket_links(fps, 4)
    assert (np.bitwise_count(fps[later] ^ fps[earlier]) <= 4).all() and (earlier < later).all() and len(later) <= 2 * len(fps)
    linked = set(later.tolist())
    for i in range(1, len(fps)):
        assert (i in linked) == bool((np.bitwise_count(fps[:i] ^ fps[i]) <= 4).any())


def _near_text_brute_force(texts, radius=3, threshold=0.8):
    """Least index of each text's component, from all pairs within the radius by all five-word shingles."""
    from lodestack.llm import near_text
    from lodestack.llm.textblock import span_hashes, words

    prints, sets = [], []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        starts, ends, _ = words(raw, np.array([0, len(raw)]))
        prints.append(near_text.word_set_fingerprints(span_hashes(raw, starts, ends), np.array([0, len(starts)]))[0].tolist())
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and min((x ^ y).bit_count() for x, y in zip(prints[i], prints[j], strict=True)) <= radius and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_links_of_large_buckets_are_within_the_radius_and_few():
    from lodestack.llm import near_text

    rng = np.random.default_rng(14)
    fps = np.uint64(999) ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    later, earlier = near_text.ordered_links(fps, 2)
    assert (np.bitwise_count(fps[later] ^ fps[earlier]) <= 2).all() and (earlier < later).all() and len(later) < len(fps)


def test_a_large_group_of_near_copies(spark):
    """More texts than are compared in a bucket: one group, and the others apart."""
    from lodestack.llm import near_text

    rng = random.Random(15)
    w = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(700):
        near = list(w)
        near[rng.randrange(200)] = f"n{i}"
        texts.append(" ".join(near))
    texts += [" ".join(f"o{rng.randrange(300)}" for _ in range(120)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["group_id"] for r in near_text.groups(docs).collect()}
    assert all(got[i] == 0 for i in range(700)) and all(got[i] == i for i in range(700, 720))


def test_similar_texts_are_found():
    """Of pairs that random changes leave with a similarity from 0.8 to 0.85, nine of ten or more are within the radius."""
    from lodestack.llm import near_text

    rng = random.Random(16)
    near = total = 0
    for k in range(400):
        w = [f"{rng.randrange(10**9)}" for _ in range(rng.randint(60, 400))]
        other = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) // 52)):
            other[at] = "changed"
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, other))
        if not 0.8 <= len(a & b) / len(a | b) < 0.85:
            continue
        hashes = np.array([hash(x) & (2**64 - 1) for x in w + other], np.uint64)
        x, y = near_text.word_set_fingerprints(near_text.mix(hashes), np.array([0, len(w), 2 * len(w)]))
        total += 1
        near += bool((np.bitwise_count(x ^ y) <= near_text.RADIUS).any())
    assert total > 100 and near >= 0.9 * total


def test_near_texts_in_crowded_buckets_equal_brute_force(spark):
    from lodestack.llm import near_text

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(100):  # nearly all have the same words, so their fingerprints are within a few bits of each other
        w = [rng.choice(vocabulary) for _ in range(400)]
        near = list(w)
        for k in rng.sample(range(400), 6):
            near[k] = rng.choice(vocabulary)
        texts += [" ".join(w), " ".join(near)]
    want = _near_text_brute_force(texts, radius=64)  # fingerprints of any distance
    assert sum(want[i] != i for i in range(len(texts))) > 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["group_id"] for r in near_text.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def _random_sets(rng, n):
    """Sets that share common members, some of them near copies of others, some empty."""
    sets = [set()]
    for _ in range(n):
        if len(sets) > 2 and rng.random() < 0.5:
            new = set(rng.choice(sets))
            for x in rng.sample(sorted(new), min(len(new), rng.randrange(8))):
                new.discard(x)
                new.add(rng.randrange(-(2**62), 2**62))
        else:
            new = {rng.randrange(400) for _ in range(rng.randrange(60))} | {rng.randrange(-(2**62), 2**62) for _ in range(rng.randrange(30))}
        sets.append(new)
    return sets


def test_rare_prefixes_and_bounds_lose_no_similar_pair():
    from collections import Counter

    from lodestack.llm import near_text

    sets = _random_sets(random.Random(21), 250)
    counts = Counter(x for s in sets for x in s)
    flat = np.array([x for s in sets for x in sorted(s)], np.int64)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    level = np.array([0 if counts[int(x)] == 1 else 2 if counts[int(x)] > 15 else 1 for x in flat])
    owner, place, shingle = near_text.rare_prefixes(flat, at, level, 0.8)
    parities = near_text.parity_bits(flat, at)
    found = set()
    for x in np.unique(shingle):
        mine = np.flatnonzero(shingle == x)
        who = owner[mine]
        for u, v in near_text.apart_within(who, np.diff(at)[who], place[mine], parities[who], 0.8):
            found |= {(int(a), int(b)) for a, b in zip(who[u], who[v], strict=True)}
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j]]
    similar = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(similar) > 40 and similar <= found
    assert len(found) < len(pairs) / 10


def test_parity_bits_bound_the_difference():
    from lodestack.llm import near_text

    sets = _random_sets(random.Random(22), 60)
    flat = np.array([x for s in sets for x in sorted(s)], np.int64)
    bits = near_text.parity_bits(flat, np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert not bits[0].any()
    for i in range(len(sets)):
        for j in range(i):
            assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(sets[i] ^ sets[j])


def test_near_texts_longer_than_the_sample_are_decided_exactly(spark):
    from lodestack.llm import near_text

    rng = random.Random(12)
    texts = []
    for k in range(40):  # a changed tail of d words makes the similarity (1196 - d) / (1196 + d): 0.8 is at 132.9
        w = [f"t{k}w{rng.randrange(10**6)}" for _ in range(1200)]
        d = 131 if k % 2 else 135
        texts += [" ".join(w), " ".join(w[: 1200 - d] + [f"x{k}y{rng.randrange(10**6)}" for _ in range(d)])]
    want = _near_text_brute_force(texts, radius=64)
    assert sum(want[i] != i for i in range(len(texts))) == 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = docs.select(F.col("doc_id").alias("node"), near_text.doc_key().alias("doc_key"), near_text.text_key().alias("text_key"))
    pairs = spark.createDataFrame([(i + 1, i) for i in range(0, len(texts), 2)], "u long, v long")
    decided = {r["u"] for r in near_text._similar(pairs, near_text._shingles(docs, wanted), 0.8).collect()}
    assert decided == {i for i in range(len(texts)) if want[i] != i}
    # a pair beyond the radius need not be found, but none is taken that isn't similar, and nothing within them is lost
    got = {r["doc_id"]: r["group_id"] for r in near_text.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_registered_sql_gives_the_same_rows(spark):
    import duckdb

    from lodestack.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        want = con.sql(sql)
        got = registry.queries()[name](spark, SF).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr), name


def test_pipeline_stages_on_planted_cases(spark):
    import corpus_pipeline as p

    clean = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()}
    texts = list(clean.values())
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where(F.length("text") > 120).first()["text"]
    long = max(texts, key=len)
    rows = [(i, t, "en" if i % 2 else None, "s", len(t)) for i, t in clean.items()]
    rows += [(5000, long, "en", "s", 1), (5001, None, None, None, None), (5002, " 12 ", "en", "s", 4), (5003, f"Ahead {item} behind", "en", "s", 9), (5003, f"Ahead {item} behind", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    a = p.language_id(spark, docs, SF)
    assert a.columns == p.COLUMNS and {5001, 5002}.isdisjoint(r["doc_id"] for r in a.collect()) and a.where("lang is null").count() == 0
    b = p.simhash_near_dedup(spark, docs, SF)
    ids = sorted(r["doc_id"] for r in b.collect())
    assert 5000 not in ids and ids.count(5003) == 1
    c = p.suffix_array_dedup(spark, docs, SF)
    assert 5000 not in {r["doc_id"] for r in c.collect()}
    d = {r["doc_id"]: r["text"] for r in p.benchmark_decontamination(spark, docs, SF).collect()}
    assert item not in d[5003] and d[5003].startswith("Ahead")
    assert p.pack_sequences(spark, docs.limit(0), SF).count() == 0


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as p

    rng = random.Random(13)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(5000)}" for _ in range(200)) for x in "abcd")
    near = a + " end"
    rows = [(1, a), (2, b), (2, near), (3, c), (3, d), (3, d), (4, b), (5, c), (6, d), (6, d + " end"), (7, "x y z"), (7, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", str(k), 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in p.simhash_near_dedup(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (3, c), (3, d), (7, "x y z"), (7, None), (None, a), (None, a)], key=repr)
    both = spark.createDataFrame([(8, a, "en", "s", 1), (8, near, "en", "s", 1)], docs.schema)
    assert p.simhash_near_dedup(spark, both, SF).count() == 1


def test_pipeline_runs(spark):
    import corpus_pipeline as p

    assert p.run(spark, SF).where("length > 0").count() > 0
