"""Document operators against brute force, on rows with every awkward case."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, langid, packing, rans, simhash, substring_dedup, suffix_dedup, tokens, toxicity
from lodestack.llm.storage import new_path
from lodestack.llm.textblock import BLOCK_BYTES, as_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, kept int, fp string, n_words string"
random.seed(5)
WORDS = ["the", "of", "Thé", "nation", "x", "ñandú", "größe", "don't", "a1b2", "loser", "—", "東京"]


def _text(n, words=WORDS):
    return " ".join(random.choice(words) for _ in range(n))


PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = _text(6000)
BASE = [
    (0, PASSAGE), (1, f"start {PASSAGE} end"), (2, f"{PASSAGE} tail {PASSAGE}"), (3, ""), (4, None), (5, "   \n\t "), (6, "one"), (7, "one two"), (8, "one"),
    (9, "a" * 400), (10, "a" * 150 + "b" + "a" * 150), (11, LONG), (12, LONG[:9000] + " changed " + LONG[9000:]), (13, LONG), (14, "ab" * 200), (15, _text(40)),
    (16, "tab\tand\u0085odd spaces  here\x1cend"), (17, " lead"), (18, "12345 !!! ???"), (19, "<|endoftext|> text"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, 2, "f", "w") for i, t in rows], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_suffix_dedup_equals_brute_force(spark):
    out = suffix_dedup.remove_repeats(frame(spark, BASE).repartition(5), with_text=True)
    got = rows_of(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(suffix_dedup.brute_force(BASE), key=repr)
    assert {"score", "fp"} <= set(out.columns)


def _brute_substring(docs):
    import hashlib

    split = [(d, (t or "").encode().split()) for d, t in docs]
    least = {}
    for d, w in split:
        for i in range(len(w) - 12):
            least[tuple(w[i : i + 13])] = min(least.get(tuple(w[i : i + 13]), d), d)
    out = []
    for d, w in split:
        gone = {k for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup_equals_brute_force(spark):
    got = rows_of(substring_dedup.remove_repeats(frame(spark, BASE).repartition(5)).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == _brute_substring(BASE)


@pytest.mark.parametrize("heavy", [2, 5])
def test_heavy_anchors_give_the_same_result(spark, heavy):
    """All anchors or the frequent ones go by portions: a passage within many surroundings, runs of one letter, copies."""
    rng = random.Random(heavy)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    rows = [(i, f"{' '.join(rng.choice(words) for _ in range(rng.randint(0, 30)))} {PASSAGE[: rng.randint(0, 300)]} {' '.join(rng.choice(words) for _ in range(20))}") for i in range(60)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:10])] + [(200, "a" * 500), (201, "b" + "a" * 300 + "b" + "a" * 90), (202, "ab" * 150), (203, f"{PASSAGE} {PASSAGE}"), (204, " ".join(words) * 3)]
    docs = frame(spark, rows).repartition(6)
    got = rows_of(suffix_dedup.remove_repeats(docs, heavy=heavy).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(suffix_dedup.brute_force(rows), key=repr)
    got = rows_of(substring_dedup.remove_repeats(docs, heavy=heavy).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == _brute_substring(rows)


def test_dedup_keeps_clashing_columns(spark):
    names = ["doc", "hash", "spans", "doc2", "hash2", "key", "payload", "__doc", "__spans", "kept"]
    docs = frame(spark, [(1, PASSAGE), (2, PASSAGE)]).select("doc_id", "text", *[F.lit(f"mine {n}").alias(n) for n in names])
    for out in (suffix_dedup.remove_repeats(docs), substring_dedup.remove_repeats(docs)):
        rows = out.collect()
        assert all(r[n] == f"mine {n}" for r in rows for n in names[:-1])
        assert {r["doc_id"]: r["kept"] for r in rows} == {1: PASSAGE, 2: ""}
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(docs.withColumn("doc_id", F.lit("x")))


def test_repeated_rows_and_null_ids_have_a_defined_result(spark):
    rows = [(None, PASSAGE), (1, PASSAGE), (1, PASSAGE), (2, None), (2, "")]
    n_bytes = len(PASSAGE.encode())
    got = rows_of(suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_removed"))
    assert got == sorted([(None, 0), (1, n_bytes), (1, n_bytes), (2, 0), (2, 0)], key=repr)
    got = rows_of(substring_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_removed"))
    assert got == sorted([(None, 0), (1, 60), (1, 60), (2, 0), (2, 0)], key=repr)


def test_hot_passage_collapses(spark):
    rows = [(i, f"{i} before {PASSAGE} after {i * i}") for i in range(300)]
    got = rows_of(suffix_dedup.remove_repeats(frame(spark, rows).repartition(6)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(suffix_dedup.brute_force(rows), key=repr)


def test_simhash_equals_brute_force(spark):
    rows = BASE + [(100 + i, LONG.replace("nation", "station", i)) for i in range(30)]
    out = simhash.near_duplicates(frame(spark, rows).repartition(3)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert rows_of(out) == sorted(simhash.brute_force(rows), key=repr)


def test_simhash_large_buckets_and_chains(spark):
    base = 0x0123456789ABCDEF
    fps = {base} | {base ^ (1 << i) for i in range(40)} | {base ^ (1 << i) ^ (1 << (i + 1)) ^ (1 << (i + 2)) for i in range(0, 40, 3)} | {0, 1 << 63, 0xFFFF << 20}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.links_within(spark.createDataFrame([(x,) for x in fps], "fp long"))
    from lodestack.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    label = {x: x for x in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    assert {x: got.get(x, x) for x in fps} == label


def test_covering_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_decontamination_equals_brute_force(spark):
    items = [(1, PASSAGE), (2, "one two"), (2, "again"), (3, None), (4, " ... "), (None, "the of x nation"), (5, _text(12))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    out = decontaminate.decontaminate(frame(spark, BASE), bench, block_bytes=100)
    got = rows_of(out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256), F.col("n_hit") > 0))
    assert got == sorted(decontaminate.brute_force(BASE, items), key=repr)
    clean = {r["doc_id"]: r["clean"] for r in out.collect()}
    assert clean[1].split() == ["start", "end"] and clean[6] == "one" and clean[7] == ""


def test_fm_index_finds_every_occurrence():
    from lodestack.llm.fm_index import FMIndex

    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (50, 3), (700, 5)):
        text = rng.integers(0, k, n)
        index = FMIndex(text, k)
        patterns = rng.integers(1, k, (40, 4))
        lengths = rng.integers(1, 5, 40)
        lo, hi = index.search(patterns, lengths)
        for p, m, a, b in zip(patterns, lengths, lo, hi, strict=True):
            want = [i for i in range(n - m + 1) if (text[i : i + m] == p[:m]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


_ALPHABET = [
    " ", " ", " ", "\n", "\n\n", "  ", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "a", "B", "word", "Hello", "nation",
    "é", "É", "ñ", "Ñ", "ß", "ÿ", "Ÿ", "Þ", "þ", "×", "İ", "İ.", "İ,", "Σ", "ΑΣ", "ﬁ", "e\u0301", "A\u030a", "\u0301", "ª", "µ", "ĳ", "ǅ", "東京", "☃", "😀",
    "0", "1", "23", "９", "Ⅷ", "'", "'s", "'LL", ".", ",", "!", "_", "-", "—", "\x00", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "x" * 23, "y" * 40, "?" * 30,
]


@pytest.mark.parametrize("memo", [2_000_000, 600, 40])
@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_librarys_ids(file, memo):
    """Against a tokenizer as the file describes it, no setting changed; small memos lose pieces on the way."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(memo)
    m = tokens.PieceMemo(tokens.tokenizer_file(file), memo_pieces=memo)
    assert m.cuts
    texts = [t for _, t in BASE] + [None, "", "hello <|endoftext|> world", "ok İstanbulİ. end", "aİ.", "☃ snow☃", "a\n\nb", "x\ny", " ", "\n", "don't DON'T 's"]
    texts += ["".join(rng.choice(_ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(" aéÉB.'1\n") for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    plain = Tokenizer.from_file(tokens.tokenizer_file(file))
    want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        for k in range(0, len(texts), 500):
            ids, at = m.encode(pa.array(texts[k : k + 500], pa.string()))
            got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
            assert got == want[k : k + 500]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    rules = json.load(open(tokens.tokenizer_file("byte_bpe_50k.json")))
    rules["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(rules))
    m = tokens.PieceMemo(str(tmp_path / "t.json"))
    assert not m.cuts
    texts = ["one two", None, "x <|endoftext|> y"]
    plain = Tokenizer.from_file(str(tmp_path / "t.json"))
    ids, at = m.encode(pa.array(texts, pa.string()), 3)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids + [3] for t in texts]


def _ids(text, file, end):
    from tokenizers import Tokenizer

    t = _PLAIN.setdefault(file, Tokenizer.from_file(tokens.tokenizer_file(file)))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


_PLAIN = {}


def test_rans_files_round_trip(spark):
    rows = [r for r in BASE if r[0] != 5] + [(5, "x"), (5, "x"), (5, "y")]
    path = new_path(spark, "test")
    rans.write(frame(spark, rows).repartition(4), path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in rans.read(spark, path).collect())
    assert [g[1] for g in got] == sorted(r[0] for r in rows)
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0
    want = sorted((d, _ids(t, "byte_bpe_50k.json", 0)) for d, t in rows)
    assert sorted((g[1], g[4]) for g in got) == want
    assert all(g[3] == zlib.crc32(g[4]) and 4 * g[2] == len(g[4]) for g in got)


def test_rans_segments_decode_alone_and_check_themselves():
    rng = np.random.default_rng(2)
    data = np.minimum(rng.geometric(0.02, 5000), 499)
    table = rans.Table(rans.quantise(np.bincount(data, minlength=500)))
    block = rans.encode(data, table, lanes=16, every=32)
    assert (rans.decode(block, table) == data).all()
    k = len(block["places"]) - 1
    assert (rans.decode_segment(block, table, k) == data[k * 512 :]).all()
    broken = block | {"words": bytes(len(block["words"]))}
    with pytest.raises(ValueError):
        rans.decode(broken, table)


def _check_pieces(rows, docs, window=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for d, t in docs:
        pieces = sorted(by_doc[d], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in pieces) == _ids(t, "word_bpe_49k.json", 1)
    fills = []
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.concatenate([[0], np.cumsum([r["length"] for r in pieces])[:-1]]).tolist()
        fills.append(sum(r["length"] for r in pieces))
    assert max(fills) <= window and sum(f < window for f in fills) <= 1
    return by_sequence


def test_packing_keeps_every_id_once(spark):
    rows = BASE + [(200 + i, _text(random.randint(1, 3000))) for i in range(120)]
    _check_pieces(packing.pack(frame(spark, rows).repartition(5)).collect(), rows)


def test_packing_solves_counts():
    h = np.zeros(2048, np.int64)
    h[[1000, 1048, 500, 548, 700]] = [40, 40, 30, 30, 7]
    p = packing.plan(h)
    assert p["sequences"] == -(-int((h * np.arange(2048)).sum()) // 2048)  # no window but the last has room
    assert p["residual"] < h.sum() / 2
    x = packing.non_negative_least_squares([(1000, 1048)], h)
    assert x.min() >= 0 and abs(x[0] - 40) < 0.1


def test_language_id_learns_and_labels_spans(spark):
    english, german = ["the", "nation", "with", "thing", "other", "ship"], ["der", "größe", "schön", "nicht", "auch", "über"]
    rows = [(i, _text(60, english if i % 2 else german), "en" if i % 2 else "de") for i in range(120)]
    mixed = " ".join([_text(40, english), _text(25, german), _text(40, english)])
    extra = [(1000, mixed, None), (1001, None, "en"), (1002, "123 !!", "en"), (1003, "", None), (None, "the thing with the other ship", None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = {r["doc_id"]: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [s["lang"] for s in out[1000]["lang_spans"]] == ["en", "de", "en"] and out[1000]["lang_pred"] == "en"
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1001, 1002, 1003))
    assert out[None]["lang_pred"] == "en"


def test_constant_path_shortcut_agrees_with_the_search():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.normal(0, 6, (rng.integers(1, 9), 3))
        best = max((sum(s[t, p[t]] for t in range(len(p))) - 5 * sum(a != b for a, b in zip(p, p[1:], strict=False)), p) for p in __import__("itertools").product(range(3), repeat=len(s)))
        got = langid.viterbi(s, 5)
        assert abs(sum(s[t, got[t]] for t in range(len(s))) - 5 * int((np.diff(got) != 0).sum()) - best[0]) < 1e-9


def test_toxicity_on_held_out_documents(spark):
    bad = ["scum", "moron", "loser"]
    rows = [(i, _text(40, ["the", "of", "nation", "thing"]) + (" " + random.choice(bad) + " " + random.choice(bad) if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows + [(None, "scum"), (1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), 5) for i in range(0, 400, 2)] + [(7, 1, None, 5), (None, 1, 1, 5)], "doc_id long, quality int, toxic int, text int")
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(out[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.95
    assert 0 <= out[1000] < 0.7 and out[1000] == out[1001]
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels.where("toxic = 0"))).collect()} == {0.0}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    docs = frame(spark, BASE[:n])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = new_path(spark, "empty")
    rans.write(docs, path)
    results = [
        rans.read(spark, path), suffix_dedup.remove_repeats(docs), substring_dedup.remove_repeats(docs), simhash.near_duplicates(docs), decontaminate.decontaminate(docs, bench),
        packing.pack(docs), langid.identify(docs, langid.learn(docs)), toxicity.score(docs, toxicity.learn(docs, labels)),
    ]
    assert [r.count() for r in results] == [n] * 8


def test_word_ids_by_blocks_equal_those_of_whole_texts():
    rng = random.Random(5)
    texts = ["", None, "one Two", " ".join(rng.choices(["One", "two", "x", "é"], k=BLOCK_BYTES // 2)), "...", *(" ".join(rng.choices(["two", "y"], k=2000)) for _ in range(300)), "one"]
    vocabulary = {b"one": 1, b"two": 2, "é".encode(): 3}
    ids, bounds = decontaminate.word_ids(*as_bytes(pa.array(texts, pa.string())), vocabulary)
    expected = [[vocabulary.get(w, 0) for w in decontaminate.fold_words(t)] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected
