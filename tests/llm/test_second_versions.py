"""Language ID, the toxicity learner and the packer's solver against plain versions, and all registered queries once."""

import math
import random

import numpy as np
import pytest

from lodestack.llm import langid, packing, registry, toxicity

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1

# -- language ID --------------------------------------------------------------


def _words(text):
    out, held, start = [], "", 0
    for i, c in enumerate(text.lower() + "\n"):
        if c.isalpha():
            start, held = (start if held else i), held + c
        elif held:
            out.append(held)
            held = ""
    return out


def _bucket(gram):
    h = len(gram)
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + (32 if c == " " else ord(c))) & M64
        h ^= h >> 29
    return ((h * 0xBF58476D1CE4E5B9) & M64) >> 48


def _grams(word):
    padded = f" {word} "
    for n in langid.ORDERS:
        for i in range(len(padded) - n + 1):
            yield n, _bucket(padded[i : i + n])


def _script(word):
    for k, ranges in enumerate(langid.SCRIPTS.values(), 1):
        if any(a <= ord(word[0]) <= b for a, b in ranges):
            return k
    return 0


def _plain_path(scores, penalty):
    """Best path by comparing all predecessors; of equal ones staying comes first, then the first language."""
    best, back = list(scores[0]), []
    for row in scores[1:]:
        new, from_ = [], []
        for j, s in enumerate(row):
            value, at = max((best[i] - (penalty if i != j else 0), i == j, -i) for i in range(len(row)))[0::2]
            new.append(value + s)
            from_.append(-at)
        best = new
        back.append(from_)
    j = max(range(len(best)), key=lambda i: (best[i], -i))
    path = [j]
    for from_ in reversed(back):
        j = from_[j]
        path.append(j)
    return path[::-1]


def _plain_identify(train, texts, penalty=langid.PENALTY):
    languages = sorted({lang for _, lang in train})
    counts = {lang: {} for lang in languages}
    letters = {lang: [0] * (len(langid.SCRIPTS) + 1) for lang in languages}
    for text, lang in train:
        for w in _words(text):
            letters[lang][_script(w)] += len(w)
            for g in _grams(w):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    totals = {lang: {n: sum(c for (m, _), c in counts[lang].items() if m == n) + 0.5 * (1 << langid.BUCKET_BITS) for n in langid.ORDERS} for lang in languages}
    allowed = {lang: [x / max(1, sum(v)) >= langid.SCRIPT_SHARE for x in v] for lang, v in letters.items()}
    out = []
    for text in texts:
        w = _words(text or "")
        if not w:
            out.append(("und", 0.0, None))
            continue
        scores = []
        for x in w:
            k, row = _script(x), []
            for lang in languages:
                s = sum(math.log((counts[lang].get(g, 0) + 0.5) / totals[lang][g[0]]) / len(langid.ORDERS) for g in _grams(x))
                row.append(s if allowed[lang][k] or not any(allowed[y][k] for y in languages) else s - 1e6)
            scores.append(row)
        path = _plain_path(scores, penalty)
        share = [sum(len(x) for x, p in zip(w, path, strict=True) if p == i) for i in range(len(languages))]
        best = share.index(max(share))
        out.append((languages[best], share[best] / sum(share), [languages[p] for p in path]))
    return out


@pytest.mark.parametrize("group", [200, 2])
def test_language_id_equals_a_plain_version(spark, group):
    rng = random.Random(41)
    alphabets = {"aa": "abcdefg", "bb": "fghijklé", "cc": "mnopqrs", "gr": "αβγδεζ", "ru": "абвгдеж"}
    lexicon = {lang: ["".join(rng.choice(a) for _ in range(rng.randint(1, 9))) for _ in range(60)] for lang, a in alphabets.items()}
    say = lambda lang, n: [rng.choice(lexicon[lang]) for _ in range(n)]
    rows = [(i, " ".join(say(lang, 30)).capitalize() + ", 12!", lang) for i, lang in enumerate(list(alphabets) * 12)]
    mixed = [" ".join(w for _ in range(rng.randint(1, 4)) for w in say(rng.choice(list(alphabets)), rng.randint(1, 25))) for _ in range(60)]
    texts = [*mixed, None, "", "12 !?", "漢字 abc", "x", "\U00010400 \U00010401"]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(train, group=group)
    assert len(model.groups) == -(-5 // group)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in langid.identify(asked, model).collect()}
    import zlib

    kept = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    for i, (lang, share, path) in enumerate(_plain_identify(kept, texts)):
        r = got[i]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(share), texts[i]
        if path:
            assert [s["lang"] for s in r["lang_spans"] for _ in range(s["end"] - s["start"])] == path, texts[i]


# -- toxicity -----------------------------------------------------------------


def _risk(w, positive, unlabelled, prior):
    """(what labels as negative cost, what they cost as positive), by loops."""
    z = lambda doc: w[-1] + sum(w[f] for f in doc)
    loss = lambda z, y: math.log1p(math.exp(-abs(z))) + max(0.0, -z * y)
    as_positive = prior * sum(loss(z(d), 1) for d in positive) / len(positive)
    negative = sum(loss(z(d), -1) for d in unlabelled) / len(unlabelled) - prior * sum(loss(z(d), -1) for d in positive) / len(positive)
    return negative, as_positive


def _plain_fit(positive, unlabelled, prior, k, rounds):
    w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[-1] = math.log(prior / (1 - prior))
    branches = set()
    for t in range(1, rounds + 1):
        negative = _risk(w, positive, unlabelled, prior)[0]
        branches.add(negative >= 0)
        # non-negative risk: where the corrected negative part falls below zero, it alone is driven up
        goal = (lambda w: sum(_risk(w, positive, unlabelled, prior))) if negative >= 0 else (lambda w: -_risk(w, positive, unlabelled, prior)[0])
        g = np.zeros(k + 1)
        for i in range(k + 1):
            up, down = w.copy(), w.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            g[i] = (goal(up) - goal(down)) / 2e-5
        g[:-1] += toxicity.DECAY * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - toxicity.RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w, branches


@pytest.mark.parametrize("prior", [0.3, 0.8])
def test_nnpu_equals_a_plain_version(prior):
    rng = random.Random(6)
    features = [11, 222, 3333, 44444]
    positive = [[f for f in features if rng.random() < 0.7] for _ in range(30)]
    unlabelled = [[f for f in features if rng.random() < (0.7 if rng.random() < 0.3 else 0.05)] for _ in range(60)]

    def arrays(docs):
        return np.array([i for i, d in enumerate(docs) for _ in d], np.int64), np.array([f for d in docs for f in d], np.int64), len(docs)

    rounds = 60
    weights, bias = toxicity.fit(arrays(positive), arrays(unlabelled), prior, rounds)
    at = {f: i for i, f in enumerate(features)}
    w, branches = _plain_fit([[at[f] for f in d] for d in positive], [[at[f] for f in d] for d in unlabelled], prior, len(features), rounds)
    assert branches == {True, False}
    assert np.allclose(weights[features], w[:-1], atol=2e-3) and abs(bias - w[-1]) < 2e-3
    assert set(np.flatnonzero(weights)) <= set(features)


# -- packing ------------------------------------------------------------------


def _active_set(a, b):
    """Lawson and Hanson's solver."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if w.max() <= 1e-9:
            break
        free[w.argmax()] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                break
            bad = free & (s <= 0)
            step = (x[bad] / (x[bad] - s[bad] + 1e-300)).min()
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return x


def test_nnls_equals_an_active_set_solver():
    rng = np.random.default_rng(9)
    for _ in range(5):
        histogram = np.zeros(65, np.int64)
        histogram[rng.integers(4, 60, 25)] = rng.integers(1, 400, 25)
        combos = packing.combinations(histogram, 64)
        a = np.zeros((65, len(combos)))
        for j, c in enumerate(combos):
            for length in c:
                a[length, j] += 1
        want = _active_set(a, histogram.astype(float))
        got = packing.non_negative_least_squares(combos, histogram, 4000)
        cost = lambda x: float(((a @ x - histogram) ** 2).sum())
        assert (got >= 0).all() and cost(got) <= cost(want) * 1.001 + 0.5


# -- queries ------------------------------------------------------------------


@pytest.mark.parametrize("name", registry.queries())
def test_registered_queries_return_their_rows(spark, name):
    out = registry.queries()[name](spark, SF)
    rows = out.collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    n = int(name[2:].split("_")[0])
    if n in (1, 4, 5, 6, 7, 8, 9, 11, 13):
        assert len(rows) == documents == len({r["doc_id"] for r in rows})
    elif n == 10:
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    else:
        assert rows
