"""Columns of any name and type pass through, and a few rows with them get the results that they get without."""

import pytest

from lodestack.llm import decontaminate, langid, near_text, packing, rans, simhash, substring_dedup, suffix_dedup, toxicity

ODD = "odd struct<`a b`:int,`c``d`:string,`e.f`:int>, `a``b` int, `g.h` string, `kept` int, spans string, fp int, `doc` int, `hash` int, score string"
VALUES = ((1, "x", 2), 3, "dots", 4, "s", 5, 6, 7, "t")
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
ROWS = [(1, LONG * 3, "en"), (2, LONG * 3, "en"), (2, LONG * 3, "en"), (3, None, None), (4, "", "fr"), (None, "kein Wort hat eine Nummer", "de"), (5, LONG, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *VALUES) for r in ROWS], f"doc_id long, text string, lang string, {ODD}").repartition(2)


def _benchmark(spark):
    return spark.createDataFrame([(1, LONG)], "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, _benchmark(s)),
    "langid": lambda s, d: langid.identify(d, langid.learn(d)),
    "substring": lambda s, d: substring_dedup.remove_repeats(d),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.learn(d, s.createDataFrame([(1, 1), (2, 0), (5, 1)], "doc_id long, toxic int"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_columns_pass_through(spark, docs, name):
    got = OPERATORS[name](spark, docs)
    plain = OPERATORS[name](spark, docs.select("doc_id", "text", "lang"))
    rows = got.select("doc_id", "odd.`a b`", "odd.`c``d`", "odd.`e.f`", "`a``b`", "`g.h`", "doc", "hash").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(((r[0], 1, "x", 2, 3, "dots", 6, 7) for r in ROWS), key=repr)
    same = [c for c in plain.columns if c not in ("doc", "hash")]
    assert sorted(map(repr, got.select(*same).collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("name", ["simhash", "packing", "near", "tokens"])
def test_odd_columns_do_no_harm(spark, docs, name, tmp_path):
    def run(d):
        if name == "simhash":
            return simhash.near_duplicates(d)
        if name == "packing":
            return packing.pack(d).select("doc_id", "start", "length")
        if name == "near":
            return near_text.groups(d)
        rans.write(d, path := f"file://{tmp_path}/{len(d.columns)}")
        return rans.read(spark, path)

    assert sorted(map(repr, run(docs).collect())) == sorted(map(repr, run(docs.select("doc_id", "text", "lang")).collect()))
