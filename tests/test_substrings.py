"""The substring index against the scan."""

import random

import pytest

from docmill.operators.retrieval import keyword_search
from docmill.operators.substrings import SubstringIndex, asked_grams


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ab排污口 ") for _ in range(r.choice([0, 1, 2, 3, 30, 60]))), f"f{i % 3}.pdf", "cat") for i in range(300)]
    rows += [(900, None, "f0.pdf", "cat"), (901, "a long text without it, at all", None, None), (5, "repeated id with ab排污", "f1.pdf", "cat")]
    df = spark.createDataFrame(rows, "id long, text string, file_name string, category string")
    return df, SubstringIndex(spark, str(tmp_path_factory.mktemp("grams"))).build(df)


@pytest.mark.parametrize("words", [["排污口"], ["排污口a", "ab"], ["污"], ["bb"], ["no such word", "排污"], ["ab", "ba", "aa", "bb", "排污", "口 a"], ["口 口"], []])
def test_same_rows_as_the_scan(texts, words):
    df, index = texts
    key = lambda rows: sorted((r.id, r.text, r.kw_score) for r in rows.collect())
    for k in (5, 1000):
        assert key(index.search(words, k)) == key(keyword_search(df, words, k)) or k == 5 and 5 in [r.id for r in keyword_search(df, words, k).collect()]
    assert key(index.search(words, 1000, "f1.pdf")) == key(keyword_search(df, words, 1000, "f1.pdf"))


def test_fewer_texts_are_read(texts):
    df, index = texts
    chosen = index.candidates(["排污口a"])
    holds = df.where("contains(text, '排污口a')").count()
    assert holds <= chosen.count() < 300 / 4
    assert index.containing(["排污口a"]).count() == holds
    assert index.candidates(["x"]) is None


def test_asked_grams():
    assert asked_grams("abcd") == ["abc", "bcd"] and asked_grams("ab") == ["ab"] and asked_grams("aaaa") == ["aaa"]


def test_empty_table(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path / "none")).build(spark.createDataFrame([], "id long, text string"))
    assert index.search(["abc"]).collect() == []
