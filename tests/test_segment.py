"""Best paths against all paths, and words that stay whole."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.functions.segment import DOMAIN_WORDS, Lattice, is_ideograph, occurrences, segmenter
from docmill.functions.text import keywords_of
from docmill.operators.plugins import segment_column
from docmill.operators.retrieval import keyword_list


def runs(text):
    """End of the run of letters and digits that a place stands in."""
    wordy = [(c.isalnum() or c == "_") and not is_ideograph(c) for c in text]
    return [next((j for j in range(i, len(text)) if not wordy[j]), len(text)) if wordy[i] else i + 1 for i in range(len(text))]


def paths(lattice, text, i=0):
    """All paths from a place: (score, ends)."""
    if i == len(text):
        yield 0.0, ()
        return
    for end, score, known in lattice.edges(text, i, runs(text)[i]):
        for rest, ends in paths(lattice, text, end):
            yield score + rest, ((end, known), *ends)


def pieces(text, ends):
    out, i, loose = [], 0, False
    for end, known in ends:
        piece = text[i:end]
        plain = not known and is_ideograph(piece[0])
        if known or plain or piece[0].isalnum() or piece[0] == "_":
            if plain and loose:
                out[-1] += piece
            else:
                out.append(piece)
        loose = plain
        i = end
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_path_is_the_best_of_all(seed):
    r = random.Random(seed)
    for _ in range(60):
        words = {"".join(r.choice("甲乙丙ab1,") for _ in range(r.randrange(1, 4))): r.choice([1, 2, 50]) for _ in range(r.randrange(8))}
        lattice, text = Lattice(words), "".join(r.choice("甲乙丙丁ab1, -") for _ in range(r.randrange(11)))
        score, ends = max(paths(lattice, text), key=lambda p: (round(p[0], 9), [e for e, _ in p[1]], [k for _, k in p[1]]))
        found = lattice.cut(text)
        told = {tuple(pieces(text, e)) for s, e in paths(lattice, text) if abs(s - score) < 1e-9}
        assert tuple(found) in told and "".join(found) == "".join(pieces(text, ends))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("请问排污许可证的有效期", ["请问", "排污许可证", "的有效期"]),
        ("1,4-丁二醇和丁二醇, BDO", ["1,4-丁二醇", "和", "丁二醇", "BDO"]),
        ("综合能耗 2023年 kgce/t", ["综合能耗", "2023", "年", "kgce", "t"]),
        ("请问哪些废水处理情况", ["请问", "哪些", "废水处理", "情况"]),
        ("排污口排污许可证", ["排污口", "排污许可证"]),
        ("plain words, only_one", ["plain", "words", "only_one"]),
        ("", []),
        (" ，。", []),
    ],
)
def test_words_of_the_trade_stay_whole(text, want):
    assert segmenter()(text) == want


def test_user_words_and_weights():
    assert segmenter(["有效期"])("排污许可证的有效期") == ["排污许可证", "的", "有效期"]
    both = {"研究生": 5, "生命": 50, "研究": 50, "起源": 5}
    assert Lattice(both).cut("研究生命起源") == ["研究", "生命", "起源"]
    assert Lattice(both | {"研究生": 10_000}).cut("研究生命起源") == ["研究生", "命", "起源"]


def test_long_text_takes_linear_time():
    text = "排污许可证x1 " * 50_000
    assert len(segmenter()(text)) == 100_000


def test_occurrences(spark):
    docs = spark.createDataFrame([("aaa 排污口",), (None,), ("",), ("排污口排污",)], "text string")
    assert {r.word: r.n for r in occurrences(docs, ["aa", "排污", "排污口", "none", ""]).collect()} == {"aa": 2, "排污": 3, "排污口": 2, "none": 0}


def test_keywords_of_a_query(spark):
    assert keyword_list(spark, "请问排污许可证和综合能耗，BDO？", segmenter()) == ["排污许可证", "综合能耗", "BDO"]
    df = spark.createDataFrame([("单位产品能耗 是 多少",), (None,)], "t string")
    assert [r.w for r in df.select(keywords_of(segment_column(F.col("t"), segmenter)).alias("w")).collect()] == [["单位产品能耗", "多少"], []]


def test_keywords_of_a_table(spark):
    from docmill.plans import registry

    rows = registry.QUERIES["kw_segment"](spark, "/root/testdata/sf0.001").collect()
    words = [*DOMAIN_WORDS, "排污"]
    told = [(r, words[r.id % len(words)]) for r in rows]
    assert rows and sum(w in r.keywords.split("|") or len(r.keywords.split("|")) == 8 for r, w in told) >= 0.9 * len(rows)
