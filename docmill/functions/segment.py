"""Segmentation of unspaced text: a dictionary trie and the best path over the lattice of its words.

Every dictionary word in a text is an edge of the lattice, weighted by the logarithm of its
share of all weights.  What no word covers goes piece by piece: an ideograph, or a run of
letters and digits, each at half the share of a word of weight one.  The best path has the
largest sum; of equal ones, that with the longer word first.  Ideographs in a row that no
word covers stay together.  White space and punctuation end pieces and are left out,
except within dictionary words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import KEYWORD_STOP_WORDS

# Words of the trade that must stay whole.
DOMAIN_WORDS = (
    "法人代表", "统一社会信用代码", "排污许可证", "营业执照", "聚四氢呋喃", "1,4-丁二醇", "丁二醇", "乙炔", "甲醛", "甲醇", "PTMEG", "BDO", "BYD", "BED", "THF", "NMP", "碳排放", "碳中和", "碳达峰",
    "温室气体", "绿色工厂", "清洁生产", "节能减排", "能源管理", "危险废物", "固体废物", "废水处理", "排污口", "环境影响评价", "竣工验收", "三同时", "单位产品能耗", "综合能耗", "标准煤",
)

_END = ""  # the trie's mark of a whole word; no character


def is_ideograph(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "\U00020000" <= c <= "\U000323af"


class Lattice:
    """A dictionary: words, or words with weights of one or more."""

    def __init__(self, words: Iterable[str] | Mapping[str, float]):
        weights = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, 1.0)
        weights = {w: max(1.0, float(x)) for w, x in weights.items() if w}
        total = sum(weights.values()) + 1
        self.piece = log(0.5 / total)
        self.trie: dict = {}
        for word, weight in weights.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[_END] = log(weight / total)

    def words_at(self, text: str, i: int) -> Iterator[tuple[int, float]]:
        """(end, score) of every dictionary word that begins at a place, shorter ones first."""
        node = self.trie
        for j in range(i, len(text)):
            node = node.get(text[j])
            if node is None:
                return
            if _END in node:
                yield j + 1, node[_END]

    def edges(self, text: str, i: int, run_end: int) -> Iterator[tuple[int, float, bool]]:
        """(end, score, known) of everything that may begin at a place; ``run_end`` is where a run of letters and digits ends."""
        for end, score in self.words_at(text, i):
            yield end, score, True
        if is_ideograph(text[i]):
            yield i + 1, self.piece, False
        elif text[i].isalnum() or text[i] == "_":
            yield run_end, self.piece, False
        else:
            yield i + 1, 0.0, False

    def cut(self, text: str) -> list[str]:
        """The pieces of the best path, in order; time grows with the text and the longest word."""
        n = len(text)
        best, step = [0.0] * (n + 1), [(n, False)] * (n + 1)
        run_end = n
        for i in range(n - 1, -1, -1):
            wordy = (text[i].isalnum() or text[i] == "_") and not is_ideograph(text[i])
            if not wordy or i + 1 == n or is_ideograph(text[i + 1]) or not (text[i + 1].isalnum() or text[i + 1] == "_"):
                run_end = i + 1
            score, end, known = max((s + best[j], j, k) for j, s, k in self.edges(text, i, run_end))
            best[i], step[i] = score, (end, known)
        out: list[str] = []
        i, loose = 0, False  # whether the last piece may grow
        while i < n:
            end, known = step[i]
            piece = text[i:end]
            if known or is_ideograph(piece[0]) or piece[0].isalnum() or piece[0] == "_":
                grows = not known and is_ideograph(piece[0])
                if grows and loose:
                    out[-1] += piece
                else:
                    out.append(piece)
                loose = grows
            else:
                loose = False
            i = end
        return out


def segmenter(words: Iterable[str] | Mapping[str, float] = ()) -> Callable[[str], list[str]]:
    """Cuts texts into words of the trade and further ``words`` of the user's, kept whole, and what lies between.
    Stop words of several characters are cut off likewise, so that no keyword holds them."""
    own = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, 1.0)
    stops = (w for w in KEYWORD_STOP_WORDS if len(w) > 1)
    return Lattice(dict.fromkeys((*DOMAIN_WORDS, *stops), 1.0) | own).cut


def occurrences(docs: DataFrame, words: Iterable[str], text: str = "text") -> DataFrame:
    """(word, n): how often every word stands in the texts, overlapping ones included; weights for a ``Lattice``.

    The words go to the tasks as a trie, counts are summed in the tasks before the shuffle; words without a hit count 0.
    """
    from docmill.workers import map_arrow

    words = sorted({w for w in words if w})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(words), Counter()
        for batch in batches:
            for value in batch.column(0):
                own = value.as_py() or ""
                counts.update(own[i:end] for i in range(len(own)) for end, _ in lattice.words_at(own, i))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    every = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
    found = map_arrow(docs.select(text), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return every.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
