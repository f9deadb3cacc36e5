"""Text functions as column expressions.

Java's ``\\s``, ``\\d`` and ``\\W`` are ASCII unless ``(?U)`` is set, and SQL's trim
only takes spaces, so Unicode-aware forms live here and are used everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
BM25_STOP_WORDS = (
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
    "that", "the", "and", "is", "in", "to", "of", "a", "for", "with", "on", "at", "by", "from", "as", "but", "or", "if", "so", "can", "will", "would",
)
KEYWORD_STOP_WORDS = (
    "的", "了", "是", "在", "和", "与", "或", "有", "这", "那", "中", "为", "对", "所有", "全部", "哪些", "什么", "请问", "告诉我", "查询", "列出", "列举", "一下", "一些", "相关", "情况",
    "如何", "怎么", "是否", "有没有",
)
LIST_QUERY_WORDS = ("所有", "全部", "清单", "列表", "汇总", "统计", "有哪些")
KEYWORD_BREAKS = r"[\s，。！？；、,.!?;]+"
SNIPPET, KEYWORDS_KEPT, KEYWORDS_MATCHED, LEAST_TEXT = 300, 8, 5, 10
STORE_LIMITS = {"file_name": 512, "file_hash": 64, "category": 256, "block_type": 32, "heading_path": 1024, "table_headers": 1024, "text": 4000}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Strips white space of any script from both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def clean_text(c: Column | str) -> Column:
    """White space between two ideographs goes (one pass, pairs don't overlap), three or more line ends become two, ends are stripped."""
    joined = F.regexp_replace(_c(c), r"(?U)([一-鿿])\s+([一-鿿])", "$1$2")
    return utrim(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def clean_table_text(c: Column | str) -> Column:
    return utrim(F.regexp_replace(_c(c), "\n{3,}", "\n\n"))


def content_hash(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def format_cell(text: Column, number: Column, day: Column) -> Column:
    """A typed cell as text: dates as year-month-day, integral numbers without a point, others without trailing zeros, strings stripped, null empty."""
    decimals = F.regexp_replace(F.regexp_replace(number.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    whole = number.cast("decimal(38,0)").cast("string")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.when(number == F.floor(number), whole).otherwise(decimals), utrim(text), F.lit(""))


def header_names(headers: Column) -> Column:
    """Stripped headers in one line each; an empty one is called by its position."""
    one_line = lambda h: F.regexp_replace(utrim(F.coalesce(h, F.lit(""))), "\n", " ")
    return F.transform(headers, lambda h, i: F.when(one_line(h) == "", F.concat(F.lit("列"), (i + 1).cast("string"))).otherwise(one_line(h)))


def format_row(headers: Column, cells: Column) -> Column:
    """``header: value`` of every non-empty cell, as far as both sides go."""
    n = F.least(F.size(headers), F.size(cells))
    value = lambda c: F.regexp_replace(utrim(F.coalesce(c, F.lit(""))), "\n", " ")
    pairs = F.zip_with(F.slice(headers, F.lit(1), n), F.slice(cells, F.lit(1), n), lambda h, c: F.when(value(c) != "", F.concat(h, F.lit(": "), value(c))))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")


def bm25_tokens(c: Column | str) -> Column:
    """Lower-cased words between white space, punctuation and symbols, without stop words."""
    plain = F.lower(F.regexp_replace(_c(c), r"[\p{P}\p{S}]+", " "))
    return F.filter(F.split(plain, r"(?U)[\s　]+"), lambda t: (t != "") & ~t.isin(*BM25_STOP_WORDS))


def keywords(c: Column | str) -> Column:
    """Up to eight distinct words of two characters or more, longest first, case kept."""
    return keywords_of(F.split(utrim(c), "(?U)" + KEYWORD_BREAKS))


def keywords_of(words: Column) -> Column:
    """The same from words that a segmenter has cut."""
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*KEYWORD_STOP_WORDS) & ~w.rlike(r"(?U)^[\s\W]+$"))
    ranked = F.array_sort(F.transform(kept, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.array_distinct(F.transform(ranked, lambda r: r["w"])), 1, KEYWORDS_KEPT)


def snippet(c: Column | str) -> Column:
    return F.substring(_c(c), 1, SNIPPET)


def file_type(name: Column | str) -> Column:
    """The upper-case extension without its dot; empty without one."""
    return F.upper(F.regexp_extract(_c(name), r"[^/.][^/]*\.([^./]*)$", 1))


def is_list_query(c: Column | str) -> Column:
    return F.exists(F.array(*map(F.lit, LIST_QUERY_WORDS)), lambda w: F.contains(_c(c), w))


def location(file_name: Column, page: Column, category: Column, heading_path: Column) -> Column:
    """Where a hit stands, for prompts."""
    place = F.concat(F.lit("文件："), file_name, F.lit(" 第"), page.cast("string"), F.lit("页"))
    place = F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit("分类："), category, F.lit(" / "), place)).otherwise(place)
    return F.when(F.coalesce(heading_path, F.lit("")) != "", F.concat(place, F.lit(" / "), heading_path)).otherwise(place)
