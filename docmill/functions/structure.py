"""Heading levels as column expressions, and heading paths as windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LEVEL = 9
DOCX_PAGE = 40


def likely_heading(text: Column) -> Column:
    """Level by a number prefix of a short line without a colon; 0 if none."""
    fits = F.length(text).between(4, 80) & ~text.rlike("[:：]")
    level = F.when(text.rlike(r"(?U)^\d+\.\d+\.\d+"), 3).when(text.rlike(r"(?U)^\d+\.\d+"), 2).when(text.rlike(r"(?U)^\d+[、\s]"), 2).otherwise(0)
    return F.when(fits, level).otherwise(0)


def numbered_heading(text: Column) -> Column:
    """Chapter and clause numbers in Chinese numerals."""
    return F.when(text.rlike("^第[一二三四五六七八九十百]+[章节部分]"), 1).when(text.rlike("^[一二三四五六七八九十]+[、．.]"), 2).otherwise(0)


def by_text(text: Column) -> Column:
    likely = likely_heading(text)
    return F.when(F.length(text) > 120, 0).otherwise(F.when(likely > 0, likely).otherwise(numbered_heading(text)))


def by_style(style: Column) -> Column:
    """Level named by a paragraph style; null if it names none."""
    plain = F.replace(F.lower(F.coalesce(style, F.lit(""))), F.lit(" "), F.lit(""))
    digit = F.regexp_extract(plain, "^(?:heading|标题)([0-9])", 1)
    return F.when(digit != "", digit.cast("int")).when(F.contains(plain, F.lit("title")), 1)


def by_size(size: Column, bold: Column, bold_from: float, second_from: float) -> Column:
    """Level by mean letter size; null for body text."""
    return F.when((size >= 16) | ((size >= bold_from) & bold), F.when(size >= 18, 1).when(size >= second_from, 2).otherwise(3))


def docx_visual(size: Column, bold: Column) -> Column:
    return by_size(size, bold, 14, 16)


def docx_level(text: Column, style: Column, outline: Column, size: Column, bold: Column) -> Column:
    """Outline level, else style, else size, else text: the first that speaks."""
    found = F.coalesce(F.when(outline.isNotNull(), F.least(outline + 1, F.lit(6))), by_style(style), docx_visual(size, bold), by_text(text))
    return F.when(F.length(text) > 120, 0).otherwise(found)


def pdf_level(text: Column, size: Column, bold: Column) -> Column:
    """Text decides if it speaks; else size, where bold counts for short blocks only."""
    visual = by_size(size, bold & (F.length(text) < 80), 13, 15)
    spoken = by_text(text)
    return F.when(spoken > 0, spoken).otherwise(F.coalesce(visual, F.lit(0)))


def with_heading_path(blocks: DataFrame, key: str, order: str, level: str = "level", text: str = "text", part: Column | None = None) -> DataFrame:
    """Adds ``heading_path``: the headings that a row stands under, itself included.

    A heading of level L is in force if none of a level below L has come since, so the
    path is nine running "last heading of level L" windows over one sort; no fold.

    ``part`` cuts long files: an expression that never falls along ``order`` (a line number over
    10,000).  Then windows run within parts, and each part takes over the last headings of the parts
    before it, which are one row a part; so no file is a single window.
    """
    levels, place = range(1, MAX_LEVEL + 1), [key] if part is None else [key, "__part_no"]
    rows = blocks if part is None else blocks.withColumn("__part_no", part)
    heading = {n: F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(text).alias("text"))) for n in levels}
    window = Window.partitionBy(*place).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"__h{n}": F.last(h, ignorenulls=True).over(window) for n, h in heading.items()})
    if part is not None:
        ends = rows.groupBy(*place).agg(*(F.max(h).alias(f"__e{n}") for n, h in heading.items()))
        before = Window.partitionBy(key).orderBy("__part_no").rowsBetween(Window.unboundedPreceding, -1)
        taken = ends.select(*place, *(F.last(f"__e{n}", ignorenulls=True).over(before).alias(f"__t{n}") for n in levels))
        out = out.join(taken, place).withColumns({f"__h{n}": F.coalesce(f"__h{n}", f"__t{n}") for n in levels}).drop("__part_no", *(f"__t{n}" for n in levels))

    def in_force(n: int) -> Column:
        own = F.col(f"__h{n}")
        lower = [F.coalesce(own["at"] > F.col(f"__h{m}")["at"], F.lit(True)) for m in range(1, n)]
        return F.when(reduce(lambda a, b: a & b, lower, own.isNotNull()), own["text"])

    path = F.array_join(F.filter(F.array(*(in_force(n) for n in levels)), lambda t: t.isNotNull()), " > ")
    return out.withColumn("heading_path", path).drop(*(f"__h{n}" for n in levels))


def docx_page(nth: Column) -> Column:
    """Pseudo page of the n-th paragraph (from 1)."""
    return F.greatest(F.lit(1), F.floor(nth / DOCX_PAGE)).cast("int")


def list_island(is_list: Column, window) -> Column:
    """Number of the run that a row stands in: items in a row share one, any other row has its own."""
    starts = ~is_list | ~F.coalesce(F.lag(is_list).over(window), F.lit(False))
    return F.sum(F.when(starts, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))


def list_text(order: str) -> Column:
    """The items of a group, bulleted, in order, one a line."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "text")))
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("• "), x["text"])), "\n")


def merge_lists(paragraphs: DataFrame, key: str, order: str) -> DataFrame:
    """Rows (key, order, kind, text), kind list, blank or another -> list items between breaks in one text.

    Blank paragraphs do not break a list.  Islands are numbered by a running count of breaks.
    """
    kept = paragraphs.where(F.col("kind") != "blank").withColumn("__list", F.col("kind") == "list")
    kept = kept.withColumn("__island", list_island(F.col("__list"), Window.partitionBy(key).orderBy(order)))
    grouped = kept.groupBy(key, "__island").agg(F.min(order).alias(order), F.first("__list").alias("is_list"), F.min_by("text", order).alias("first"), list_text(order).alias("items"))
    return grouped.select(key, order, "is_list", F.when(F.col("is_list"), F.col("items")).otherwise(F.col("first")).alias("text"))


def merge_body(blocks: DataFrame, key: list[str], order: str, least: int = 400) -> DataFrame:
    """Rows (key, order, is_heading, text) -> body texts merged until they hold ``least`` characters.

    A heading ends what is pending.  Within a stretch without headings the running total
    is reset at each flush, which no window frame can say: one aggregate a stretch.
    """
    window = Window.partitionBy(*key).orderBy(order)
    stretch = F.sum(F.when(F.col("is_heading"), 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("stretch", stretch)
    body = rows.where(~F.col("is_heading")).groupBy(*key, "stretch").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "text"))).alias("parts"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        n, held = a["n"] + F.length(p["text"]), F.concat(a["held"], F.array(p["text"]))
        full = n >= least
        return F.struct(F.when(full, F.concat(a["out"], F.array(F.array_join(held, "\n")))).otherwise(a["out"]).alias("out"), F.when(full, F.array().cast("array<string>")).otherwise(held).alias("held"), F.when(full, 0).otherwise(n).alias("n"))

    merged = F.aggregate("parts", start, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(F.array_join(a["held"], "\n")))).otherwise(a["out"]))
    return body.select(*key, "stretch", F.posexplode(merged).alias("part", "text"))


def captioned(text: Column, window) -> Column:
    """The text of a table under the caption before it: among non-blank rows (kind, text), the row before
    if it is a paragraph that numbers a table."""
    before = F.when(F.lag("kind").over(window) == "paragraph", F.lag("text").over(window))
    numbered = before.rlike(r"(?U)表\s*\d|[Tt]able\s*\d|表\s*[一二三四五六七八九十百]")
    return F.when(numbered, F.concat(F.lit("["), before, F.lit("]\n"), text)).otherwise(text)


def with_caption(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows (key, order, kind, text) of kinds paragraph and table: a table gets the caption before it.

    Blank tables are not emitted and leave the caption for the next.
    """
    spoken = rows.where(F.regexp_replace("text", r"(?U)\s+", "") != "")
    told = spoken.withColumn("__text", captioned(F.col("text"), Window.partitionBy(key).orderBy(order)))
    return told.where(F.col("kind") == "table").select(key, order, F.col("__text").alias("text"))


def without_table_text(blocks: DataFrame, tables: DataFrame, key: tuple[str, ...] = ("file_name", "page")) -> DataFrame:
    """Text blocks that don't repeat the beginning of a table of their page."""
    prefix = F.substring("text", 1, 200)
    known = tables.select(*key, prefix.alias("__prefix")).distinct()
    return blocks.withColumn("__prefix", prefix).join(known, [*key, "__prefix"], "left_anti").drop("__prefix")
