"""Chunking: greedy packing of text, and row windows over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import clean_table_text, utrim

CHUNK, OCR_WINDOW, OCR_STEP, PDF_WINDOW, SHEET_ROWS = 1200, 4, 2, 30, 50
_ENDS = "[。！？；\n]"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where an expression named within a lambda is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack(units: Column, most: int, joiner: str) -> Column:
    """Packs texts greedily up to ``most`` characters (joiners don't count); on overflow the
    last unit is carried into the next pack, and a carried unit may exceed the bound.

    A fold notes where packs end (each begins with the last unit of the one before), and texts are joined
    from these places afterwards.  Spark copies an accumulator at every step, so the fold runs over blocks
    of the square root of the units' number, and what a block notes is appended once.
    """
    none = F.array().cast("array<int>")

    def step(a: Column, u: Column) -> Column:
        over = (a["at"] > 0) & (a["n"] + F.length(u) > most)
        n, ends = F.when(over, a["last"]).otherwise(a["n"]), F.when(over, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"])
        return F.struct((a["at"] + 1).alias("at"), (n + F.length(u)).alias("n"), F.length(u).alias("last"), ends.alias("ends"))

    def ends(given: Column, size: Column) -> Column:
        def block(a: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(given, k * size + 1, size), F.struct(*(a[f].alias(f) for f in ("at", "n", "last")), none.alias("ends")), step)
            return bound(own, lambda b: F.struct(*(b[f].alias(f) for f in ("at", "n", "last")), F.concat(a["ends"], b["ends"]).alias("ends")))

        start = F.struct(*(F.lit(0).alias(f) for f in ("at", "n", "last")), none.alias("ends"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(given) - 1) / size).cast("int"))
        return F.aggregate(blocks, start, block, lambda a: F.concat(a["ends"], F.array(a["at"])))

    def text(given: Column, begin: Column, end: Column) -> Column:
        return F.array_join(F.slice(given, begin + 1, end - begin), joiner)

    def texts(given: Column) -> Column:
        at = bound(F.ceil(F.sqrt(F.size(given))).cast("int"), lambda size: ends(given, size))
        packs = bound(at, lambda e: F.transform(e, lambda end, i: text(given, F.when(i == 0, 0).otherwise(F.get(e, i - 1) - 1), end)))
        return F.when(F.size(given) == 0, F.array().cast("array<string>")).otherwise(packs)

    return bound(units, texts)


def smart_chunk(text: Column, most: int = CHUNK) -> Column:
    """Chunks of a text: whole if short; else paragraphs, long ones cut after sentence ends, packed in turn."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n+", -1), utrim), lambda p: p != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(pack(F.split(p, f"(?<={_ENDS})", -1), most, ""))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.filter(pack(units, most, "\n\n"), lambda c: utrim(c) != ""))


def chunks(files: DataFrame, text: str = "text", most: int = CHUNK) -> DataFrame:
    """All columns of ``files`` with one row per chunk: ``chunk_index`` from 0 and ``chunk``."""
    return files.select("*", F.posexplode(smart_chunk(F.col(text), most)).alias("chunk_index", "chunk"))


def row_windows(rows: Column, size: int, step: int) -> Column:
    """Sliding windows from every ``step``-th row, the last ones short: array<struct<start, rows>>."""
    starts = F.sequence(F.lit(0), F.size(rows) - 1, F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(rows, s + 1, F.lit(size)).alias("rows")))


def ocr_table_chunks(text: Column, size: int = OCR_WINDOW, step: int = OCR_STEP) -> Column:
    """Windows of table lines, the first two lines on each; a small table stays whole."""
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r]", -1), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    parts = lambda x: F.struct(F.size(x).alias("n"), F.slice(x, 3, 1_000_000_000).alias("rows"), F.concat(F.array_join(F.slice(x, 1, 2), "\n"), F.lit("\n")).alias("head"))

    def cut(t: Column) -> Column:
        windows = F.transform(row_windows(t["rows"], size, step), lambda w: F.concat(t["head"], F.array_join(w["rows"], "\n")))
        return F.when(t["n"] == 0, F.array().cast("array<string>")).when(F.size(t["rows"]) <= size, F.array(text)).otherwise(windows)

    return bound(lines, lambda x: bound(parts(x), cut))


def pdf_table_chunks(headers: Column, rows: Column, size: int = PDF_WINDOW) -> Column:
    """Formatted rows under the header line; beyond ``size`` rows in half-overlapping, labelled windows."""

    def cut(t: Column) -> Column:
        def labelled(w: Column) -> Column:
            label = F.concat(F.lit("第"), (w["start"] + 1).cast("string"), F.lit("~"), (w["start"] + F.size(w["rows"])).cast("string"), F.lit("行"))
            return F.concat(F.lit("[表格"), label, F.lit("] "), t["head"], F.lit("\n"), F.array_join(w["rows"], "\n"))

        whole = F.concat(F.lit("[表格] "), t["head"], F.lit("\n"), F.array_join(t["rows"], "\n"))
        return F.when(F.size(t["rows"]) == 0, F.array().cast("array<string>")).when(F.size(t["rows"]) <= size, F.array(whole)).otherwise(F.transform(row_windows(t["rows"], size, size // 2), labelled))

    return bound(F.struct(rows.alias("rows"), F.array_join(headers, " | ").alias("head")), cut)


def sheet_batches(rows: DataFrame, size: int = SHEET_ROWS) -> DataFrame:
    """(file_name, sheet, row, cells) -> table chunks of ``size`` rows each under the sheet's first row.

    Blank rows go first, so numbers count what is left.  Batches are a grouping by row
    number; the header joins as one row per sheet.
    """
    window = Window.partitionBy("file_name", "sheet").orderBy("row")
    kept = rows.where(F.exists("cells", lambda c: c != "")).withColumn("__n", F.row_number().over(window) - 1)
    head = kept.where("__n = 0").select("file_name", "sheet", F.col("cells").alias("headers"), F.array_join("cells", " | ").alias("header_line"))
    batch = F.floor((F.col("__n") - 1) / size).cast("int")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__n", F.array_join("cells", " | ").alias("line")))), lambda x: x["line"])
    bodies = kept.where("__n > 0").groupBy("file_name", "sheet", batch.alias("batch")).agg(F.count(F.lit(1)).cast("int").alias("n"), lines.alias("lines"))
    first = F.col("batch") * size + 2
    span = F.concat(F.lit("行"), first.cast("string"), F.lit("~"), (first + F.col("n") - 1).cast("string"))
    title = F.concat(F.lit("Sheet: "), "sheet")
    return head.join(bodies, ["file_name", "sheet"], "left").select(
        "file_name",
        "sheet",
        F.coalesce(F.col("batch") + 1, F.lit(1)).alias("page"),
        F.when(F.col("batch").isNull(), title).otherwise(F.concat(title, F.lit(" / "), span)).alias("heading_path"),
        "headers",
        F.when(F.col("batch").isNull(), F.concat(F.lit("["), title, F.lit("]\n"), "header_line"))
        .otherwise(F.concat(F.lit("["), title, F.lit("]（"), span, F.lit("）\n"), "header_line", F.lit("\n"), F.array_join("lines", "\n")))
        .alias("text"),
    )


def docx_table(grid: Column) -> Column:
    """Non-blank rows of a grid in lines: struct<headers, text>; no row is split off."""
    kept = F.filter(F.transform(grid, lambda r: F.transform(r, lambda c: utrim(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    return F.struct(F.coalesce(F.get(kept, F.lit(0)), F.array().cast("array<string>")).alias("headers"), F.array_join(F.transform(kept, lambda r: F.array_join(r, " | ")), "\n").alias("text"))


def expand_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, value) with every cell of a merged range (sheet, r1, c1, r2, c2)
    filled from the range's first cell; of ranges that overlap, the one that begins last counts.

    An interval join by spans of rows: a range of up to 2^n rows touches two spans of 2^n at most, and a
    cell looks into its span at each height that its sheet's ranges have.  Ranges of any size are two rows.
    """
    firsts = cells.select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), F.coalesce("value", F.lit("")).alias("__first")).dropDuplicates(["sheet", "r1", "c1"])
    height = F.ceil(F.log2(F.col("r2") - F.col("r1") + 1)).cast("int")
    span = lambda row: F.floor(F.col(row) / F.pow(F.lit(2.0), "__height")).cast("long")
    held = ranges.where("r1 <= r2 and c1 <= c2").join(firsts, ["sheet", "r1", "c1"], "left").withColumn("__height", height)
    spans = held.withColumn("__span", F.explode(F.array_distinct(F.array(span("r1"), span("r2")))))
    asked = cells.select("sheet", "row", "col").distinct().join(held.select("sheet", "__height").distinct(), "sheet").withColumn("__span", span("row"))
    found = asked.join(spans, ["sheet", "__height", "__span"]).where("row between r1 and r2 and col between c1 and c2")
    filled = found.groupBy("sheet", "row", "col").agg(F.max(F.struct("r1", "c1", F.coalesce("__first", F.lit("")).alias("v"))).alias("__m"))
    return cells.join(filled, ["sheet", "row", "col"], "left").select("sheet", "row", "col", F.coalesce("__m.v", "value", F.lit("")).alias("value"))


def image_text_chunks(text: Column, is_table: Column) -> Column:
    """A table image is one chunk with its columns kept apart; other text is cleaned and chunked."""
    from docmill.functions.text import clean_text

    parts = F.when(is_table, F.array(clean_table_text(text))).otherwise(smart_chunk(clean_text(text)))
    return F.filter(parts, lambda c: utrim(c) != "")
