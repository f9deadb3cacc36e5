"""Text from recognised boxes: rows, columns, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
TABLE_IMAGE_WORDS = ("表", "table", "汇总", "统计", "报表", "清单", "明细", "账单", "报告")
MONTH_ROWS = ("1月", "2月", "3月", "4月", "5月", "6月", "7月", "8月", "9月", "10月", "11月", "12月", "当年累计支出", "累计均价")
ROW_GAP, MONTH_MARGIN, FIRST_MONTH_ROW = 15, 60, 4

_ITEMS = "array<struct<y:double,x:double,c:double,i:int,text:string>>"


def engine_chain(*texts: Column) -> Column:
    """The first engine's text that is not blank, stripped; empty if all fail."""
    from docmill.functions.text import utrim

    return F.coalesce(*(F.nullif(utrim(t), F.lit("")) for t in texts), F.lit(""))


def is_table_text(text: Column) -> Column:
    """Three lines or more of which over 40 % hold a digit and either three words, a comma or a point."""
    lines = F.filter(F.split(text, "\r\n|[\n\r]", -1), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != "")
    tabular = F.filter(lines, lambda x: x.rlike(r"(?U)\d") & (x.rlike("[,.]") | (F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")) > 2)))
    return (F.size(lines) >= 3) & (F.size(tabular) / F.size(lines) > 0.4)


def is_table_image(file_name: Column, width: Column, height: Column) -> Column:
    named = F.exists(F.array(*map(F.lit, TABLE_IMAGE_WORDS)), lambda w: F.contains(F.lower(file_name), w))
    return named | F.coalesce((width > 1.2 * height) & (width * height > 80000), F.lit(False))


def kept_images(images: DataFrame, least: int = 100, order: str | None = None) -> DataFrame:
    """Images of a page (file_hash, page, xref, width, height): each reference once, the first by ``order``, none narrow or low."""
    key, large = ["file_hash", "page", "xref"], images.where((F.col("width") >= least) & (F.col("height") >= least))
    if order is None:
        return large.dropDuplicates(key)
    return large.join(large.groupBy(*key).agg(F.min(order).alias(order)), [*key, order], "left_semi")


def _rows(items: Column, gap: Column, closed: bool) -> Column:
    """Rows of items sorted by y: an item joins while it is near the row's first item; rows are sorted by x."""
    start = F.struct(F.array().cast(f"array<{_ITEMS}>").alias("rows"), F.array().cast(_ITEMS).alias("row"), F.lit(None).cast("double").alias("y"))

    def step(a: Column, x: Column) -> Column:
        distance = F.abs(x["y"] - a["y"])
        near = F.coalesce(distance <= gap if closed else distance < gap, F.lit(False))
        begins = a["y"].isNull()
        return F.struct(
            F.when(near | begins, a["rows"]).otherwise(F.concat(a["rows"], F.array(a["row"]))).alias("rows"),
            F.when(near, F.concat(a["row"], F.array(x))).otherwise(F.array(x)).alias("row"),
            F.when(near, a["y"]).otherwise(x["y"]).alias("y"),
        )

    rows = F.aggregate(items, start, step, lambda a: F.concat(a["rows"], F.array(a["row"])))
    by_x = lambda r: F.transform(F.array_sort(F.transform(r, lambda x, k: F.struct(x["x"].alias("x"), k.alias("k"), x.alias("item")))), lambda x: x["item"])
    return F.transform(rows, by_x)


def _items(boxes: DataFrame, key: str) -> DataFrame:
    """One row per image: items sorted by y centre, then arrival."""
    y, c = (F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2
    item = F.struct(y.cast("double").alias("y"), F.col("ord").cast("int").alias("ord"), F.col("x1").cast("double").alias("x"), c.cast("double").alias("c"), "text")
    sizes = [F.avg(F.col("y2") - F.col("y1")).alias("avg_h"), F.avg(F.col("x2") - F.col("x1")).alias("avg_w")]
    grouped = boxes.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"), *sizes)
    return grouped.withColumn("items", F.transform("items", lambda x: F.struct(x["y"].alias("y"), x["x"].alias("x"), x["c"].alias("c"), x["ord"].alias("i"), x["text"].alias("text"))))


def rows_to_text(boxes: DataFrame, key: str = "image") -> DataFrame:
    """Boxes (image, ord, x1, y1, x2, y2, text) -> lines in reading order, two spaces between cells.

    A statement table whose month column was not recognised gets its row labels back.
    """
    out = _items(boxes, key).withColumn("rows", _rows(F.col("items"), F.lit(float(ROW_GAP)), False))
    probed = F.slice("rows", FIRST_MONTH_ROW + 1, 12)
    right = F.size(F.filter(probed, lambda r: F.get(r, F.lit(0))["x"] > MONTH_MARGIN))
    unnamed = ~F.exists(probed, lambda r: F.contains(F.get(r, F.lit(0))["text"], F.lit("月")))
    out = out.withColumn("patch", (F.size(probed) >= 10) & (right >= F.size(probed) * 0.8) & unnamed)
    labels = F.array(*map(F.lit, MONTH_ROWS))

    def line(r: Column, i: Column) -> Column:
        cells = F.filter(F.transform(r, lambda x: x["text"]), lambda t: F.trim(t) != "")
        label = F.when(F.col("patch") & (i >= FIRST_MONTH_ROW), F.get(labels, i - FIRST_MONTH_ROW))
        return F.array_join(F.concat(F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>")), cells), "  ")

    lines = F.filter(F.transform("rows", line), lambda x: F.trim(x) != "")
    return out.select(key, F.array_join(lines, "\n").alias("text"))


def rebuild_table(boxes: DataFrame, key: str = "image") -> DataFrame:
    """Boxes -> a table on a grid of clustered column centres, ``-`` in empty cells.

    Rows lie within 0.6 mean heights (10 at least) of their first item; columns begin where
    sorted centres leave a gap of 1.2 mean widths (20 at least) and their centre moves half
    way to each member.  An item goes to the nearest column, and a later one replaces an earlier.
    """
    from docmill.functions.text import utrim

    boxes = boxes.withColumn("text", utrim("text")).where("text <> ''")
    out = _items(boxes, key).withColumn("rows", _rows(F.col("items"), F.greatest(F.col("avg_h") * 0.6, F.lit(10.0)), True))
    gap = F.greatest(F.col("avg_w") * 1.2, F.lit(20.0))

    def cluster(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        begins = F.coalesce(x - last > gap, F.lit(True))
        moved = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array((last + x) / 2))
        return F.when(begins, F.concat(a, F.array(x))).otherwise(moved)

    centres = F.array_sort(F.transform("items", lambda x: x["c"]))
    out = out.withColumn("centres", F.aggregate(centres, F.array().cast("array<double>"), cluster))

    def column(x: Column) -> Column:
        distances = F.transform("centres", lambda c: F.abs(c - x["c"]))
        return F.array_position(distances, F.array_min(distances))

    def grid(r: Column) -> Column:
        placed = F.transform(r, lambda x: F.struct(column(x).alias("at"), x["text"].alias("text")))
        cells = F.transform(F.sequence(F.lit(1), F.size("centres")), lambda k: F.coalesce(F.try_element_at(F.filter(placed, lambda p: p["at"] == k), F.lit(-1))["text"], F.lit("-")))
        return F.array_join(cells, "  ")

    plain = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda x: x["text"]), " ")), "\n")
    return out.select(key, F.when(F.size("rows") < 2, plain).otherwise(F.array_join(F.transform("rows", grid), "\n")).alias("text"))
