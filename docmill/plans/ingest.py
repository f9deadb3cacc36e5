"""From block streams to chunks, and from files to the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.structure import captioned, docx_level, list_island, list_text, merge_body, pdf_level, with_heading_path, without_table_text
from docmill.functions.text import clean_text, format_row, header_names, utrim
from docmill.operators.catalog import ingest_status, new_files, parser_of
from docmill.operators.chunking import docx_table, image_text_chunks, pdf_table_chunks, sheet_batches, smart_chunk
from docmill.operators.layout import is_table_text, kept_images
from docmill.sources.embeddings import EmbeddingCache

FILE = ["file_hash", "file_name", "file_path"]
_OUT = [*FILE, "page", "__at", "__part", "block_type", "heading_level", "heading_path", "table_headers", "text"]


def _parts(rows: DataFrame, parts: Column) -> DataFrame:
    """One row per non-blank part."""
    return rows.select("*", F.posexplode(F.filter(parts, lambda t: utrim(t) != "")).alias("__part", "__text")).withColumn("text", F.col("__text"))


def _as_chunks(rows: DataFrame, kind: str, headers: Column | None = None, level: Column | None = None) -> DataFrame:
    added = {"block_type": F.lit(kind), "heading_level": F.lit(0) if level is None else level.cast("int"), "table_headers": F.array().cast("array<string>") if headers is None else headers}
    return rows.withColumns(added).select(*_OUT)


def _numbered(chunks: DataFrame) -> DataFrame:
    """Numbers chunks per file in emission order, from 0."""
    order = Window.partitionBy("file_hash", "file_name").orderBy("__at", "__part")
    return chunks.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int")).drop("__at", "__part")


def docx_chunks(blocks: DataFrame) -> DataFrame:
    """Headings, list runs, paragraphs, tables and recognised images of word files, in body order."""
    level = F.when(F.col("kind") == "paragraph", docx_level(F.col("text"), F.col("style"), F.col("outline_lvl"), F.col("avg_size"), F.coalesce("is_bold", F.lit(False)))).otherwise(0)
    blank = F.coalesce(utrim("text"), F.lit("")) == ""
    role = F.when(blank, "blank").when(F.col("kind") != "paragraph", F.col("kind")).when(F.col("level") > 0, "heading").when(F.contains(F.lower(F.coalesce("style", F.lit(""))), F.lit("list")), "list").otherwise("plain")
    rows = with_heading_path(blocks.withColumn("level", F.when(blank, 0).otherwise(level)), "file_hash", "ord").withColumn("role", role)
    own = Window.partitionBy("file_hash").orderBy("ord")
    last_page = F.max("page").over(Window.partitionBy("file_hash"))
    spoken = rows.withColumn("__last", last_page).where("role <> 'blank'")
    spoken = spoken.withColumns({"__next_page": F.coalesce(F.lead("page").over(own), F.col("__last"))})
    table = docx_table(F.col("grid"))
    spoken = spoken.withColumns({"__captioned": captioned(table["text"], own), "__island": list_island(F.col("role") == "list", own), "__at": F.col("ord")})

    lists = spoken.where("role = 'list'").groupBy(*FILE, "__island").agg(F.min("ord").alias("__at"), F.max_by("__next_page", "ord").alias("page"), F.min_by("heading_path", "ord").alias("heading_path"), list_text("ord").alias("text"))
    tables = spoken.where("role = 'table'").withColumns({"__t": table, "text": F.col("__captioned"), "__part": F.lit(0)})
    headings = spoken.where("role = 'heading'").withColumn("__part", F.lit(0))
    out = (
        _as_chunks(headings, "heading", level=F.col("level"))
        .unionByName(_as_chunks(_parts(spoken.where("role = 'plain'"), smart_chunk(F.col("text"))), "text"))
        .unionByName(_as_chunks(_parts(lists, smart_chunk(F.col("text"))), "text"))
        .unionByName(_as_chunks(tables, "table", headers=F.col("__t.headers")))
        .unionByName(_as_chunks(_parts(spoken.where("role = 'image'"), smart_chunk(clean_text("text"))), "image"))
    )
    return _numbered(out)


def sheet_chunks(blocks: DataFrame) -> DataFrame:
    """Row batches of every sheet, in workbook order."""
    rows = blocks.where("kind = 'sheet'").select(*FILE, F.col("page").alias("__sheet_no"), F.col("text").alias("sheet"), F.posexplode("grid").alias("row", "cells"))
    keyed = rows.select(F.concat_ws("\u0000", *FILE, F.lpad(F.col("__sheet_no").cast("string"), 9, "0")).alias("file_name"), "sheet", "row", "cells")
    cut = sheet_batches(keyed)
    names = F.split("file_name", "\u0000")
    cut = cut.select(*(names[i].alias(f) for i, f in enumerate(FILE)), F.struct(names[3].cast("int").alias("sheet"), F.col("page").alias("batch")).alias("__at"), F.lit(0).alias("__part"), "page", F.lit("table").alias("block_type"), F.lit(0).alias("heading_level"), "heading_path", F.col("headers").alias("table_headers"), "text")
    return _numbered(cut)


def image_chunks(blocks: DataFrame) -> DataFrame:
    """Recognised text (in ``text``) of image files."""
    rows = blocks.where("kind = 'image'").withColumns({"__at": F.col("ord"), "heading_path": F.lit("")})
    return _numbered(_as_chunks(_parts(rows, image_text_chunks(F.col("text"), is_table_text(F.col("text")))), "image"))


def pdf_chunks(blocks: DataFrame) -> DataFrame:
    """Blocks of kinds ocr_page, table (grid), image (recognised text) and paragraph, page by page:
    a scanned page gives its recognised text only; else tables, images, text, under headings that span pages."""
    phase = F.when(F.col("kind") == "ocr_page", 0).when(F.col("kind") == "table", 1).when(F.col("kind") == "image", 2).otherwise(3)
    scanned = blocks.where("kind = 'ocr_page'").select("file_hash", "page", F.lit(True).alias("__scanned")).distinct()
    rows = blocks.join(scanned, ["file_hash", "page"], "left").where("__scanned is null or kind = 'ocr_page'").drop("__scanned")
    headers = header_names(F.element_at("grid", 1))
    data = F.filter(F.slice("grid", 2, 1_000_000_000), lambda r: F.exists(r, lambda c: utrim(F.coalesce(c, F.lit(""))) != ""))
    rows = rows.withColumn("__headers", F.when((F.col("kind") == "table") & (F.size("grid") >= 2), headers))
    rows = rows.withColumn("__tables", F.when(F.col("__headers").isNotNull(), pdf_table_chunks(F.col("__headers"), F.transform(data, lambda r: format_row(F.col("__headers"), r)))))
    shown = rows.where(F.size("__tables") > 0).select("file_hash", "page", F.explode(F.array_union(F.array(F.array_join("__headers", " | ")), "__tables")).alias("text"))
    is_text = F.coalesce((F.col("kind") == "paragraph") & F.col("text").isNotNull(), F.lit(False))
    rows = without_table_text(rows.where(is_text), shown, ("file_hash", "page")).unionByName(rows.where(~is_text))
    level = F.when(F.col("kind") == "paragraph", pdf_level(F.col("text"), F.coalesce("avg_size", F.lit(12.0)), F.coalesce("is_bold", F.lit(False)))).otherwise(0)
    rows = rows.withColumns({"level": level, "__at": F.struct("page", phase.alias("phase"), "ord")})
    rows = with_heading_path(rows, "file_hash", "__at")
    tables = rows.where("__tables is not null").select("*", F.posexplode("__tables").alias("__part", "__t")).withColumn("text", F.col("__t"))
    headings = rows.where("level > 0").withColumn("__part", F.lit(0))
    text = rows.where("kind = 'paragraph' and text <> ''").withColumn("is_heading", F.col("level") > 0)
    merged = merge_body(text, [*FILE, "page"], "__at")
    # Where a merged stretch begins and under which headings: those of its first block.
    window = Window.partitionBy(*FILE, "page").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    begun = text.withColumn("stretch", F.sum(F.when(F.col("is_heading"), 1).otherwise(0)).over(window)).where("not is_heading").groupBy(*FILE, "page", "stretch").agg(F.min("__at").alias("__at"), F.min_by("heading_path", "__at").alias("heading_path"))
    merged = merged.withColumnRenamed("part", "__run").join(begun, [*FILE, "page", "stretch"])
    merged = _parts(merged, smart_chunk(F.col("text"))).withColumn("__part", F.col("__run") * 1_000_000 + F.col("__part"))
    out = (
        _as_chunks(_parts(rows.where("kind in ('ocr_page', 'image')"), smart_chunk(clean_text("text"))), "image")
        .unionByName(_as_chunks(tables, "table", headers=F.col("__headers")))
        .unionByName(_as_chunks(headings, "heading", level=F.col("level")))
        .unionByName(_as_chunks(merged, "text"))
    )
    return _numbered(out)


def chunk_blocks(blocks: DataFrame) -> DataFrame:
    """Chunks of all files of a block stream, each by its format's rules."""
    blocks = blocks.where("error is null").withColumn("__parser", parser_of(F.col("file_name")))
    by = {"docx": docx_chunks, "sheet": sheet_chunks, "image": image_chunks, "pdf": pdf_chunks}
    out = None
    for name, fold in by.items():
        own = fold(blocks.where(F.col("__parser") == name).drop("__parser"))
        out = own if out is None else out.unionByName(own)
    return out


def extracted(files: DataFrame, catalog: DataFrame, extractors=None, recognise=None) -> tuple[DataFrame, DataFrame]:
    """(blocks, files that they come from): copies of known content, further copies of a batch and
    files that nothing reads never reach an extractor.

    Of equal contents the earliest by path is read, once for each parser that the copies' names
    ask for, so a copy that can't be read hides none that can.  Image files without a recogniser
    give the error ``ocr_unavailable``.
    """
    from docmill.sources.files import EXTRACTORS
    from docmill.sources.files import blocks as extract

    readable = files.where(F.col("parser").isin(sorted({*EXTRACTORS, *(extractors or {})})))
    fresh = new_files(readable.withColumn("arrival", F.col("file_path")), catalog, ("file_hash", "parser"))
    found = extract(fresh, extractors)
    image = F.col("kind") == "image"
    # Of an image that a page refers to more than once, the first counts; small ones are not read.
    placed = image & F.col("xref").isNotNull()
    found = kept_images(found.where(placed), order="ord").unionByName(found.where(~placed))
    if recognise is not None:
        found = found.withColumn("text", F.when(image & F.col("image").isNotNull(), recognise(F.col("image"), F.col("text"))).otherwise(F.col("text")))
    else:
        alone = image & (parser_of(F.col("file_name")) == "image")
        found = found.withColumns({"text": F.when(image, F.lit("")).otherwise(F.col("text")), "error": F.when(alone, F.lit("ocr_unavailable")).otherwise(F.col("error"))})
    return found.drop("image", "xref", "width", "height"), fresh.drop("content")


def chunked(blocks: DataFrame, category: str = "", embed=None) -> DataFrame:
    """Chunks of blocks as the store takes them, embedded if there is an embedder: a function of a column, or
    an ``EmbeddingCache``, whose model sees only texts that no earlier batch had."""
    chunks = chunk_blocks(blocks).withColumns({"category": F.lit(category), "table_headers": F.array_join("table_headers", "|")})
    if isinstance(embed, EmbeddingCache):
        return embed.added(chunks)
    return chunks if embed is None else chunks.withColumn("embedding", embed(F.col("text")))


def ingest(spark: SparkSession, files: DataFrame, catalog: DataFrame, category: str = "", embed=None, extractors=None, recognise=None) -> tuple[DataFrame, DataFrame]:
    """(chunks, files of the batch): deduplicate, extract, recognise images, chunk, embed.  ``files`` comes from ``read_files``."""
    found, fresh = extracted(files, catalog, extractors, recognise)
    return chunked(found, category, embed), fresh


def ingest_into(store, files: DataFrame, category: str = "", embed=None, extractors=None, recognise=None, batch: str | None = None) -> DataFrame:
    """Ingests files into a ``Store`` and returns every file's status and reason.

    Files are extracted once: their blocks are written beside the store before they are
    chunked.  A file is entered in the catalog only if it gave chunks, so failures are tried
    again.  ``batch`` names the batch: one that is run again replaces what its first run wrote.
    """
    number, catalog = store.begin(batch)
    found, fresh = extracted(files, catalog, extractors, recognise)
    blocks, fresh = store.stage(found, "blocks", number), store.stage(fresh, "batch", number)
    store.add(chunked(blocks, category, embed), fresh, number)
    counts = store.batch(number).groupBy("file_hash", "file_name").agg(F.count(F.lit(1)).alias("n_chunks"))
    errors = blocks.groupBy("file_hash", "file_name").agg(F.max("error").alias("error"))
    told = fresh.join(counts, ["file_hash", "file_name"], "left").join(errors, ["file_hash", "file_name"], "left").select("file_hash", "parser", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "error")
    every = files.select("file_name", "file_hash", "parser", F.col("file_path").alias("arrival")).join(told, ["file_hash", "parser"], "left")
    every = every.withColumn("error", F.coalesce("error", F.when(F.col("n_chunks").isNull(), F.lit("no parser for this type"))))
    return ingest_status(every, catalog)
