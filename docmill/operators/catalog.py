"""The file catalog: deduplication, status, upserts, deletes, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import STORE_LIMITS

SUPPORTED = {"pdf": "pdf", "docx": "docx", "xlsx": "sheet", "xls": "sheet", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "bmp": "image"}


def parser_of(file_name: Column) -> Column:
    """The parser of a file by its extension; null if none reads it."""
    ext = F.lower(F.regexp_extract(file_name, r"\.([^./]*)$", 1))
    out = F.lit(None).cast("string")
    for name in sorted(set(SUPPORTED.values())):
        out = F.when(ext.isin([e for e, p in SUPPORTED.items() if p == name]), name).otherwise(out)
    return out


def new_files(files: DataFrame, catalog: DataFrame, by: tuple[str, ...] = ("file_hash",)) -> DataFrame:
    """Files whose content is neither indexed nor earlier in the batch (by ``arrival``), one for each value of ``by``.

    The anti join and the pick of the earliest copy stand before any parsing.  The pick
    is an aggregate, combined before the shuffle, so one often repeated file is no hot key.
    """
    known = catalog.where("status = 'indexed'").select("file_hash").distinct()
    first = files.groupBy(*by).agg(F.min("arrival").alias("arrival"))
    return files.join(first, [*by, "arrival"], "left_semi").join(known, "file_hash", "left_anti")


def ingest_status(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every file of a batch with its status and reason.

    ``n_chunks`` is what its parser gave and ``error`` what it raised.  A copy is skipped
    only after an earlier copy succeeded; the first success of each content is an
    aggregate, so many copies of one file are no hot key.
    """
    known = catalog.where("status = 'indexed'").select("file_hash", F.lit(True).alias("__known")).distinct()
    works = F.col("error").isNull() & (F.col("n_chunks") > 0)
    first = files.where(works).groupBy("file_hash").agg(F.min("arrival").alias("__first"))
    rows = files.join(first, "file_hash", "left").join(known, "file_hash", "left")
    status = F.when(F.col("__known") | (F.col("__first") < F.col("arrival")), "skipped").when(F.col("error") == "ocr_unavailable", "ocr_unavailable").when(~works, "failed").otherwise("success")
    reason = F.when(status == "skipped", "already indexed").when(status == "failed", F.coalesce("error", F.lit("no content"))).when(status == "ocr_unavailable", "no OCR engine").otherwise("")
    return rows.select("file_name", "file_hash", "arrival", status.alias("status"), reason.alias("reason"))


def file_summary(chunks: DataFrame) -> DataFrame:
    """Per file: number of chunks and the distinct block types."""
    return chunks.groupBy("file_name").agg(F.count(F.lit(1)).alias("chunk_count"), F.array_join(F.sort_array(F.collect_set("block_type")), ",").alias("types"))


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks as the store holds them: every text cut to its column's length."""
    return chunks.withColumns({c: F.substring(c, 1, n) for c, n in STORE_LIMITS.items() if c in chunks.columns})


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of the same content; their creation time is that of the update."""
    fresh = new.withColumns({"status": F.lit("indexed"), "created_at": F.col("updated_at")})
    return catalog.join(fresh.select("file_hash"), "file_hash", "left_anti").unionByName(fresh.select(*catalog.columns))


def delete_by_hash(rows: DataFrame, file_hash: str) -> DataFrame:
    return rows.where(~F.col("file_hash").eqNullSafe(file_hash))


def hash_by_name(catalog: DataFrame, file_name: str) -> DataFrame:
    """The content hash of the first file of a name; no row if there is none."""
    return catalog.where(F.col("file_name") == file_name).orderBy("id").limit(1).select("file_hash")


def delete_by_name(rows: DataFrame, catalog: DataFrame, file_name: str) -> DataFrame:
    """Rows without those of the first file of a name."""
    return rows.join(F.broadcast(hash_by_name(catalog, file_name)), "file_hash", "left_anti")


def list_files(catalog: DataFrame) -> DataFrame:
    return catalog.where("status = 'indexed'").select("file_name", "file_hash", "file_type", "category", "chunk_count", "created_at").orderBy("category", F.desc("created_at"), "file_name")


def list_categories(catalog: DataFrame) -> DataFrame:
    return catalog.where("category <> ''").select("category").distinct().orderBy("category")


def are_indexed(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return files.join(catalog.where("status = 'indexed'"), "file_hash", "left_semi")
