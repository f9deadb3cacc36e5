"""Keeps a table of chunks up to date with a growing table of documents.

The documents (doc_id, text, source, ...) are a file stream over a folder, or over a pattern
of files: a run takes the files that have come since the last one and ends.  Texts are cleaned; empty ones and those whose
cleaned text is known already are not chunked.  Below ``output``:

    chunks/batch=<n>/category=<source>/   doc_id, file_hash, chunk_index, n_chars, text
    catalog/batch=<n>/                    doc_id, file_hash, category, n_chars, n_chunks, status

Every document that arrived is one row of the catalog: ``indexed``, ``duplicate`` or
``empty``.  Of equal texts in one batch the smallest id counts; one of an earlier batch
comes before all later ones.  A run that died leaves its batch to the next one, which
takes the same files under the same number and replaces what the batch had written.
With nothing new, nothing is written.

    python -m jobs.ingest_corpus --config jobs/ingest_corpus.toml --input /data/documents --output /data/kb --checkpoint /data/kb-mark

Edges: a null text counts as empty, a null or empty source is the category ``unknown``; rows that
repeat an id count as documents of their own, and a null id comes after all others;
further columns are ignored; an empty table gives an empty catalog.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import clean_text, content_hash
from docmill.operators.chunking import CHUNK, smart_chunk
from docmill.sources.tables import read_or_empty

log = logging.getLogger("ingest_corpus")

CONFIG = "jobs/ingest_corpus.toml"
INPUT = "doc_id long, text string, source string"
STAGED = "doc_id long, file_hash string, category string, n_chars long, status string, chunks array<string>"
CATALOG = "doc_id long, file_hash string, category string, n_chars long, n_chunks int, status string, batch int"
CHUNKS = "doc_id long, file_hash string, chunk_index int, n_chars long, text string, batch int, category string"


def triaged(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The documents with cleaned text, hash and status; ``known`` has the hashes (file_hash) of earlier batches."""
    text, category = F.coalesce(clean_text("text"), F.lit("")), F.when(F.col("source") != "", F.col("source")).otherwise("unknown")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), category.alias("category"), text.alias("text"))
    rows = rows.withColumns({"file_hash": content_hash("text"), "row": F.monotonically_increasing_id()})
    # One row for each text of the batch: a minimum, combined before the shuffle, so copies don't meet in a task.
    first = rows.where("text <> ''").groupBy("file_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first"))
    first = first.join(known.select("file_hash").distinct(), "file_hash", "left_anti").select(F.col("first.row").alias("row"), F.lit("indexed").alias("status"))
    return rows.join(first, "row", "left").withColumn("status", F.coalesce("status", F.when(F.col("text") == "", "empty").otherwise("duplicate"))).drop("row")


def ingest(spark: SparkSession, docs: DataFrame, output: str, batch: int, most: int = CHUNK) -> None:
    """One batch: its documents cut once, then its chunks and its catalog, in place of what the batch had written before."""
    known = read_or_empty(spark, f"{output}/catalog", CATALOG).where((F.col("batch") < batch) & (F.col("status") == "indexed"))
    cut = F.when(F.col("status") == "indexed", smart_chunk(F.col("text"), most))
    staged = f"{output}/staged/batch={batch}"
    triaged(docs, known).select("doc_id", "file_hash", "category", F.length("text").cast("long").alias("n_chars"), "status", cut.alias("chunks")).write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(STAGED).parquet(staged)
    chunks = rows.select("doc_id", "file_hash", "category", F.posexplode("chunks").alias("chunk_index", "text")).withColumn("n_chars", F.length("text").cast("long"))
    chunks.write.mode("overwrite").partitionBy("category").parquet(f"{output}/chunks/batch={batch}")
    catalog = rows.withColumn("n_chunks", F.coalesce(F.when(F.col("chunks").isNotNull(), F.size("chunks")), F.lit(0))).drop("chunks")
    catalog.write.mode("overwrite").parquet(f"{output}/catalog/batch={batch}")
    told = {r["status"]: (r["n"], r["chunks"]) for r in read_or_empty(spark, f"{output}/catalog", CATALOG).where(F.col("batch") == batch).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chunks").alias("chunks")).collect()}
    indexed, copies, empty = (told.get(s, (0, 0)) for s in ("indexed", "duplicate", "empty"))
    log.info("batch %d: read %d documents; wrote %d chunks of %d documents to %s/chunks, %d duplicates and %d empty ones to its catalog", batch, indexed[0] + copies[0] + empty[0], indexed[1], indexed[0], output, copies[0], empty[0])


def run(spark: SparkSession, options: dict) -> DataFrame:
    """Ingests what is new; returns the table of all chunks."""
    output = options["output"].rstrip("/")
    arriving = spark.readStream.schema(INPUT)
    if options.get("files_per_batch"):
        arriving = arriving.option("maxFilesPerTrigger", options["files_per_batch"])
    log.info("reading what is new in %s", options["input"])
    stream = (
        arriving.parquet(options["input"])
        .writeStream.foreachBatch(lambda docs, batch: ingest(spark, docs, output, batch, options.get("chunk_chars", CHUNK)))
        .option("checkpointLocation", options["checkpoint"])
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return read_or_empty(spark, f"{output}/chunks", CHUNKS)


if __name__ == "__main__":
    from jobs.common import main

    main("ingest_corpus", run, CONFIG, ("input", "output", "checkpoint"))
