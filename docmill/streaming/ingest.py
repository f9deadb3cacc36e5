"""Ingest of arriving files as a stream: each micro-batch runs the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.operators.catalog import parser_of
from docmill.plans.ingest import ingest_into
from docmill.sources.store import Store

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, category: str = "", stream: str = "watch", **plugins) -> StreamingQuery:
    """Reads new files of ``folder`` until none is left and ingests them into the ``Store`` at ``store``.

    The catalog is read again for every micro-batch, so copies across batches are skipped.
    Files are entered once they gave chunks; what failed is not, so a later copy is tried.
    A micro-batch that runs again replaces what its first run wrote, by its number and the
    name of the ``stream``.  Every file's status is written to ``<store>/status``.
    """
    name = F.element_at(F.split("path", "/"), -1)
    arriving = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(folder)
    files = arriving.select(name.alias("file_name"), F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), parser_of(name).alias("parser"), "content")

    def batch(df: DataFrame, number: int) -> None:
        status = ingest_into(Store(spark, store), df, category, batch=f"{stream}-{number}", **plugins)
        status.write.mode("overwrite").parquet(f"{store}/status/stream={stream}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
