"""Vectors kept by content: a text is embedded once, however often and in however many batches it comes.

One Parquet table below a folder for each model, in batches under names of their own:

    <root>/model=<name>/batch=<unique>/   text_hash, embedding

A batch counts once its writer has finished (``_SUCCESS``).  Rows are named by their content, so a batch
that is written again, or by two writers at once, adds at most rows that say the same; of these one is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.sources.tables import read_or_empty

HELD = "text_hash string, embedding array<float>"


class EmbeddingCache:
    """``embed`` makes a column of vectors from a column of texts (see ``operators.plugins.embed_column``);
    ``model`` names what it computes: another model, or another version of it, has vectors of its own.

    Edges: a null text is embedded as the empty one; repeated texts are embedded once; a column of the added
    one's name gives way; names that begin with two underscores are the cache's own; no rows give no rows.
    """

    def __init__(self, spark: SparkSession, root: str, model: str, embed: Callable[[Column], Column]):
        self.spark, self.path, self.embed = spark, f"{root.rstrip('/')}/model={model}", embed
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        found = self._fs.globStatus(self._place(f"{self.path}/batch=*/_SUCCESS")) or []
        return sorted(s.getPath().getParent().getName()[6:] for s in found)

    def _drop(self, batch: str) -> None:
        self._fs.delete(self._place(f"{self.path}/batch={batch}"), True)

    def _keep(self, vectors: DataFrame) -> str:
        batch = f"b{uuid.uuid4().hex}"
        vectors.write.parquet(f"{self.path}/batch={batch}")
        return batch

    def known(self) -> DataFrame:
        """(text_hash, embedding), one row for each text."""
        held = read_or_empty(self.spark, self.path, f"{HELD}, batch string").where(F.col("batch").isin(self._batches()))
        return held.drop("batch").dropDuplicates(["text_hash"])

    def fill(self, rows: DataFrame, text: str = "text") -> int:
        """Embeds the texts of ``rows`` that have no vector yet and returns their number.

        Copies within a task meet before the shuffle, and known texts go before the model is asked; the
        model's work is spread by content, so copies of one text are no burden to a task.
        """
        whole = F.coalesce(F.col(text), F.lit(""))
        texts = rows.select(F.sha2(whole, 256).alias("text_hash"), whole.alias("__text")).dropDuplicates(["text_hash"])
        fresh = texts.join(self.known().select("text_hash"), "text_hash", "left_anti")
        batch = self._keep(fresh.select("text_hash", self.embed(F.col("__text")).cast("array<float>").alias("embedding")))
        n = self.spark.read.schema(HELD).parquet(f"{self.path}/batch={batch}").count()
        if n == 0:
            self._drop(batch)
        return n

    def added(self, rows: DataFrame, text: str = "text", column: str = "embedding") -> DataFrame:
        """``rows`` with their texts' vectors, after those that are missing are made.  ``rows`` is computed twice.

        The join is by content; a text that many rows share is split by Spark's adaptive skew join.
        """
        self.fill(rows, text)
        vectors = self.known().select(F.col("text_hash").alias("__hash"), F.col("embedding").alias("__vector"))
        keyed = rows.withColumn("__hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).drop(column)
        return keyed.join(vectors, "__hash", "left").withColumnRenamed("__vector", column).drop("__hash")

    def compact(self) -> None:
        """Writes all batches as one; those that it stands for go once it is finished."""
        done = self._batches()
        if len(done) > 1:
            self._keep(self.known())
            for batch in done:
                self._drop(batch)
