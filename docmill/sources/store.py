"""The store: chunks, catalog and deletions as Parquet below one folder.

Chunks are only ever appended, in numbered batches by category; a deletion is a row
that hides a content's chunks up to a batch.  The catalog is small and is written
anew, as a numbered version, by every change.  A batch or version counts once its
writer has finished (``_SUCCESS``), so a failed or lost write is never seen.  There is
one writer at a time.  A named batch notes its number and the catalog that it starts
from before it writes anything, so when it is run again it replaces its own chunks,
whatever the first run came to; no other batch ever gets a number that is noted.

A compaction writes what is left of the batches up to a number as one table, which
stands for them once it is finished.  Ids are the batch's number and the row's place in
the batch, counted over its tasks, so no two chunks share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.text import file_type
from docmill.operators.catalog import stored, upsert
from docmill.schemas import FILES
from docmill.sources.tables import read_or_empty

STORED_CHUNK = "id long, text string, file_name string, file_hash string, page int, block_type string, heading_path string, heading_level int, table_headers string, chunk_index int, embedding array<float>"


NOTE = "number int, version int"


def numbered(written: DataFrame, number: int) -> DataFrame:
    """Ids in place of the ``monotonically_increasing_id`` that a written table has: 2^40 for each number, and
    the row's place among all rows.  The offsets are one row for each task that wrote, so they are broadcast."""
    placed = written.withColumn("task", F.shiftright("id", 33)).withColumn("at", F.col("id") - F.shiftleft("task", 33))
    tasks = placed.groupBy("task").agg((F.max("at") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tasks.select("task", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "task").withColumn("id", F.lit(number << 40) + F.col("before") + F.col("at")).drop("task", "at", "before")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.ensure()

    def _finished(self, kind: str) -> list[int]:
        """Numbers of the finished writes of a kind, ascending: one listing, however many there are."""
        found = self._fs.globStatus(self._path(f"{self.root}/{kind}/n=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)

    def _noted(self) -> list[int]:
        """Numbers that named batches have taken, written or not."""
        notes = read_or_empty(self.spark, f"{self.root}/begun", NOTE, recursiveFileLookup="true")
        return [r["number"] for r in notes.collect()]

    def _next(self, kind: str) -> int:
        return max([*self._finished(kind), *(self._noted() if kind == "chunks" else [])], default=0) + 1

    def _write(self, df: DataFrame, kind: str, *partitions: str, n: int | None = None) -> int:
        n = n or self._next(kind)
        df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.root}/{kind}/n={n}")
        return n

    def begin(self, batch: str | None = None) -> tuple[int, DataFrame]:
        """The number of a new batch of chunks, or of the one of that name, and the catalog that it starts from."""
        number, version = self._next("chunks"), self._finished("files")[-1]
        if batch is not None:
            path = f"{self.root}/begun/{batch}"
            if not self._fs.exists(self._path(f"{path}/_SUCCESS")):
                self.spark.createDataFrame([(number, version)], NOTE).write.mode("overwrite").parquet(path)
            number, version = self.spark.read.schema(NOTE).parquet(path).first()
        return number, self.files(version)

    def stage(self, df: DataFrame, name: str, number: int) -> DataFrame:
        """``df`` as written beside the store for the batch of a number, so that it is computed once."""
        path = f"{self.root}/staged/{name}/n={number}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def ensure(self) -> None:
        """Creates an empty catalog if there is none; the chunk table needs no creation."""
        if not self._finished("files"):
            self._write(self.spark.createDataFrame([], FILES), "files")

    def files(self, version: int | None = None) -> DataFrame:
        """The latest catalog, or one of its versions.  A column that an older version lacks reads as null."""
        return self.spark.read.schema(FILES).parquet(f"{self.root}/files/n={version or self._finished('files')[-1]}")

    def batch(self, n: int) -> DataFrame:
        """The chunks of one batch, deletions aside."""
        path = f"{self.root}/chunks/n={n}"
        return self.spark.read.schema(f"{STORED_CHUNK}, category string").option("basePath", path).parquet(path)

    def _held(self) -> DataFrame:
        """All chunks with their ``batch``: those of the last compaction, and of the batches after it."""
        base = max(self._finished("compact"), default=0)
        done, schema = [n for n in self._finished("chunks") if n > base], f"{STORED_CHUNK}, n int, category string"
        out = read_or_empty(self.spark, f"{self.root}/chunks", schema).where(F.col("n").isin(done))
        if base:
            out = out.unionByName(self.spark.read.schema(schema).option("basePath", f"{self.root}/compact").parquet(f"{self.root}/compact/n={base}"))
        return out.withColumnRenamed("n", "batch")

    def _live(self) -> DataFrame:
        out, gone = self._held(), self._finished("deleted")
        if gone:
            hidden = self.spark.read.schema("file_hash string, upto int, n int").parquet(f"{self.root}/deleted").where(F.col("n").isin(gone))
            hidden = hidden.groupBy("file_hash").agg(F.max("upto").alias("upto"))
            out = out.join(hidden, "file_hash", "left").where("upto is null or batch > upto").drop("upto")
        return out

    def chunks(self) -> DataFrame:
        """All chunks that no later deletion hides: one table, partitioned by batch and category."""
        return self._live().drop("batch")

    def compact(self) -> int:
        """Writes what is left of the finished batches as one table; batches that are noted but not written, and later ones, stay apart."""
        done = self._finished("chunks")
        waiting = min(set(self._noted()) - set(done), default=None)
        upto = max((n for n in done if waiting is None or n < waiting), default=0)
        if upto > max(self._finished("compact"), default=0):
            self._write(self._live().where(F.col("batch") <= upto).drop("batch").repartition("category", F.pmod(F.xxhash64("file_hash"), F.lit(64))), "compact", "category", n=upto)
        return upto

    def add(self, chunks: DataFrame, files: DataFrame, number: int | None = None) -> None:
        """Appends the chunks of a batch, cut to the columns' lengths, and enters its files that have any."""
        number = number or self._next("chunks")
        names = [f.split()[0] for f in STORED_CHUNK.split(", ")]
        for name, kind in (f.split() for f in STORED_CHUNK.split(", ")):
            if name not in chunks.columns:
                chunks = chunks.withColumn(name, F.lit(None).cast(kind))
        # Of a content that several parsers read, the first file's chunks count.
        path = ["file_path"] if "file_path" in chunks.columns else []
        staged = self.stage(stored(chunks.select(*names, *path, F.coalesce("category", F.lit("")).alias("category"))).withColumn("id", F.monotonically_increasing_id()), "chunks", number)
        staged = numbered(staged, number)
        if path:
            first = staged.groupBy("file_hash").agg(F.min("file_path").alias("file_path"))
            staged = staged.join(first, ["file_hash", "file_path"], "left_semi").drop("file_path")
        self._write(staged.select(*names, "category"), "chunks", "category", n=number)
        # Counted on what was written: extraction and embedding run once.
        counts = self.batch(number).groupBy("file_hash", "file_name").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), F.min("category").alias("category"))
        version = self._next("files")
        added = {"id": F.monotonically_increasing_id(), "file_type": file_type("file_name"), "status": F.lit("indexed"), "created_at": F.lit(None).cast("timestamp"), "updated_at": F.current_timestamp()}
        entered = files.select("file_name", "file_path", "file_hash").join(counts, ["file_hash", "file_name"]).withColumns(added)
        self._write(upsert(self.files(), numbered(self.stage(entered, "files", number), version)), "files", n=version)

    def delete(self, file_hash: str) -> None:
        """Hides a content's chunks and takes its file out of the catalog."""
        upto = max(self._finished("chunks"), default=0)
        self._write(self.spark.createDataFrame([(file_hash, upto)], "file_hash string, upto int"), "deleted")
        self._write(self.files().where(F.col("file_hash") != file_hash), "files")

    def delete_name(self, file_name: str) -> None:
        """Deletes the first file of a name."""
        found = self.files().where(F.col("file_name") == file_name).orderBy("id").limit(1).first()
        if found is None:
            raise KeyError(file_name)
        self.delete(found["file_hash"])

    def reset(self) -> None:
        """Drops everything and begins anew."""
        self._fs.delete(self._path(self.root), True)
        self.ensure()
