"""Substring search over stored postings of character pairs and triples.

``build`` writes, below the index's folder, the rows themselves (``rows``) and, for every
run of two and three characters in a text, the ids of the rows that hold it (``grams``),
by bucket of the run's hash.  A word is looked up by its triples (a word of two characters
by its pair): rows that hold all of them are candidates, and ``contains`` verifies these
alone.  Words of one character, which no run can tell, are looked for in all rows.

``search`` gives the rows of ``retrieval.keyword_search``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import KEYWORDS_MATCHED
from docmill.operators.retrieval import keyword_search, scoped
from docmill.sources.tables import if_small, read_or_empty

BUCKETS, IDS = 64, 4096  # partitions of the runs; ids of a row of postings, about
GRAMS = "gram string, part int, ids array<long>, bucket int"


def grams_of(text: Column) -> Column:
    """The distinct runs of two and three characters of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    runs = F.flatten(F.transform(at, lambda i: F.array(F.substring(text, i, 2), F.substring(text, i, 3))))
    return F.array_distinct(F.filter(runs, lambda r: F.length(r) >= 2))


def _bucket(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int").alias("bucket")


def asked_grams(word: str) -> list[str]:
    """The runs that a row must hold to contain a word."""
    n = 3 if len(word) > 2 else 2
    return sorted({word[i : i + n] for i in range(len(word) - n + 1)})


class SubstringIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, rows: DataFrame) -> SubstringIndex:
        """Indexes rows with a column ``id`` and a column ``text``, in place of what the folder held; null texts hold nothing."""
        rows.write.mode("overwrite").parquet(f"{self.root}/rows")
        held = self.spark.read.schema(rows.schema).parquet(f"{self.root}/rows")
        parts = max(1, -(-held.count() // IDS))
        pairs = held.where("text is not null").select(F.col("id").cast("long").alias("id"), F.explode(grams_of(F.col("text"))).alias("gram"))
        pairs = pairs.withColumns({"bucket": _bucket("gram"), "part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")})
        # A frequent run's ids are spread over parts, so no group grows with the table.
        grams = pairs.repartition("bucket", "part").groupBy("bucket", "gram", "part").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        grams.select("gram", "part", "ids", "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/grams")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def candidates(self, words: list[str]) -> DataFrame | None:
        """Ids of the rows that may contain one of the words; None if every row may."""
        if any(len(w) < 2 for w in words):
            return None
        asked = [(w, g, len(asked_grams(w))) for w in sorted(set(words)) for g in asked_grams(w)]
        told = self.spark.createDataFrame(asked, "word string, gram string, needed int").withColumn("bucket", _bucket("gram"))
        grams = read_or_empty(self.spark, f"{self.root}/grams", GRAMS)
        found = grams.join(F.broadcast(told), ["bucket", "gram"]).select("word", "needed", F.explode("ids").alias("id"))
        return found.groupBy("word", "needed", "id").agg(F.count(F.lit(1)).alias("n")).where("n = needed").select("id").distinct()

    def search(self, words: list[str], top_k: int = 20, file_name: str | None = None, category: str | None = None) -> DataFrame:
        """The rows of ``keyword_search`` over the indexed rows, for the texts of candidates alone."""
        rows = scoped(self.rows(), file_name, category)
        chosen = self.candidates(words[:KEYWORDS_MATCHED]) if words else None
        return keyword_search(rows if chosen is None else rows.join(if_small(chosen), "id", "left_semi"), words, top_k)

    def containing(self, words: list[str]) -> DataFrame:
        """All rows that contain one of the words."""
        chosen, match = self.candidates(words), reduce(lambda a, b: a | b, (F.contains("text", F.lit(w)) for w in words))
        return (self.rows() if chosen is None else self.rows().join(if_small(chosen), "id", "left_semi")).where(match)
