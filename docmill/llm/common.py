"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docmill.workers import map_arrow  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's
    ``spark.checkpoint.dir``, or a folder in the warehouse where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    return where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def own_dir(spark: SparkSession, name: str) -> str:
    """A fresh place below this application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/docmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that still read it must be stored before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/docmill-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again."""
    path = own_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """The schema with further fields at its end."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def room_for(names: list[str], ddl: str) -> list[str]:
    """The names without those of the DDL, in any case: input columns give way to an operator's own."""
    taken = {n.lower() for n in StructType.fromDDL(ddl).names}
    return [n for n in names if n.lower() not in taken]


def spare_name(names: list[str]) -> str:
    """A column name that is not in use."""
    name, used = "text__", {n.lower() for n in names}
    while name in used:
        name += "_"
    return name


#: ASCII characters that end a word become spaces; other bytes stay, so letters of any script hold together.
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + bytes(range(32))
WORD_TABLE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def folded_words(text: str) -> list[bytes]:
    """Lower-cased words of a text as UTF-8, without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def coded_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All folded words of the texts: the text's number and the word's code for each, and the words by code."""
    import pyarrow as pa
    import pyarrow.compute as pc

    folded = pa.array([t.lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).strip() for t in texts], pa.binary())
    lists = pc.ascii_split_whitespace(folded.view(pa.string()))
    words = lists.flatten().view(pa.binary()).dictionary_encode()
    code, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    if b"" in distinct:  # of texts without a word
        kept = code != distinct.index(b"")
        text, code = text[kept], code[kept]
    return text, code.astype(np.int64), distinct


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (public-domain splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BROADCAST_BYTES = 32_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the (written) table's rows, as text, take no more than ``most`` bytes in all."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


HUB, HUBS = 1000, 100_000


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the smallest v of every u.

    Nodes of more than ``HUB`` edges, and as many more as it takes that no more than
    ``HUBS`` of the n edges' nodes are such, get theirs by a broadcast, which moves no
    edge; only the others' edges are shuffled, so no node brings many to a task.
    """
    bound = max(HUB, n // HUBS)
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > bound).select("u", F.col("m").alias("h")))  # n / bound rows at most
    seen = edges.join(hubs, "u", "left")
    rest = seen.where("h is null").select("u", "v").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return rest.unionByName(seen.where("h is not null").select("u", "v", F.col("h").alias("m")))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph given as (a, b): root is the component's smallest node.

    Alternates large-star and small-star contraction until the edges are stars.  Each
    round is joins and minima by node, pre-aggregated before the shuffle, and is written
    to the shared folder.  A hub's edges never meet in one task, see ``_with_least``.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(spark, edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, u, v, m = mark(now), F.col("u"), F.col("v"), F.col("m")
    while before[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        large = _with_least(both, 2 * before[0]).where(v > u).select(v.alias("u"), F.least(u, m).alias("v")).where(u != v).distinct()
        large = materialize(spark, large, "large")
        small = _with_least(large, large.count())
        small = small.where(v != m).select(v.alias("u"), m.alias("v")).unionByName(small.select("u", m.alias("v")))
        now = materialize(spark, small.distinct(), "small")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(u.alias("node"), v.alias("root")).unionByName(now.select(v.alias("node"), v.alias("root")).distinct())


def grouped(batches, key_columns: int):
    """Rows of sorted Arrow batches, one list of batch slices for each run of equal keys in
    the first columns (integers without nulls); a run may go on from batch to batch."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(key_columns)])
        starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for i, j in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            own = tuple(keys[:, i])
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(i, j - i))
    if held:
        yield key, pa.Table.from_batches(held)
