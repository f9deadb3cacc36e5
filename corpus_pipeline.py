"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents that the nearest labelled examples call toxic go;
2. near_duplicates: one document of each group of copies and near copies stays, the one with the smallest id;
3. decontamination: documents that hold a benchmark item go;
4. personal_data: spans are replaced by their kind, ``n_chars`` follows the text;
5. byte_bpe: every text is encoded; the rows hold ids, counts and digests in place of the text.

Every stage works on all rows that its predecessor kept, whatever further columns
there are: operators see the columns under other names, so none can clash.  Rows with a null id or
text take part: a null text counts as empty; a null id is never learned from and
never a copy.  Where ids repeat, stage 2 tells rows apart by numbers of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe, decontaminate, jaccard, pii, toxicity
from docmill.llm.common import materialize, table


def hidden(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``docs`` under names of the pipeline's own, those names, and the text's."""
    names = [f"c{i}__" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn_from=~toxicity.in_fold())
    rows, names, text = hidden(docs)
    return toxicity.score(spark, rows, model, text=text, keep=names).where("predicted = 0").select(*names).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    rows, names, text = hidden(docs)
    key = names[docs.columns.index("doc_id")]
    if repeated:
        named = F.when(F.col(key).isNotNull(), F.monotonically_increasing_id())
        key, rows = "row__", materialize(spark, rows.withColumn("row__", named), "rows")
    told = jaccard.similar(spark, rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    copies = materialize(spark, told.where("doc_id <> class_id").select(F.col("doc_id").alias(key)), "copies")
    if copies.count() <= jaccard.BROADCAST_ROWS:
        copies = F.broadcast(copies)
    return rows.join(copies, key, "left_anti").select(*names).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names, text = hidden(docs)
    return decontaminate.contaminated(spark, rows, table(spark, sf_dir, "benchmark"), text=text).where("not contaminated").select(*names).toDF(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names, text = hidden(docs)
    clean = pii.redact(pii.find(rows, text=text, classifier=pii.fit(rows, text)), text=text)
    n_chars = names[docs.columns.index("n_chars")]
    counted = F.when(F.size("pii_spans") > 0, F.length(text).cast("long")).otherwise(F.col(n_chars))
    return clean.withColumn(n_chars, counted).select(*names).toDF(*docs.columns)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(spark, docs, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: SQL can express neither the nearest examples nor the tilings; a test holds all rows of ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
