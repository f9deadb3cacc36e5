"""Parquet tables below a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 1_000_000  # rows of ids that may be broadcast; beyond them joins shuffle


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or a folder in the warehouse where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return where.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A place below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/docmill/{name}-{uuid.uuid4().hex}"


def read_or_empty(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """The Parquet table at a path, or no rows where nothing has been written yet."""
    try:
        return spark.read.options(**options).schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A broadcast hint if there are at most so many (narrow) rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
