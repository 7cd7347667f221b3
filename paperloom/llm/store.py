"""Shared storage between stages: written tables that cut lineage and survive lost executors."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows of a few longs (16 MB or so).
BROADCAST_ROWS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a new local one only where the setting is absent."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors elsewhere would write to folders of their own")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that later steps neither recompute nor depend on executors."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """small, marked for broadcast if a count shows at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1 and so on, so that no name of ours can clash; and these names by the old ones."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain, {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}


def named(docs: DataFrame) -> list[Column]:
    """The columns of docs under their own names, out of a table that numbered() made."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
