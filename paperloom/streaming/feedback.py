"""Feedback as streams: an append-only log, windowed counts with late data, and triage kept up by micro-batches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.state import folded, folded_again

ACTIONS = ("saved", "dismissed", "unsaved", "shown", "snoozed")


def feedback_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Allowed actions go to an append-only Parquet log; run by a scheduler, each run takes what is there and ends."""
    return events.where(F.col("action").isin(*ACTIONS)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def latest(state: str) -> str | None:
    """The snapshot that the last finished batch left, by its number; None before the first."""
    import glob

    done = sorted(glob.glob(f"{state}/snapshot/batch=*/_SUCCESS"), key=lambda p: int(p.split("batch=")[1].split("/")[0]))
    return done[-1].removesuffix("/_SUCCESS") if done else None


def keep_triage(events: DataFrame, state: str, checkpoint: str):
    """The triage of each card as a partial fold that takes in one batch at a time: a batch's events are folded by card and
    merged with the last snapshot, which is all that is read. A batch repeated after a failure starts from the snapshot
    before its own number again, so that it counts once. Snapshots are numbered; the largest finished one is current."""

    def batch(df: DataFrame, number: int):
        spark = df.sparkSession
        before = f"{state}/snapshot/batch={number - 1}"
        new = folded(df)
        if number:
            new = folded_again(spark.read.parquet(before).unionByName(new))
        new.write.mode("overwrite").parquet(f"{state}/snapshot/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
