"""Incremental gathering: each micro-batch of found papers is scored, de-duplicated against what is stored, and added once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import resolve


def current(state: str, spark, schema: str, before: int | None = None) -> DataFrame:
    """What batches have stored, or those before a number."""
    try:
        rows = spark.read.schema(f"{schema}, batch int").parquet(state)
    except Exception as e:  # noqa: BLE001 - Spark says a missing path by a general error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch int")
    return rows if before is None else rows.where(F.col("batch") < before)


STORED = "profile long, paper_id long, score double, title_key string, keys array<string>"


def gather(found: DataFrame, seeds: DataFrame, state: str, checkpoint: str):
    """found: a stream of papers (profile, paper_id, title_key, keys, v). A batch writes a folder of its own number, so that
    a batch repeated after a failure replaces its rows; the first owner of a key over all batches stays."""
    from paperloom.operators.selection import scored

    def batch(df: DataFrame, number: int):
        spark = df.sparkSession
        old = current(state, spark, STORED, number)
        new = df.dropDuplicates(["profile", "paper_id"]).join(old.select("profile", "paper_id"), ["profile", "paper_id"], "left_anti")
        s = scored(new.select("profile", "paper_id", "v"), seeds).select("profile", "paper_id", "score")
        ranked = new.drop("v").join(s, ["profile", "paper_id"])
        from pyspark.sql import Window

        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("score"), "paper_id")))
        told = resolve.persisted(ranked, old.select("profile", "paper_id", "keys"), 1 << 30).where("outcome = 'new'")
        out = ranked.join(told.select("profile", "paper_id"), ["profile", "paper_id"]).select("profile", "paper_id", "score", "title_key", "keys")
        out.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
