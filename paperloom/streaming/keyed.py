"""Keyed state over streams: who first brought a key, and runs that are closed when they fall silent.

A micro-batch reads its own rows and the state of its own keys, which Spark keeps in RocksDB beside the checkpoint; what was
stored before is never read. A restart goes on from the checkpoint."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The error of a run closed without an end, and how long a closed run is remembered, so that a late end is ignored.
INTERRUPTED, REMEMBERED_MS = "interrupted", 24 * 3600 * 1000


def with_state_store(spark: SparkSession) -> None:
    """Keyed state needs this state store; a session that has chosen it, or one like it, already is left alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Owners(StatefulProcessor):
    """State of a key: the paper that first brought it. The papers of a batch that bring one key are held while their best
    is sought; a source's rows a trigger bound them."""

    def init(self, handle) -> None:
        self.owner = handle.getValueState("owner", "paper_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, papers, best = self.owner.exists(), set(), None
        for r in rows:
            papers.add(r.paper_id)
            rank = (r.score is None, -(r.score or 0.0), r.paper_id)
            best = rank if best is None else min(best, rank)
        if not known:
            self.owner.update((best[2],))
        (owner,) = self.owner.get()
        for p in sorted(papers):
            yield Row(profile=key[0], key=key[1], paper_id=p, owner=owner, known=known)

    def close(self) -> None:
        pass


def claims(found: DataFrame) -> DataFrame:
    """found: a stream (profile, paper_id, score, keys) -> profile, key, paper_id, owner, known for each key of each paper,
    its own id among them: the paper that first brought the key, the best of a batch by score (nulls last, ties to the
    smaller id), and whether an earlier batch had it."""
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("#"), "paper_id")), F.filter(F.coalesce("keys", F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != ""))))
    score = F.when(~F.isnan("score"), F.col("score"))
    each = found.select("profile", "paper_id", score.alias("score"), F.explode(keys).alias("key"))
    kind = dict(found.dtypes)["profile"]
    return each.groupBy("profile", "key").transformWithState(Owners(), f"profile {kind}, key string, paper_id long, owner long, known boolean", "update", "none")


def outcomes(told: DataFrame) -> DataFrame:
    """claims() of whole papers -> profile, paper_id, outcome, owner: `resurfaced` where another paper brought a key of its
    own before, with the least such; `again` for an id that an earlier batch had; else `new`.

    A resurfaced paper goes on owning the keys that none brought before it: what shares those is the same work again."""
    other = F.min(F.when(F.col("owner") != F.col("paper_id"), F.col("owner")))
    again = F.bool_or(F.col("known") & F.col("key").startswith("#"))
    by = told.groupBy("profile", "paper_id").agg(other.alias("other"), again.alias("again"))
    outcome = F.when(F.col("other").isNotNull(), "resurfaced").when(F.col("again"), "again").otherwise("new")
    return by.select("profile", "paper_id", outcome.alias("outcome"), F.coalesce("other", "paper_id").alias("owner"))


def keep_first(found: DataFrame, out: str, checkpoint: str):
    """Writes the outcomes of each batch to a folder of its number; a batch repeated after a failure replaces its own."""
    with_state_store(found.sparkSession)

    def batch(df: DataFrame, number: int):
        outcomes(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return claims(found).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Runs(StatefulProcessor):
    """State of a run: its start, its last sign of life, and whether it is closed; a timer a run closes it, or forgets it."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "started long, seen long, closed boolean")

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        started, seen, closed = self.run.get() if self.run.exists() else (None, None, False)
        if closed:
            return
        ended = failed = None
        for r in rows:
            if r.kind == "start":
                started = r.ms if started is None else min(started, r.ms)
            elif r.kind == "end" and (ended is None or r.ms < ended):
                ended, failed = r.ms, r.error
            seen = r.ms if seen is None else max(seen, r.ms)
        over = ended is not None
        self.run.update((started, seen, over))
        # a timer not after the watermark would be late at once; the next advance calls it
        self._wake(max(seen + (REMEMBERED_MS if over else self.patience), timerValues.getCurrentWatermarkInMs() + 1))
        if over:
            yield Row(run=key[0], started=started, finished=ended, error=failed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, seen, closed = self.run.get()
        if closed:
            self.run.clear()
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.run.update((started, seen, True))
        self._wake(max(at + REMEMBERED_MS, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(run=key[0], started=started, finished=at, error=INTERRUPTED)

    def close(self) -> None:
        pass


def closed_runs(events: DataFrame, patience: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """events: a stream (run, kind: start, tick or end, ts, error) -> run, started, finished, error of runs as they close:
    by their end, the first of a batch, or as interrupted once the watermark is `patience` past their last sign of life.
    What comes for a closed run is ignored for a day of event time. Null runs and times are left out; started is null
    where no start came."""
    ms = F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', TIMESTAMP_NTZ '1970-01-01' + INTERVAL {patience})")
    wait = events.sparkSession.range(1).select(ms).first()[0]
    e = events.where("run is not null and ts is not null").withWatermark("ts", late).select("run", "kind", "ts", F.unix_millis("ts").alias("ms"), "error")
    kind = dict(events.dtypes)["run"]
    out = e.groupBy("run").transformWithState(Runs(wait), f"run {kind}, started long, finished long, error string", "append", "eventTime")
    at = lambda c: F.timestamp_millis(c).alias(c)
    return out.select("run", at("started"), at("finished"), "error")


def keep_runs(events: DataFrame, out: str, checkpoint: str, patience: str = "10 minutes", late: str = "1 minute"):
    """Appends closed runs to Parquet, each once."""
    with_state_store(events.sparkSession)
    return closed_runs(events, patience, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
