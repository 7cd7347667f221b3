"""Which rows are one work: first owners of keys, fuzzy titles, lookups with redirection, a ladder of identifiers."""

import tempfile
import uuid
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed value: the least ratio of two titles of one work.
SAME_TITLE = 0.90


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a new local one only where the setting is absent."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again: plans do not pile up, lost executors cost a task, and Spark
    knows the table's size when it joins it."""
    at = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def first_owners(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch (profile, paper_id, rank, keys) with kept: rows in rank order, each kept unless one of its keys is owned, by a
    stored row (profile, paper_id, keys) or by a row kept before it; a dropped row owns nothing.

    The order matters only among rows that share keys. In each round the undecided rows that own a key of theirs nowhere
    and come first for all of them are kept, and those with an owned key are dropped, until none is left; rows without a
    key are kept at once. Keys are reduced to their least rank before any join."""
    keyed = cut(batch.select("profile", "paper_id", "rank", F.explode_outer("keys").alias("key")))
    owned = stored.select("profile", F.explode("keys").alias("key")).distinct()
    open_rows, done = keyed, []
    while True:
        taken = open_rows.join(owned, ["profile", "key"], "left_semi").select("profile", "paper_id").distinct()
        left = open_rows.join(taken, ["profile", "paper_id"], "left_anti")
        least = left.where("key is not null").groupBy("profile", "key").agg(F.min("rank").alias("least"))
        late = left.join(least, ["profile", "key"]).where("rank > least").select("profile", "paper_id").distinct()
        first = left.join(late, ["profile", "paper_id"], "left_anti")
        kept = cut(first.select("profile", "paper_id", "key"))
        dropped = cut(taken)
        done.append(kept.select("profile", "paper_id", F.lit(True).alias("kept")).distinct().unionByName(dropped.withColumn("kept", F.lit(False))))
        owned = cut(owned.unionByName(kept.where("key is not null").select("profile", "key")).distinct())
        decided = done[-1].select("profile", "paper_id")
        open_rows = cut(open_rows.join(decided, ["profile", "paper_id"], "left_anti"))
        if open_rows.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return batch.join(out, ["profile", "paper_id"])


def persisted(ranked: DataFrame, stored: DataFrame, counted: int) -> DataFrame:
    """ranked (profile, paper_id, rank, score, title_key, keys), stored (profile, paper_id, keys) -> profile, paper_id,
    outcome: of a batch's equal titles the first goes on; known ids come again; a paper that is stored under another id is
    a resurfacing; a score that is no number is left out; counts tells rows among the first `counted`."""
    one = F.row_number().over(Window.partitionBy("profile", F.coalesce(F.nullif("title_key", F.lit("")), F.concat(F.lit("#"), "paper_id"))).orderBy("rank"))
    rows = ranked.withColumn("n", one)
    known = stored.select("profile", "paper_id").distinct().withColumn("known", F.lit(True))
    go = rows.where("n = 1").join(known, ["profile", "paper_id"], "left")
    new = first_owners(go.where("known is null").select("profile", "paper_id", "rank", "keys"), stored).select("profile", "paper_id", "kept")
    out = rows.join(known, ["profile", "paper_id"], "left").join(new, ["profile", "paper_id"], "left")
    no_number = F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))
    outcome = F.when(F.col("n") > 1, "same title").when(F.col("kept") == F.lit(False), "resurfaced").when(no_number, "no score").when(F.col("known"), "again").otherwise("new")
    return out.select("profile", "paper_id", outcome.alias("outcome"), (F.col("rank") <= counted).alias("counts"))


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of two texts that lies in matching blocks."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def plain_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def best_titles(hits: DataFrame, least: float = SAME_TITLE) -> DataFrame:
    """hits (record, title, year, author; work, w_title, w_year, w_author, place in the answer) -> record, work, ratio: the
    hit whose title really is the record's, by the same author and within a year where both are known."""
    h = hits.withColumn("a", plain_title(F.col("title"))).withColumn("b", plain_title(F.col("w_title")))
    h = h.where((F.col("a") != "") & (F.col("b") != "")).withColumn("ratio", title_ratio("a", "b"))
    best = h.groupBy("record").agg(F.max_by(F.struct("work", "ratio", "year", "w_year", "author", "w_author"), F.struct("ratio", -F.col("place"))).alias("h")).select("record", "h.*")
    close = F.col("year").isNull() | F.col("w_year").isNull() | (F.abs(F.col("year") - F.col("w_year")) <= 1)
    same = F.col("author").isNull() | (F.col("author") == F.col("w_author"))
    return best.where((F.col("ratio") >= least) & close & same).select("record", "work", "ratio")


def looked_up(wanted: DataFrame, works: DataFrame, merged_ids: DataFrame) -> DataFrame:
    """wanted (id) with found, the work it leads to: itself, or where it was merged into (old_id, new_id); else null."""
    a = wanted.join(merged_ids, F.col("id") == F.col("old_id"), "left").select("id", F.coalesce("new_id", "id").alias("to"))
    return a.join(works.select(F.col("work").alias("found")), F.col("to") == F.col("found"), "left").select("id", "found", (F.col("to") != F.col("id")).alias("redirected"))


def ladder(records: DataFrame, rungs: list[tuple[str, DataFrame]]) -> DataFrame:
    """records (record and a column for each rung) with resolved and rung: the first of the rungs, tables (rung's column,
    work), that knows the record; `synthetic` where none does. A key of several works leads to the least."""
    out, found = records, []
    for name, works in rungs:
        one = works.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("work").alias(f"by_{name}"))
        out = out.join(one, name, "left")
        found.append(F.when(F.col(f"by_{name}").isNotNull(), name))
    by = [F.col(f"by_{n}") for n, _ in rungs]
    return out.select("record", F.coalesce(*by).alias("resolved"), F.coalesce(*found, F.lit("synthetic")).alias("rung"))
